"""Files on disk: parts of unlike headers, unreadable numbers, frames and clips found by path."""

import io
import wave

import numpy as np
import pytest

from fieldtrace.plans.prepare import aligned_with_trajectory
from fieldtrace.sources import readers


def clip(samples, width=2, channels=1, rate=8):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(width)
        out.setframerate(rate)
        out.writeframes(np.asarray(samples, dtype="<i2" if width == 2 else "u1").tobytes())
    return buffer.getvalue()


@pytest.fixture()
def parts(tmp_path):
    (tmp_path / "part_2024-10-18.csv").write_text("\ufeff时间,方向,标记,经度,纬度,速度,深度\n2024-10-18 08:00:00,51,3,120.5,35.5,1.5,0.4\nbad,1,2,3,4,5,6\n")
    (tmp_path / "part_2024-10-19.csv").write_text("纬度,经度,速度,时间,标记,did,方向\n35.25,120.25,x,2024-10-19 08:00:01,y,9,\"77\"\n")
    return str(tmp_path)


def test_parts_are_matched_by_name(spark, parts):
    rows = {r["date"]: r for r in readers.read_parts(spark, f"{parts}/*.csv").collect()}
    a, b = rows["2024-10-18"], rows["2024-10-19"]
    assert (a["heading"], a["label"], a["lon"], a["lat"], a["speed"], a["depth"], a["did"]) == (51, 3, 120.5, 35.5, 1.5, 0.4, None)
    assert (b["heading"], b["label"], b["lon"], b["lat"], b["speed"], b["depth"], b["did"]) == (77, -1, 120.25, 35.25, None, None, 9)


def test_a_part_without_a_time_column_is_named(spark, parts, tmp_path):
    (tmp_path / "part_2024-10-20.csv").write_text("a,标记\n1,2\n")
    with pytest.raises(ValueError, match="fix_time.*part_2024-10-20.csv"):
        readers.read_parts(spark, f"{tmp_path}/*.csv")


def test_files_without_a_date_are_ignored_whatever_they_hold(spark, parts, tmp_path):
    (tmp_path / "notes.csv").write_text("a,b\n1,2\n")
    (tmp_path / "part_2024-10-21.csv").write_text("")
    assert readers.read_parts(spark, f"{tmp_path}/*.csv").count() == 2


def test_no_header_at_all_is_an_error(spark, tmp_path):
    (tmp_path / "part_2024-10-18.csv").write_text("")
    with pytest.raises(ValueError, match="header"):
        readers.read_parts(spark, f"{tmp_path}/*.csv")


ALIGNED = {"frame_path": "f.jpg", "frame_time": "2024-10-18 08:00:00", "video_file": "v.mp4", "second_in_video": "4", "分类": "3", "经度": "120.5", "纬度": "35.5", "速度": "1.5", "深度": "0.2", "方向角": "90"}


def aligned_file(path, columns):
    """Quoted and plain, with a byte order mark and Windows line ends."""
    path.write_bytes(("\ufeff" + ",".join(columns) + "\r\n" + ",".join(f'"{v}"' if i % 2 else v for i, v in enumerate(columns.values())) + "\r\n\r\n").encode())


@pytest.mark.parametrize("broadcast", [0, 10])
def test_aligned_files_of_unlike_column_order(spark, tmp_path, monkeypatch, broadcast):
    from fieldtrace.sources import named_csv

    monkeypatch.setattr(named_csv, "BROADCAST_FILES", broadcast)
    aligned_file(tmp_path / "a.csv", ALIGNED)
    aligned_file(tmp_path / "b.csv", dict(reversed((ALIGNED | {"note": "x, y", "时间戳": "17"}).items())) | {"note": "z"})
    rows = sorted(readers.read_aligned(spark, f"{tmp_path}/*.csv").collect(), key=lambda r: r["note"] or "")
    for r in rows:
        assert (r["lon"], r["lat"], r["speed"], r["depth"], r["heading"], r["label"], r["second"]) == (120.5, 35.5, 1.5, 0.2, 90.0, 3, 4)
    assert [(r["note"], r["epoch_second"]) for r in rows] == [(None, -1), ("z", 17)]
    assert readers.read_aligned(spark, f"{tmp_path}/a.csv").columns == ["frame_path", "frame_time", "entity_id", "second", "label", "lon", "lat", "speed", "depth", "heading"]


def test_an_aligned_file_without_a_position_is_named(spark, tmp_path):
    aligned_file(tmp_path / "a.csv", ALIGNED)
    aligned_file(tmp_path / "b.csv", {k: v for k, v in ALIGNED.items() if k != "经度"})
    with pytest.raises(ValueError, match="lon.*b.csv"):
        readers.read_aligned(spark, f"{tmp_path}/*.csv")


def test_model_metrics_of_unlike_column_order(spark, tmp_path):
    for model, text in (("m1", "class_id,precision,recall,f1,support\n3,0.5,0.25,0.33,4\n"), ("m2", "support,f1,recall,precision,class_id,more\n4,0.33,0.25,0.5,3,x\n")):
        (tmp_path / model).mkdir()
        (tmp_path / model / "per_class_metrics.csv").write_text("\ufeff" + text)
    rows = readers.read_model_metrics(spark, f"{tmp_path}/*/*.csv").orderBy("model").collect()
    assert [tuple(r) for r in rows] == [(m, 3, 0.5, 0.25, 0.33, 4) for m in ("m1", "m2")]
    (tmp_path / "m3").mkdir()
    (tmp_path / "m3" / "per_class_metrics.csv").write_text("class_id,precision\n1,0.5\n")
    with pytest.raises(ValueError, match="support.*m3"):
        readers.read_model_metrics(spark, f"{tmp_path}/*/*.csv")


def test_lines_are_read_twice_and_never_by_kind_of_header(spark, parts):
    # One scan finds the headers and is written; the rows come from one scan of the lines joined to it.
    plan = readers.read_parts(spark, f"{parts}/*.csv")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Union" not in plan


def test_unreadable_epoch_seconds_match_nothing(spark, parts, tmp_path):
    folder = tmp_path / "aligned"
    folder.mkdir()
    head = "frame_path,frame_time,video_file,second_in_video,分类,经度,纬度,速度,深度,方向角,时间戳,frame_number,did"
    line = "f{i}.jpg,2024-10-18 08:00:00,v.mp4,{i},3,1,2,3,4,5,{e},{n},{d}"
    second = 1729238400
    rows = [line.format(i=0, e=second, n=7, d=1.5), line.format(i=1, e="n/a", n="x", d=""), line.format(i=2, e=second + 1, n=8, d=2)]
    (folder / "a.csv").write_text("\n".join([head, *rows]) + "\n")
    aligned = readers.read_aligned(spark, str(folder))
    assert [r["epoch_second"] for r in aligned.orderBy("second").collect()] == [second, -1, second + 1]
    assert dict(aligned.dtypes)["frame_number"] == "bigint" and dict(aligned.dtypes)["did"] == "double"
    dated = aligned.selectExpr("*", "'2024-10-18' AS date")
    out = aligned_with_trajectory(dated, readers.read_parts(spark, f"{parts}/*.csv")).collect()
    assert [(r["second"], r["lon"]) for r in out] == [(0, 120.5)]


def test_frames_are_found_by_path(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "000001.jpg").write_bytes(b"x")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path")
    rows = spark.createDataFrame([("v1/000001.jpg",), ("v2/000001.jpg",)], "frame_path string")
    out = {r["frame_path"]: r["is_missing"] for r in readers.frame_refs(rows, files, root=str(tmp_path)).collect()}
    assert out == {"v1/000001.jpg": False, "v2/000001.jpg": True}


def test_waveforms_from_disk(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "000000.wav").write_bytes(clip([16384, -16384]))
    (tmp_path / "a" / "000001.wav").write_bytes(b"not a clip, and nobody asks for it")
    rows = spark.createDataFrame([(1, "a/000000.wav"), (2, "a/000009.wav"), (3, None)], "i int, audio_path string")
    out = {r["i"]: r["waveform"] for r in readers.read_waveforms(rows, str(tmp_path), sample_rate=8).collect()}
    assert out == {1: [0.5, -0.5, 0, 0, 0, 0, 0, 0], 2: None, 3: None}


def test_other_sample_widths_are_an_error():
    with pytest.raises(ValueError, match="1 bytes"):
        readers.decode_pcm16(clip([128, 128], width=1))


def test_media_are_listed_by_tasks_and_read_on_demand(spark, tmp_path):
    from fieldtrace.sources.media import MediaReader, media_files, with_contents

    for name, data in (("top.wav", b"t"), ("a/x.wav", b"xx"), ("a/b/y.WAV", b"yy"), ("a/b/y.wav", b"yyy"), ("c/z.jpg", b""), ("c d/ü.wav", b"u")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "empty").mkdir()
    root = str(tmp_path)
    reader = MediaReader(root, [".wav"], False)
    assert [(p.path.removeprefix(root), p.deep) for p in reader.partitions()] == [("", False), ("/a", True), ("/c", True), ("/c d", True), ("/empty", True)]
    listed = {r["path"].removeprefix(root + "/"): r["length"] for r in media_files(spark, root, [".wav"]).collect()}
    assert listed == {"top.wav": 1, "a/x.wav": 2, "a/b/y.wav": 3, "c d/ü.wav": 1}
    assert media_files(spark, root).count() == 6
    for uri in (root, f"file:{root}", f"file://{root}/"):
        found = media_files(spark, uri, [".wav"], content=True).collect()
        assert {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in found} == {"top.wav": b"t", "x.wav": b"xx", "y.wav": b"yyy", "ü.wav": b"u"}
    # Only the files that are left are opened.
    (tmp_path / "a" / "x.wav").unlink()
    left = spark.createDataFrame([(f"{root}/top.wav",)], "path string")
    assert [bytes(r["content"]) for r in with_contents(left).collect()] == [b"t"]
    assert media_files(spark, f"{root}/nowhere").count() == 0
    batches = list(reader.read(reader.partitions()[1]))
    assert [b.schema.names for b in batches] == [["path", "length"]]
