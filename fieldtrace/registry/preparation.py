"""Coercion, scalar functions, alignment, splits by date, cleaning and assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.functions import coerce, scalar
from fieldtrace.operators import align, assets, clean
from fieldtrace.operators.ordered import Order
from fieldtrace.operators.segments import with_class_name
from fieldtrace.registry.book import BOOK, joined, q6, r6
from fieldtrace.registry.views import (
    ALIGN, DATED, OBSERVATIONS, SPLIT_DATES, SPLITTED, TRACK, aligned, dated, observations, points, sql_list, table, track,
)
from fieldtrace.sources.readers import read_by_date
from fieldtrace.sources.writers import settled, work_folder, write_by_date
from fieldtrace.schema import ANCHOR_COLUMNS, CLASS_NAMES, CLEAN_INPUT_COLUMNS, TRAJECTORY_COLUMNS, require_columns

FIRST_BY = ["tie"]
RULE_ORDER = Order(entity="entity_id", second="second", time="frame_time", tie="frame_path")


def splitted(spark, sf):
    return align.assign_split(dated(spark, sf), SPLIT_DATES)


# Coercions.


def texts(spark, sf):
    """Event columns as text, every third one unreadable."""
    bad = F.col("event_id") % 3 == 0
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        F.when(bad, F.col("event_type")).otherwise(F.col("value").cast("string")).alias("number"),
        F.when(bad, F.col("event_type")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("moment"),
        F.when(bad, F.col("event_type")).otherwise((F.col("event_id") % 11).cast("string")).alias("label"),
    )


TEXTS = """texts AS (SELECT event_id,
  CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS number,
  CASE WHEN event_id % 3 = 0 THEN event_type ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment,
  CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id % 11 AS VARCHAR) END AS label FROM events)"""


@BOOK.query("require_columns", f"WITH {OBSERVATIONS} SELECT tie, second FROM observations")
def require(spark, sf):
    return require_columns(observations(spark, sf), CLEAN_INPUT_COLUMNS).select("tie", "second")


@BOOK.query(
    "coerce_numeric",
    f"""WITH {TEXTS} SELECT event_id, TRY_CAST(number AS DOUBLE) AS kept,
    coalesce(TRY_CAST(number AS DOUBLE), 0.0::DOUBLE) AS filled FROM texts""",
)
def coerce_numeric(spark, sf):
    return texts(spark, sf).select(
        "event_id", coerce.to_number("number").alias("kept"), coerce.to_number("number", 0.0).alias("filled")
    )


@BOOK.query("coerce_time", f"WITH {TEXTS} SELECT event_id, TRY_CAST(moment AS TIMESTAMP) AS moment FROM texts")
def coerce_time(spark, sf):
    return coerce.coerce_times(texts(spark, sf).select("event_id", "moment"), ["moment"])


@BOOK.query("coerce_label", f"WITH {TEXTS} SELECT event_id, coalesce(TRY_CAST(label AS INTEGER), -1) AS label FROM texts")
def coerce_label(spark, sf):
    return texts(spark, sf).select("event_id", coerce.to_label("label").alias("label"))


@BOOK.query(
    "rename_align",
    """SELECT o_orderkey AS did, o_orderdate AS fix_time, o_totalprice AS speed, CAST(NULL AS DOUBLE) AS heading,
    CAST(NULL AS INTEGER) AS label FROM orders""",
)
def rename_align(spark, sf):
    renames = {"o_orderkey": "did", "o_orderdate": "fix_time", "o_totalprice": "speed"}
    wanted = {"did": "bigint", "fix_time": "timestamp_ntz", "speed": "double", "heading": "double", "label": "int"}
    return coerce.align_columns(table(spark, sf, "orders"), renames, wanted)


@BOOK.query("drop_missing", f"WITH {OBSERVATIONS} SELECT tie FROM observations WHERE frame_time IS NOT NULL AND speed IS NOT NULL")
def drop_missing(spark, sf):
    return observations(spark, sf).dropna(subset=["frame_time", "speed"]).select("tie")


@BOOK.query("filter_label_range", f"WITH {OBSERVATIONS} SELECT tie, label FROM observations WHERE label BETWEEN 0 AND 10")
def filter_label_range(spark, sf):
    return observations(spark, sf).where(clean.in_range("label", 0, 10)).select("tie", "label")


@BOOK.query("filter_flag", f"WITH {OBSERVATIONS} SELECT tie FROM observations WHERE coalesce(audio_exists, false)")
def filter_flag(spark, sf):
    return observations(spark, sf).where(coerce.flag("audio_exists")).select("tie")


@BOOK.query(
    "normalise_heading",
    f"""WITH {OBSERVATIONS} SELECT tie, CASE WHEN heading = 360 THEN 0.0::DOUBLE ELSE heading END AS heading FROM observations""",
)
def normalise_heading(spark, sf):
    return observations(spark, sf).select("tie", clean.normalised_heading().alias("heading"))


@BOOK.query("filter_heading_range", f"WITH {OBSERVATIONS} SELECT tie, heading FROM observations WHERE heading BETWEEN 0 AND 359.999999")
def filter_heading_range(spark, sf):
    return observations(spark, sf).where(clean.in_range("heading", 0, clean.HEADING_HIGH)).select("tie", "heading")


@BOOK.query("derive_date", f"WITH {TRACK} SELECT tie, strftime(fix_time, '%Y-%m-%d') AS date FROM track")
def derive_date(spark, sf):
    return track(spark, sf).select("tie", coerce.day("fix_time").alias("date"))


@BOOK.query("format_time", f"WITH {TRACK} SELECT tie, strftime(fix_time, '%Y-%m-%d %H:%M:%S') AS time_text FROM track")
def format_time(spark, sf):
    return track(spark, sf).select("tie", coerce.time_text("fix_time").alias("time_text"))


@BOOK.query("epoch_seconds", f"WITH {TRACK} SELECT tie, CAST(floor(epoch_us(fix_time) / 1e6) AS BIGINT) AS epoch_second FROM track")
def epoch_seconds(spark, sf):
    return track(spark, sf).select("tie", coerce.epoch_second("fix_time").alias("epoch_second"))


NAMES = "CASE label " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(CLASS_NAMES)) + " ELSE CAST(label AS VARCHAR) END"


@BOOK.query("class_name", f"WITH {OBSERVATIONS} SELECT tie, {NAMES} AS class_name FROM observations")
def class_name(spark, sf):
    return with_class_name(observations(spark, sf), "label").select("tie", "class_name")


def by_date(spark, sf):
    """The track as a dataset with a folder for each date."""
    path = work_folder(spark)
    write_by_date(dated(spark, sf).select("date", "frame_time", "entity_id", "second", "tie"), path, ["frame_time", "entity_id", "second", "tie"])
    return read_by_date(spark, path)


@BOOK.query("filter_dates", f"WITH {DATED} SELECT tie, date FROM dated WHERE date IN ('2024-01-03', '2024-01-17')")
def filter_dates(spark, sf):
    rows = align.on_dates(by_date(spark, sf), " 2024-01-03, ,2024-01-17 ")
    return rows.select("tie", coerce.day("date").alias("date"))


@BOOK.query(
    "filter_dates_joined",
    f"""WITH {DATED} SELECT tie, date FROM dated
    WHERE date IN (SELECT strftime(o_orderdate + INTERVAL (2024 - year(o_orderdate)) YEAR, '%Y-%m-%d') FROM orders WHERE o_totalprice > 495000)""",
)
def filter_dates_joined(spark, sf):
    """Dates on which, in some year, there was a large order."""
    large = table(spark, sf, "orders").where("o_totalprice > 495000")
    day = F.expr("o_orderdate + make_ym_interval(2024 - year(o_orderdate), 0)")
    rows = align.on_wanted_dates(by_date(spark, sf), large.select(F.to_date(day).alias("date")))
    return rows.select("tie", coerce.day("date").alias("date"))


@BOOK.query(
    "filter_entities",
    f"""WITH {TRACK}, firsts AS (SELECT entity_id, min(frame_time) AS t FROM track GROUP BY 1 ORDER BY t, entity_id LIMIT 5)
    SELECT entity_id, tie FROM track WHERE entity_id IN (SELECT entity_id FROM firsts)""",
)
def filter_entities(spark, sf):
    return align.first_entities(track(spark, sf), 5, ["frame_time"]).select("entity_id", "tie")


@BOOK.query(
    "final_casts",
    f"""WITH {OBSERVATIONS} SELECT tie, CAST(trunc(frame_number / 2) AS INTEGER) AS frame_number, CAST(label AS INTEGER) AS label,
    coalesce(audio_exists, false) AS audio_exists, strftime(frame_time, '%Y-%m-%d %H:%M:%S') AS frame_time,
    strftime(frame_time, '%Y-%m-%d') AS date FROM observations""",
)
def final_casts(spark, sf):
    rows = observations(spark, sf).withColumn("frame_number", F.col("frame_number") / 2)
    return clean.final_casts(rows).select("tie", "frame_number", "label", "audio_exists", "frame_time", "date")


@BOOK.query("lookup_in_set", f"WITH {TRACK} SELECT tie, label FROM track WHERE label IN (3, 7, 9)")
def lookup_in_set(spark, sf):
    wanted = [int(x) for x in scalar.listed("3, 7,9,")]
    return track(spark, sf).where(F.col("label").isin(wanted)).select("tie", "label")


# Scalar functions.


@BOOK.query(
    "scalar_math",
    f"""WITH {TRACK} SELECT tie, greatest(1.0::DOUBLE, least(speed, 20.0::DOUBLE)) AS clipped, round_even(speed, 0) AS half_even,
    {q6('ceil(sqrt(abs(lon - 120.5) + speed)) + ln(1 + speed) + exp(-speed) + pow(speed, 0.5)', 'mixed')} FROM track""",
)
def scalar_math(spark, sf):
    s = F.col("speed")
    mixed = F.ceil(F.sqrt(F.abs(F.col("lon") - 120.5) + s)) + F.log(1 + s) + F.exp(-s) + F.pow(s, F.lit(0.5))
    return track(spark, sf).select(
        "tie", scalar.clip(s, 1.0, 20.0).alias("clipped"), F.bround(s).alias("half_even"), r6(mixed).alias("mixed")
    )


@BOOK.query(
    "linspace",
    f"""WITH {TRACK} SELECT tie, CAST(range AS INTEGER) AS i, {q6('-speed + range * ((speed + speed) / 4)', 'x')} FROM track, range(5)""",
)
def linspace(spark, sf):
    values = scalar.linspace(-F.col("speed"), F.col("speed"), 5)
    return track(spark, sf).select("tie", F.posexplode(values).alias("i", "x")).withColumn("x", r6("x"))


@BOOK.query(
    "path_functions",
    r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem,
    CASE WHEN starts_with(url, 'http:/') THEN substr(url, 7) ELSE url END AS relative,
    printf('%06d.wav', page_id) AS clip FROM pages""",
)
def path_functions(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        scalar.basename(url).alias("base"),
        scalar.stem(url).alias("stem"),
        scalar.relative_to(url, "http:").alias("relative"),
        scalar.clip_name(F.col("page_id")).alias("clip"),
    )


@BOOK.query(
    "comma_list",
    """SELECT doc_id, list_aggregate(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), 'string_agg', '|') AS items
    FROM documents""",
)
def comma_list(spark, sf):
    items = F.nullif(F.array_join(scalar.split_list(F.col("text")), "|"), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", items.alias("items"))


@BOOK.query(
    "array_pad",
    """SELECT vec_id, embedding[10 + vec_id % 50 + 1]::DOUBLE AS picked, embedding[least(vec_id % 100, 63) + 1]::DOUBLE AS clipped,
    CAST(greatest(64, vec_id % 128) AS INTEGER) AS padded FROM embeddings""",
)
def array_pad(spark, sf):
    e, i = F.col("embedding"), F.col("vec_id")
    short = F.when(i % 128 > 64, scalar.pad_left(e, 128)).otherwise(e)
    padded = F.when(i % 128 > 64, F.size(F.slice(short, F.lit(129) - (i % 128).cast("int"), (i % 128).cast("int"))))
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.get(e, (10 + i % 50).cast("int")).cast("double").alias("picked"),
        scalar.item_clipped(e, (i % 100).cast("int")).cast("double").alias("clipped"),
        F.coalesce(padded, F.size(e)).alias("padded"),
    )


@BOOK.query(
    "waveform_math",
    f"""SELECT vec_id, CAST(i AS INTEGER) AS i, {q6('''CASE WHEN i < 32 THEN (embedding[i + 1]::DOUBLE + embedding[i + 33]::DOUBLE) / 2 ELSE 0 END''', 'x')}
    FROM embeddings, (SELECT range AS i FROM range(40))""",
)
def waveform_math(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    stereo = F.array(F.slice(e, 1, 32), F.slice(e, 33, 32))
    fitted = scalar.fit_length(scalar.mono(stereo), 40, F.lit(0.0))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(fitted).alias("i", "x")).withColumn("x", r6("x"))


@BOOK.query(
    "softmax_argmax",
    f"""WITH flat AS (SELECT vec_id, r.range AS i, embedding[r.range + 1]::DOUBLE AS x FROM embeddings, range(11) r),
    top AS (SELECT vec_id, max(x) AS m, sum(exp(x)) AS z, CAST(min(i) FILTER (x = mx) AS INTEGER) AS best
      FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS mx FROM flat) GROUP BY vec_id)
    SELECT vec_id, CAST(i AS INTEGER) AS i, {q6('exp(x) / z', 'p')}, {q6('x - ln(z)', 'lp')}, best FROM flat JOIN top USING (vec_id)""",
)
def softmax_argmax(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 11), lambda x: x.cast("double")).alias("l"))
    rows = rows.select("vec_id", scalar.argmax(F.col("l")).alias("best"), scalar.softmax(F.col("l")).alias("p"), scalar.log_softmax(F.col("l")).alias("lp"))
    rows = rows.select("vec_id", "best", F.posexplode(F.arrays_zip("p", "lp")).alias("i", "z"))
    return rows.select("vec_id", "i", "best", r6(F.col("z.p")).alias("p"), r6(F.col("z.lp")).alias("lp"))


@BOOK.query("json_columns", "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, '{\"k\":' || (props->>'$.k') || '}' AS again FROM events")
def json_columns(spark, sf):
    parsed = F.from_json("props", "k int")
    rows = table(spark, sf, "events").select("event_id", parsed.alias("p"))
    return rows.select("event_id", "p.k", F.to_json("p").alias("again"))


@BOOK.query(
    "missing_tests",
    f"""WITH {OBSERVATIONS} SELECT entity_id, bool_or(frame_time IS NULL) AS any_missing, bool_and(coalesce(audio_exists, false)) AS all_audio
    FROM observations GROUP BY 1""",
)
def missing_tests(spark, sf):
    return observations(spark, sf).groupBy("entity_id").agg(
        F.bool_or(F.col("frame_time").isNull()).alias("any_missing"), F.bool_and(coerce.flag("audio_exists")).alias("all_audio")
    )


# Alignment.

ON = ["epoch_second"]
ALIGNED_KEYS = ["entity_id", "frame_number", "line", "epoch_second"]


@BOOK.query("dedupe_keep_first", f"WITH {ALIGN} SELECT epoch_second, point_id FROM first_points")
def dedupe_keep_first(spark, sf):
    return align.keep_first(points(spark, sf), ON, ["fix_time", "point_id"]).select("epoch_second", "point_id")


@BOOK.query(
    "dedupe_with_copies",
    f"""WITH {ALIGN} SELECT epoch_second, min(point_id) AS point_id, count(*) AS copies FROM points GROUP BY 1""",
)
def dedupe_with_copies(spark, sf):
    return align.keep_first(points(spark, sf), ON, ["fix_time", "point_id"], "copies").select("epoch_second", "point_id", "copies")


@BOOK.query(
    "semi_join_on_second",
    f"WITH {ALIGN} SELECT {', '.join(ALIGNED_KEYS)} FROM aligned WHERE epoch_second IN (SELECT epoch_second FROM points)",
)
def semi_join_on_second(spark, sf):
    return align.semi_join_on_second(aligned(spark, sf), points(spark, sf), ON).select(*ALIGNED_KEYS)


OVER = [c for c in TRAJECTORY_COLUMNS if c not in ON]


@BOOK.query(
    "overlay_join",
    f"""WITH {ALIGN} SELECT {', '.join('a.' + c for c in ALIGNED_KEYS)}, a.date, {', '.join('p.' + c for c in OVER)}
    FROM aligned a JOIN first_points p USING (epoch_second)""",
)
def overlay_join(spark, sf):
    firsts = align.keep_first(points(spark, sf), ON, ["fix_time", "point_id"])
    return align.overlay(aligned(spark, sf), firsts, ON, TRAJECTORY_COLUMNS)


FILTERED = f"""{ALIGN}, filtered AS (SELECT a.entity_id, a.frame_number, a.line, a.epoch_second, a.date,
  coalesce(TRY_CAST(p.label AS INTEGER), -1) AS label, {', '.join('p.' + c for c in OVER if c != 'label')}
  FROM aligned a JOIN first_points p USING (epoch_second))"""


def filtered_frame(spark, sf):
    return align.filter_and_overlay(aligned(spark, sf), points(spark, sf), ON, ["fix_time", "point_id"])


@BOOK.query("filter_and_overlay", f"WITH {FILTERED} SELECT * FROM filtered")
def filter_and_overlay(spark, sf):
    return filtered_frame(spark, sf)


@BOOK.query(
    "date_summary",
    f"""WITH {FILTERED}, kinds AS (
      SELECT strftime(fix_time, '%Y-%m-%d') AS date, 1 AS t, 0 AS a, 0 AS f FROM points
      UNION ALL SELECT date, 0, 1, 0 FROM aligned UNION ALL SELECT date, 0, 0, 1 FROM filtered)
    SELECT date, CAST(sum(t) AS BIGINT) AS trajectory_rows, CAST(sum(a) AS BIGINT) AS aligned_source_rows,
      CAST(sum(f) AS BIGINT) AS filtered_rows,
      (SELECT coalesce(string_agg(DISTINCT 'part' || hour(fix_time) % 3, ',' ORDER BY 'part' || hour(fix_time) % 3), '') FROM points p WHERE strftime(p.fix_time, '%Y-%m-%d') = kinds.date) AS part_files,
      (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM filtered f WHERE f.date = kinds.date GROUP BY label)) AS class_counts,
      (SELECT min(fix_time) FROM filtered f WHERE f.date = kinds.date) AS time_start, (SELECT max(fix_time) FROM filtered f WHERE f.date = kinds.date) AS time_end
      FROM kinds GROUP BY date""",
)
def date_summary(spark, sf):
    part = F.concat(F.lit("part"), (F.hour("fix_time") % 3).cast("string"))
    traj = points(spark, sf).withColumn("date", coerce.day("fix_time")).withColumn("part_file", part)
    out = align.date_summary(aligned(spark, sf), traj, filtered_frame(spark, sf), part="part_file", time="fix_time")
    cells = F.transform(F.map_entries("class_counts"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return out.withColumns({"part_files": joined("part_files"), "class_counts": F.array_join(cells, ",")})


@BOOK.query("assign_split", f"WITH {SPLITTED} SELECT tie, split FROM splitted")
def assign_split(spark, sf):
    return splitted(spark, sf).select("tie", "split")


@BOOK.query("unassigned_dates", f"WITH {DATED} SELECT DISTINCT date FROM dated WHERE date > '2024-01-25'")
def unassigned_dates(spark, sf):
    known = {k: v for k, v in SPLIT_DATES.items() if k != "test"}
    return align.unassigned_dates(dated(spark, sf), known)


@BOOK.query(
    "split_summary",
    f"""WITH {SPLITTED} SELECT coalesce(split, 'all') AS split, count(*) AS rows, count(DISTINCT entity_id) AS videos,
    array_to_string(list_sort(list(DISTINCT date)), ',') AS dates, min(fix_time) AS time_start, max(fix_time) AS time_end
    FROM splitted GROUP BY GROUPING SETS ((split), ())""",
)
def split_summary(spark, sf):
    return align.split_summary(splitted(spark, sf), time="fix_time").withColumn("dates", joined("dates"))


@BOOK.query(
    "class_counts",
    f"""WITH {SPLITTED} SELECT coalesce(split, 'all') AS split, label, count(*) AS rows
    FROM splitted GROUP BY GROUPING SETS ((split, label), (label))""",
)
def class_counts(spark, sf):
    return align.split_class_counts(splitted(spark, sf))


@BOOK.query("distinct_values", f"WITH {DATED} SELECT DISTINCT entity_id, date FROM dated")
def distinct_values(spark, sf):
    return dated(spark, sf).select("entity_id", "date").distinct()


@BOOK.query("write_all", f"WITH {SPLITTED} SELECT split, tie, fix_time FROM splitted")
def write_all(spark, sf):
    rows = splitted(spark, sf)
    parts = {name: rows.where(F.col("split") == name).drop("split") for name in SPLIT_DATES}
    return align.union_splits(parts).select("split", "tie", "fix_time")


@BOOK.query("order_aligned", f"WITH {SPLITTED} SELECT split, entity_id, tie, second FROM splitted")
def order_aligned(spark, sf):
    order = ["frame_time", "entity_id", "second", "frame_path"]
    return align.ordered_output(splitted(spark, sf), order).select("split", "entity_id", "tie", "second")


@BOOK.query("order_entity", f"WITH {TRACK} SELECT entity_id, second, frame_time, tie FROM track")
def order_entity(spark, sf):
    order = ["entity_id", "second", "frame_time", "tie"]
    return align.ordered_output(track(spark, sf), order).select(*order)


@BOOK.query(
    "date_from_name",
    """SELECT doc_id, regexp_extract('part_' || CASE WHEN doc_id % 4 = 0 THEN source ELSE '2024-10-' || (10 + doc_id % 20) END || '.csv',
      '(\\d{4}-\\d{2}-\\d{2})', 1) AS date FROM documents WHERE doc_id % 4 <> 0""",
)
def date_from_name(spark, sf):
    i = F.col("doc_id")
    dated_name = F.concat(F.lit("2024-10-"), (10 + i % 20).cast("string"))
    name = F.concat(F.lit("part_"), F.when(i % 4 == 0, F.col("source")).otherwise(dated_name), F.lit(".csv"))
    rows = table(spark, sf, "documents").select("doc_id", scalar.date_in_name(name).alias("date"))
    return rows.where(F.col("date").isNotNull())


LOCATIONS = ["train", "val", "test"]


@BOOK.query(
    "resolve_source",
    f"""WITH {DATED}, inventory AS (SELECT date, CASE label % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'old' END AS location,
      date || '/' || tie AS path FROM dated WHERE tie % 7 = 0),
    best AS (SELECT * FROM inventory WHERE location <> 'old' QUALIFY row_number() OVER (PARTITION BY date
      ORDER BY CASE location WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, path) = 1)
    SELECT d.date, location, path FROM (SELECT DISTINCT date FROM dated) d LEFT JOIN best USING (date)""",
)
def resolve_source(spark, sf):
    rows = dated(spark, sf)
    code = F.col("label") % 4
    location = F.when(code == 0, "train").when(code == 1, "val").when(code == 2, "test").otherwise("old")
    path = F.concat_ws("/", "date", F.col("tie").cast("string"))
    inventory = rows.where(F.col("tie") % 7 == 0).select("date", location.alias("location"), path.alias("path"))
    return align.resolve_sources(rows.select("date").distinct(), inventory, LOCATIONS)


# Set operations over requested and present seconds.

SECONDS = f"""{TRACK}, wanted AS (SELECT DISTINCT entity_id, second FROM track),
made AS (SELECT DISTINCT entity_id, second FROM track WHERE label % 3 <> 0)"""


def seconds(spark, sf):
    rows = track(spark, sf)
    return rows.select("entity_id", "second"), rows.where(F.col("label") % 3 != 0).select("entity_id", "second")


@BOOK.query("requested_minus_written", f"WITH {SECONDS} SELECT * FROM wanted EXCEPT SELECT * FROM made")
def requested_minus_written(spark, sf):
    wanted, made = seconds(spark, sf)
    return wanted.subtract(made)


@BOOK.query("wanted_intersect_produced", f"WITH {SECONDS} SELECT * FROM wanted INTERSECT SELECT * FROM made")
def wanted_intersect_produced(spark, sf):
    wanted, made = seconds(spark, sf)
    return wanted.intersect(made)


@BOOK.query("union_parts", f"WITH {ALIGN} SELECT fix_time, speed, label FROM points UNION ALL SELECT NULL, speed, label FROM aligned")
def union_parts(spark, sf):
    left = points(spark, sf).select("fix_time", "speed", "label")
    return left.unionByName(aligned(spark, sf).select("speed", "label"), allowMissingColumns=True)


@BOOK.query(
    "first_n_examples",
    f"""WITH {SECONDS}, gone AS (SELECT * FROM wanted EXCEPT SELECT * FROM made),
    few AS (SELECT * FROM gone QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY second) <= 10)
    SELECT entity_id, string_agg(second, ',' ORDER BY second) AS seconds FROM few GROUP BY 1""",
)
def first_n_examples(spark, sf):
    wanted, made = seconds(spark, sf)
    out = align.examples(wanted.subtract(made), ["entity_id"], "second", 10, "seconds")
    return out.withColumn("seconds", joined("seconds"))


# Cleaning.

HAVERSINE = """12742000.0 * atan2(sqrt(h), sqrt(1 - h))"""
CLEAN = f"""{OBSERVATIONS},
r1 AS (SELECT * FROM observations WHERE frame_time IS NOT NULL),
r2 AS (SELECT * FROM r1 WHERE label BETWEEN 0 AND 10),
r3 AS (SELECT * FROM r2 WHERE coalesce(audio_exists, false)),
r4 AS (SELECT * REPLACE (CASE WHEN heading = 360 THEN 0 ELSE heading END AS heading) FROM r3),
r5 AS (SELECT * FROM r4 WHERE heading BETWEEN 0 AND 359.999999),
r6 AS (SELECT * FROM r5 QUALIFY row_number() OVER (PARTITION BY entity_id, second ORDER BY tie) = 1),
r7 AS (SELECT * FROM r6 QUALIFY row_number() OVER (PARTITION BY frame_path ORDER BY tie) = 1),
m0 AS (SELECT *, second - lag(second) OVER w AS second_gap, coalesce(lag(lat) OVER w, lat) AS lat0, coalesce(lag(lon) OVER w, lon) AS lon0
  FROM r7 WINDOW w AS (PARTITION BY entity_id ORDER BY second, frame_time, frame_path)),
m1 AS (SELECT *, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2) AS h FROM m0),
m2 AS (SELECT *, coalesce(second_gap = 1 AND {HAVERSINE} > CASE WHEN speed IS NOT NULL THEN greatest(12.0, speed * 1.5 + 2.0) END, false) AS gps_jump FROM m1),
cleaned AS (SELECT * FROM m2 WHERE NOT gps_jump)"""


@BOOK.query(
    "drop_reason",
    f"""WITH {OBSERVATIONS} SELECT tie, CASE WHEN frame_time IS NULL THEN 'missing_required' WHEN label > 10 THEN 'invalid_label'
    WHEN NOT coalesce(audio_exists, false) THEN 'missing_audio' WHEN heading < 0 THEN 'invalid_heading' END AS drop_reason FROM observations""",
)
def drop_reason(spark, sf):
    return clean.mark_rows(clean.coerce_rows(observations(spark, sf))).select("tie", "drop_reason")


@BOOK.query("gps_jump_flag", f"WITH {CLEAN} SELECT tie, gps_jump FROM m2")
def gps_jump_flag(spark, sf):
    rows = clean.coerce_rows(observations(spark, sf))
    return clean.survivors(rows, FIRST_BY, RULE_ORDER).select("tie", "gps_jump")


def cleaned(spark, sf):
    return clean.clean_rows(observations(spark, sf), FIRST_BY, RULE_ORDER)


@BOOK.query(
    "clean_rows",
    f"""WITH {CLEAN} SELECT tie, entity_id, second, heading, CAST(label AS INTEGER) AS label, frame_path,
    strftime(frame_time, '%Y-%m-%d %H:%M:%S') AS frame_time, strftime(frame_time, '%Y-%m-%d') AS date FROM cleaned""",
)
def clean_rows(spark, sf):
    columns = ["tie", "entity_id", "second", "heading", "label", "frame_path", "frame_time", "date"]
    return cleaned(spark, sf).withColumn("second", F.col("second").cast("bigint")).select(*columns)


@BOOK.query(
    "clean_report",
    f"""WITH {CLEAN} SELECT 'source_rows' AS measure, (SELECT count(*) FROM observations) AS rows
    UNION ALL SELECT 'dropped_missing_required', (SELECT count(*) FROM observations) - (SELECT count(*) FROM r1)
    UNION ALL SELECT 'dropped_invalid_label', (SELECT count(*) FROM r1) - (SELECT count(*) FROM r2)
    UNION ALL SELECT 'dropped_missing_audio', (SELECT count(*) FROM r2) - (SELECT count(*) FROM r3)
    UNION ALL SELECT 'normalized_heading_360_to_0', (SELECT count(*) FROM r3 WHERE heading = 360)
    UNION ALL SELECT 'dropped_invalid_heading', (SELECT count(*) FROM r4) - (SELECT count(*) FROM r5)
    UNION ALL SELECT 'dropped_duplicate_entity_second', (SELECT count(*) FROM r5) - (SELECT count(*) FROM r6)
    UNION ALL SELECT 'dropped_duplicate_frame_path', (SELECT count(*) FROM r6) - (SELECT count(*) FROM r7)
    UNION ALL SELECT 'dropped_extreme_motion_rows', (SELECT count(*) FROM m2 WHERE gps_jump)
    UNION ALL SELECT 'clean_rows', (SELECT count(*) FROM cleaned)""",
)
def clean_report(spark, sf):
    return clean.clean_report(observations(spark, sf), FIRST_BY, RULE_ORDER)


# The cleaned rows on their real dates, with splits and the target layout.

LAYOUT = f"""{CLEAN},
placed AS (SELECT *, strftime(fix_time, '%Y-%m-%d') AS date FROM cleaned),
splits AS (SELECT *, CASE WHEN date IN ({sql_list(SPLIT_DATES['train'])}) THEN 'train'
  WHEN date IN ({sql_list(SPLIT_DATES['val'])}) THEN 'val' ELSE 'test' END AS split,
  first_value(date) OVER (PARTITION BY source_video_path ORDER BY second, frame_time, frame_path) AS video_date FROM placed),
layout AS (SELECT tie, entity_id, split, date, 'frames/' || date || '/aligned_frames/' || regexp_extract(frame_path, '([^/]*)$', 1) AS frame_path,
  'audio_segments/' || split || '/' || date || '/' || replace(entity_id, '.mp4', '') || '/' || regexp_extract(audio_path, '([^/]*)$', 1) AS audio_path,
  'videos/' || video_date || '/' || regexp_extract(source_video_path, '([^/]*)$', 1) AS video_path FROM splits)"""


def layout(spark, sf):
    rows = settled(cleaned(spark, sf)).withColumn("date", F.substring("fix_time", 1, 10))
    rows = align.assign_split(rows, SPLIT_DATES)
    return assets.rewrite_paths(rows, ["second", "frame_time", "frame_path"], "frames", "audio_segments", "videos")


@BOOK.query("rewrite_paths", f"WITH {LAYOUT} SELECT * FROM layout")
def rewrite_paths(spark, sf):
    return layout(spark, sf).select("tie", "entity_id", "split", "date", "frame_path", "audio_path", "video_path")


ANCHOR_SQL = ", ".join(
    {
        "frame_path": "l.frame_path", "audio_path": "l.audio_path", "video_path": "l.video_path", "split": "l.split",
        "entity_id": "c.entity_id", "frame_number": "CAST(frame_number AS INTEGER) AS frame_number",
        "frame_time": "strftime(frame_time, '%Y-%m-%d %H:%M:%S') AS frame_time",
        "fix_time": "strftime(fix_time, '%Y-%m-%d %H:%M:%S') AS fix_time", "did": "CAST(did AS DOUBLE) AS did",
        "audio_start_second": "CAST(audio_start_second AS INTEGER) AS audio_start_second",
    }.get(c, f"c.{c}")
    for c in ANCHOR_COLUMNS
)


@BOOK.query("select_anchor_columns", f"WITH {LAYOUT} SELECT {ANCHOR_SQL} FROM cleaned c JOIN layout l USING (tie)")
def select_anchor_columns(spark, sf):
    return layout(spark, sf).select(*ANCHOR_COLUMNS)


@BOOK.query(
    "link_report",
    f"""WITH {LAYOUT} SELECT 'frame_path' AS kind, count(DISTINCT frame_path) AS unique_paths FROM layout
    UNION ALL SELECT 'audio_path', count(DISTINCT audio_path) FROM layout UNION ALL SELECT 'video_path', count(DISTINCT video_path) FROM layout""",
)
def link_report(spark, sf):
    return assets.link_report(layout(spark, sf))


@BOOK.query(
    "verify_assets",
    f"""WITH {LAYOUT}, have AS (SELECT frame_path AS path FROM layout WHERE tie % 9 <> 0 UNION SELECT video_path FROM layout WHERE tie % 2 = 0
      UNION SELECT audio_path FROM layout WHERE tie % 4 <> 1),
    paths AS (SELECT DISTINCT 'frame_path' AS kind, frame_path AS path FROM layout UNION ALL SELECT DISTINCT 'audio_path', audio_path FROM layout
      UNION ALL SELECT DISTINCT 'video_path', video_path FROM layout),
    gone AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path) AS rn FROM paths WHERE path NOT IN (SELECT path FROM have))
    SELECT p.kind, count(*) AS checked, (SELECT count(*) FROM gone g WHERE g.kind = p.kind) AS missing,
      coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM gone g WHERE g.kind = p.kind AND rn <= 10), '') AS missing_examples
    FROM paths p GROUP BY p.kind""",
)
def verify_assets(spark, sf):
    rows = settled(layout(spark, sf))
    i = F.col("tie")
    have = F.array_compact(
        F.array(F.when(i % 9 != 0, F.col("frame_path")), F.when(i % 2 == 0, F.col("video_path")), F.when(i % 4 != 1, F.col("audio_path")))
    )
    out = assets.verify_assets(rows, rows.select(F.explode(have).alias("path")))
    return out.withColumn("missing_examples", joined("missing_examples"))


# Clips.

CLIP_ORDER = ["second", "frame_time", "tie"]
PLAN = f"""{SPLITTED},
firsts AS (SELECT entity_id, arg_min(split, (second, frame_time, tie)) AS s0, strftime(min(frame_time), '%Y-%m-%d') AS d0 FROM splitted GROUP BY 1),
plan AS (SELECT x.*, 'out/audio_segments/' || s0 || '/' || d0 || '/' || x.entity_id || '/' || printf('%06d.wav', second) AS audio_path,
  CAST(second AS INTEGER) AS audio_start_second, 1.0::DOUBLE AS audio_duration_seconds FROM splitted x JOIN firsts USING (entity_id)),
present AS (SELECT DISTINCT audio_path AS path FROM plan WHERE tie % 5 <> 0),
old_silence AS (SELECT DISTINCT audio_path AS path FROM plan WHERE tie % 10 = 0)"""


def plan(spark, sf):
    return assets.clip_plan(splitted(spark, sf), CLIP_ORDER, "out")


def clips(spark, sf):
    rows = settled(plan(spark, sf))
    path = F.col("audio_path").alias("path")
    return rows, rows.where(F.col("tie") % 5 != 0).select(path).distinct(), rows.where(F.col("tie") % 10 == 0).select(path).distinct()


@BOOK.query("clip_plan", f"WITH {PLAN} SELECT tie, audio_path, audio_start_second, audio_duration_seconds FROM plan")
def clip_plan(spark, sf):
    return plan(spark, sf).select("tie", "audio_path", "audio_start_second", "audio_duration_seconds")


@BOOK.query("first_of_entity", f"WITH {PLAN} SELECT entity_id, s0 AS split, d0 AS date FROM firsts")
def first_of_entity(spark, sf):
    columns = {"split": F.col("split"), "date": coerce.day("frame_time")}
    return assets.first_of_entity(splitted(spark, sf), columns, CLIP_ORDER)


@BOOK.query(
    "attach_asset_flag",
    f"""WITH {PLAN} SELECT tie, audio_path IN (SELECT path FROM present) AS audio_exists,
    audio_path IN (SELECT path FROM old_silence) AS audio_is_silence_fill FROM plan""",
)
def attach_asset_flag(spark, sf):
    rows, present, silence = clips(spark, sf)
    return assets.attach_clips(rows, present, silence).select("tie", "audio_exists", "audio_is_silence_fill")


@BOOK.query(
    "silence_registry",
    f"""WITH {PLAN} SELECT path FROM old_silence UNION SELECT audio_path FROM plan WHERE audio_path NOT IN (SELECT path FROM present)""",
)
def silence_registry(spark, sf):
    return assets.silence_registry(*clips(spark, sf))


COVERAGE = f"""{PLAN},
asked AS (SELECT DISTINCT entity_id, second, audio_path FROM plan),
seen AS (SELECT *, audio_path IN (SELECT path FROM present) AS there, audio_path IN (SELECT path FROM old_silence) AS silent FROM asked),
coverage AS (SELECT entity_id, count(*) AS requested_seconds, count(*) FILTER (there OR silent) AS written_clips,
  count(*) FILTER (NOT there AND NOT silent) AS missing_clips, count(*) FILTER (silent AND NOT there) AS silence_filled_clips,
  min(second) AS min_second, max(second) AS max_second, count(*) FILTER (NOT there AND NOT silent) = 0 AS ok,
  coalesce(array_to_string(list(second ORDER BY second) FILTER (NOT there AND NOT silent)[1:20], ','), '') AS missing_second_examples
  FROM seen GROUP BY entity_id)"""


@BOOK.query("clip_coverage", f"WITH {COVERAGE} SELECT * FROM coverage")
def clip_coverage(spark, sf):
    return assets.clip_coverage(*clips(spark, sf)).withColumn("missing_second_examples", joined("missing_second_examples"))


@BOOK.query("silence_filled_seconds", f"WITH {COVERAGE} SELECT entity_id, second FROM seen WHERE silent AND NOT there")
def silence_filled_seconds(spark, sf):
    return assets.silence_filled_seconds(*clips(spark, sf))


TOTALS = ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("requested_seconds", "written_clips", "missing_clips", "silence_filled_clips")
)


@BOOK.query("coverage_totals", f"WITH {COVERAGE} SELECT count(*) AS videos, {TOTALS}, count(*) FILTER (NOT ok) AS failed_videos FROM coverage")
def coverage_totals(spark, sf):
    return assets.coverage_totals(assets.clip_coverage(*clips(spark, sf)))


@BOOK.query(
    "audio_coverage",
    f"""WITH {PLAN} SELECT split, count(*) AS rows, count(*) FILTER (audio_path IN (SELECT path FROM present)) AS audio_exists_rows FROM plan GROUP BY 1""",
)
def audio_coverage(spark, sf):
    rows, present, silence = clips(spark, sf)
    return assets.audio_coverage(assets.attach_clips(rows, present, silence), ["split"])


# Sources looked up by name: labelled documents stand for the files that exist.


def document_names(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("entity_id"), "source")
    name = F.col("doc_id").cast("string")
    have = table(spark, sf, "labels").select(name.alias("name"), F.concat(F.lit("/videos/"), name).alias("path"))
    return docs, have


@BOOK.query(
    "attach_source_path",
    """SELECT CAST(d.doc_id AS VARCHAR) AS entity_id, source, coalesce('/videos/' || l.doc_id, '') AS source_video_path
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def attach_source_path(spark, sf):
    return assets.attach_source_path(*document_names(spark, sf))


@BOOK.query(
    "find_missing_sources",
    "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS entity_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def find_missing_sources(spark, sf):
    return assets.missing_sources(*document_names(spark, sf))
