"""Each stage on odd rows and on an empty table; its rows against a brute-force version are in the operators' tests."""

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    items = [(1, "some benchmark item of invented words zarkle bimpot fendle quorm.")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, docs, no_docs, folder):
    rows = docs
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, rows, folder)
        if i < len(P.STAGES) - 1:
            assert out.columns == docs.columns, name
            if name != "mixing":
                assert out.count() <= rows.count()
            rows = out
        else:
            assert set(out.columns) == set(docs.columns) | {"shard", "slot"} and out.count() == rows.count()
        assert stage(spark, no_docs, folder).count() == 0


def test_clean_rows_stay(spark, docs, folder):
    kept = {r["doc_id"] for r in P.known_language(spark, docs, folder).collect()}
    assert not kept & {14, 15, 16, 17} and len(kept) > 45
    assert P.decontaminated(spark, docs, folder).count() == docs.count()
