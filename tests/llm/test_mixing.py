from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldtrace.llm import common, mixing, sharding


def refill(sizes, weights, cap):
    """Targets by sharing the excess again and again."""
    total, capped = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(capped.values())
        level = rest / sum(weights[i] for i in free) if free else 0
        over = [i for i in free if level * weights[i] > cap * sizes[i]]
        if not over:
            return [capped.get(i, level * weights[i]) for i in range(len(sizes))]
        capped |= {i: cap * sizes[i] for i in over}


@pytest.mark.parametrize("sizes", [[10, 1000, 5, 400], [0, 7, 900], [3, 3, 3], [0, 0], [1, 10_000, 1, 1, 1]])
def test_targets_share_the_excess_again(spark, sizes):
    totals = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(totals).collect()}
    want = refill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_due_inverts_the_integral(spark):
    for knots in mixing.SCHEDULES:
        rows = spark.range(0, 11).select((F.col("id") / 10).alias("s")).select("s", mixing.due(F.col("s"), knots).alias("t")).collect()
        area = sum((a + b) / 2 * (t - s) for (s, a), (t, b) in zip(knots, knots[1:]))
        for r in rows:
            done = 0.0
            for (s, a), (t, b) in zip(knots, knots[1:]):
                x = min(max(r["t"] - s, 0.0), t - s)
                done += a * x + (b - a) / (t - s) * x * x / 2
            assert done / area == pytest.approx(r["s"], abs=1e-9)


def test_plan_of_odd_rows(docs, no_docs):
    plan = mixing.plan(docs).collect()
    assert len(plan) == docs.count()
    assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and len(r["times"]) == r["copies"] for r in plan)
    assert all(r["copies"] == 0 for r in plan if not (r["doc"]["text"] or "").split())
    by = {}
    for r in plan:
        by.setdefault(r["source"], []).append(r)
    for source, rows in by.items():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in plan)
    assert mixing.plan(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_reruns_agree(docs):
    a, b = ([tuple(r) for r in mixing.plan(d, carry=False).select("doc_id", "taken", "first_position").collect()] for d in (docs, docs.repartition(5)))
    assert sorted(a, key=str) == sorted(b, key=str)


def many(spark, n=3_000):
    """Sources of unlike size, one null, with repeated rows and ids."""
    heavy = F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), (F.col("id") % 39).cast("string")))
    rows = spark.range(n).select(
        (F.col("id") % (n - 50)).alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 17).cast("int")).alias("text"),
        F.when(F.col("id") % 7 != 0, F.coalesce(heavy, F.lit("a"))).alias("source"),
    )
    return rows.unionByName(rows.where("doc_id < 5")).repartition(3)


def moves_of_texts(df, capsys):
    """Exchanges through which whole rows go."""
    capsys.readouterr()
    df.explain("formatted")
    parts = capsys.readouterr().out.split("\n\n")
    return sum(" Exchange\n" in p and "doc#" in p.split("Input", 1)[-1].split("\n")[0] for p in parts)


@pytest.mark.parametrize("sources", [1, 1_000])
def test_mixed_takes_the_plan(spark, monkeypatch, sources):
    monkeypatch.setattr(common, "BUCKET_ROWS", 20)
    monkeypatch.setattr(mixing, "CUT_SOURCES", sources)
    docs = many(spark)
    want, got = Counter(), Counter(tuple(r) for r in mixing.mixed(docs).collect())
    for r in mixing.plan(docs).collect():
        want[tuple(r["doc"])] += r["copies"]
    assert got == +want and 0 < len(got) < len(want)


def test_texts_are_shuffled_no_more_than_needed(spark, monkeypatch, capsys):
    monkeypatch.setattr(common, "BUCKET_ROWS", 20)
    docs, limit = many(spark), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    # As if the tables of sources and buckets were too large to be broadcast unasked.
    spark.conf.set(limit, "-1")
    try:
        assert (moves_of_texts(mixing.mixed(docs), capsys), moves_of_texts(sharding.kd_shards(docs, shards=3), capsys)) == (2, 1)
    finally:
        spark.conf.set(limit, before)


def test_the_query_sorts_and_writes_whole_documents(spark, monkeypatch, tmp_path):
    """Its rows come off a table that holds every copy of a document, all its columns, in training order."""
    monkeypatch.setattr(common, "BUCKET_ROWS", 20)
    kept, write = [], mixing.settled
    monkeypatch.setattr(mixing, "settled", lambda *a: kept.append(write(*a)) or kept[-1])
    many(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op4_curriculum_mix"](spark, str(tmp_path)).collect()
    whole = [t for t in kept if "doc" in t.columns]
    assert len(whole) == 1 and whole[0].select("doc.*").columns == docs.columns
    rows = [r for f in sorted(whole[0].inputFiles()) for r in spark.read.parquet(f).collect()]
    assert sum(r["_time"] is None for r in rows) == sum(r["copies"] == 0 for r in got) > 0
    times = [r["_time"] for r in rows if r["_time"] is not None]
    assert times == sorted(times) and len(times) == sum(r["copies"] for r in got)
    held = Counter(tuple(r["doc"]) for r in rows if r["_time"] is not None)
    assert held == Counter(tuple(r) for r in mixing.mixed(docs).collect())
    columns = ("doc_id", "size", "source_size", "target", "taken", "copies")
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(tuple(r) for r in mixing.plan(docs, carry=False).select(*columns).collect())


@pytest.mark.parametrize("sources", [1, 1_000])
def test_delivered_rows_are_the_plan(spark, monkeypatch, docs, no_docs, sources):
    monkeypatch.setattr(common, "BUCKET_ROWS", 20)
    monkeypatch.setattr(mixing, "CUT_SOURCES", sources)
    for table in (docs, many(spark, 600)):
        got = mixing.delivered(table)
        want = mixing.plan(table, carry=False).select(*got.columns)
        assert got.dtypes == want.dtypes
        assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in want.collect())
    assert mixing.delivered(no_docs).count() == 0
