import zlib

from fieldtrace.llm import sharding


def test_shards_of_odd_rows(docs, no_docs):
    rows = sharding.kd_shards(docs, shards=4).collect()
    assert len(rows) == docs.count()
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    for r in rows:
        text = r["doc"]["text"] or ""
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
    copies = {r["shard"] for r in rows if r["doc_id"] in (1, 10, 11, 12)}
    assert len(copies) == 1
    assert sharding.kd_shards(no_docs, shards=4).count() == 0


def test_sizes_are_near_equal(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "repeat('ab ', cast(id % 37 as int)) AS text")
    out = sharding.kd_shards(rows, shards=7).groupBy("shard").sum("size").collect()
    sizes = [r["sum(size)"] for r in out]
    assert len(sizes) == 7 and max(sizes) < 1.03 * min(sizes)


def test_a_group_heavier_than_a_shard_is_cut(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 < 2, 'same text', concat('text ', id)) AS text")
    sizes = [r["sum(size)"] for r in sharding.kd_shards(rows, shards=5).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 5 and max(sizes) < 1.05 * min(sizes)


def test_target_bytes_sets_the_number_of_shards(spark):
    rows = spark.range(1000).selectExpr("id AS doc_id", "'twenty-four bytes of text' AS text")
    out = sharding.kd_shards(rows, target_bytes=10_000)
    assert out.select("shard").distinct().count() == 5
