"""Sharding by a k-d tree: split at weighted medians along the widest metadata dimension until leaves have their size.

The weights are bytes. A node that is to become n shards is cut where n // 2 of n parts of its bytes lie to the left, so
any number of shards comes out even. Medians are searched for all nodes of a level at once, by histograms over the
bits of a coordinate: a round sums bytes by the next bits below the prefix that holds the median, until what that
prefix holds no longer matters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldtrace.llm.common import crc, hash_key, running, whole
from fieldtrace.sources.writers import settled

#: Bits of a coordinate: the dimension, then a hash of the text, then one of the id.
DIM_BITS, TEXT_BITS, ID_BITS = 20, 20, 23
SHIFTS = (47, 35, 23, 11, 0)
#: A cut may miss its share of a node by half this part of a shard's bytes; by more where that keeps equal texts together.
TOLERANCE, GROUP_TOLERANCE = 0.002, 0.01


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def default_dims(text: Column) -> list[Column]:
    """Length on a log scale, bytes per character (which tells scripts apart), and the text's hash."""
    some = F.coalesce(text, F.lit(""))
    return [
        F.log2(text_bytes(text).cast("double")),
        F.octet_length(some) / (F.length(some) + 1),
        crc(text).cast("double"),
    ]


def spans_of(rows: DataFrame, dims: int) -> list[tuple[float, float]]:
    """Least and greatest value of each dimension over the whole table."""
    r = rows.agg(*(F.min(f"_v{i}").alias(f"a{i}") for i in range(dims)), *(F.max(f"_v{i}").alias(f"b{i}") for i in range(dims))).first()
    return [(r[f"a{i}"] or 0.0, r[f"b{i}"] or 0.0) for i in range(dims)]


def coordinates(rows: DataFrame, spans: list[tuple[float, float]]) -> DataFrame:
    """Scales each dimension to 20 bits over its span and appends hash bits, so that ties can be cut."""
    low = F.shiftleft(F.col("text_crc32") % (1 << TEXT_BITS), ID_BITS) + F.conv(F.substring("_key", 25, 8), 16, 10).cast("long") % (1 << ID_BITS)
    for i, (a, b) in enumerate(spans):
        unit = F.floor((F.coalesce(F.col(f"_v{i}"), F.lit(a)) - F.lit(a)) * F.lit(((1 << DIM_BITS) - 1) / ((b - a) or 1.0))).cast("long")
        rows = rows.withColumn(f"_c{i}", F.shiftleft(F.least(F.greatest(unit, F.lit(0)), F.lit((1 << DIM_BITS) - 1)), TEXT_BITS + ID_BITS) + low)
    return rows


def start(rows: DataFrame, parts: int) -> DataFrame:
    """All rows in the root: _node is the first shard of a row's node, _parts the node's number of shards."""
    return rows.withColumn("_node", F.lit(0)).withColumn("_parts", F.lit(parts))


def descend(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Rows one level further down, by the cuts of that level: a table of at most one row per shard."""
    table = rows.sparkSession.createDataFrame([(c[0], c[1], c[2]) for c in cuts], "_node int, _dim int, _cut long")
    dims = [c for c in rows.columns if c.startswith("_c")]
    out = rows.join(F.broadcast(table), "_node", "left")
    value = F.element_at(F.array(*dims), F.col("_dim") + 1)
    left = F.floor(F.col("_parts") / 2).cast("int")
    right = F.coalesce(value >= F.col("_cut"), F.lit(False))
    parts = F.when(F.col("_dim").isNull(), F.col("_parts")).when(right, F.col("_parts") - left).otherwise(left)
    node = F.when(right, F.col("_node") + left).otherwise(F.col("_node"))
    return out.withColumns({"_to": node, "_parts": parts}).drop("_node", "_dim", "_cut").withColumnRenamed("_to", "_node")


def find_cuts(placed: DataFrame, dims: int, leaf: float) -> list[tuple]:
    """None when every node is one shard. Else, for every node of more than one part: (node, dimension, cut, parts). The driver holds a few numbers per shard."""
    spark = placed.sparkSession
    # The hash dimension comes last and is only cut along when the others have no width.
    stats = placed.where("_parts > 1").groupBy("_node", "_parts").agg(
        F.sum("size").alias("w"), *(F.min(f"_c{i}").alias(f"a{i}") for i in range(dims)), *(F.max(f"_c{i}").alias(f"b{i}") for i in range(dims))
    ).collect()
    shift = TEXT_BITS + ID_BITS
    open_nodes, done = {}, []
    for s in stats:
        widths = [(s[f"b{i}"] >> shift) - (s[f"a{i}"] >> shift) for i in range(dims)]
        real = widths[:-1] if dims > 1 and max(widths[:-1]) > 0 else widths
        open_nodes[s["_node"]] = [widths.index(max(real)), 0, 0, s["w"] * (s["_parts"] // 2) / s["_parts"], s["_parts"]]
    last = 63
    for shift in SHIFTS:
        if not open_nodes:
            break
        table = spark.createDataFrame([(n, d, prefix, float(before), goal) for n, (d, prefix, before, goal, _) in open_nodes.items()], "_node int, _dim int, _prefix long, _before double, _goal double")
        joined = placed.join(F.broadcast(table), "_node")
        value = F.element_at(F.array(*(f"_c{i}" for i in range(dims))), F.col("_dim") + 1)
        inside = joined.where(F.shiftright(value, last) == F.col("_prefix")) if last < 63 else joined
        bins = inside.groupBy("_node", "_before", "_goal", F.shiftright(value, shift).alias("_bin")).agg(F.sum("size").alias("_w"))
        order = W.partitionBy("_node").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
        summed = bins.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_w").over(order), F.lit(0)))
        found = summed.where(F.col("_at") <= F.col("_goal")).groupBy("_node").agg(F.max(F.struct("_at", "_bin", "_w")).alias("m")).collect()
        for r in found:
            n, (at, b, w) = r["_node"], r["m"]
            dim, _, _, goal, parts = open_nodes[n]
            if w <= leaf * (GROUP_TOLERANCE if shift == ID_BITS else TOLERANCE) or shift == 0:
                edge = b if goal - at <= at + w - goal else b + 1
                done.append((n, dim, min(edge << shift, (1 << 63) - 1), parts))
                del open_nodes[n]
            else:
                open_nodes[n][1], open_nodes[n][2] = b, at
        last = shift
    return done


def kd_shards(docs: DataFrame, shards: int = 40, target_bytes: int | None = None, carry: bool = True, dims: list[Column] | None = None) -> DataFrame:
    """Each row with shard (0 to shards - 1, sizes near equal) and slot (gapless from 0 within the shard, hash order).

    Columns: doc (struct of all columns of docs, or of doc_id alone), doc_id, size (UTF-8 bytes of the text plus 16;
    null counts as none), text_crc32, shard, slot. With ``target_bytes`` the number of shards is what the table's bytes
    need. Equal texts have equal coordinates but for the last bits, so copies share a shard unless their group is
    itself too heavy for the cut; then it is cut by a hash of doc_id. Rows equal in all columns go to one shard. A text of any
    length counts all its bytes, though one longer than a shard makes its shard so much larger; an empty table gives no rows.
    """
    values = dims or default_dims(F.col("text"))
    base = docs.select(
        whole(docs) if carry else F.struct("doc_id").alias("doc"), "doc_id", text_bytes(F.col("text")).alias("size"), crc(F.col("text")).alias("text_crc32"),
        hash_key(F.col("doc_id"), "|shard").alias("_key"), *(v.cast("double").alias(f"_v{i}") for i, v in enumerate(values)),
    )
    narrow = settled(base.drop("doc"))
    full = narrow.agg(F.sum("size")).first()[0] or 0
    if target_bytes:
        shards = max(1, math.ceil(full / target_bytes))
    spans = spans_of(narrow, len(values))
    rows = start(coordinates(narrow, spans), shards)
    levels: list[list[tuple]] = []
    # Each level of the narrow rows is written once, so that no plan grows with the depth of the tree.
    while cuts := find_cuts(rows, len(values), full / shards):
        levels.append(cuts)
        rows = settled(descend(rows, cuts))
    spread = [f"_v{i}" for i in range(len(values))]
    if carry:
        placed = start(coordinates(base, spans), shards)
        for cuts in levels:
            placed = descend(placed, cuts)
    else:
        placed = rows.withColumn("doc", F.struct("doc_id"))
    placed = placed.withColumnRenamed("_node", "shard").withColumn("_one", F.lit(1)).drop(*spread, "_parts")
    slim = rows.select(F.col("_node").alias("shard"), "_key", F.lit(1).alias("_one"))
    numbered = running(placed, slim, ["shard"], "_key", ["doc_id", "text_crc32"], "_one", "slot")
    return numbered.select("doc", "doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
