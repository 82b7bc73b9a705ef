"""Ordered work per entity that stays parallel when one entity holds much of the data.

``chunked`` gives every row a window key ``_chunk``. An ordinary entity is one chunk. A *hot* entity (more than
``hot_rows`` rows) is cut by row position into chunks of ``hot_rows`` rows, and the rows near a cut are copied to the
neighbouring chunk (the halo), so that a frame of up to ``before`` rows back and ``after`` rows ahead sees all its
rows. Windows then partition by (entity, _chunk): one exchange, and tasks whose size does not depend on the data.

Whether an entity is hot is counted, never estimated: one map-side-combined aggregate per call, or one for several
calls with ``with_hot``. Where the counts find none, rows pass straight through.

``islands`` numbers maximal stretches over such chunks. What a chunk cannot know (how many breaks came before
it) arrives as a carry row per chunk. Tables of hot entities, slices and chunks are joined without a hint: they are one
row for each ``hot_rows`` rows, and Spark broadcasts them while they are small. NULL entities and NULL seconds are values
like any other (NULL seconds come first).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.sources.writers import settled

#: Rows that a task of a table dealt out by ``deal`` should hold.
TASK_ROWS = 250_000
HELPERS = ["_chunk", "_own", "_pos", "_size", "_rows"]


@dataclass(frozen=True)
class Order:
    """The total order of an entity's rows: second, then time (if any), then a tie-break.

    Together the order columns have to be unique within an entity.
    ``hot_rows`` is the smallest entity worth cutting. ``hot`` may hold the known hot entities (see ``with_hot``).
    """

    entity: str = "entity_id"
    second: str = "second"
    time: str | None = "frame_time"
    tie: str = "tie"
    hot_rows: int = 1_000_000
    hot: DataFrame | None = field(default=None, compare=False, repr=False)

    @property
    def by(self) -> list[str]:
        return [c for c in (self.second, self.time, self.tie) if c]

    @property
    def keys(self) -> list[str]:
        return [self.entity, *self.by]

    def window(self, *extra: str):
        """Rows of one chunk of an entity, in order; ``extra`` splits the chunk further."""
        return Window.partitionBy(self.entity, "_chunk", *extra).orderBy(*self.by)


def hot_entities(df: DataFrame, order: Order) -> DataFrame:
    """(entity, _rows, _size) of the entities with more than ``hot_rows`` rows; _size is the rows of a chunk."""
    counts = df.groupBy(order.entity).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") > order.hot_rows).withColumn("_size", F.lit(order.hot_rows).cast("bigint"))


def match(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that takes NULL keys as equal."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in columns})
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns]
    return left.join(other, on, how).drop(*(f"_r_{c}" for c in columns))


def with_hot(df: DataFrame, order: Order) -> Order:
    """The order with the hot entities of ``df`` counted once and kept as a small table.

    Worth it before several operators run over the same entities: none of them has to count again. Rows may be
    filtered afterwards, the counts are upper bounds.
    """
    return replace(order, hot=settled(hot_entities(df, order)))


def positions(df: DataFrame, order: Order, hot: DataFrame) -> DataFrame:
    """Rows of hot entities with ``_pos``, their zero-based place in the entity.

    The rows are range-partitioned in their order, so a partition holds an even share of rows whatever the spread of
    seconds; counting (partition, entity) tells each how many rows precede it. They are written once, because a range
    exchange that is run again may draw other bounds.
    """
    rows = match(df, hot, [order.entity])
    ranged = rows.repartitionByRange(*order.keys).withColumn("_slice", F.spark_partition_id())
    ranged = settled(ranged)
    counts = ranged.groupBy(order.entity, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(order.entity).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(order.entity, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    within = Window.partitionBy(order.entity, "_slice").orderBy(*order.by)
    placed = match(ranged, offsets, [order.entity, "_slice"])
    return placed.withColumn("_pos", F.col("_off") + F.row_number().over(within) - 1).drop("_slice", "_off")


def uncut(df: DataFrame) -> DataFrame:
    """Rows that belong to no hot entity: each entity is one chunk."""
    return df.selectExpr("*", "-1L AS _chunk", "true AS _own")


def chunked(
    df: DataFrame, order: Order, before: int = 1, after: int = 1, hot: DataFrame | None = None
) -> DataFrame:
    """Add the window key ``_chunk`` and halo copies; ``_own`` marks the rows that are not copies.

    Where hot entities are possible it also adds ``_pos``, ``_size`` and ``_rows``, NULL for ordinary entities, which
    pass straight through.
    ``hot`` may come from ``hot_entities`` of an earlier, larger state of the same rows: at the end of a long
    chain that spares running the chain once more just to count.
    """
    hot = order.hot if hot is None else hot
    hot = settled(hot_entities(df, order)) if hot is None else hot
    if hot.isEmpty():
        return uncut(df)
    hot = hot.withColumn("_size", F.greatest("_size", F.lit(before + after + 1)))
    plain = uncut(match(df, hot.select(order.entity), [order.entity], "left_anti").select(*df.columns))
    plain = plain.selectExpr("*", *(f"CAST(NULL AS BIGINT) AS {c}" for c in ("_pos", "_size", "_rows")))
    home = F.floor(F.col("_pos") / F.col("_size"))
    place = F.col("_pos") % F.col("_size")
    onward = (place >= F.col("_size") - before) & ((home + 1) * F.col("_size") < F.col("_rows"))
    backward = (place < after) & (home > 0)
    targets = F.array_compact(F.array(home, F.when(onward, home + 1), F.when(backward, home - 1)))
    cut = positions(df, order, hot).withColumn("_chunk", F.explode(targets))
    cut = cut.select(*df.columns, "_chunk", (F.col("_chunk") == home).alias("_own"), "_pos", "_size", "_rows")
    return plain.unionByName(cut)


def deal(chunks: DataFrame, order: Order, rows: int) -> DataFrame:
    """Chunks dealt out by their key to as many tasks as ``rows`` rows need: what a task holds does not grow with the table.

    For operators that sort several copies of a row; others leave the number of tasks to Spark.
    """
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    # Without hot entities _chunk is a constant, which windows leave out of their key.
    return chunks.repartition(tasks, order.entity, *(["_chunk"] if "_pos" in chunks.columns else []))


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the halo copies and the helper columns."""
    keep = [c for c in df.columns if c not in HELPERS]
    return df.where("_own").select(*keep)


def local_position(chunks: DataFrame, order: Order) -> Column:
    """Zero-based place of the row in its entity: carried for hot rows, counted otherwise."""
    counted = F.row_number().over(order.window()).cast("bigint") - 1
    return F.coalesce(F.col("_pos"), counted) if "_pos" in chunks.columns else counted


def breaks(pos: Column, condition: Column, order: Order) -> Column:
    """A break flag: True on an entity's first row, NULL where the previous row is not in the chunk."""
    first = F.row_number().over(order.window()) == 1
    return F.when(pos == 0, True).when(first, F.lit(None)).otherwise(F.coalesce(condition, F.lit(False)))


def islands(chunks: DataFrame, order: Order, flags: dict[str, Column], before: int = 1, after: int = 1) -> DataFrame:
    """For each named break condition add ``{name}_id``, ``{name}_start`` and ``{name}_last``.

    ``chunks`` comes from ``chunked`` with the same ``before``/``after`` (both at least 1). A condition may look
    at the previous row through ``F.lag(..).over(order.window())``. ``_id`` counts islands of the entity from 0,
    ``_start`` is the position of the island's first row, ``_last`` tells whether the row ends its island. All
    three are exact for own rows and for halo rows (``_last`` only where the next row is in the halo too).
    """
    marked = chunks.withColumn("pos", local_position(chunks, order))
    marked = marked.withColumns({f"_{n}": breaks(F.col("pos"), c, order) for n, c in flags.items()})

    w = order.window()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for n in flags:
        hit = F.expr(f"CASE WHEN _{n} THEN pos END")
        out[f"{n}_id"] = F.count(hit).over(so_far) - 1
        out[f"{n}_start"] = F.max(hit).over(so_far)
        out[f"{n}_last"] = F.coalesce(F.lead(f"_{n}").over(w), F.lit(True))
    local = marked.withColumns(out) if flags else marked
    keep = [*chunks.columns, "pos", *(f"{n}_{part}" for n in flags for part in ("id", "start", "last"))]
    if not flags or "_pos" not in chunks.columns:
        return local.select(*keep)

    # Breaks at or before the first row of chunk k + 1 (its halo included) are unknown there: they are carried.
    head = F.col("pos") <= (F.col("_chunk") + 1) * F.col("_size") - before
    totals = []
    for n in flags:
        hit = F.when(F.col(f"_{n}"), F.col("pos"))
        totals += [
            F.count(hit).alias(f"n_{n}"),
            F.max(hit).alias(f"s_{n}"),
            F.count(F.when(head, hit)).alias(f"hn_{n}"),
            F.max(F.when(head, hit)).alias(f"hs_{n}"),
        ]
    per_chunk = marked.where((F.col("_chunk") >= 0) & F.col("_own")).groupBy(order.entity, "_chunk").agg(*totals)
    by_chunk = Window.partitionBy(order.entity).orderBy("_chunk")
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -2)
    carried = []
    for n in flags:
        carried += [
            (
                F.coalesce(F.sum(f"n_{n}").over(earlier), F.lit(0))
                + F.coalesce(F.lag(f"hn_{n}").over(by_chunk), F.lit(0))
            ).alias(f"cn_{n}"),
            F.coalesce(F.lag(f"hs_{n}").over(by_chunk), F.max(f"s_{n}").over(earlier)).alias(f"cs_{n}"),
        ]
    carry = per_chunk.select(order.entity, "_chunk", *carried)

    local = match(local, carry, [order.entity, "_chunk"], "left")
    final = {}
    for n in flags:
        final[f"{n}_id"] = F.col(f"{n}_id") + F.coalesce(F.col(f"cn_{n}"), F.lit(0))
        final[f"{n}_start"] = F.coalesce(f"{n}_start", f"cs_{n}")
    return local.withColumns(final).select(*keep)
