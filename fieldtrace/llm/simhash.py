"""Near-duplicate groups by SimHash and generalised pigeonhole search.

Fingerprints of 64 bits link when at most R bits differ. The bits are dealt to m groups; with a threshold t_i for each
group and sum(t_i) = R - m + 1, two fingerprints at most R apart agree up to t_i bits in some group i. Bits that vary
together go to one group, so the others stay selective; the thresholds are chosen by dynamic programming on how many
candidates each is expected to bring, from counts over all fingerprints. A probe row is made for every variant of a
group's bits within its threshold, met with the unchanged bits by an equi-join, and verified in the join itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from fieldtrace.llm.common import components, match, whole
from fieldtrace.sources.writers import settled

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Hashes that are unpacked to bits at a time: bounds memory for texts of any length.
BLOCK = 1 << 16
#: Cost of a shuffled probe row against a candidate that the join verifies.
ROW_COST = 40.0
#: A probe row has at most so many variants; no useful plan has more.
MOST_VARIANTS = 600


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash over the text's word shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: max(1, n - shingle + 1)].tolist()
    ends = ends[min(n, shingle) - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), BLOCK):
        spans = zip(starts[k : k + BLOCK], ends[k : k + BLOCK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts)).view(">i8")[0])


@pandas_udf(LongType())
def simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for all pairs of bits, how many have both: 64 x 64 sums from each task."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((64, 64))
        for part in parts:
            bits = np.unpackbits(part["fp"].to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            both += bits.T @ bits
        at = np.arange(4096)
        yield pd.DataFrame({"cell": at, "both": both.ravel()})

    cells = prints.select("fp").mapInPandas(partial, "cell long, both double").groupBy("cell").agg(F.sum("both").alias("both")).collect()
    both = np.zeros(4096)
    for cell, value in cells:
        both[cell] = value
    return prints.count(), both.reshape(64, 64)


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits, each grown around the bit with the strongest ties among those left."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, groups = list(range(64)), []
    for i in range(m):
        size = len(left) // (m - i)
        first = max(left, key=lambda b: (tie[b, left].sum(), -b))
        chosen = [first]
        while len(chosen) < size:
            chosen.append(max((b for b in left if b not in chosen), key=lambda b: (tie[b, chosen].sum(), -b)))
        groups.append(sorted(chosen))
        left = [b for b in left if b not in chosen]
    return groups


def variants(bits: list[int], most: int) -> list[int]:
    """All masks over the bits with at most ``most`` of them set."""
    masks = [(0, -1)]
    out = [0]
    for _ in range(most):
        masks = [(mask | 1 << b, i) for mask, last in masks for i, b in enumerate(bits) if i > last]
        out += [mask for mask, _ in masks]
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with the given sum and the least cost; costs[i][t + 1] is that of threshold t in group i."""
    best = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for j, more in enumerate(row):
                if used + j not in step or cost + more < step[used + j][0]:
                    step[used + j] = (cost + more, [*chosen, j - 1])
        best = step
    return best[total + len(costs)]


def make_plan(prints: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) for each group of the cheapest plan for these fingerprints."""
    n, both = bit_counts(prints)
    dealt = {m: group_bits(both, n, m) for m in range(1, radius + 2)}
    masks = [(m, i, signed(sum(1 << b for b in bits))) for m, groups in dealt.items() for i, bits in enumerate(groups)]
    keys = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for m, i, mask in masks if m > 1)))
    sizes = prints.select(keys.alias("k")).groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("c"))
    equal = {(r["m"], r["i"]): r["pairs"] for r in sizes.groupBy("k.m", "k.i").agg((F.sum(F.col("c") * (F.col("c") - 1)) / 2).alias("pairs")).collect()} if radius else {}
    share = np.diag(both) / max(n, 1)
    apart = np.clip(2 * share * (1 - share), 1e-9, 1 - 1e-9)
    odds, best = apart / (1 - apart), None
    for m, groups in dealt.items():
        costs = []
        for i, bits in enumerate(groups):
            row, sums = [0.0], [1.0]
            for t in range(0, radius - m + 2 + (m - 1)):
                if t > 0:
                    grown = np.zeros(t + 1)
                    grown[0] = 1.0
                    for b in bits:
                        grown[1:] += odds[b] * grown[:-1].copy()
                    sums = list(grown)
                count = sum(_choose(len(bits), k) for k in range(t + 1))
                found = equal.get((m, i), float(n)) * sum(sums)
                row.append(float("inf") if count > MOST_VARIANTS else ROW_COST * n * (1 + count / 2) + found)
            costs.append(row)
        cost, chosen = allocate(costs, radius - m + 1)
        if best is None or cost < best[0]:
            best = (cost, list(zip(groups, chosen)))
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def near_pairs(prints: DataFrame, plan: list[tuple[list[int], int]], radius: int, label: str | None = None) -> DataFrame:
    """Each pair (a, b) of different fingerprints at most ``radius`` bits apart, once.

    With ``label``, pairs whose labels are equal are left out.
    """
    used = [(i, bits, t, signed(sum(1 << b for b in bits))) for i, (bits, t) in enumerate(plan) if t >= 0]
    carried = ["fp", *([label] if label else [])]
    pairs = None
    for place, (i, bits, t, mask) in enumerate(used):
        key = F.col("fp").bitwiseAND(F.lit(mask))
        index = prints.select(key.alias("key"), *(F.col(c).alias(f"_b_{c}") for c in carried))
        if t == 0:
            probe = prints.select(key.alias("key"), F.lit(0).cast("long").alias("flip"), *(F.col(c).alias(f"_a_{c}") for c in carried))
        else:
            # A pair differs first, from the top, in some bit: only the side with 0 there probes.
            flips = F.array(*(F.lit(signed(v)) for v in variants(bits, t)))
            tops = F.array(*(F.lit(signed(1 << (v.bit_length() - 1)) if v else 0) for v in variants(bits, t)))
            some = F.filter(F.arrays_zip(flips.alias("flip"), tops.alias("top")), lambda z: F.col("fp").bitwiseAND(z["top"]) == 0)
            probe = prints.select(F.explode(some).alias("z"), *carried)
            probe = probe.select(key.bitwiseXOR(F.col("z.flip")).alias("key"), F.col("z.flip").alias("flip"), *(F.col(c).alias(f"_a_{c}") for c in carried))
        apart = F.col("_a_fp").bitwiseXOR(F.col("_b_fp"))
        on = (probe["key"] == index["key"]) & (F.bit_count(apart) <= radius) & ((F.col("flip") != 0) | (F.col("_a_fp") < F.col("_b_fp")))
        for _, _, u, earlier in used[:place]:
            on = on & (F.bit_count(apart.bitwiseAND(F.lit(earlier))) > u)
        if label:
            on = on & (F.col(f"_a_{label}") != F.col(f"_b_{label}"))
        found = probe.join(index, on).select(F.col("_a_fp").alias("a"), F.col("_b_fp").alias("b"))
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs


def neighbour_links(prints: DataFrame, plan: list[tuple[list[int], int]], radius: int) -> DataFrame:
    """Links between neighbours when fingerprints are sorted with each group's bits in front.

    They join nearly all of a dense heap of fingerprints by one link each, so that the search need not emit its pairs.
    """

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for part in parts:
            values = part["fp"].to_numpy()
            if last is not None:
                values = np.concatenate([[last], values])
            apart = np.bitwise_count((values[1:] ^ values[:-1]).view(np.uint64))
            close = apart <= radius
            last = values[-1] if len(values) else last
            yield pd.DataFrame({"a": values[:-1][close], "b": values[1:][close]})

    out = None
    for bits, _ in plan:
        mask = signed(sum(1 << b for b in bits))
        order = [F.col("fp").bitwiseAND(F.lit(mask)), F.col("fp")]
        sorted_prints = prints.select("fp").repartitionByRange(*order).sortWithinPartitions(*order)
        links = sorted_prints.mapInPandas(scan, "a long, b long")
        out = links if out is None else out.unionByName(links)
    return out.distinct()


def print_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> (node, root): components of the links, for fingerprints that have a link.

    Neighbour links first make provisional components; the search then emits only pairs across them.
    """
    plan = make_plan(prints, radius)
    first = settled(components(neighbour_links(prints, plan, radius)))
    named = settled(prints.select("fp").join(first, prints["fp"] == first["node"], "left").select("fp", F.coalesce("root", "fp").alias("label")))
    across = settled(near_pairs(named, plan, radius, label="label"))
    a, b = named.select(F.col("fp").alias("a"), F.col("label").alias("la")), named.select(F.col("fp").alias("b"), F.col("label").alias("lb"))
    joined = across.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    second = settled(components(joined))
    out = named.join(second, named["label"] == second["node"], "left").select("fp", F.coalesce("root", "label").alias("root"))
    return settled(out)


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each document with its fingerprint and group.

    Columns: doc_id, text_key (hash of the text), fp, group (a fingerprint), component_id (smallest doc_id of the
    group, null if all are null), keeper (the row that stands for its group: smallest doc_id, then text_key; rows equal
    in both are all keepers). Null, empty and blank texts have fingerprint 0 and are linked like any other; texts of any
    length are read whole; an empty table gives no rows.
    """
    rows = settled(docs.select("doc_id", text_key(F.col("text")).alias("text_key"), simhash(F.col("text").cast("binary")).alias("fp")))
    firsts = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    prints = settled(rows.groupBy("fp").agg(firsts.alias("first")))
    groups = match(prints, print_groups(prints.select("fp"), radius), ["fp"])
    heads = groups.groupBy("root").agg(F.min("first").alias("head"))
    named = settled(groups.join(heads, "root").select("fp", F.col("root").alias("group"), "head"))
    keeper = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))
    return rows.join(named, "fp").select("doc_id", "text_key", "fp", "group", F.col("head.doc_id").alias("component_id"), keeper.alias("keeper"))


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents, one of each group: the keeper, once if its row is repeated."""
    keep = settled(near_duplicates(docs, radius).where("keeper").select("doc_id", "text_key").distinct())
    rows = docs.select(whole(docs), "doc_id", text_key(F.col("text")).alias("text_key"))
    kept = match(rows, keep, ["doc_id", "text_key"])
    return kept.dropDuplicates(["doc_id", "text_key"]).select("doc.*")
