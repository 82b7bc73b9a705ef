"""Substring dedup by repeated-phrase automata.

A phrase is a window of ``words`` successive words that starts at two places or more. Minimisers, the least hash of a run of
words within each window, tell where a window may recur: only stretches around recurring minimisers are looked at, and there
windows are confirmed by counting 128-bit hashes. Confirmed phrases are dealt to shards by the text in which their minimiser
recurs first, so that near copies meet few shards, and compiled into one Aho-Corasick automaton a shard; every stretch then
streams through its shard's automaton, which finds each occurrence of each phrase word by word.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fieldtrace.llm.common import whole
from fieldtrace.llm.suffixes import Words, run_hashes, word_hashes
from fieldtrace.sources.writers import settled

#: Words of a window, and of the hashed run; a window holds WORDS - RUN + 1 runs.
WORDS, RUN = 20, 8
#: Phrases that one automaton should hold, words of a text whose phrases share a shard, starts of one stretch.
PHRASES, BLOCK, STARTS = 1 << 14, 8192, 4096
#: Window starts that stream through one copy of an automaton, and windows counted at a time within a task.
LOAD, COUNTED = 1 << 20, 1 << 18
#: Texts that a task remembers to have sampled: of equal texts one is enough.
REMEMBERED = 1 << 18

STRETCH = "shard long, did long, tid long, at int, n int, words binary"


def keyed(docs: DataFrame) -> DataFrame:
    """Adds did (doc_id, null as the greatest) and tid (hash of the text)."""
    return docs.withColumn("did", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn("tid", F.xxhash64("text"))


def spread_over(values: np.ndarray, width: int, kept: np.ufunc) -> np.ndarray:
    """``kept`` (minimum or maximum) of each ``width`` successive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = kept(values[: len(values) - step], values[step:])
        done += step
    return values


def least_places(keys: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least key of some ``window`` successive ones; of equal least keys all are taken."""
    if len(keys) < window:
        return np.zeros(0, dtype=np.int64)
    least = spread_over(keys, window, np.minimum)
    # A place is one if the greatest of the windows' least keys around it is its own.
    edge = np.zeros(window - 1, dtype=keys.dtype)
    return np.flatnonzero(spread_over(np.concatenate([edge, least, edge]), window, np.maximum) == keys)


def sampled(texts: DataFrame, words: int) -> DataFrame:
    """(did, tid, text) -> the minimisers of each text (key, at), once a task, and for each row its size (at = -1 - words) and digest."""

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, done = Words(), set()
        for part in parts:
            dids, tids, keys, places, digests = [], [], [], [], []
            for did, tid, text in zip(part["did"].tolist(), part["tid"].tolist(), part["text"]):
                if tid in done:
                    at, k, n = [], np.zeros(0, dtype=np.uint64), len(text.split())
                else:
                    h = word_hashes(text, seen)
                    n = len(h)
                    k = run_hashes(h, RUN) if n >= words else h[:0]
                    at = least_places(k, words - RUN + 1)
                    if len(done) >= REMEMBERED:
                        done.clear()
                    done.add(tid)
                dids += [did] * (len(at) + 1)
                tids += [tid] * (len(at) + 1)
                keys += [k[at].view(np.int64) if len(at) else k[:0].view(np.int64), [0]]
                places += [at, [-1 - n]]
                digests += [None] * len(at) + [hashlib.sha256(text).digest()]
            if dids:
                yield pd.DataFrame({"did": dids, "tid": tids, "key": np.concatenate(keys).astype(np.int64), "at": np.concatenate(places).astype(np.int32), "digest": digests})

    return texts.mapInPandas(emit, "did long, tid long, key long, at int, digest binary")


def stretches(rows: DataFrame, words: int) -> DataFrame:
    """(did, tid, text, places: array of shard * 2^32 + at) -> the stretches of a text that may hold phrases of a shard.

    A stretch has n starts; every window that has one of the places as its minimiser starts in a stretch of that shard.
    """
    back = words - RUN

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["shard", "did", "tid", "at", "n", "words"]
        for part in parts:
            out, held = [], 0
            for did, tid, text, places in zip(part["did"].tolist(), part["tid"].tolist(), part["text"], part["places"]):
                found = text.split()
                last = len(found) - words
                packed = np.sort(np.asarray(places, dtype=np.int64))
                shards, ats = packed >> 32, packed & 0xFFFFFFFF
                first, end = np.maximum(ats - back, 0), np.minimum(ats, last) + 1
                # Successive places of a shard whose starts meet make one stretch: both ends rise with the places.
                opens = np.append(True, (shards[1:] != shards[:-1]) | (first[1:] > end[:-1]))
                heads = np.flatnonzero(opens)
                for shard, a, b in zip(shards[heads].tolist(), first[heads].tolist(), end[np.append(heads[1:], len(packed)) - 1].tolist()):
                    for i in range(a, b, STARTS):
                        n = min(STARTS, b - i)
                        out.append((shard, did, tid, i, n, b" ".join(found[i : i + n + words - 1])))
                        held += n
                if held >= COUNTED:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    return rows.select("did", "tid", "text", "places").mapInPandas(emit, STRETCH)


def window_hashes(text: bytes, words: int, seen: Words) -> tuple[np.ndarray, np.ndarray]:
    h = word_hashes(text, seen)
    with np.errstate(over="ignore"):
        other = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return run_hashes(h, words), run_hashes(other, words)


def windows(found: DataFrame, words: int) -> DataFrame:
    """Windows of stretches by hash and shard, with the first place and a count, those of one task taken together."""

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Words()
        held: list[tuple[np.ndarray, ...]] = []

        def taken() -> pd.DataFrame:
            h1, h2, shard, did, at = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(h1)
            h1, h2, shard, did, at = h1[order], h2[order], shard[order], did[order], at[order]
            # A window may stand in stretches of several shards: only that of its own minimiser holds all its places.
            new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (shard[1:] != shard[:-1]))
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(h1)))
            least = np.minimum.reduceat(did, first)
            start = np.minimum.reduceat(np.where(did == np.repeat(least, n), at, np.iinfo(np.int64).max), first)
            return pd.DataFrame({"h1": h1[first].view(np.int64), "h2": h2[first].view(np.int64), "shard": shard[first], "did": least, "at": start, "n": n})

        size = 0
        for part in parts:
            for shard, did, at, n, text in zip(part["shard"].tolist(), part["did"].tolist(), part["at"].tolist(), part["n"].tolist(), part["words"]):
                h1, h2 = window_hashes(text, words, seen)
                held.append((h1, h2, np.full(n, shard), np.full(n, did), np.arange(at, at + n)))
                size += n
                if size >= COUNTED:
                    yield taken()
                    held, size = [], 0
        if held:
            yield taken()

    return found.select("shard", "did", "at", "n", "words").mapInPandas(emit, "h1 long, h2 long, shard long, did long, at long, n long")


def confirmed(found: DataFrame, words: int) -> DataFrame:
    """(shard, did, at): the first place of each window that starts at several places.

    Stretches of a shard are brought together first, so that near copies are counted within tasks; a shard larger than a
    task is split. Repeated rows of one document may confirm a window that starts nowhere else; nothing comes after it.
    """
    together = found.hint("rebalance", "shard").sortWithinPartitions("shard")
    # A decimal orders like (did, at) and, unlike a struct, is aggregated by hash.
    place = (F.col("did").cast("decimal(20,0)") * F.lit(1 << 32) + F.col("at")).cast("decimal(38,0)")
    counted = windows(together, words).groupBy("h1", "h2", "shard").agg(F.min(place).alias("place"), F.sum("n").alias("n"))
    did = F.floor(F.col("place") / F.lit(1 << 32).cast("decimal(20,0)"))
    place = counted.where("n > 1").select("shard", "place", did.cast("long").alias("did"))
    return place.select("shard", "did", (F.col("place") - F.col("did").cast("decimal(20,0)") * F.lit(1 << 32)).cast("int").alias("at"))


def dealt(rows: DataFrame, words: int) -> DataFrame:
    """Rows of a shard with too many phrases for one automaton go to one of several window by window, by their hash."""

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Words()
        for part in parts:
            one = part["parts"] == 1
            if one.any():
                yield part[one].assign(part=0)
            for row in part[~one].to_dict("records"):
                h1, _ = window_hashes(row["words"], words, seen)
                own = row["words"].split()
                yield pd.DataFrame([{**row, "at": row["at"] + i, "n": 1, "words": b" ".join(own[i : i + words]), "part": int(h1[i] % np.uint64(row["parts"]))} for i in range(row["n"])])

    return rows.mapInPandas(emit, f"{STRETCH}, phrase boolean, parts long, salts long, part long")


class Automaton:
    """Finds windows of words. Words are pairs of letters, of two alphabets no larger than need be: nodes stay narrow."""

    def __init__(self, phrases: list[tuple[list[bytes], int, int, int]], words: int) -> None:
        self.words = words
        names = {w for own, _, _, _ in phrases for w in own}
        base = math.isqrt(len(names) + 1) + 1
        # Letters below 2 * base; the first word stands for all that no phrase holds.
        self.letters = {w: chr(i // base) + chr(base + i % base) for i, w in enumerate(names, 1)}
        self.unknown = chr(0) + chr(base)
        self.automaton = ahocorasick.Automaton()
        for own, n, did, at in phrases:
            spelt = self.spelt(own)
            for i in range(n):
                phrase, place = spelt[2 * i : 2 * (i + words)], (did, at + i)
                # Rows of one doc_id may bring a phrase at a later place as well.
                if place < self.automaton.get(phrase, (math.inf, 0)):
                    self.automaton.add_word(phrase, place)
        self.automaton.make_automaton()

    def spelt(self, own: list[bytes]) -> str:
        get, unknown = self.letters.get, self.unknown
        return "".join([get(w, unknown) for w in own])

    def occurrences(self, own: list[bytes]) -> Iterator[tuple[int, tuple[int, int]]]:
        """Starts of phrases with the phrases' first places."""
        for end, first in self.automaton.iter(self.spelt(own)):
            yield (end + 1) // 2 - self.words, first


def located(rows: DataFrame, words: int) -> DataFrame:
    """Streams each group's stretches through the automaton of its phrases: (did, tid, start, stop) of the later occurrences."""

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, phrases, automaton = None, [], None
        for part in parts:
            dids, tids, starts, stops = [], [], [], []
            columns = (part[c] for c in ("shard", "part", "salt", "phrase", "did", "tid", "at", "n", "words"))
            for shard, piece, salt, phrase, did, tid, at, n, text in zip(*columns):
                if group != (shard, piece, salt):
                    group, phrases, automaton = (shard, piece, salt), [], None
                own = text.split()
                if phrase:
                    phrases.append((own, n, did, at))
                    continue
                if automaton is None:
                    automaton, phrases = Automaton(phrases, words) if phrases else (), []
                if not automaton:
                    continue
                stop = -1
                for i, first in automaton.occurrences(own):
                    if first < (did, at + i):
                        if at + i > stop:
                            dids.append(did)
                            tids.append(tid)
                            starts.append(at + i)
                            stops.append(0)
                        stops[-1] = stop = at + i + words
            if dids:
                yield pd.DataFrame({"did": dids, "tid": tids, "start": starts, "stop": stops})

    return rows.mapInPandas(emit, "did long, tid long, start int, stop int")


def repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(did, tid, spans) of the texts with words to remove; spans (array of start, stop, in words from 0) may overlap or touch."""
    texts = keyed(docs).where("text is not null").select("did", "tid", F.col("text").cast("binary").alias("text"))
    found = settled(sampled(texts, words))
    # A copy of a whole text: all of its windows start earlier, in the text's first row.
    held = found.where(-F.col("at") - 1 >= words).select("did", "tid", "digest", (-F.col("at") - 1).alias("size"))
    firsts = held.groupBy("digest").agg(F.min(F.struct("did", "tid")).alias("first"), F.count(F.lit(1)).alias("rows"))
    copies = held.join(firsts.where("rows > 1").drop("rows"), "digest").where("did > first.did")
    copied = copies.select("did", "tid", F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("stop"))).alias("spans")).distinct()
    owners = firsts.select("first.did", "first.tid")

    places = found.where("at >= 0").select("key", "tid", "at")
    place = F.col("tid").bitwiseAND(~0xFFFFFF).bitwiseOR(F.col("at").bitwiseAND(0xFFFFFF).cast("long"))
    spread = places.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b")
    home = F.xxhash64(F.shiftright("a", 24), F.floor(F.col("a").bitwiseAND(0xFFFFFF) / BLOCK))
    keys = settled(spread.select("key", home.alias("home")))
    shards = max(1, math.ceil(keys.count() * (words - RUN + 2) / PHRASES))
    placed = places.join(keys, "key").groupBy("tid").agg(F.collect_set(F.shiftleft(F.pmod("home", F.lit(shards).cast("long")), 32) + F.col("at")).alias("places"))
    looked_at = texts.join(placed.join(owners, "tid").select("did", "tid", "places"), ["did", "tid"])
    pieces = settled(stretches(looked_at, words))

    phrases = settled(confirmed(pieces, words))
    sizes = phrases.groupBy("shard").agg(F.count(F.lit(1)).alias("phrases"))
    loads = pieces.groupBy("shard").agg(F.sum("n").alias("load"))
    plan = sizes.join(loads, "shard").select(
        "shard", F.when(F.col("phrases") <= 2 * PHRASES, 1).otherwise(F.ceil(F.col("phrases") / PHRASES)).cast("long").alias("parts"), F.ceil(F.col("load") / LOAD).cast("long").alias("salts")
    )
    plan = settled(plan)
    # A phrase's words are those of its first place; runs of phrases travel as one row. Where rows of one doc_id differ, each
    # of them gives what starts at that place: all of it comes before any later place.
    wanted = phrases.groupBy("shard", "did").agg(F.collect_set("at").alias("starts"))
    runs = pieces.join(wanted, ["shard", "did"]).select(*pieces.columns, "starts").mapInPandas(lambda parts: cut_runs(parts, words), STRETCH)
    both = runs.withColumn("phrase", F.lit(True)).unionByName(pieces.withColumn("phrase", F.lit(False)))
    spread_out = both.join(plan, "shard").select(*pieces.columns, "phrase", "parts", "salts")
    spread_out = spread_out.withColumn("part", F.lit(0).cast("long")) if plan.where("parts > 1").isEmpty() else dealt(spread_out, words)
    salt = F.when(F.col("phrase"), F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("did", "tid", "at"), F.col("salts"))))
    salted = spread_out.withColumn("salt", F.explode(salt)).drop("parts", "salts")
    streamed = salted.repartition("shard", "part", "salt").sortWithinPartitions("shard", "part", "salt", F.desc("phrase"))
    spans = located(streamed, words).groupBy("did", "tid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return spans.unionByName(copied)


def cut_runs(parts: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    """Stretches with the starts of their text's phrases -> runs of successive phrases."""
    for part in parts:
        out = []
        for shard, did, tid, at, n, text, starts in zip(part["shard"], part["did"], part["tid"], part["at"], part["n"], part["words"], part["starts"]):
            mine = np.sort(np.asarray(starts))
            mine = mine[np.searchsorted(mine, at) : np.searchsorted(mine, at + n)]
            if not len(mine):
                continue
            own = text.split()
            for run in np.split(mine, np.flatnonzero(np.diff(mine) != 1) + 1):
                a = int(run[0]) - at
                out.append((shard, did, tid, int(run[0]), len(run), b" ".join(own[a : a + len(run) + words - 1])))
        if out:
            yield pd.DataFrame(out, columns=["shard", "did", "tid", "at", "n", "words"])


def without_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Each row with doc (struct of all columns), n_words, spans (merged, in words from 0) and kept (the words outside them).

    ``docs`` holds (doc_id long, text) and any other columns. Words are what ASCII blanks separate. A word goes if it lies in a
    window of ``words`` words whose sequence also starts earlier: at a smaller doc_id or, in the same document, further left.
    A null doc_id counts as the greatest one; rows of one doc_id are one document, so that what starts at one place in several
    of them is not earlier in any. Null and empty texts have no words and keep "", texts shorter than a window are kept whole,
    texts of any length are read whole, and an empty table gives no rows. Windows are judged on the input. They are confirmed
    by 128-bit hashes, whole texts by SHA-256, and located word by word.
    """
    if words <= RUN:
        raise ValueError(f"windows must have more than {RUN} words")
    rows = keyed(docs.select(whole(docs), "doc_id", "text")).select("doc", "did", "tid", "text")

    @pandas_udf("n_words long, spans array<struct<start: int, stop: int>>, kept string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        counts, merged, kept = [], [], []
        for text, found in zip(texts, spans):
            own = text.split() if text is not None else []
            union: list[dict[str, int]] = []
            for s in sorted(found, key=lambda s: s["start"]) if found is not None else ():
                if union and s["start"] <= union[-1]["stop"]:
                    union[-1]["stop"] = max(union[-1]["stop"], int(s["stop"]))
                else:
                    union.append({"start": int(s["start"]), "stop": int(s["stop"])})
            counts.append(len(own))
            for s in reversed(union):
                del own[s["start"] : s["stop"]]
            merged.append(union)
            kept.append(b" ".join(own).decode("utf-8", "replace"))
        return pd.DataFrame({"n_words": counts, "spans": merged, "kept": kept})

    joined = rows.join(repeats(docs, words), ["did", "tid"], "left")
    return joined.select("doc", cut(F.col("text").cast("binary"), "spans").alias("_c")).select("doc", "_c.n_words", "_c.spans", "_c.kept")
