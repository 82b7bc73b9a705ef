"""The whole pipeline against plain versions of its five stages, one after the other."""

import random
import zlib

import duckdb
import pandas as pd
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as P
from fieldtrace.llm import decontamination, language, sharding
from fieldtrace.llm.queries import op4_sql

from .conftest import prose
from .test_brute_force import coordinates, numbered, smallest_encoding, tree
from .test_decontamination import length
from .test_simhash import brute, plain_print


def corpus(seed=17):
    """Unique ids; two languages and texts of neither, copies, near copies, leaks plain and reworded, unlike sources."""
    rng = random.Random(seed)
    names = [f"{a}{b}" for a in "ba ke lo mi nu po ra si to vu".split() for b in "den gal hur jin lok mas ner pik".split()]
    items = [(i, " ".join(rng.choices(names, k=rng.choice([12, 30, 60]))) + ".") for i in range(8)]
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "de"])
        rows.append([i, prose(rng, lang, rng.randint(20, 160)), lang if i % 11 else None, f"s{min(3, rng.randrange(8))}" if i % 13 else None])
    for i in range(150, 170):
        rows.append([i, rows[i - 150][1] + (" tail" if i % 2 else ""), "en", "s0"])
    for i, (_, text) in enumerate(items):
        words = text.split()
        if i % 2:
            words[::9] = ["changed"] * len(words[::9])
        rows.append([200 + i, " ".join([prose(rng, "en", 60), *words, prose(rng, "en", 40)]), "en", "s1"])
    rows += [[300, None, "en", "s1"], [301, "123 ?!", None, "s2"], [302, "", "de", "s0"]]
    return [(*r, len(r[1] or "")) for r in rows], items


def same_print(rows):
    """The row of the smallest id of each group of linked fingerprints."""
    prints = {r[0]: plain_print(r[1]) for r in rows}
    label = {p: p for p in prints.values()}
    links = brute(list(prints.values()), 4)
    for _ in range(len(links) + 1):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    firsts = {}
    for r in rows:
        at = (r[0], xxhash.xxh64(r[1].encode(), seed=42).intdigest())
        firsts.setdefault(label[prints[r[0]]], []).append((at, r))
    return [min(own)[1] for own in firsts.values()]


def leaks(text, items):
    words = [w.decode() for w in decontamination.words_of(text)]
    for _, item in items:
        for unit, answer in decontamination.units_of(item):
            share = length(unit, words) / len(unit)
            if share >= decontamination.SHARED and (share >= decontamination.VERBATIM or length(answer, words) >= decontamination.ANSWERED * len(answer)):
                return True
    return False


def test_the_whole_pipeline(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path)).collect()

    learned = language.train(spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2], schema))
    kept = []
    for r in rows:
        _, margin = smallest_encoding(learned, r[1]) if r[1] and language.LETTER.search(r[1]) else (None, 0.0)
        kept += [r] if margin >= language.MARGIN else []
    assert 0 < len(kept) < len(rows)
    alone = same_print(kept)
    assert len(alone) < len(kept)
    clean = [r for r in alone if not leaks(r[1], items)]
    assert len(clean) == len(alone) - len(items)

    documents = pd.DataFrame(clean, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841 (read by name below)
    con = duckdb.connect()
    con.register("documents", documents)
    copies = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, copies FROM ({op4_sql()})").fetchall()}
    taken = [r for r in clean for _ in range(copies[r[0]])]
    assert len({r[0] for r in taken}) < len(clean) < len(taken) + len(clean)

    frame = spark.createDataFrame(taken, schema)
    dims = frame.select(*(d.cast("double").alias(f"v{i}") for i, d in enumerate(sharding.default_dims(F.col("text"))))).collect()
    placed = coordinates([r[0] for r in taken], [r[1] for r in taken], [[d[i] for d in dims] for i in range(3)])
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) == numbered(tree(placed, 0, P.SHARDS, 3))
    texts = {r[0]: r for r in rows}
    assert all(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) == texts[r["doc_id"]] for r in got)
