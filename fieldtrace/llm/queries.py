"""The operators as queries over the test tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.llm import decontamination, language, lexical, mixing, phrases, quality, sharding, simhash, suffixes, tokens, topk, toxicity, whitening
from fieldtrace.llm.labels import labelled, remainder
from fieldtrace.registry.book import Book, r6

BOOK = Book()


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def knots_sql(share: str, knots) -> str:
    """The inverse of a schedule's integral, as mixing.due says it."""
    areas = [(b + a) / 2 * (t - s) for (s, a), (t, b) in zip(knots, knots[1:])]
    total, before, cases = sum(areas), 0.0, []
    for ((s, a), (t, b)), area in zip(zip(knots, knots[1:]), areas):
        rest = f"(({share}) * {total!r}::DOUBLE - {before!r}::DOUBLE)"
        slope = 2 * (b - a) / (t - s)
        at = f"{s!r}::DOUBLE + 2.0::DOUBLE * {rest} / ({a!r}::DOUBLE + sqrt(greatest({a * a!r}::DOUBLE + {slope!r}::DOUBLE * {rest}, 0.0::DOUBLE)))"
        cases.append(f"WHEN {rest} < {area!r}::DOUBLE THEN {at}")
        before += area
    return f"CASE {' '.join(cases)} ELSE {knots[-1][0]!r}::DOUBLE END"


def op4_sql() -> str:
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    share = "(CASE WHEN full_rounds > 0 THEN before WHEN filler THEN based ELSE before END)::DOUBLE / (full_rounds * source_size + based + last_size)"
    times = " ".join(f"WHEN {i} THEN {knots_sql(share, k)}" for i, k in enumerate(mixing.SCHEDULES))
    n = len(mixing.SCHEDULES)
    return f"""WITH sized AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
               md5(CAST(doc_id AS VARCHAR) || '{mixing.SEED}') AS key FROM documents),
    totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM totals),
    weighed AS (SELECT *, (CASE place % {len(mixing.WEIGHTS)} {weight} END)::DOUBLE AS weight FROM placed),
    dense AS (SELECT *, CASE WHEN source_size = 0 THEN 'inf'::DOUBLE ELSE weight / source_size END AS dense FROM weighed),
    leveled AS (SELECT *, row_number() OVER o AS pos,
        ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM dense WINDOW o AS (ORDER BY dense DESC, place)),
    final AS (SELECT arg_min(level, pos) AS level FROM leveled WHERE level * weight <= source_size::DOUBLE * 3),
    goals AS (SELECT source, source_size, place, least(source_size::DOUBLE * 3, coalesce((SELECT level FROM final) * weight, 0.0::DOUBLE)) AS target FROM leveled),
    rounds AS (SELECT *, (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS full_rounds FROM goals),
    laid AS (SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.place, r.full_rounds, r.target - r.full_rounds * r.source_size AS rest,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM sized s JOIN rounds r ON s.source IS NOT DISTINCT FROM r.source),
    based AS (SELECT *, before + size <= rest AS base, sum(CASE WHEN before + size <= rest THEN size ELSE 0 END) OVER (PARTITION BY source)::BIGINT AS based FROM laid),
    gap AS (SELECT *, abs(size - (rest - based)) AS miss, rest - based AS gap FROM based),
    pick AS (SELECT *, CASE WHEN NOT base AND size > 0 AND miss < gap THEN row_number() OVER (PARTITION BY source, (NOT base AND size > 0 AND miss < gap) ORDER BY miss, before) END AS n FROM gap),
    taken AS (SELECT *, coalesce(n = 1, false) AS filler, coalesce(max(CASE WHEN n = 1 THEN size END) OVER (PARTITION BY source), 0)::BIGINT AS last_size FROM pick),
    counted AS (SELECT *, CASE WHEN size > 0 THEN full_rounds + (base OR filler)::INT ELSE 0 END AS copies FROM taken)
    SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::INT AS copies,
        CASE WHEN copies > 0 THEN round(CASE place % {n} {times} END, 6) + 0.0::DOUBLE END AS first_position FROM counted"""


@BOOK.query("op1_toxicity_scores")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(*labelled(docs, table(spark, sf_dir, "labels"), "toxic", 3, 1, toxicity.SAMPLE_ROWS))
    found = toxicity.scored(docs, model, 0.7)
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@BOOK.query("op2_compression_language")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = remainder(F.col("doc_id"), 4) == 2
    learned = language.train(docs.where(~held))
    found = language.identified(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@BOOK.query("op7_latent_leaks")
def op7(spark, sf_dir):
    """Documents that hold benchmark items, exactly or reworded; clean ones have no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.with_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") > 0)
    return found.select("doc_id", F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"), r6(F.array_max(F.transform("leaks", lambda x: x["share"]))).alias("share"))


@BOOK.query("op8_quality_scores")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample, _ = labelled(docs, table(spark, sf_dir, "labels"), "quality", 5, 0, quality.SAMPLE_ROWS)
    model = quality.train(sample)
    found = quality.scored(docs, model, 0.3)
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


#: Where the box keeps the files of public tokenizers.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@BOOK.query("op3_viterbi_tokens")
def op3(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY).select("doc_id", "tokens")


@BOOK.query("op4_curriculum_mix", op4_sql())
def op4(spark, sf_dir):
    """The plan of each document as the mixture, written whole and in training order, holds it."""
    found = mixing.delivered(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies", r6("first_position").alias("first_position"))


@BOOK.query("op5_simhash_groups")
def op5(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@BOOK.query("op6_kd_shards")
def op6(spark, sf_dir):
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=40, carry=False)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@BOOK.query("op9_suffix_repeats")
def op9(spark, sf_dir):
    """Documents with passages of 50 words or more that others share; the rest have no row."""
    spans = suffixes.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.sum(F.col("stop") - F.col("start")).cast("long")
    listed = F.sort_array(F.collect_list(F.struct("start", "stop")))
    return spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("passages"), size.alias("repeated_words"), listed.alias("spans"))


OP10_SQL = """WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20"""


@BOOK.query("op10_block_top_k", OP10_SQL)
def op10(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


OP13_SQL = f"""WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical.TERMS}')) AS term FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY doc_id)::BIGINT AS n FROM terms GROUP BY doc_id, term),
totals AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS words FROM terms),
asked AS (SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical.TERMS}')) AS term FROM benchmark)
    GROUP BY item_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, totals GROUP BY term, docs),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
    FROM asked JOIN counted USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10"""


@BOOK.query("op13_ranked_lexical_search", OP13_SQL)
def op13(spark, sf_dir):
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@BOOK.query("op11_embedding_whitening")
def op11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whitening.shifted(F.col("embedding")).alias("v"))
    found = whitening.whitened(vectors, most=16)
    return found.select(
        F.col("doc.vec_id").alias("vec_id"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "c"),
    ).select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


OP12_SQL = """WITH split AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM split),
windows AS (SELECT *, count(*) OVER w AS n, md5(string_agg(word, ' ') OVER w) AS k FROM words
    WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
late AS (SELECT doc_id, i, word, (n = 20 AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1)::INTEGER AS late FROM windows),
gone AS (SELECT *, max(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM late),
texts AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN texts USING (doc_id)"""


@BOOK.query("op12_phrase_automata", OP12_SQL)
def op12(spark, sf_dir):
    found = phrases.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(F.col("doc.doc_id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
