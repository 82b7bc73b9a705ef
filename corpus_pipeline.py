"""From raw documents to training shards: language, near duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows
are dropped only by a stage's own decision: texts without a clear language, all but one document of each near-duplicate
group, documents that hold benchmark items, and documents that the mixture does not take. Texts of any length are read whole,
an empty table stays empty, and other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm import decontamination, language, mixing, sharding, simhash
from fieldtrace.llm.labels import remainder
from fieldtrace.sources.writers import settled

SHARDS = 40
#: SQL cannot say these stages; tests/llm compares each, and all of them in turn, with plain versions.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression can tell; the dictionaries are learned from the stage's own rows.

    Null and empty texts and those without a letter have no language and go; so do all rows if none has a text and a lang.
    """
    learned = language.train(docs.where(remainder(F.col("doc_id"), 4) != 2))
    return language.identified(docs, learned).where("not rejected").select("doc.*")


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates.

    A null id comes last; rows equal in doc_id and text are one document, which stays once whatever their other columns hold.
    Null, empty and blank texts are one group.
    """
    return simhash.without_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and with no items all documents stay."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target takes it.

    Null and empty texts have no words and are never taken; a null source is one of its own; repeated rows are taken one by one.
    """
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with shard and slot; columns of those names are replaced.

    Every row has its place: repeated rows, null ids and null or empty texts (of 16 bytes) as well. Slots follow a hash of the
    ids, so rows of one document that the mixture took several times stand together.
    """
    placed = sharding.kd_shards(docs, shards=SHARDS)
    own = [F.col(f"doc.`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*own, "shard", "slot")


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between stages the rows are written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settled(docs)
    return docs
