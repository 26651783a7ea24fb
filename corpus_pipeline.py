"""Five stages from raw documents to a mix: toxicity, near duplicates, leaks, secrets, source weights.

Each stage works on all rows that the one before kept and, but for the last, returns the columns of
``documents``. SQL cannot express the learned, hashed and edit-distance stages, so ``ORACLE_SQL`` is
None and the stages are tested one by one against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devprism.llm import leaks, mixing, neardup, secrets, toxicity
from devprism.llm.common import pick
from devprism.runtime import land

COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
#: A document is rejected as toxic from this score on.
TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity bound. Learns from all labelled documents of the input.

    Null and empty texts are below it; repeated rows and rows without an id are each scored and stay as they are.
    Without labels of both classes nothing is dropped. An empty table gives no rows.
    """
    docs = pick(docs, **COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.toxicity_score(F.col("text"), model) < TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group over 5-word shingles with a similarity of 0.8 or more.

    Repeated rows stay once, copies without an id too; null texts and texts without words are in no group and stay.
    An empty table gives no rows.
    """
    docs = pick(docs, **COLUMNS)
    return neardup.one_of_each(docs, neardup.Settings(words=5, percent=80))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none, nor does any text if the benchmark is empty. Rows without an id are judged
    by their text like others, repeated rows all stay or all go. An empty table gives no rows.
    """
    return leaks.without_leaks(pick(docs, **COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and lengths set anew where a text changed.

    Null and empty texts, repeated rows and rows without an id stay as they are. An empty table gives no rows.
    """
    docs = pick(docs, **COLUMNS).withColumn("masked", secrets.masked(F.col("text")))
    length = F.coalesce(F.char_length("masked").cast("bigint"), "n_chars")
    return docs.select("doc_id", F.coalesce("masked", "text").alias("text"), "lang", "source", length.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words taken from each and the pieces of its output shards.

    Texts without words, null ones too, have nothing to take and go. A null source is a source of its own, the last.
    Rows without an id and repeated rows are taken like others. An empty table gives no rows.
    """
    mixed = mixing.mix(docs, keep={"lang": "string", "n_chars": "bigint"})
    rows = mixed.withColumn("taken", mixing.taken(F.col("pieces"))).filter("taken > 0")
    return rows.select(*COLUMNS, "size", "source_size", "target", "taken", "pieces")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
