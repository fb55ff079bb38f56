"""A corpus pipeline of five stages; each stage's rows are written as Parquet and read again by the next.

quality (7) drops documents that the classifier rejects, lines (10) takes
cross-site boilerplate lines out, near_duplicates (6) keeps the first document of each
class, decontaminate (8) drops documents that contain a benchmark item, encode (5)
returns the token ids of what is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import byte_pair, containment, discriminant, line_spread, order_minhash
from granary.llm.queries import vocabulary
from granary.llm.tables import deleted, read, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as of the text now (null for a null text); extra columns do not go on."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected rows go by id and text, so of several rows under one id each has its own verdict; rows with a null id go or stay like others."""
    scored = discriminant.quality_scores(docs, read(spark, sf_dir, "labels"))
    gone = scored.filter("predicted = 0").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return documents(docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash")), "left_anti"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose every line stands in another document go; all others stay."""
    cleaned = line_spread.without_boilerplate(docs)
    return documents(cleaned.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t-\r]")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each class stays; rows of one id are one document; rows with a null id stay."""
    return documents(order_minhash.one_of_each(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain an item go by id and text; rows with a null id, null texts and empty ones stay."""
    return documents(containment.without_benchmark(docs, read(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row, null texts as empty ones; the text and the other columns do not go on."""
    return byte_pair.bpe_round_trip(docs, vocabulary(), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: The classifier, the near-duplicate classes and the encoder have no SQL form; tests hold the stages to plain loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between is written to the shared folder, and goes once the next stage is written."""
    docs = read(spark, sf_dir, "documents")
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.parquet(f"{root}/{i}-{name}")
        if i:
            deleted(spark, f"{root}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
