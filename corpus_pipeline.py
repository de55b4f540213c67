"""A corpus pipeline of five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.llm import decontaminate, language, lines, packing, parity_join
from talkgrid.session import remove, shared_folder

#: Documents whose likeliest language has a smaller share are rejected; on the check's 51,282 and 256,410 documents that and the
#: texts without a letter are one document each.
LEAST_SHARE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), and those that no language explains, go; lang becomes the prediction."""
    model = language.fit(docs)
    found = language.identify(docs, model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= LEAST_SHARE))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go, and documents of which nothing is left; null and empty texts stay as they are."""
    kept = lines.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their 5-word shingles the one with the least doc_id stays; so do texts without a word, each once."""
    return parity_join.keep_first(docs, width=5, threshold=(8, 10))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage near a benchmark item go; null and empty texts stay."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null or empty text is a piece of the end id alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: The stages have no SQL form; they are tested against brute force on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, which stay in the shared folder; what the others have written goes as soon as the next one has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
