"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_harmonic_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrid.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query("op6_parity_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrid.llm.parity_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrid.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_language_mixture")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrid.llm.language import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = fit(docs, ~F.coalesce(held_out, F.lit(False)))
    # only the text goes to the prediction; doc_id is carried along
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


@query("op3_credential_linking")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrid.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


@query("op8_risk_controlled_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrid.llm.quality import filter_quality

    rows = filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumn("failed_rules", F.array_join("failed_rules", ","))


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrid.llm.lines import removed_lines

    rows = removed_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


@query("op5_licence_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrid.llm.licences import find_licences

    return find_licences(table(spark, sf_dir, "documents"))


@query("op7_role_repair")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrid.llm.chat import repair

    return repair(table(spark, sf_dir, "conversations"))


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkgrid.llm.suffix_dedup import remove_repeats

    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
