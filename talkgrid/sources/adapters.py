"""Deterministic views of the test tables as recordings, segments, words, timelines and voices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EVENTS_PER_RECORDING = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, seg_ord, start, end, speaker, text: one row per non-blank line of a conversation."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    lines = lines.where(F.trim("s") != "").withColumn("dur", 400 * F.size(F.split(F.trim("s"), r"\s+")))
    gap = ((F.col("conv_id") * 31 + F.col("turn") * 17 + F.col("line") * 7) % 40) * 100 - 500
    order = Window.partitionBy("conv_id").orderBy("turn", "line")
    begin = F.greatest(F.lit(0), F.coalesce(F.sum(F.col("dur") + gap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return lines.select(
        F.col("conv_id").alias("recording_id"),
        F.row_number().over(order).alias("seg_ord"),
        (begin / 1000.0).cast("double").alias("start"),
        ((begin + F.col("dur")) / 1000.0).cast("double").alias("end"),
        F.col("role").alias("speaker"),
        F.trim("s").alias("text"),
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, ord, start, end, speaker, secondary from events, in milliseconds over 1000."""
    events = table(spark, sf_dir, "events").withColumn("recording_id", F.expr(f"event_id div {EVENTS_PER_RECORDING}"))
    first = Window.partitionBy("recording_id")
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    start = ms - F.min(ms).over(first)
    length = F.floor(F.abs("value") * 1000)
    return events.select(
        "recording_id",
        F.col("event_id").alias("ord"),
        (start / 1000.0).alias("start"),
        ((start + length) / 1000.0).alias("end"),
        F.concat(F.lit("SPK_"), (F.col("user_id") % 3).cast("string")).alias("speaker"),
        F.col("event_type").alias("secondary"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voice, session, vec_id, clean_seconds, verified, embedding of array<double>."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("voice"),
        (F.col("vec_id") % 3).alias("session"),
        "vec_id",
        (F.lit(0.8) + (F.col("vec_id") % 50) / 10.0).alias("clean_seconds"),
        (F.col("vec_id") % 4 != 0).alias("verified"),
        F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label"), 2.0).otherwise(0.0)).alias("embedding"),
    )


#: The same views for DuckDB, as the beginning of a WITH clause.
SEGMENTS_SQL = """
seg0 AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM conversations),
seg1 AS (SELECT *, 400 * len(regexp_split_to_array(trim(s), '\\s+')) AS dur, ((conv_id * 31 + turn * 17 + line * 7) % 40) * 100 - 500 AS gap FROM seg0 WHERE trim(s) <> ''),
seg2 AS (SELECT *, greatest(0, coalesce(sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS b,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) AS seg_ord FROM seg1),
segments AS (SELECT conv_id AS recording_id, seg_ord, (b / 1000.0)::DOUBLE AS start, ((b + dur) / 1000.0)::DOUBLE AS "end", role AS speaker, trim(s) AS text FROM seg2)
"""
TIMELINE_SQL = f"""
tl0 AS (SELECT *, event_id // {EVENTS_PER_RECORDING} AS recording_id, epoch_us(ts) // 1000 AS ms FROM events),
timeline AS (SELECT recording_id, event_id AS ord, (ms - min(ms) OVER (PARTITION BY recording_id)) / 1000.0::DOUBLE AS start,
  (ms - min(ms) OVER (PARTITION BY recording_id) + floor(abs(value) * 1000)::BIGINT) / 1000.0::DOUBLE AS "end",
  'SPK_' || (user_id % 3)::VARCHAR AS speaker, event_type AS secondary FROM tl0)
"""
WINDOWS_SQL = """
windows AS (SELECT label AS voice, vec_id % 3 AS session, vec_id, 0.8::DOUBLE + (vec_id % 50) / 10.0::DOUBLE AS clean_seconds, vec_id % 4 <> 0 AS verified,
  list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE + CASE WHEN i - 1 = label THEN 2.0 ELSE 0.0 END) AS embedding FROM embeddings)
"""
