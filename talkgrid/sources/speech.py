"""Deterministic words, segments and recordings over the test tables, in whole milliseconds.

The made-up columns are arithmetic on ordinals, given as expressions that Spark
and DuckDB read alike; the operators and their SQL are written apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.sources import adapters as A

_TIMED = "(word_ord * 7 + seg_ord) % 23 <> 0"
WORD = {
    "s": f"CASE WHEN {_TIMED} THEN s0 + 400 * word_ord END",
    "e": f"CASE WHEN {_TIMED} THEN s0 + 400 * word_ord + CASE WHEN (word_ord + seg_ord) % 31 = 0 THEN 0 ELSE 250 + (word_ord * 37 + seg_ord * 11) % 200 + CASE WHEN (word_ord * 3 + seg_ord) % 61 = 5 THEN 1700 ELSE 0 END END END",
    "score": "CASE WHEN (word_ord + seg_ord) % 10 = 9 THEN NULL ELSE (word_ord * 13 + recording_id) % 100 END",
    "speaker": "CASE WHEN (word_ord + seg_ord) % 11 = 0 THEN NULL WHEN (word_ord + 3 * seg_ord) % 17 IN (3, 4) THEN 'SPK_X' ELSE role END",
    "local_speaker": "CASE WHEN (word_ord + 2 * seg_ord) % 13 = 0 THEN NULL ELSE 'L_' || role END",
    "secondary": "CASE WHEN (seg_ord * 5 + word_ord) % 9 = 2 THEN NULL WHEN (seg_ord * 5 + word_ord) % 9 < 2 OR seg_ord % 7 = 3 THEN 'L_other' ELSE 'L_' || role END",
    "ambiguous": "(seg_ord * 3 + word_ord) % 19 = 0",
    "identity": "CASE WHEN seg_ord % 5 = 1 THEN 'human_verified' WHEN (seg_ord + word_ord) % 29 = 0 THEN 'unresolved_no_match' WHEN seg_ord % 5 = 2 THEN 'matched' END",
}
SEGMENT = {
    "s": "CASE WHEN seg_ord % 19 = 0 THEN NULL ELSE s0 END",
    "e": "CASE WHEN seg_ord % 17 = 0 THEN NULL WHEN seg_ord % 41 = 0 THEN s0 - 100 ELSE e0 END",
    "speaker": "CASE WHEN seg_ord % 23 = 0 THEN NULL ELSE role END",
    "local_speaker": "CASE WHEN seg_ord % 6 = 0 THEN NULL ELSE 'L_' || role END",
    "identity": "CASE WHEN seg_ord % 5 = 1 THEN 'human_verified' WHEN seg_ord % 7 = 2 THEN 'unresolved_ambiguous' END",
    "confidence": "CASE WHEN seg_ord % 4 = 0 THEN NULL ELSE (seg_ord * 37) % 100 END",
    "line": "CASE WHEN seg_ord % 37 = 0 THEN '  ' ELSE text END",
}
#: What a recognizer says of a segment: log probability and no-speech probability in thousandths.
DIAGNOSTIC = {
    "ds": "s0 + (seg_ord * 13) % 300 - 150",
    "de": "e0 + (seg_ord * 29) % 500 - 250",
    "logprob": "-((seg_ord * 211) % 1400)",
    "no_speech": "(seg_ord * 97) % 800",
}


#: The recognizer's own time of a word, where it is paired with one.
PAIR = {
    "p_s": "CASE WHEN (word_ord + seg_ord) % 3 <> 0 THEN s + (word_ord * 53 + seg_ord * 17) % 1000 - 100 END",
    "p_e": "CASE WHEN (word_ord + seg_ord) % 3 <> 0 THEN e + (word_ord * 31 + seg_ord * 7) % 900 - 50 END",
    "p_diag": "CASE WHEN (word_ord + seg_ord) % 3 <> 0 THEN seg_ord END",
}
#: What a refinement has found about a piece.
CANDIDATE = {
    "decision": "CASE WHEN ord % 4 = 0 THEN 'abstained_sortformer_disagreement' WHEN ord % 4 = 1 THEN 'abstained_below_confidence_threshold' WHEN ord % 4 = 2 THEN 'abstained_candidate_voice_ambiguous' ELSE 'corrected' END",
    "strategy": "CASE WHEN ord % 3 = 0 THEN 'bracketed_utterance' ELSE 'word_run' END",
    "seam": "ord % 5 = 0",
}
#: Evidence windows of a piece, and measured features of a turn: level and change in hundredths of dB, pitch variation in thousandths.
WINDOW = {"retained": "ord % 4 <> 0", "disagreement": "ord % 5 = 0", "agreement": "ord % 10 = 0", "suggested": "CASE WHEN ord % 6 = 1 THEN 'user' WHEN ord % 6 = 2 THEN 'assistant' END"}
FEATURE = {"level": "-((turn_ord * 1370 + recording_id * 91) % 4100)", "change": "(turn_ord * 211) % 1500 - 700", "pitch": "CASE WHEN turn_ord % 7 = 0 THEN NULL ELSE (turn_ord * 53) % 400 END"}
#: Tone scores in thousandths of a window that begins at w_s, the best first.
_P = "(500 + (turn_ord * 37 + w_s * 3) % 500)"
_LABELS = ("angry", "happy", "sad", "neutral", "unknown")
_LABEL = lambda k: "CASE (turn_ord * 3 + w_s + {}) % 5 ".format(k) + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LABELS)) + " END"
TONE = {
    "l0": _LABEL(0), "p0": _P, "l1": _LABEL(1), "p1": f"(1000 - {_P}) - (1000 - {_P}) % 7", "l2": _LABEL(2), "p2": f"(1000 - {_P}) % 7",
    "confirmed": "(turn_ord + w_s) % 4 <> 0", "eligible": "turn_ord % 6 <> 5", "model": "CASE WHEN turn_ord % 9 = 0 THEN 'other' ELSE 'emotion2vec/emotion2vec_plus_large' END",
}


def made(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with made-up columns."""
    return df.select("*", *[F.expr(e).alias(n) for n, e in columns.items()])


def made_sql(columns: dict[str, str]) -> str:
    return _select(columns)


def _ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return A.segments(spark, sf_dir).select("recording_id", F.col("seg_ord").cast("long").alias("seg_ord"), ms("start").alias("s0"), ms("end").alias("e0"), F.col("speaker").alias("role"), "text")


def _made(df: DataFrame, columns: dict[str, str], *keep: str) -> DataFrame:
    return df.select(*keep, *[F.expr(e).alias(n) for n, e in columns.items()])


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, seg_ord, word_ord, text and the columns of WORD."""
    rows = _ms(spark, sf_dir).select("recording_id", "seg_ord", "s0", "role", F.posexplode(F.split("text", r"\s+")).alias("word_ord", "text"))
    rows = rows.where("seg_ord % 43 <> 0")  # recognized without words
    return _made(rows.withColumn("word_ord", F.col("word_ord").cast("long")), WORD, "recording_id", "seg_ord", "word_ord", "text")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, seg_ord, text and the columns of SEGMENT."""
    return _made(_ms(spark, sf_dir), SEGMENT, "recording_id", "seg_ord").withColumnRenamed("line", "text")


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, diag_ord, s, e, logprob, no_speech, text."""
    return _made(_ms(spark, sf_dir), DIAGNOSTIC, "recording_id", F.col("seg_ord").alias("diag_ord"), "text").withColumnsRenamed({"ds": "s", "de": "e"})


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, ord, s, e, speaker, secondary of the events."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return A.timeline(spark, sf_dir).select("recording_id", "ord", ms("start").alias("s"), ms("end").alias("e"), "speaker", "secondary")


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


MS_SQL = A.SEGMENTS_SQL + ', ms0 AS (SELECT recording_id, seg_ord, round(start * 1000)::BIGINT AS s0, round("end" * 1000)::BIGINT AS e0, speaker AS role, text FROM segments)'
WORDS_SQL = (
    MS_SQL
    + f""", w0 AS (SELECT recording_id, seg_ord, s0, role, unnest(regexp_split_to_array(text, '\\s+')) AS text, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) - 1 AS word_ord FROM ms0),
words AS (SELECT recording_id, seg_ord, word_ord, text, {_select(WORD)} FROM w0 WHERE seg_ord % 43 <> 0)"""
)
SEGS = f"segs AS (SELECT recording_id, seg_ord, {_select(SEGMENT)} FROM ms0)"
DIAGNOSTICS = f"diag AS (SELECT recording_id, seg_ord AS diag_ord, text, {_select(DIAGNOSTIC)} FROM ms0)"
TIMELINE_SQL = A.TIMELINE_SQL + """, tm AS (SELECT recording_id, ord, round(start * 1000)::BIGINT AS s, round("end" * 1000)::BIGINT AS e, speaker, secondary FROM timeline)"""
