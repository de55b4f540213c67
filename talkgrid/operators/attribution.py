"""Whose speech it is: exclusive spans, label votes, choices at a point, sentence continuations. Times are in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.functions import text as T
from talkgrid.operators import intervals as I

#: Milliseconds cut off at both ends of exclusive speech, and the least length that must be left; neighbours so near are one.
TRIM_MS, LEAST_MS, JOIN_MS = 80, 500, 80
#: A word is spoken from so long before its time until so long after it; pauses so long are speech too.
PAD_MS, PAUSE_MS = 60, 350
#: Per cent of a word that its label must cover, and lead over the next label.
COVER, LEAD = 60, 15
#: Milliseconds of a join bucket.
WIDTH_MS = 60_000


def in_ms(rows: DataFrame) -> DataFrame:
    """rows with start and end as whole milliseconds; null times are 0, and no end is before its start."""
    ms = lambda c: F.coalesce(F.greatest(F.round(F.col(c) * 1000).cast("long"), F.lit(0)), F.lit(0).cast("long"))
    return rows.withColumn("start", ms("start")).withColumn("end", F.greatest(F.col("start"), ms("end")))


def solo(timeline: DataFrame) -> DataFrame:
    """recording_id, speaker, start, end: the longest spans in which one speaker alone is active.

    Edges of the merged intervals are swept in order of time, so no row meets
    the rows that it overlaps.
    """
    merged = I.merge(timeline, ["recording_id", "speaker"]).withColumn("id", F.row_number().over(Window.partitionBy("recording_id").orderBy("start", "end", "speaker")).cast("long"))
    edge = lambda at, by: merged.select("recording_id", F.col(at).alias("t"), F.lit(by).cast("long").alias("n"), (F.col("id") * by).alias("who"))
    edges = edge("start", 1).union(edge("end", -1)).groupBy("recording_id", "t").agg(F.sum("n").alias("n"), F.sum("who").alias("who"))
    w = Window.partitionBy("recording_id").orderBy("t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    spans = edges.select("recording_id", F.col("t").alias("a"), F.lead("t").over(w).alias("b"), F.sum("n").over(so_far).alias("active"), F.sum("who").over(so_far).alias("id"))
    # of the one active interval the sum is the id
    return spans.where("active = 1").join(merged.select("recording_id", "id", "speaker"), ["recording_id", "id"]).select("recording_id", "speaker", F.col("a").alias("start"), F.col("b").alias("end"))


def exclusive(timeline: DataFrame) -> DataFrame:
    """What of each row no other speaker overlaps, trimmed, long enough, and merged by speaker; n_rows different pieces each."""
    rows = in_ms(timeline).select("recording_id", "speaker", "start", "end")
    pairs = I.interval_join(rows, solo(rows), "recording_id", WIDTH_MS).where("speaker = r_speaker")
    alone = pairs.select("recording_id", "speaker", F.greatest("start", "r_start").alias("s"), F.least("end", "r_end").alias("e")).distinct().withColumn("part", F.col("s"))
    # an empty row of another speaker cuts, too
    points = rows.where("start = end").select("recording_id", "speaker", F.col("start").alias("s"), F.col("end").alias("e"))
    cut = I.subtract(alone.withColumn("until", F.col("e")), points, ["recording_id", "speaker", "part", "until"], apart="speaker")
    # pieces of different ends may be equal once they are cut
    pieces = cut.select("recording_id", "speaker", (F.col("s") + TRIM_MS).alias("start"), (F.col("e") - TRIM_MS).alias("end")).distinct()
    return I.merge(pieces.where(F.col("end") - F.col("start") >= LEAST_MS), ["recording_id", "speaker"], JOIN_MS)


def recognized_speech(words: DataFrame) -> DataFrame:
    """Spans of lexical words, padded and merged over short pauses; n_rows words each."""
    rows = in_ms(words).where(T.is_lexical(F.col("text")))
    padded = rows.select("recording_id", "speaker", F.greatest(F.col("start") - PAD_MS, F.lit(0)).alias("start"), (F.col("end") + PAD_MS).alias("end"))
    return I.merge(padded, ["recording_id", "speaker"], PAUSE_MS)


def label_votes(words: DataFrame, labels: DataFrame) -> DataFrame:
    """recording_id, ord, label, ambiguous of words(recording_id, ord, start, end) by labels(recording_id, start, end, label).

    The label that covers most of a word wins, if it covers enough and leads
    by enough; a word that labels overlap without a winner is ambiguous. A null
    label overlaps but never wins.
    """
    words = in_ms(words).select("recording_id", "ord", "start", "end")
    pairs = I.interval_join(words, in_ms(labels).select("recording_id", "start", "end", "label"), "recording_id", WIDTH_MS)
    shared = F.when(F.col("r_label").isNull(), 0).otherwise(F.least("end", "r_end") - F.greatest("start", "r_start"))
    votes = pairs.groupBy("recording_id", "ord", "start", "end", F.col("r_label").alias("label")).agg(F.sum(shared).alias("ms"))
    # at most one row per label of a word
    ranked = votes.groupBy("recording_id", "ord", "start", "end").agg(F.sort_array(F.collect_list(F.struct("ms", "label")), asc=False).alias("v"))
    best, second, length = F.col("v")[0], F.coalesce(F.get("v", F.lit(1))["ms"], F.lit(0)), F.col("end") - F.col("start")
    wins = (best["ms"] > 0) & (100 * best["ms"] >= COVER * length) & (100 * (best["ms"] - second) >= LEAD * length)
    won = ranked.select("recording_id", "ord", F.when(wins, best["label"]).alias("label"), (~wins).alias("ambiguous"))
    return words.select("recording_id", "ord").join(won, ["recording_id", "ord"], "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def choices_at(words: DataFrame, turns: DataFrame) -> DataFrame:
    """recording_id, ord, choice: the choice of the turn in which the middle of a word lies.

    turns(recording_id, speaker, ord, start, end, choice) of the word's speaker
    count: the first by ord with start <= middle < end, else the last that ends
    there. Points meet turns in buckets of time.
    """
    # twice the milliseconds, so that the middle is whole
    points = in_ms(words).select("recording_id", "speaker", "ord", (F.col("start") + F.col("end")).alias("m"))
    spans = in_ms(turns).select("recording_id", "speaker", (2 * F.col("start")).alias("a"), (2 * F.col("end")).alias("b"), F.struct("ord", "choice").alias("turn"))
    bucket = lambda c: F.floor(F.col(c) / (2 * WIDTH_MS))
    spread = spans.withColumn("bucket", F.explode(F.sequence(bucket("a"), bucket("b"))))
    met = points.withColumn("bucket", bucket("m")).join(spread, ["recording_id", "speaker", "bucket"]).where("a <= m and m <= b")
    first, last = F.min(F.when(F.col("m") < F.col("b"), F.col("turn"))), F.max(F.when(F.col("m") == F.col("b"), F.col("turn")))
    chosen = met.groupBy("recording_id", "ord").agg(F.coalesce(first, last)["choice"].alias("choice"))
    return points.select("recording_id", "ord").join(chosen, ["recording_id", "ord"], "left")


def differences(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """key and status (missing, unexpected, changed) of rows that are not alike in both tables; keys are unique."""
    x, y = expected.select(key, F.col(value).alias("x"), F.lit(True).alias("in_x")), actual.select(key, F.col(value).alias("y"), F.lit(True).alias("in_y"))
    status = F.when(F.col("in_y").isNull(), "missing").when(F.col("in_x").isNull(), "unexpected").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return x.join(y, key, "full_outer").select(key, status.alias("status")).where("status is not null")
