"""Refinement of speaker labels: which runs of words another voice has spoken. Times are in milliseconds, similarities in thousandths.

The similarities of a run or utterance to the voices' prototypes come from an
encoder outside; everything that is decided from them is here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.functions import text as T
from talkgrid.operators import intervals as I
from talkgrid.operators.state import secondary_consensus

LEAST_MS, SHORT_MS, SEAM_RUN_MS, MICRO_MS, LONG_MS, BRIEF_MS = 350, 2000, 12_000, 500, 1400, 600
CONTEXT_MS, SEAM_MS = 1250, 120
ALIKE, ONE_SIDE, BOTH_SIDES, MICRO_ALIKE, MICRO_MARGIN = 520, 140, 100, 420, 200
#: An utterance's gate, and the one where a second diarizer agrees.
UTTERANCE_GATE, AGREED_GATE = (520, 140), (450, 100)


def prototypes(evidence: DataFrame) -> DataFrame:
    """The evidence(recording_id, voice, clean_ms, window_count, cohesion) that is enough to compare with; cohesion in thousandths."""
    return evidence.where("clean_ms >= 4000 and window_count >= 2 and cohesion >= 400")


def _clear(rows: DataFrame, keys: list[str], regions: DataFrame) -> DataFrame:
    """Rows that regions of simultaneous speech overlap little."""
    over = I.covered(rows, regions, keys)
    limit = F.least(F.lit(120.0), (F.col("e") - F.col("s")) * 0.15)
    return rows.join(over, keys).where(F.col("covered") <= limit).drop("covered")


def best_voices(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, best, its score, margin over the next voice, and scores by voice, of scores(keys, voice, score); of equal ones the first voice."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "voice")
    ranked = scores.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    top = ranked.where("n = 1").select(*keys, F.col("voice").alias("best"), F.col("score").alias("best_score"), (F.col("score") - F.coalesce("next", F.lit(-1000))).alias("margin"))
    return top.join(scores.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("voice", "score"))).alias("by_voice")), keys)


def utterance_decisions(words: DataFrame, scores: DataFrame, middle_scores: DataFrame, voices: DataFrame, regions: DataFrame) -> DataFrame:
    """Decisions on the middle of utterances in which one voice interrupts another: recording_id, utterance, original, target, s, e (of the middle), decision.

    words(recording_id, utterance, ord, s, e, speaker, secondary) of utterances;
    scores and middle_scores(recording_id, utterance, voice, score) of the whole
    and of the middle; voices(recording_id, voice) with a prototype; regions
    of simultaneous speech.
    """
    key = ["recording_id", "utterance"]
    w = Window.partitionBy(*key).orderBy("ord")
    owned = words.join(voices.select("recording_id", F.col("voice").alias("speaker"), F.lit(True).alias("known")), ["recording_id", "speaker"], "left")
    rows = owned.withColumn("c", F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("int"), F.lit(1))).withColumn("run", F.sum("c").over(w))
    at = lambda k, c, f: f(F.when(F.col("run") == k, F.col(c)))
    found = rows.groupBy(*key).agg(
        F.min("s").alias("s"), F.max_by("e", "ord").alias("e"), F.max("run").alias("n"), F.min(F.coalesce("known", F.lit(False))).alias("all_known"),
        at(1, "speaker", F.max).alias("target"), at(2, "speaker", F.max).alias("original"), at(3, "speaker", F.max).alias("last"),
        at(2, "s", F.min).alias("m_s"), F.max_by("e", F.when(F.col("run") == 2, F.col("ord"))).alias("m_e"),
    )
    shaped = found.where("n = 3 and target = last and all_known").where(f"e - s between {LEAST_MS} and {SEAM_RUN_MS}")
    shaped = _clear(shaped, key, regions)
    vote = secondary_consensus(rows.where("run = 2"), key).select(*key, F.col("label").alias("vote"))
    rows = shaped.join(best_voices(scores, key), key).join(vote, key, "left").join(middle_scores.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("voice", "score"))).alias("mid")), key, "left")
    agrees = F.coalesce(F.col("vote") == F.col("target"), F.lit(False))
    alike, lead = (F.when(agrees, AGREED_GATE[i]).otherwise(UTTERANCE_GATE[i]) for i in (0, 1))
    own = F.try_element_at("by_voice", F.col("target"))
    mid = F.try_element_at("mid", F.col("target"))
    rest = F.array_max(F.map_values(F.map_filter("mid", lambda k, _: k != F.col("target"))))
    decision = (
        F.when(F.col("vote").isNotNull() & ~agrees, "abstained_sortformer_disagreement")
        .when((F.col("best") != F.col("target")) | (own < alike) | (F.col("margin") < lead), "abstained_below_confidence_threshold")
        .when(mid.isNull() | (mid < MICRO_ALIKE) | (mid - F.coalesce(rest, F.lit(-1000)) < lead), "abstained_candidate_voice_ambiguous")
        .otherwise("corrected")
    )
    return rows.select(*key, "original", "target", F.col("m_s").alias("s"), F.col("m_e").alias("e"), decision.alias("decision"))


def run_decisions(runs: DataFrame, words: DataFrame, scores: DataFrame, voices: DataFrame, regions: DataFrame, settled: DataFrame) -> DataFrame:
    """Decisions on runs of words that another voice of their context may have spoken: recording_id, run, original, best, s, e, decision.

    runs(recording_id, run, speaker, s, e, text) by time; words(recording_id,
    run, ord, s, e, secondary); scores(recording_id, run, voice, score); settled
    are the intervals(recording_id, s, e) that utterances have decided.
    """
    key = ["recording_id", "run"]
    w = Window.partitionBy("recording_id").orderBy("run")
    side = F.struct("speaker", "s", "e", "text")
    rows = runs.withColumn("p", F.lag(side).over(w)).withColumn("n", F.lead(side).over(w))
    before, after = F.greatest(F.lit(0), F.col("s") - F.col("p.e")), F.greatest(F.lit(0), F.col("n.s") - F.col("e"))
    joins = lambda a, b: T.sentence_continues(a, b)
    left, right = joins(F.col("p.text"), F.col("text")), joins(F.col("text"), F.col("n.text"))
    rows = rows.withColumns({
        "neighbours": F.array_compact(F.array(F.when(before <= CONTEXT_MS, F.col("p.speaker")), F.when(after <= CONTEXT_MS, F.col("n.speaker")))),
        "seams": F.array_compact(F.array(F.when((before <= SEAM_MS) & left, F.col("p.speaker")), F.when((after <= SEAM_MS) & right, F.col("n.speaker")))),
        "length": F.col("e") - F.col("s"),
    })
    known = voices.groupBy("recording_id").agg(F.collect_set("voice").alias("known"))
    rows = rows.join(known, "recording_id").where((F.col("length") >= LEAST_MS) & F.array_contains("known", F.col("speaker")) & (F.size("known") >= 2))
    other = lambda c: F.filter(F.array_intersect(c, "known"), lambda v: v != F.col("speaker"))
    short = F.col("length") <= SHORT_MS
    rows = rows.withColumn("supported", F.when(short, other("neighbours")).otherwise(other("seams")))
    rows = rows.where((short | ((F.col("length") <= SEAM_RUN_MS) & (F.size(other("seams")) > 0))) & (F.size("supported") > 0))
    rows = _clear(rows, key, regions)
    rows = rows.join(I.covered(rows, settled, key).where("covered > 0").select(*key), key, "left_anti")
    vote = secondary_consensus(words, key).select(*key, F.col("label").alias("vote"))
    rows = rows.join(best_voices(scores, key), key).join(vote, key, "left")
    agree = lambda c: F.size(F.filter(c, lambda v: v == F.col("best")))
    micro = (F.col("length") <= MICRO_MS) & (agree("seams") > 0)
    lead = F.when(micro, MICRO_MARGIN).otherwise(F.when(agree("neighbours") >= 2, BOTH_SIDES).otherwise(ONE_SIDE) + F.when(F.col("length") > LONG_MS, 40).otherwise(0))
    alike = F.when(micro, MICRO_ALIKE).otherwise(F.lit(ALIKE) + F.when(F.col("length") < BRIEF_MS, 30).otherwise(0))
    decision = (
        F.when(F.col("best") == F.col("speaker"), "kept_original")
        .when(~F.array_contains("supported", F.col("best")), "abstained_best_voice_not_supported_by_context")
        .when(F.col("vote").isNotNull() & (F.col("vote") != F.col("best")), "abstained_sortformer_disagreement")
        .when((F.col("best_score") < alike) | (F.col("margin") < lead), "abstained_below_confidence_threshold")
        .otherwise("corrected")
    )
    return rows.select(*key, F.col("speaker").alias("original"), "best", "s", "e", "margin", decision.alias("decision"))


def corrected_words(words: DataFrame, corrections: DataFrame) -> DataFrame:
    """words(recording_id, run, ...) with the speaker of the corrections(recording_id, run, best), and from, the label before, null where it stays."""
    fixed = corrections.select("recording_id", "run", F.col("best").alias("__to"))
    rows = words.join(fixed, ["recording_id", "run"], "left")
    changed: Column = F.col("__to").isNotNull()
    return rows.withColumn("from", F.when(changed, F.col("speaker"))).withColumn("speaker", F.coalesce("__to", "speaker")).drop("__to")


def refined_segments(words: DataFrame, segments: DataFrame) -> DataFrame:
    """recording_id, seg_ord, speaker, corrected (words) and changed of the segments(recording_id, seg_ord, speaker) with corrected words: the voice of most of their time, of equal ones the first."""
    timed = words.where("s is not null and e is not null")
    per = timed.groupBy("recording_id", "seg_ord", "speaker").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.col("s"))).alias("ms"), F.min("word_ord").alias("first"))
    best = per.withColumn("n", F.row_number().over(Window.partitionBy("recording_id", "seg_ord").orderBy(F.desc("ms"), "first"))).where("n = 1")
    fixed = timed.groupBy("recording_id", "seg_ord").agg(F.count("from").alias("corrected")).where("corrected > 0")
    before = segments.select("recording_id", "seg_ord", F.coalesce("speaker", F.lit("SPEAKER_UNKNOWN")).alias("before"))
    rows = best.join(fixed, ["recording_id", "seg_ord"]).join(before, ["recording_id", "seg_ord"])
    return rows.select("recording_id", "seg_ord", "speaker", "corrected", (F.col("before") != F.col("speaker")).alias("changed"))
