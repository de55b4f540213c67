"""Rules that give turns, words and windows their labels and reasons. Times are in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.functions import text as T
from talkgrid.operators import intervals as I
from talkgrid.operators.sessions import UNKNOWN

#: A second diarizer disagrees with a turn if it was compared for so long and differs in so many per cent.
COMPARED_MS, DIFFERS = 500, 65
UNTIMED_MS = 200
#: Words longer than this, or than so much a character, are stretched; scores under WEAK are weak; clocks further apart than APART_MS disagree.
STRETCHED_MS, PER_CHARACTER_MS, WEAK, APART_MS = 1500, 180, 35, 750
#: A recognizer's log probability below, and no-speech probability above, are weak support, in thousandths.
LOW_LOGPROB, HIGH_NO_SPEECH = -1000, 600
CONTEXT_MS = 90_000
# Emotions that may be shown, and the only estimator whose labels are.
EMOTIONS = ("angry", "disgusted", "fearful", "happy", "sad", "surprised")
ESTIMATOR = "emotion2vec/emotion2vec_plus_large"
STRONG, LEAD, TONE_MS = 850, 300, 2500


def listed(*parts: tuple[Column, str]) -> Column:
    """The names whose test holds, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in parts]))


def compared(words: DataFrame) -> DataFrame:
    """recording_id, turn_ord, compared and differing milliseconds of the second diarizer, and unsupported, whether a word had no speaker of its own and no human has confirmed one."""
    own = F.when(F.col("s").isNull() | F.col("e").isNull(), UNTIMED_MS).otherwise(F.greatest(F.lit(0), F.col("e") - F.col("s")))
    both = F.col("secondary").isNotNull() & F.col("local_speaker").isNotNull()
    return words.groupBy("recording_id", "turn_ord").agg(
        F.sum(F.when(both, own).otherwise(0)).alias("compared"),
        F.sum(F.when(both & (F.col("secondary") != F.col("local_speaker")), own).otherwise(0)).alias("differing"),
        F.max(F.col("fallback") & ~F.col("identity").eqNullSafe("human_verified")).alias("unsupported"),
    )


def suspicions(turns: DataFrame, candidates: DataFrame) -> DataFrame:
    """recording_id, turn_ord and suspected, the reasons of the candidates(recording_id, ord, s, e, decision, strategy, seam) that overlap a turn enough, in order."""
    seam = (F.col("decision") == "abstained_below_confidence_threshold") & ((F.col("strategy") == "bracketed_utterance") | F.col("seam"))
    reason = (
        F.when(F.col("decision") == "abstained_sortformer_disagreement", "refinement_model_disagreement")
        .when(F.col("decision") == "abstained_candidate_voice_ambiguous", "candidate_voice_ambiguous")
        .when(seam, "unresolved_sentence_continuation")
    )
    odd = candidates.select("recording_id", "ord", "s", "e", reason.alias("reason")).where("reason is not null and s >= 0 and e > s")
    met = I.ms_join(turns.select("recording_id", "turn_ord", "s", "e"), odd)
    enough = 10 * (F.least("e", "r_e") - F.greatest("s", "r_s")) >= F.least(F.lit(1000), F.greatest(F.lit(100), F.col("e") - F.col("s")))
    found = met.where(enough).groupBy("recording_id", "turn_ord").agg(F.array_sort(F.collect_list(F.struct("r_ord", "r_reason"))).alias("x"))
    return found.select("recording_id", "turn_ord", F.array_distinct(F.transform("x", lambda v: v["r_reason"])).alias("suspected"))


def attribution(turns: DataFrame, words: DataFrame, candidates: DataFrame) -> DataFrame:
    """recording_id, turn_ord, reasons (in order), status, compared and differing of each turn."""
    key = ["recording_id", "turn_ord"]
    rows = turns.join(compared(words), key, "left").join(suspicions(turns, candidates), key, "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("compared", "differing")})
    none = F.array().cast("array<string>")
    reasons = F.concat(
        listed(
            (F.coalesce("speaker", F.lit(UNKNOWN)) == UNKNOWN, "unknown_speaker"),
            (F.coalesce("identity", F.lit("")).startswith("unresolved"), "unresolved_voice_identity"),
            (F.coalesce("unsupported", F.lit(False)), "unsupported_word_assignment"),
            ((F.col("compared") >= COMPARED_MS) & (100 * F.col("differing") >= DIFFERS * F.col("compared")), "sortformer_majority_disagrees"),
        ),
        F.coalesce("suspected", none),
        listed((F.col("confidence") < 50, "low_speaker_confidence")),
    )
    out = rows.select(*key, reasons.alias("reasons"), "compared", "differing")
    return out.withColumn("status", F.when(F.size("reasons") > 0, "uncertain").otherwise("assigned"))


def best_segment(words: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """recording_id, seg_ord, word_ord and the recognizer's segment that overlaps the word most, of equal ones the first."""
    key = ["recording_id", "seg_ord", "word_ord"]
    met = I.ms_join(words.where("s >= 0 and s < e").select(*key, "s", "e"), diagnostics)
    order = F.struct((F.greatest("s", "r_s") - F.least("e", "r_e")).alias("less"), F.col("r_diag_ord").alias("diag_ord"))
    best = met.groupBy(*key).agg(F.min(F.struct(order.alias("o"), F.struct(*[F.col(f"r_{c}").alias(c) for c in ("diag_ord", "s", "e", "logprob", "no_speech", "text")]).alias("d"))).alias("x"))
    return best.select(*key, F.col("x.d").alias("near"))


def word_timing(words: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Words with issues of their times, status and the recognizer's segment (diag_ord, d_s, d_e, d_text).

    words(recording_id, seg_ord, word_ord, text, s, e, score, p_s, p_e, p_diag):
    p_* are the recognizer's own times and segment where the word is paired.
    """
    key = ["recording_id", "seg_ord", "word_ord"]
    named = diagnostics.select("recording_id", F.col("diag_ord").alias("p_diag"), F.struct("diag_ord", "s", "e", "logprob", "no_speech", "text").alias("paired"))
    rows = words.join(named, ["recording_id", "p_diag"], "left").join(best_segment(words.where("p_diag is null"), diagnostics), key, "left")
    rows = rows.withColumn("d", F.coalesce("paired", "near"))
    valid = F.coalesce((F.col("s") >= 0) & (F.col("s") < F.col("e")), F.lit(False))
    longest = F.greatest(F.lit(STRETCHED_MS), F.length(T.token(F.col("text"))) * PER_CHARACTER_MS)
    far = F.greatest(F.abs(F.col("s") - F.col("p_s")), F.abs(F.col("e") - F.col("p_e"))) > APART_MS
    issues = listed(
        (~valid, "missing_or_zero_word_timing"),
        (valid & (F.col("e") - F.col("s") > longest), "stretched_word_timing"),
        (F.col("score") < WEAK, "weak_alignment"),
        (valid & F.col("p_s").isNotNull() & F.col("p_e").isNotNull() & far, "whisper_alignment_disagreement"),
        ((F.col("d.logprob") < LOW_LOGPROB) | (F.col("d.no_speech") > HIGH_NO_SPEECH), "weak_asr_support"),
    )
    out = rows.withColumn("issues", issues)
    return out.select(
        *[c for c in words.columns if c not in ("p_s", "p_e", "p_diag")], "issues", F.when(F.size("issues") > 0, "uncertain").otherwise("aligned").alias("status"),
        F.col("d.diag_ord").alias("diag_ord"), F.col("d.s").alias("d_s"), F.col("d.e").alias("d_e"), F.col("d.text").alias("d_text"),
    )


def turn_timing(turns: DataFrame, words: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """recording_id, turn_ord, issues (sorted), status, and the source context c_s, c_e, c_text of each turn.

    words have their timing and turn_ord. Without a word's segment the
    recognizer's segments that overlap the turn give the context; one over
    CONTEXT_MS is none.
    """
    key = ["recording_id", "turn_ord"]
    per = words.groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))).alias("issues"),
        F.max(F.col("s").isNull() | F.col("e").isNull()).alias("open"),
        F.min("d_s").alias("w_s"), F.max("d_e").alias("w_e"),
        F.array_sort(F.collect_list(F.when(F.col("d_s").isNotNull(), F.struct("seg_ord", "word_ord", "d_text")))).alias("texts"),
    )
    near = I.ms_join(turns.select(*key, "s", "e"), diagnostics.select("recording_id", "diag_ord", "s", "e", "text"))
    near = near.groupBy(*key).agg(F.min("r_s").alias("n_s"), F.max("r_e").alias("n_e"), F.array_sort(F.collect_list(F.struct("r_diag_ord", F.col("r_text").alias("d_text")))).alias("near"))
    rows = turns.select(*key).join(per, key, "left").join(near, key, "left")
    none = F.array().cast("array<string>")
    issues = F.array_sort(F.array_union(F.coalesce("issues", none), listed((F.coalesce("open", F.lit(True)), "incomplete_word_timing"))))
    own = F.size(F.coalesce("texts", F.array())) > 0
    start, end = F.when(own, F.col("w_s")).otherwise(F.col("n_s")), F.when(own, F.col("w_e")).otherwise(F.col("n_e"))
    joined = lambda c: F.array_join(F.array_distinct(F.transform(c, lambda x: F.trim(x["d_text"]))), " ")
    rows = rows.select(*key, issues.alias("issues"), start.alias("c_s"), end.alias("c_e"), F.when(own, joined("texts")).otherwise(joined("near")).alias("c_text"))
    holds = (F.col("c_s") >= 0) & (F.col("c_s") < F.col("c_e")) & (F.col("c_e") - F.col("c_s") <= CONTEXT_MS)
    return rows.select(*key, "issues", F.when(F.size("issues") > 0, "uncertain").otherwise("aligned").alias("status"), *[F.when(holds, F.col(c)).alias(c) for c in ("c_s", "c_e", "c_text")])


def review_reasons(turns: DataFrame, windows: DataFrame) -> DataFrame:
    """recording_id, turn_ord and review, the sorted reasons why a human should look.

    turns(recording_id, turn_ord, s, e, speaker, reasons, status, overlapped, timing);
    windows(recording_id, s, e, retained, disagreement, agreement).
    """
    key = ["recording_id", "turn_ord"]
    met = I.ms_join(turns.select(*key, "s", "e"), windows).groupBy(*key).agg(
        F.max(~F.col("r_retained") & ~F.col("r_disagreement")).alias("outlier"), F.max(F.col("r_disagreement") & ~F.col("r_agreement")).alias("disputed")
    )
    rows = turns.join(met, key, "left")
    kept = F.filter("reasons", lambda r: r != "unresolved_voice_identity")
    more = listed(
        (F.col("speaker") == UNKNOWN, "unknown_speaker"),
        ((F.col("status") == "uncertain") & (F.size("reasons") == 0) & (F.col("speaker") != UNKNOWN), "speaker_timing_disputed"),
        (F.col("overlapped"), "overlapping_voices"),
        (F.col("timing") == "uncertain", "check_word_timing"),
        (F.coalesce("outlier", F.lit(False)), "voice_reference_outlier"),
        (F.coalesce("disputed", F.lit(False)), "diarizer_disagreement"),
    )
    return rows.select(*key, F.array_sort(F.array_union(kept, more)).alias("review"))


def voice_hints(turns: DataFrame, words: DataFrame, windows: DataFrame, aliases: DataFrame) -> DataFrame:
    """recording_id, turn_ord, suggested (sorted voices) and hints, the review reasons with what matched voices explain taken out.

    turns have review; words(recording_id, turn_ord, local_speaker, secondary,
    ambiguous); windows(recording_id, s, e, suggested); aliases(recording_id,
    local_speaker, voice) of the matched labels.
    """
    key = ["recording_id", "turn_ord"]
    voices = I.ms_join(turns.select(*key, "s", "e"), windows).groupBy(*key).agg(F.array_sort(F.collect_set("r_suggested")).alias("suggested"))
    a = aliases.select("recording_id", "local_speaker", F.col("voice").alias("v1"))
    b = aliases.select("recording_id", F.col("local_speaker").alias("secondary"), F.col("voice").alias("v2"))
    differs = words.where("secondary is not null and secondary <> local_speaker").join(a, ["recording_id", "local_speaker"], "left").join(b, ["recording_id", "secondary"], "left")
    explained = differs.groupBy(*key).agg(F.min(~F.col("ambiguous") & F.coalesce(F.col("v1") == F.col("v2"), F.lit(False))).alias("explained"))
    own = words.join(a, ["recording_id", "local_speaker"]).groupBy(*key).agg(F.collect_set("v1").alias("matched"))
    none = F.array().cast("array<string>")
    rows = turns.join(voices, key, "left").join(explained, key, "left").join(own, key, "left").withColumn("suggested", F.coalesce("suggested", none)).withColumn("matched", F.coalesce("matched", none))
    kept = F.when(F.coalesce("explained", F.lit(False)), F.filter("review", lambda r: r != "sortformer_majority_disagrees")).otherwise(F.col("review"))
    conflict = (F.size("suggested") > 1) | ((F.size("matched") > 0) & (F.size(F.array_except("suggested", "matched")) > 0))
    return rows.select(*key, "suggested", F.concat(kept, listed((conflict, "conflicting_voice_references"))).alias("hints"))


def observations(turns: DataFrame) -> DataFrame:
    """Turns with relative, their level against the median of their speaker's turns without overlap (else of all turns), and observed labels in order.

    turns(recording_id, turn_ord, s, e, speaker, text, n_words, level, change,
    pitch, overlapped, pause_before, overlap_ms); level and change in hundredths
    of dB, pitch variation in thousandths.
    """
    clean = turns.where(~F.col("overlapped")).groupBy("recording_id", "speaker").agg(F.percentile("level", 0.5).alias("own"))
    every = turns.groupBy("recording_id").agg(F.percentile("level", 0.5).alias("whole"))
    rows = turns.join(clean, ["recording_id", "speaker"], "left").join(every, "recording_id")
    rows = rows.withColumn("relative", F.col("level") - F.coalesce("own", "whole"))
    length = F.greatest(F.lit(1), F.col("e") - F.col("s"))
    # words a second in thousandths, rounded as the rate is
    rate = F.floor(1_000_000 * F.col("n_words") / length + 0.5)
    labels = listed(
        (F.col("relative") >= 400, "elevated volume"), (F.col("relative") <= -600, "quiet speech"),
        (rate >= 3200, "fast speech"), ((rate <= 1200) & (F.size(F.split("text", r"\s+")) >= 3), "slow speech"),
        (F.col("pause_before") >= 2000, "long pause before"), (F.abs("change") >= 600, "substantial energy change"),
        (F.coalesce("pitch", F.lit(0)) >= 250, "substantial pitch variation"), (F.col("overlap_ms") > 0, "overlap"),
    )
    return rows.select(*turns.columns, "relative", rate.cast("long").alias("rate"), F.concat(F.when(F.col("overlapped"), F.array(F.lit("overlap"))).otherwise(F.array().cast("array<string>")), labels).alias("observed"))


def ranked(scores: Column) -> Column:
    """array<struct<label, p>> by p, the largest first and equal ones in their order."""
    keyed = F.transform(scores, lambda x, i: F.struct((-x["p"]).alias("less"), i.alias("i"), x["label"].alias("label"), x["p"].alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["label"].alias("label"), x["p"].alias("p")))


def strong_label(scores: Column) -> Column:
    """The best label if it may be shown, has at least STRONG thousandths and leads by LEAD."""
    best = ranked(F.filter(scores, lambda x: x["p"].isNotNull()))
    top, second = F.get(best, F.lit(0)), F.coalesce(F.get(best, F.lit(1))["p"], F.lit(0))
    return F.when(top["label"].isin(*EMOTIONS) & top["p"].between(STRONG, 1000) & (top["p"] - second >= LEAD), top["label"])


def rank_scores(scores: Column, most: int = 4) -> Column:
    """Scores with the last part of each label's path in lower case, unknown for the model's own word for it, the best first."""
    last = lambda v: F.lower(F.element_at(F.split(F.trim(v), "/"), -1))
    name = lambda v: F.when(last(v).isin("<unk>", "unk", ""), "unknown").otherwise(last(v))
    return F.slice(ranked(F.transform(scores, lambda x: F.struct(name(x["label"]).alias("label"), x["p"].alias("p")))), 1, most)


def summarize_tone(windows: DataFrame) -> DataFrame:
    """recording_id, turn_ord, scores (label and p, means weighted by length), n_windows, varies and status of windows(recording_id, turn_ord, w_s, w_e, scores)."""
    key = ["recording_id", "turn_ord"]
    rows = windows.withColumn("w", F.col("w_e") - F.col("w_s"))
    per = rows.groupBy(*key).agg(F.sum("w").alias("total"), F.count("*").alias("n_windows"), (F.count_distinct(F.col("scores")[0]["label"]) > 1).alias("varies"))
    seen = rows.select(*key, "w_s", "w", F.posexplode("scores").alias("pos", "x"))
    sums = seen.groupBy(*key, F.col("x.label").alias("label")).agg(F.sum(F.col("x.p") * F.col("w")).alias("sum"), F.min(F.struct("w_s", "pos")).alias("first"))
    lists = sums.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("sum")).alias("less"), "first", "label", "sum"))).alias("x"))
    out = lists.join(per, key)
    means = F.transform("x", lambda v: F.struct(v["label"].alias("label"), (v["sum"] / F.col("total")).alias("p")))
    return out.select(*key, means.alias("scores"), "n_windows", "varies", F.when(F.col("x")[0]["label"] == "unknown", "unclassified").otherwise("classified").alias("status"))


def gate_tone(turns: DataFrame, windows: DataFrame, words: DataFrame, events: DataFrame, profiles: DataFrame) -> DataFrame:
    """recording_id, turn_ord, shown (a label or null), suppressed (reasons in order) and covered of the turns with a tone.

    windows(recording_id, turn_ord, w_s, w_e, scores, confirmation, eligible, model)
    count if they are long enough, inside the turn, of one strong label by both
    scores, free of events(recording_id, turn_ord, s, e) and with words(turn_ord,
    s, e, issues) that have no issue; profiles(voice, role).
    """
    key = ["recording_id", "turn_ord"]
    own = turns.select(*key, F.col("s").alias("t_s"), F.col("e").alias("t_e"), F.col("speaker").alias("voice"))
    label, check = strong_label(F.col("scores")), strong_label(F.col("confirmation"))
    rows = windows.withColumn("label", label).withColumn("check", check).join(own, key)
    good = rows.where("eligible and w_e - w_s >= 2500 and label is not null and label = check and w_s >= t_s and w_e <= t_e").select(*key, "w_s", "w_e", "label")
    hit = good.join(events.select(*key, F.col("s").alias("x_s"), F.col("e").alias("x_e")), key).where("x_s < w_e and x_e > w_s").select(*key, "w_s").distinct()
    good = good.join(hit, [*key, "w_s"], "left_anti")
    said = good.join(words.where("s is not null and e is not null").select(*key, "s", "e", "issues"), key).where("s < w_e and e > w_s")
    clean = said.groupBy(*key, "w_s", "w_e", "label").agg(F.max(F.size("issues")).alias("bad")).where("bad = 0")
    lists = clean.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("w_s", "label"))).alias("x"), F.sum(F.col("w_e") - F.col("w_s")).alias("covered"))
    shown = windows.groupBy(*key).agg(F.min("model").alias("model")).join(own, key).join(lists, key, "left").join(profiles.select("voice", "role"), "voice", "left")
    labels = F.array_distinct(F.transform("x", lambda v: v["label"]))
    text = F.when(F.size(labels) == 1, labels[0]).otherwise(F.concat(F.lit("varied ("), F.array_join(F.slice(labels, 1, 3), " -> "), F.lit(")")))
    part = 10 * F.col("covered") < 8 * F.greatest(F.lit(1), F.col("t_e") - F.col("t_s"))
    reasons = listed(
        (~F.col("role").eqNullSafe("adult"), "adult_voice_not_confirmed"),
        (~F.col("model").eqNullSafe(ESTIMATOR), "estimator_not_validated_for_display"),
        (F.col("x").isNull(), "no_clean_consistent_strong_emotion"),
    )
    out = shown.withColumn("suppressed", reasons)
    named = F.concat(text, F.when(part, F.lit(" (part of this passage)")).otherwise(F.lit("")))
    return out.select(*key, F.when(F.size("suppressed") == 0, named).alias("shown"), "suppressed", F.coalesce("covered", F.lit(0)).alias("covered"))


def heuristic_tone(turns: DataFrame) -> DataFrame:
    """recording_id, turn_ord and the three likeliest of four labels with their probability, from volume (dB), rate, pitch variation and energy change (dB)."""
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    rows = turns.select("recording_id", "turn_ord", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("volume", 0.0), ("speed", 2.0), ("variation", 0.1), ("shift", 0.0))])
    rows = rows.withColumn("a", clip(F.lit(0.45) + F.col("volume") / 16.0 + (F.col("speed") - 2.0) / 5.0 + F.col("variation") / 2.0))
    rows = rows.withColumn("u", clip(F.col("variation") * 1.8 + F.abs("shift") / 20.0))
    a, u = F.col("a"), F.col("u")
    raw = {
        "neutral": F.lit(1.25) - F.abs(a - 0.45) - u * 0.35, "activated": F.lit(0.35) + a * 0.9,
        "subdued": F.lit(0.35) + (F.lit(1.0) - a) * 0.75, "tense": F.lit(0.2) + a * 0.45 + u * 0.55,
    }
    rows = rows.select("recording_id", "turn_ord", *[F.exp(v).alias(k) for k, v in raw.items()])
    total = sum((F.col(k) for k in list(raw)[1:]), F.col("neutral"))
    scores = F.array(*[F.struct(F.lit(k).alias("label"), (F.floor(F.col(k) / total * 1e4 + 0.5) / 1e4).alias("p")) for k in raw])
    return rows.select("recording_id", "turn_ord", F.slice(ranked(scores), 1, 3).alias("scores"))


def preserve_tone(windows: DataFrame, turns: DataFrame) -> DataFrame:
    """Windows(recording_id, w_s, w_e, model) that lie wholly in a new turn, if all that do are of one model."""
    spans = windows.select("recording_id", F.col("w_s").alias("s"), F.col("w_e").alias("e"), "model")
    met = I.ms_join(turns.select("recording_id", "turn_ord", "s", "e"), spans).where("s <= r_s and r_s < r_e and r_e <= e")
    one = met.groupBy("recording_id", "turn_ord").agg(F.count_distinct("r_model").alias("n")).where("n = 1")
    return met.join(one, ["recording_id", "turn_ord"], "left_semi").select("recording_id", "turn_ord", F.col("r_s").alias("w_s"), F.col("r_e").alias("w_e"), F.col("r_model").alias("model"))
