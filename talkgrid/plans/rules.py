"""Reasons and labels of turns, words and windows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from talkgrid.operators import intervals as I
from talkgrid.operators import rules as R
from talkgrid.operators import sessions as S
from talkgrid.plans.ranges import OVERLAPS_SQL
from talkgrid.plans.registry import query
from talkgrid.plans.sessions import TURNS_SQL, normal_words
from talkgrid.session import durable
from talkgrid.sources import speech as D

_TW = TURNS_SQL.rstrip() + ", tw AS (SELECT k1.*, fold.grp AS turn_ord FROM k1 JOIN fold USING (recording_id, seg_ord, run))"


class Speech:
    """What the rules of one query share, made once and kept in the shared folder."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    @cached_property
    def words(self):
        return durable(normal_words(self.spark, self.d))

    @cached_property
    def pieces(self):
        return durable(S.split_segments(self.words, D.segments(self.spark, self.d)))

    @cached_property
    def turns(self):
        return durable(S.build_turns(self.pieces))

    @cached_property
    def turn_words(self):
        return durable(S.turn_words(self.words, self.pieces))

    @cached_property
    def diagnostics(self):
        return D.diagnostics(self.spark, self.d)

    @cached_property
    def timed_words(self):
        words = D.made(self.turn_words, D.PAIR).select("recording_id", "seg_ord", "word_ord", "turn_ord", "text", "s", "e", "score", "local_speaker", "secondary", "ambiguous", "p_s", "p_e", "p_diag")
        return durable(R.word_timing(words, self.diagnostics))

    @cached_property
    def overlaps(self):
        return durable(I.turn_overlaps(self.turns))

    @cached_property
    def tone(self):
        rows = D.made(S.scored_windows(self.turns), D.TONE)
        score = lambda k: F.struct(F.col(f"l{k}").alias("label"), F.col(f"p{k}").alias("p"))
        rows = rows.withColumn("scores", F.array(score(0), score(1), score(2)))
        return rows.withColumn("confirmation", F.when(F.col("confirmed"), F.col("scores")).otherwise(F.array(score(1))))

    @cached_property
    def windows(self):
        return D.made(self.pieces.where("ord % 2 = 0").select("recording_id", "ord", "s", "e"), D.WINDOW)

    def attributed(self):
        return R.attribution(self.turns, self.turn_words, D.made(self.pieces.where("ord % 3 <> 2"), D.CANDIDATE))

    def timed_turns(self):
        return R.turn_timing(self.turns, self.timed_words, self.diagnostics)

    def raw(self):
        return I.raw_overlaps(self.pieces.withColumn("speaker", F.col("local_speaker")))


_ATTRIBUTION = f"""{_TW},
cmp AS (SELECT recording_id, turn_ord, sum(CASE WHEN secondary IS NOT NULL THEN CASE WHEN s IS NULL THEN 200 ELSE greatest(0, e - s) END ELSE 0 END)::BIGINT AS compared,
  sum(CASE WHEN secondary <> local_speaker THEN CASE WHEN s IS NULL THEN 200 ELSE greatest(0, e - s) END ELSE 0 END)::BIGINT AS differing,
  bool_or(fallback AND identity IS DISTINCT FROM 'human_verified') AS unsupported FROM tw GROUP BY 1, 2),
cand AS (SELECT recording_id, ord, s, e, {D.made_sql(D.CANDIDATE)} FROM pieces WHERE ord % 3 <> 2),
odd AS (SELECT recording_id, ord, s, e, CASE WHEN decision = 'abstained_sortformer_disagreement' THEN 'refinement_model_disagreement' WHEN decision = 'abstained_candidate_voice_ambiguous' THEN 'candidate_voice_ambiguous'
  WHEN decision = 'abstained_below_confidence_threshold' AND (strategy = 'bracketed_utterance' OR seam) THEN 'unresolved_sentence_continuation' END AS reason FROM cand WHERE e > s),
sus AS (SELECT recording_id, turn_ord, list(reason ORDER BY o) AS l FROM (SELECT t.recording_id, t.turn_ord, reason, min(odd.ord) AS o FROM turns t JOIN odd ON odd.recording_id = t.recording_id AND reason IS NOT NULL
  AND 10 * (least(t.e, odd.e) - greatest(t.s, odd.s)) >= least(1000, greatest(100, t.e - t.s)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
att0 AS (SELECT t.recording_id, t.turn_ord, coalesce(compared, 0) AS compared, coalesce(differing, 0) AS differing,
  list_concat(list_filter([CASE WHEN t.speaker = 'SPEAKER_UNKNOWN' THEN 'unknown_speaker' END, CASE WHEN t.identity LIKE 'unresolved%' THEN 'unresolved_voice_identity' END, CASE WHEN unsupported THEN 'unsupported_word_assignment' END,
    CASE WHEN compared >= 500 AND 100 * differing >= 65 * compared THEN 'sortformer_majority_disagrees' END], lambda x: x IS NOT NULL), list_concat(coalesce(l, []), CASE WHEN confidence < 50 THEN ['low_speaker_confidence'] ELSE [] END)) AS reasons
  FROM turns t LEFT JOIN cmp USING (recording_id, turn_ord) LEFT JOIN sus USING (recording_id, turn_ord)),
att AS (SELECT *, CASE WHEN len(reasons) > 0 THEN 'uncertain' ELSE 'assigned' END AS status FROM att0)
"""


def flat(df, *columns):
    """Lists as text, as the drivers of some databases have no lists."""
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


@query("attribution_reasons", _ATTRIBUTION + "SELECT * REPLACE (array_to_string(reasons, ',') AS reasons) FROM att")
def attribution_reasons(spark, d):
    return flat(Speech(spark, d).attributed(), "reasons")


_DIAG = f", diag0 AS (SELECT recording_id, seg_ord AS diag_ord, text, {D.made_sql(D.DIAGNOSTIC)} FROM ms0), diag AS (SELECT recording_id, diag_ord, text, ds AS s, de AS e, logprob, no_speech FROM diag0)"
_TIMED = f"""{_DIAG},
pw AS (SELECT *, s IS NOT NULL AND s >= 0 AND s < e AS valid, {D.made_sql(D.PAIR)} FROM tw),
nb AS (SELECT p.recording_id, p.seg_ord, p.word_ord, d.diag_ord, row_number() OVER (PARTITION BY p.recording_id, p.seg_ord, p.word_ord ORDER BY least(p.e, d.e) - greatest(p.s, d.s) DESC, d.diag_ord) AS k
  FROM pw p JOIN diag d ON d.recording_id = p.recording_id AND p.p_diag IS NULL AND valid AND d.s < p.e AND d.e > p.s),
wt0 AS (SELECT pw.*, coalesce(pw.p_diag, nb.diag_ord) AS dd FROM pw LEFT JOIN nb ON nb.recording_id = pw.recording_id AND nb.seg_ord = pw.seg_ord AND nb.word_ord = pw.word_ord AND k = 1),
wt AS (SELECT w.recording_id, w.seg_ord, w.word_ord, w.turn_ord, w.text, w.s, w.e, w.score, w.local_speaker, w.secondary, w.ambiguous, d.diag_ord, d.s AS d_s, d.e AS d_e, d.text AS d_text, list_filter([CASE WHEN NOT valid THEN 'missing_or_zero_word_timing' END,
  CASE WHEN valid AND w.e - w.s > greatest(1500, 180 * length(regexp_replace(replace(lower(w.text), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g'))) THEN 'stretched_word_timing' END, CASE WHEN score < 35 THEN 'weak_alignment' END,
  CASE WHEN valid AND greatest(abs(w.s - p_s), abs(w.e - p_e)) > 750 THEN 'whisper_alignment_disagreement' END, CASE WHEN logprob < -1000 OR no_speech > 600 THEN 'weak_asr_support' END], lambda x: x IS NOT NULL) AS issues
  FROM wt0 w LEFT JOIN diag d ON d.recording_id = w.recording_id AND d.diag_ord = w.dd)"""


@query("word_timing", _TW + _TIMED + " SELECT * REPLACE (array_to_string(issues, ',') AS issues), CASE WHEN len(issues) > 0 THEN 'uncertain' ELSE 'aligned' END AS status FROM wt")
def word_timing(spark, d):
    return flat(Speech(spark, d).timed_words, "issues")


_TURN_TIMING = """,
tt0 AS (SELECT recording_id, turn_ord, list_sort(list_distinct(flatten(list(issues)))) AS issues, bool_or(s IS NULL) AS open, min(d_s) AS w_s, max(d_e) AS w_e, count(d_s) AS n FROM wt GROUP BY 1, 2),
tt1 AS (SELECT recording_id, turn_ord, string_agg(x, ' ' ORDER BY o) AS w_text FROM (SELECT recording_id, turn_ord, trim(d_text) AS x, min(seg_ord * 100000 + word_ord) AS o FROM wt WHERE d_s IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
tt2 AS (SELECT t.recording_id, t.turn_ord, d.diag_ord, d.s, d.e, trim(d.text) AS x FROM turns t JOIN diag d ON d.recording_id = t.recording_id AND d.s < t.e AND d.e > t.s),
tt3 AS (SELECT recording_id, turn_ord, min(s) AS n_s, max(e) AS n_e FROM tt2 GROUP BY 1, 2),
tt4 AS (SELECT recording_id, turn_ord, string_agg(x, ' ' ORDER BY o) AS n_text FROM (SELECT recording_id, turn_ord, x, min(diag_ord) AS o FROM tt2 GROUP BY 1, 2, 3) GROUP BY 1, 2),
tt5 AS (SELECT t.recording_id, t.turn_ord, list_sort(list_concat(coalesce(issues, []), CASE WHEN coalesce(open, true) THEN ['incomplete_word_timing'] ELSE [] END)) AS issues,
  CASE WHEN n > 0 THEN w_s ELSE n_s END AS a, CASE WHEN n > 0 THEN w_e ELSE n_e END AS b, CASE WHEN n > 0 THEN w_text ELSE n_text END AS x
  FROM turns t LEFT JOIN tt0 USING (recording_id, turn_ord) LEFT JOIN tt1 USING (recording_id, turn_ord) LEFT JOIN tt3 USING (recording_id, turn_ord) LEFT JOIN tt4 USING (recording_id, turn_ord)),
tt AS (SELECT recording_id, turn_ord, issues, CASE WHEN len(issues) > 0 THEN 'uncertain' ELSE 'aligned' END AS status, CASE WHEN a >= 0 AND a < b AND b - a <= 90000 THEN a END AS c_s,
  CASE WHEN a >= 0 AND a < b AND b - a <= 90000 THEN b END AS c_e, CASE WHEN a >= 0 AND a < b AND b - a <= 90000 THEN x END AS c_text FROM tt5)"""


@query("turn_timing", _TW + _TIMED + _TURN_TIMING + " SELECT * REPLACE (array_to_string(issues, ',') AS issues) FROM tt")
def turn_timing(spark, d):
    return flat(Speech(spark, d).timed_turns(), "issues")


_WINDOWS = f", win AS (SELECT recording_id, ord, s, e, {D.made_sql(D.WINDOW)} FROM pieces WHERE ord % 2 = 0)"
_OVER = OVERLAPS_SQL[OVERLAPS_SQL.index(", ov AS") :].rstrip() + ", over AS (SELECT recording_id, turn_ord, sum(e - s)::BIGINT AS overlap_ms FROM turn_overlaps GROUP BY 1, 2)"
_REVIEW = (
    _ATTRIBUTION.rstrip()
    + _TIMED
    + _TURN_TIMING
    + _WINDOWS
    + _OVER
    + """,
rw AS (SELECT t.recording_id, t.turn_ord, bool_or(NOT retained AND NOT disagreement) AS outlier, bool_or(disagreement AND NOT agreement) AS disputed FROM turns t JOIN win w ON w.recording_id = t.recording_id AND w.s < t.e AND w.e > t.s GROUP BY 1, 2),
rv AS (SELECT t.recording_id, t.turn_ord, t.s, t.e, t.speaker, list_sort(list_distinct(list_concat(list_filter(att.reasons, lambda r: r <> 'unresolved_voice_identity'), list_filter([CASE WHEN t.speaker = 'SPEAKER_UNKNOWN' THEN 'unknown_speaker' END,
  CASE WHEN over.overlap_ms IS NOT NULL THEN 'overlapping_voices' END, CASE WHEN tt.status = 'uncertain' THEN 'check_word_timing' END, CASE WHEN outlier THEN 'voice_reference_outlier' END, CASE WHEN disputed THEN 'diarizer_disagreement' END], lambda x: x IS NOT NULL)))) AS review
  FROM turns t JOIN att USING (recording_id, turn_ord) JOIN tt USING (recording_id, turn_ord) LEFT JOIN over USING (recording_id, turn_ord) LEFT JOIN rw USING (recording_id, turn_ord))"""
)


def reviewed(sp):
    key = ["recording_id", "turn_ord"]
    over = sp.overlaps.select(*key).distinct().withColumn("overlapped", F.lit(True))
    rows = sp.turns.join(sp.attributed().select(*key, "reasons", "status"), key).join(sp.timed_turns().select(*key, F.col("status").alias("timing")), key).join(over, key, "left")
    rows = rows.withColumn("overlapped", F.coalesce("overlapped", F.lit(False)))
    return sp.turns.select(*key, "s", "e", "speaker").join(R.review_reasons(rows, sp.windows), key)


@query("review_reasons", _REVIEW + " SELECT recording_id, turn_ord, array_to_string(review, ',') AS review FROM rv")
def review_reasons(spark, d):
    return flat(reviewed(Speech(spark, d)), "review").select("recording_id", "turn_ord", "review")


_ALIAS = "('L_user', 'user'), ('L_other', 'user'), ('L_assistant', 'assistant')"


@query(
    "voice_hints",
    _REVIEW
    + f""", al AS (SELECT DISTINCT recording_id, l AS local_speaker, v AS voice FROM pieces, (VALUES {_ALIAS}) x(l, v) WHERE recording_id % 3 <> 0),
hs AS (SELECT t.recording_id, t.turn_ord, list_sort(list_distinct(list(w.suggested))) AS suggested FROM turns t JOIN win w ON w.recording_id = t.recording_id AND w.s < t.e AND w.e > t.s AND w.suggested IS NOT NULL GROUP BY 1, 2),
hd AS (SELECT w.recording_id, w.turn_ord, bool_and(NOT w.ambiguous AND coalesce(a.voice = b.voice, false)) AS explained FROM wt w LEFT JOIN al a ON a.recording_id = w.recording_id AND a.local_speaker = w.local_speaker
  LEFT JOIN al b ON b.recording_id = w.recording_id AND b.local_speaker = w.secondary WHERE w.secondary <> w.local_speaker GROUP BY 1, 2),
hm AS (SELECT w.recording_id, w.turn_ord, list_distinct(list(a.voice)) AS matched FROM wt w JOIN al a ON a.recording_id = w.recording_id AND a.local_speaker = w.local_speaker GROUP BY 1, 2),
hh AS (SELECT rv.recording_id, rv.turn_ord, coalesce(suggested, []) AS suggested, coalesce(matched, []) AS matched, CASE WHEN explained THEN list_filter(review, lambda r: r <> 'sortformer_majority_disagrees') ELSE review END AS kept
  FROM rv LEFT JOIN hs USING (recording_id, turn_ord) LEFT JOIN hd USING (recording_id, turn_ord) LEFT JOIN hm USING (recording_id, turn_ord))
SELECT recording_id, turn_ord, array_to_string(suggested, ',') AS suggested, array_to_string(list_concat(kept, CASE WHEN len(suggested) > 1 OR (len(matched) > 0 AND len(list_filter(suggested, lambda v: NOT list_contains(matched, v))) > 0) THEN ['conflicting_voice_references'] ELSE [] END), ',') AS hints FROM hh""",
)
def voice_hints(spark, d):
    local = F.explode(F.expr("array(struct('L_user' AS l, 'user' AS v), struct('L_other' AS l, 'user' AS v), struct('L_assistant' AS l, 'assistant' AS v))")).alias("x")
    sp = Speech(spark, d)
    aliases = sp.pieces.where("recording_id % 3 <> 0").select("recording_id").distinct().select("recording_id", local).select("recording_id", F.col("x.l").alias("local_speaker"), F.col("x.v").alias("voice"))
    return flat(R.voice_hints(durable(reviewed(sp)), sp.timed_words, sp.windows, aliases), "suggested", "hints")


_FEATURES = (
    OVERLAPS_SQL.rstrip()
    + f""", over AS (SELECT recording_id, turn_ord, sum(e - s)::BIGINT AS overlap_ms FROM turn_overlaps GROUP BY 1, 2),
raw AS (SELECT DISTINCT a.recording_id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM pieces a JOIN pieces b ON a.recording_id = b.recording_id AND a.ord < b.ord AND a.local_speaker <> b.local_speaker AND b.e > a.s AND b.s < a.e),
ft AS (SELECT t.recording_id, t.turn_ord, t.s, t.e, t.speaker, t.text, t.pause_before, len(regexp_split_to_array(t.text, '\\s+')) AS n_words, coalesce(overlap_ms, 0) AS overlap_ms,
  EXISTS (SELECT 1 FROM raw r WHERE r.recording_id = t.recording_id AND r.s < t.e AND r.e > t.s) AS overlapped, {D.made_sql(D.FEATURE)} FROM turns t LEFT JOIN over USING (recording_id, turn_ord))"""
)
_OBSERVED = (
    _FEATURES
    + """,
ob0 AS (SELECT recording_id, speaker, median(level) AS own FROM ft WHERE NOT overlapped GROUP BY 1, 2), ob1 AS (SELECT recording_id, median(level) AS whole FROM ft GROUP BY 1),
ob2 AS (SELECT ft.*, level - coalesce(own, whole) AS relative, floor(1000000.0::DOUBLE * n_words / greatest(1, e - s) + 0.5::DOUBLE)::BIGINT AS rate FROM ft LEFT JOIN ob0 USING (recording_id, speaker) JOIN ob1 USING (recording_id)),
ob AS (SELECT *, list_filter([CASE WHEN overlapped THEN 'overlap' END, CASE WHEN relative >= 400 THEN 'elevated volume' END, CASE WHEN relative <= -600 THEN 'quiet speech' END, CASE WHEN rate >= 3200 THEN 'fast speech' END,
  CASE WHEN rate <= 1200 AND n_words >= 3 THEN 'slow speech' END, CASE WHEN pause_before >= 2000 THEN 'long pause before' END, CASE WHEN abs(change) >= 600 THEN 'substantial energy change' END,
  CASE WHEN pitch >= 250 THEN 'substantial pitch variation' END, CASE WHEN overlap_ms > 0 THEN 'overlap' END], lambda x: x IS NOT NULL) AS observed FROM ob2)"""
)


def featured(sp):
    key = ["recording_id", "turn_ord"]
    over = sp.overlaps.groupBy(*key).agg(F.sum(F.col("e") - F.col("s")).alias("overlap_ms"))
    hit = I.ms_join(sp.turns.select(*key, "s", "e"), sp.raw().select("recording_id", "s", "e")).select(*key).distinct().withColumn("overlapped", F.lit(True))
    rows = sp.turns.select(*key, "s", "e", "speaker", "text", "pause_before", F.size(F.split("text", r"\s+")).alias("n_words")).join(over, key, "left").join(hit, key, "left")
    rows = rows.withColumn("overlap_ms", F.coalesce("overlap_ms", F.lit(0))).withColumn("overlapped", F.coalesce("overlapped", F.lit(False)))
    return durable(D.made(rows, D.FEATURE))


@query("acoustic_observations", _OBSERVED + " SELECT recording_id, turn_ord, relative, rate, array_to_string(observed, ',') AS observed FROM ob")
def acoustic_observations(spark, d):
    return flat(R.observations(featured(Speech(spark, d))), "observed").select("recording_id", "turn_ord", "relative", "rate", "observed")


@query(
    "heuristic_tone",
    _FEATURES
    + """, h0 AS (SELECT recording_id, turn_ord, level / 400.0::DOUBLE AS volume, n_words * 1000.0::DOUBLE / greatest(1, e - s) AS speed, coalesce(pitch / 1000.0::DOUBLE, 0.1::DOUBLE) AS variation, change / 100.0::DOUBLE AS shift FROM ft),
h1 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.45::DOUBLE + volume / 16.0::DOUBLE + (speed - 2.0::DOUBLE) / 5.0::DOUBLE + variation / 2.0::DOUBLE)) AS a, greatest(0.0::DOUBLE, least(1.0::DOUBLE, variation * 1.8::DOUBLE + abs(shift) / 20.0::DOUBLE)) AS u FROM h0),
h2 AS (SELECT recording_id, turn_ord, unnest(['neutral', 'activated', 'subdued', 'tense']) AS label, unnest([0, 1, 2, 3]) AS i, unnest([exp(1.25::DOUBLE - abs(a - 0.45::DOUBLE) - u * 0.35::DOUBLE), exp(0.35::DOUBLE + a * 0.9::DOUBLE), exp(0.35::DOUBLE + (1.0::DOUBLE - a) * 0.75::DOUBLE), exp(0.2::DOUBLE + a * 0.45::DOUBLE + u * 0.55::DOUBLE)]) AS x FROM h1),
h3 AS (SELECT *, floor(x / sum(x) OVER (PARTITION BY recording_id, turn_ord) * 1e4 + 0.5) / 1e4 AS p FROM h2),
h4 AS (SELECT *, row_number() OVER (PARTITION BY recording_id, turn_ord ORDER BY p DESC, i) AS k FROM h3)
SELECT recording_id, turn_ord, string_agg(label, ',' ORDER BY k) AS labels, max(p)::DOUBLE AS best FROM h4 WHERE k <= 3 GROUP BY 1, 2""",
)
def heuristic_tone(spark, d):
    rows = featured(Speech(spark, d)).select(
        "recording_id", "turn_ord", (F.col("level") / 400.0).alias("volume"), (F.col("n_words") * 1000.0 / F.greatest(F.lit(1), F.col("e") - F.col("s"))).alias("speed"),
        (F.col("pitch") / 1000.0).alias("variation"), (F.col("change") / 100.0).alias("shift"),
    )
    found = R.heuristic_tone(rows)
    return found.select("recording_id", "turn_ord", F.array_join(F.transform("scores", lambda x: x["label"]), ",").alias("labels"), F.col("scores")[0]["p"].alias("best"))


_TONE = f""", tn AS (SELECT recording_id, turn_ord, s, e, unnest(range(s, e, 12000)) AS w_s FROM turns WHERE e > s),
tone AS (SELECT recording_id, turn_ord, w_s, least(e, w_s + 12000) AS w_e, {D.made_sql(D.TONE)} FROM tn WHERE least(e, w_s + 12000) - w_s >= 250)"""


_STRONG = "CASE WHEN l0 IN ('angry', 'disgusted', 'fearful', 'happy', 'sad', 'surprised') AND p0 >= 850 AND p0 - greatest(p1, p2) >= 300 THEN l0 END"


@query("strong_labels", TURNS_SQL.rstrip() + _TONE + f" SELECT recording_id, turn_ord, w_s, {_STRONG} AS label FROM tone")
def strong_labels(spark, d):
    return Speech(spark, d).tone.select("recording_id", "turn_ord", "w_s", R.strong_label(F.col("scores")).alias("label"))


@query(
    "rank_scores",
    TURNS_SQL.rstrip()
    + _TONE
    + """, q AS (SELECT recording_id, turn_ord, w_s, unnest(['X/' || upper(l0), ' ' || l1, CASE WHEN p2 % 2 = 0 THEN '<unk>' ELSE 'a/b/' || l2 END]) AS l, unnest([p2, p1, p0]) AS p, unnest([0, 1, 2]) AS i FROM tone),
q1 AS (SELECT *, CASE WHEN lower(regexp_extract(trim(l), '[^/]*$')) IN ('<unk>', 'unk', '') THEN 'unknown' ELSE lower(regexp_extract(trim(l), '[^/]*$')) END AS name FROM q)
SELECT recording_id, turn_ord, w_s, string_agg(name || ':' || p, ',' ORDER BY p DESC, i) AS scores FROM q1 GROUP BY 1, 2, 3""",
)
def rank_scores(spark, d):
    pair = lambda label, p: F.struct(label.alias("label"), F.col(p).alias("p"))
    third = F.when(F.col("p2") % 2 == 0, F.lit("<unk>")).otherwise(F.concat(F.lit("a/b/"), "l2"))
    scores = F.array(pair(F.concat(F.lit("X/"), F.upper("l0")), "p2"), pair(F.concat(F.lit(" "), "l1"), "p1"), pair(third, "p0"))
    text = F.transform(R.rank_scores(scores), lambda x: F.concat(x["label"], F.lit(":"), x["p"].cast("string")))
    return Speech(spark, d).tone.select("recording_id", "turn_ord", "w_s", F.array_join(text, ",").alias("scores"))


@query(
    "tone_weighted_mean",
    TURNS_SQL.rstrip()
    + _TONE
    + """, e AS (SELECT recording_id, turn_ord, w_s, w_e - w_s AS w, unnest([l0, l1, l2]) AS label, unnest([p0, p1, p2]) AS p, unnest([0, 1, 2]) AS i FROM tone),
m AS (SELECT recording_id, turn_ord, label, sum(p * w) AS t, min(w_s * 10 + i) AS o FROM e GROUP BY 1, 2, 3),
b AS (SELECT recording_id, turn_ord, string_agg(label, ',' ORDER BY t DESC, o) AS labels, max(t) AS top FROM m GROUP BY 1, 2), n AS (SELECT recording_id, turn_ord, sum(w_e - w_s) AS total, count(*) AS n_windows, count(DISTINCT l0) > 1 AS varies FROM tone GROUP BY 1, 2)
SELECT recording_id, turn_ord, labels, floor(top::DOUBLE / total::DOUBLE * 1e4 + 0.5) / 1e4 AS best, n_windows, varies, CASE WHEN labels LIKE 'unknown%' THEN 'unclassified' ELSE 'classified' END AS status FROM b JOIN n USING (recording_id, turn_ord)""",
)
def tone_weighted_mean(spark, d):
    found = R.summarize_tone(Speech(spark, d).tone)
    best = F.floor(F.col("scores")[0]["p"] * 1e4 + 0.5) / 1e4
    return found.select("recording_id", "turn_ord", F.array_join(F.transform("scores", lambda x: x["label"]), ",").alias("labels"), best.alias("best"), "n_windows", "varies", "status")


_GATE = (
    _TW
    + _TIMED
    + OVERLAPS_SQL[OVERLAPS_SQL.index(", ov AS") :].rstrip()
    + _TONE
    + f""",
gt0 AS (SELECT x.recording_id, x.turn_ord, x.w_s, x.w_e, x.label FROM (SELECT *, {_STRONG} AS label FROM tone) x JOIN turns t USING (recording_id, turn_ord) WHERE x.eligible AND x.confirmed AND x.label IS NOT NULL AND x.w_e - x.w_s >= 2500 AND x.w_s >= t.s AND x.w_e <= t.e
  AND NOT EXISTS (SELECT 1 FROM turn_overlaps v WHERE v.recording_id = x.recording_id AND v.turn_ord = x.turn_ord AND v.s < x.w_e AND v.e > x.w_s)),
gt1 AS (SELECT g.* FROM gt0 g WHERE EXISTS (SELECT 1 FROM wt w WHERE w.recording_id = g.recording_id AND w.turn_ord = g.turn_ord AND w.s < g.w_e AND w.e > g.w_s)
  AND NOT EXISTS (SELECT 1 FROM wt w WHERE w.recording_id = g.recording_id AND w.turn_ord = g.turn_ord AND w.s < g.w_e AND w.e > g.w_s AND len(w.issues) > 0)),
gt2 AS (SELECT recording_id, turn_ord, list(label ORDER BY o) AS ls FROM (SELECT recording_id, turn_ord, label, min(w_s) AS o FROM gt1 GROUP BY 1, 2, 3) GROUP BY 1, 2),
gt3 AS (SELECT recording_id, turn_ord, sum(w_e - w_s)::BIGINT AS covered FROM gt1 GROUP BY 1, 2),
gt4 AS (SELECT t.recording_id, t.turn_ord, t.e - t.s AS len, ls, coalesce(covered, 0) AS covered, list_filter([CASE WHEN t.speaker <> 'user' THEN 'adult_voice_not_confirmed' END, CASE WHEN model <> 'emotion2vec/emotion2vec_plus_large' THEN 'estimator_not_validated_for_display' END,
  CASE WHEN ls IS NULL THEN 'no_clean_consistent_strong_emotion' END], lambda v: v IS NOT NULL) AS suppressed FROM (SELECT recording_id, turn_ord, min(model) AS model FROM tone GROUP BY 1, 2) m JOIN turns t USING (recording_id, turn_ord) LEFT JOIN gt2 USING (recording_id, turn_ord) LEFT JOIN gt3 USING (recording_id, turn_ord))
SELECT recording_id, turn_ord, covered, array_to_string(suppressed, ',') AS suppressed, CASE WHEN len(suppressed) = 0 THEN CASE WHEN len(ls) = 1 THEN ls[1] ELSE 'varied (' || array_to_string(ls[1:3], ' -> ') || ')' END || CASE WHEN 10 * covered < 8 * len THEN ' (part of this passage)' ELSE '' END END AS shown FROM gt4"""
)


def gated(sp):
    profiles = sp.turns.select(F.col("speaker").alias("voice")).distinct().withColumn("role", F.when(F.col("voice") == "user", "adult").otherwise("unspecified"))
    return R.gate_tone(sp.turns, sp.tone, sp.timed_words, sp.overlaps, profiles)


@query("tone_gate", _GATE)
def tone_gate(spark, d):
    return flat(gated(Speech(spark, d)), "suppressed")


@query(
    "preserve_tone",
    TURNS_SQL.rstrip()
    + _TONE
    + """, x AS (SELECT t.recording_id, t.turn_ord, w.w_s, w.w_e, w.model FROM turns t JOIN (SELECT recording_id, w_s + turn_ord % 3 * 500 AS w_s, w_e + turn_ord % 3 * 500 AS w_e, model FROM tone) w ON w.recording_id = t.recording_id AND t.s <= w.w_s AND w.w_s < w.w_e AND w.w_e <= t.e)
SELECT * FROM x WHERE (recording_id, turn_ord) IN (SELECT (recording_id, turn_ord) FROM x GROUP BY recording_id, turn_ord HAVING count(DISTINCT model) = 1)""",
)
def preserve_tone(spark, d):
    shift = F.col("turn_ord") % 3 * 500
    sp = Speech(spark, d)
    old = sp.tone.select("recording_id", (F.col("w_s") + shift).alias("w_s"), (F.col("w_e") + shift).alias("w_e"), "model")
    return R.preserve_tone(old, sp.turns)
