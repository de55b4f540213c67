"""Refined speaker labels."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from talkgrid.operators import intervals as I
from talkgrid.operators import refine as X
from talkgrid.operators import sessions as S
from talkgrid.plans.registry import fold_sql, query
from talkgrid.plans.rules import Speech
from talkgrid.plans.sessions import _CORE, _GOES, NORMAL_SQL, SPLIT_SQL
from talkgrid.session import durable
from talkgrid.sources import speech as D

# similarities of a run or utterance to each voice, made up from its number
_SCORE = "(recording_id * 13 + {0} * 37 + place * 411) % 800 + 100"
_VOICES = ("user", "assistant", "SPK_X")
_EVIDENCE = "evi AS (SELECT recording_id, place, voice, (recording_id * 700 + place * 2900) % 9000 + 1500 AS clean_ms, (recording_id + place) % 7 + 1 AS window_count, (recording_id * 37 + place * 101) % 600 + 350 AS cohesion FROM (SELECT DISTINCT recording_id FROM ms0), (VALUES (0, 'user'), (1, 'assistant'), (2, 'SPK_X')) v(place, voice)), pro AS (SELECT * FROM evi WHERE clean_ms >= 4000 AND window_count >= 2 AND cohesion >= 400)"
# where two local speakers talk at once, by the pieces of the recording
_REGIONS = """x0 AS (SELECT a.recording_id, greatest(a.s, b.s, 0) AS s, least(a.e, b.e) AS e FROM pieces a JOIN pieces b ON a.recording_id = b.recording_id AND a.ord < b.ord AND a.local_speaker <> b.local_speaker AND b.e > a.s AND b.s < a.e AND a.e > a.s AND b.e > b.s AND a.local_speaker <> 'SPEAKER_UNKNOWN' AND b.local_speaker <> 'SPEAKER_UNKNOWN'),
x1 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY recording_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 20 THEN 0 ELSE 1 END AS n FROM x0 WHERE e > s),
x2 AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM x1), reg AS (SELECT recording_id, min(s) AS s, max(e) AS e FROM x2 GROUP BY recording_id, island)"""
_VOTE = """{0}0 AS (SELECT recording_id, {1} AS k, secondary, sum(greatest(0, e - s))::BIGINT AS ms, min(o) AS first FROM {2} GROUP BY 1, 2, 3), {0}1 AS (SELECT *, sum(ms) OVER (PARTITION BY recording_id, k) AS total FROM {0}0),
{0}2 AS (SELECT *, sum(ms) OVER (PARTITION BY recording_id, k) AS compared, row_number() OVER (PARTITION BY recording_id, k ORDER BY ms DESC, first) AS n FROM {0}1 WHERE secondary IS NOT NULL),
{0} AS (SELECT recording_id, k, CASE WHEN compared >= greatest(200.0, total / 2.0) AND 100 * ms >= 65 * compared THEN secondary END AS vote FROM {0}2 WHERE n = 1)"""


def _scored(name: str, rows: str, number: str, extra: int = 0) -> str:
    return f"""{name}0 AS (SELECT r.recording_id, r.{number} AS k, p.voice, (r.recording_id * 13 + (r.{number} + {extra}) * 37 + p.place * 411) % 800 + 100 AS score FROM {rows} r JOIN pro p USING (recording_id)),
{name}1 AS (SELECT *, row_number() OVER w AS n, score - coalesce(lead(score) OVER w, -1000) AS margin FROM {name}0 WINDOW w AS (PARTITION BY recording_id, k ORDER BY score DESC, voice)), {name} AS (SELECT recording_id, k, voice AS best, score AS best_score, margin FROM {name}1 WHERE n = 1)"""


_WORDS = "ut AS (SELECT recording_id, seg_ord, word_ord, s, e, speaker, CASE secondary WHEN 'L_user' THEN 'user' WHEN 'L_assistant' THEN 'assistant' WHEN 'L_other' THEN 'SPK_X' END AS secondary, rn AS o, grp AS utterance FROM fold)"
_UTTERANCE = f"""WITH RECURSIVE {SPLIT_SQL}, {_EVIDENCE}, {_REGIONS},
ub AS (SELECT *, regexp_matches(text, '[.!?]["'')\\]}} ]*$') AS ends, row_number() OVER (PARTITION BY recording_id ORDER BY s, e, seg_ord, word_ord) AS rn FROM nw WHERE s IS NOT NULL AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
{fold_sql("ub", "greatest(0, b.s - f.e) <= 350 AND NOT f.ends AND f.e - f.u0 < 12000", {"u0": ("b.s", "f.u0")})}, {_WORDS},
u1 AS (SELECT ut.*, p.voice IS NOT NULL AS known, CASE WHEN lag(ut.speaker) OVER (PARTITION BY ut.recording_id, utterance ORDER BY o) = ut.speaker THEN 0 ELSE 1 END AS c FROM ut LEFT JOIN pro p ON p.recording_id = ut.recording_id AND p.voice = ut.speaker),
u2 AS (SELECT *, sum(c) OVER (PARTITION BY recording_id, utterance ORDER BY o) AS run FROM u1), u3 AS (SELECT recording_id, utterance, run, any_value(speaker) AS speaker, min(s) AS s, list(e ORDER BY o DESC)[1] AS e, bool_and(known) AS known FROM u2 GROUP BY 1, 2, 3),
u4 AS (SELECT recording_id, utterance, list(speaker ORDER BY run) AS l, min(s) AS s, list(e ORDER BY run DESC)[1] AS e, bool_and(known) AS known, list(s ORDER BY run) AS ls, list(e ORDER BY run) AS le FROM u3 GROUP BY 1, 2),
u5 AS (SELECT * FROM u4 WHERE len(l) = 3 AND l[1] = l[3] AND known AND e - s BETWEEN 350 AND 12000 AND (SELECT coalesce(sum(least(u4.e, g.e) - greatest(u4.s, g.s)), 0) FROM reg g WHERE g.recording_id = u4.recording_id AND g.e > u4.s AND g.s < u4.e) <= least(120.0, (u4.e - u4.s) * 0.15)),
{_scored("us", "u5", "utterance")}, {_scored("ms", "u5", "utterance", 5)}, um AS (SELECT * FROM u2 WHERE run = 2), {_VOTE.format("uv", "utterance", "um")},
u6 AS (SELECT u5.*, best, margin, vote, l[1] AS target, (SELECT score FROM us0 WHERE us0.recording_id = u5.recording_id AND us0.k = u5.utterance AND voice = l[1]) AS own, (SELECT score FROM ms0_ WHERE ms0_.recording_id = u5.recording_id AND ms0_.k = u5.utterance AND voice = l[1]) AS mid,
  (SELECT max(score) FROM ms0_ WHERE ms0_.recording_id = u5.recording_id AND ms0_.k = u5.utterance AND voice <> l[1]) AS rest, CASE WHEN vote = l[1] THEN 450 ELSE 520 END AS alike, CASE WHEN vote = l[1] THEN 100 ELSE 140 END AS lead_
  FROM u5 JOIN us ON us.recording_id = u5.recording_id AND us.k = u5.utterance LEFT JOIN uv ON uv.recording_id = u5.recording_id AND uv.k = u5.utterance),
ud AS (SELECT recording_id, utterance, l[2] AS original, target, ls[2] AS s, le[2] AS e, CASE WHEN vote IS NOT NULL AND vote <> target THEN 'abstained_sortformer_disagreement' WHEN best <> target OR own < alike OR margin < lead_ THEN 'abstained_below_confidence_threshold'
  WHEN mid IS NULL OR mid < 420 OR mid - coalesce(rest, -1000) < lead_ THEN 'abstained_candidate_voice_ambiguous' ELSE 'corrected' END AS decision FROM u6)
""".replace("ms0 AS (SELECT r.recording_id", "ms0_ AS (SELECT r.recording_id").replace("FROM ms0 WINDOW", "FROM ms0_ WINDOW")
_SETTLED = "set_ AS (SELECT recording_id, s, e FROM ud WHERE decision IN ('corrected', 'abstained_sortformer_disagreement', 'abstained_candidate_voice_ambiguous'))"


class Refinement(Speech):
    """The evidence and the words of a query on refinement."""

    @cached_property
    def evidence(self):
        place = F.explode(F.arrays_zip(F.array(*map(F.lit, range(3))).alias("place"), F.array(*map(F.lit, _VOICES)).alias("voice"))).alias("x")
        rows = self.words.select("recording_id").distinct().select("recording_id", place).select("recording_id", F.col("x.place").alias("place"), F.col("x.voice").alias("voice"))
        r, p = F.col("recording_id"), F.col("place")
        return rows.select("*", ((r * 700 + p * 2900) % 9000 + 1500).alias("clean_ms"), ((r + p) % 7 + 1).alias("window_count"), ((r * 37 + p * 101) % 600 + 350).alias("cohesion"))

    @cached_property
    def voices(self):
        return durable(X.prototypes(self.evidence))

    @cached_property
    def regions(self):
        return durable(I.overlap_regions(self.pieces.select("recording_id", "ord", "s", "e", F.col("local_speaker").alias("speaker"))).select("recording_id", "s", "e"))

    def scores(self, rows, number, extra=0):
        place = F.col("place")
        value = (F.col("recording_id") * 13 + (F.col(number) + extra) * 37 + place * 411) % 800 + 100
        return rows.select("recording_id", number).distinct().join(self.voices, "recording_id").select("recording_id", number, "voice", value.alias("score"))

    @staticmethod
    def voted(words):
        label = F.col("secondary")
        return words.withColumn("secondary", F.when(label == "L_user", "user").when(label == "L_assistant", "assistant").when(label == "L_other", "SPK_X"))

    @cached_property
    def utterances(self):
        words = self.voted(S.utterance_words(self.words))
        # places by time, as an utterance's words lie
        from pyspark.sql.window import Window

        words = durable(words.withColumn("ord", F.row_number().over(Window.partitionBy("recording_id", "utterance").orderBy(*S.BY_TIME))))
        return durable(X.utterance_decisions(words, self.scores(words, "utterance"), self.scores(words, "utterance", 5), self.voices, self.regions))

    @cached_property
    def run_words(self):
        from pyspark.sql.window import Window

        words = self.voted(S.run_words(self.words))
        return durable(words.withColumn("ord", F.row_number().over(Window.partitionBy("recording_id").orderBy("seg_ord", "word_ord"))))

    @cached_property
    def runs(self):
        settled = self.utterances.where("decision in ('corrected', 'abstained_sortformer_disagreement', 'abstained_candidate_voice_ambiguous')").select("recording_id", "s", "e")
        runs = durable(S.speaker_runs(self.words))
        return durable(X.run_decisions(runs, self.run_words, self.scores(runs, "run"), self.voices, self.regions, settled))


@query("prototypes", f"WITH {D.MS_SQL}, {_EVIDENCE} SELECT recording_id, voice FROM pro WHERE recording_id IN (SELECT recording_id FROM ms0)")
def prototypes(spark, d):
    return Refinement(spark, d).voices.select("recording_id", "voice")


@query("refine_utterances", _UTTERANCE + "SELECT * FROM ud")
def refine_utterances(spark, d):
    return Refinement(spark, d).utterances


_RUNS = (
    _UTTERANCE.rstrip()
    + f""", {_SETTLED},
r0 AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS c, row_number() OVER w AS o FROM nw WHERE s IS NOT NULL AND e > s AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AND speaker <> 'SPEAKER_UNKNOWN' WINDOW w AS (PARTITION BY recording_id ORDER BY seg_ord, word_ord)),
r1 AS (SELECT *, sum(c) OVER (PARTITION BY recording_id ORDER BY o) AS island FROM r0), r2 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY recording_id, island ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 450 THEN 0 ELSE 1 END AS n FROM r1),
r3 AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY o) AS r FROM r2), r4 AS (SELECT recording_id, r, any_value(speaker) AS speaker, list(s ORDER BY o)[1] AS s, max(e) AS e, string_agg(text, ' ' ORDER BY o) AS text FROM r3 GROUP BY 1, 2),
runs AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY s, e, r) - 1 AS run FROM r4),
rw AS (SELECT r3.recording_id, r3.seg_ord, r3.word_ord, r3.o, r3.s, r3.e, r3.speaker, CASE secondary WHEN 'L_user' THEN 'user' WHEN 'L_assistant' THEN 'assistant' WHEN 'L_other' THEN 'SPK_X' END AS secondary, run FROM r3 JOIN runs USING (recording_id, r)),
c0 AS (SELECT *, lag(speaker) OVER w AS ps, lag(text) OVER w AS pt, greatest(0, s - lag(e) OVER w) AS g0, lead(speaker) OVER w AS ns, lead(text) OVER w AS nt, greatest(0, lead(s) OVER w - e) AS g1, lag(run) OVER w IS NOT NULL AS hp, lead(run) OVER w IS NOT NULL AS hn FROM runs WINDOW w AS (PARTITION BY recording_id ORDER BY run)),
c1 AS (SELECT recording_id, run, speaker, s, e, e - s AS len, list_filter([CASE WHEN hp AND g0 <= 1250 THEN ps END, CASE WHEN hn AND g1 <= 1250 THEN ns END], lambda x: x IS NOT NULL) AS nb,
  list_filter([CASE WHEN hp AND g0 <= 120 AND {_GOES.format(_CORE.format("pt"), "text")} THEN ps END, CASE WHEN hn AND g1 <= 120 AND {_GOES.format(_CORE.format("text"), "nt")} THEN ns END], lambda x: x IS NOT NULL) AS sm FROM c0),
kn AS (SELECT recording_id, list(voice) AS known FROM pro GROUP BY 1),
c2 AS (SELECT c1.*, list_filter(nb, lambda v: list_contains(known, v) AND v <> speaker) AS nb1, list_filter(sm, lambda v: list_contains(known, v) AND v <> speaker) AS sm1 FROM c1 JOIN kn USING (recording_id) WHERE len >= 350 AND list_contains(known, speaker) AND len(known) >= 2),
c3 AS (SELECT *, CASE WHEN len <= 2000 THEN nb1 ELSE sm1 END AS sup FROM c2 WHERE (len <= 2000 OR (len <= 12000 AND len(sm1) > 0))
  AND (SELECT coalesce(sum(least(c2.e, g.e) - greatest(c2.s, g.s)), 0) FROM reg g WHERE g.recording_id = c2.recording_id AND g.e > c2.s AND g.s < c2.e) <= least(120.0, (c2.e - c2.s) * 0.15)
  AND NOT EXISTS (SELECT 1 FROM set_ g WHERE g.recording_id = c2.recording_id AND g.e > c2.s AND g.s < c2.e)),
{_scored("rs", "runs", "run")}, {_VOTE.format("rv", "run", "rw")},
c4 AS (SELECT c3.*, best, best_score, margin, vote, len(list_filter(nb, lambda v: v = best)) AS n_nb, len(list_filter(sm, lambda v: v = best)) AS n_sm FROM c3 JOIN rs ON rs.recording_id = c3.recording_id AND rs.k = c3.run LEFT JOIN rv ON rv.recording_id = c3.recording_id AND rv.k = c3.run WHERE len(sup) > 0),
rd AS (SELECT recording_id, run, speaker AS original, best, s, e, margin, CASE WHEN best = speaker THEN 'kept_original' WHEN NOT list_contains(sup, best) THEN 'abstained_best_voice_not_supported_by_context' WHEN vote IS NOT NULL AND vote <> best THEN 'abstained_sortformer_disagreement'
  WHEN best_score < CASE WHEN len <= 500 AND n_sm > 0 THEN 420 WHEN len < 600 THEN 550 ELSE 520 END OR margin < CASE WHEN len <= 500 AND n_sm > 0 THEN 200 ELSE CASE WHEN n_nb >= 2 THEN 100 ELSE 140 END + CASE WHEN len > 1400 THEN 40 ELSE 0 END END THEN 'abstained_below_confidence_threshold' ELSE 'corrected' END AS decision FROM c4)
"""
)


@query("refine_runs", _RUNS + "SELECT * FROM rd")
def refine_runs(spark, d):
    return Refinement(spark, d).runs


_FIXED = _RUNS.rstrip() + ", fx AS (SELECT rw.recording_id, rw.seg_ord, rw.word_ord, rw.s, rw.e, coalesce(rd.best, rw.speaker) AS speaker, CASE WHEN rd.best IS NOT NULL THEN rw.speaker END AS \"from\" FROM rw LEFT JOIN rd ON rd.recording_id = rw.recording_id AND rd.run = rw.run AND rd.decision = 'corrected')"


def fixed(sp):
    return X.corrected_words(sp.run_words, sp.runs.where("decision = 'corrected'"))


@query("refined_words", _FIXED + " SELECT * FROM fx")
def refined_words(spark, d):
    return fixed(Refinement(spark, d)).select("recording_id", "seg_ord", "word_ord", "s", "e", "speaker", "from")


@query(
    "refined_segments",
    _FIXED
    + """, sp AS (SELECT recording_id, seg_ord, speaker, sum(greatest(0, e - s)) AS ms, min(word_ord) AS first FROM fx GROUP BY 1, 2, 3), sb AS (SELECT recording_id, seg_ord, list(speaker ORDER BY ms DESC, first)[1] AS speaker FROM sp GROUP BY 1, 2), sf AS (SELECT recording_id, seg_ord, count("from") AS corrected FROM fx GROUP BY 1, 2)
SELECT sb.recording_id, sb.seg_ord, sb.speaker, corrected, coalesce(segs.speaker, 'SPEAKER_UNKNOWN') <> sb.speaker AS changed FROM sb JOIN sf USING (recording_id, seg_ord) JOIN segs USING (recording_id, seg_ord) WHERE corrected > 0""",
)
def refined_segments(spark, d):
    return X.refined_segments(fixed(Refinement(spark, d)), D.segments(spark, d))
