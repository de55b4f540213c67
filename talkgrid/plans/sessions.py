"""Segments, turns, paragraphs, runs, utterances, chunks and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.functions import text as T
from talkgrid.operators import sessions as S
from talkgrid.plans.registry import fold_sql, query
from talkgrid.sources import speech as D

NORMAL_SQL = (
    D.WORDS_SQL
    + ", "
    + D.SEGS
    + """,
good AS (SELECT *, coalesce(speaker, 'SPEAKER_UNKNOWN') AS ss, coalesce(local_speaker, speaker, 'SPEAKER_UNKNOWN') AS sl FROM segs WHERE trim(line) <> ''),
nw AS (SELECT w.recording_id, w.seg_ord, w.word_ord, w.text, w.s, w.e, w.score, w.secondary, w.ambiguous, coalesce(w.speaker, g.ss) AS speaker,
  coalesce(w.local_speaker, g.sl) AS local_speaker, coalesce(w.identity, g.identity) AS identity, w.speaker IS NULL AS fallback FROM words w JOIN good g USING (recording_id, seg_ord))"""
)
SPLIT_SQL = (
    NORMAL_SQL
    + """,
k0 AS (SELECT *, CASE WHEN lag(speaker) OVER w <> speaker OR lag(local_speaker) OVER w <> local_speaker THEN 1 ELSE 0 END AS c FROM nw WINDOW w AS (PARTITION BY recording_id, seg_ord ORDER BY word_ord)),
k1 AS (SELECT *, sum(c) OVER (PARTITION BY recording_id, seg_ord ORDER BY word_ord) AS run FROM k0),
k2 AS (SELECT recording_id, seg_ord, run, any_value(speaker) AS wsp, any_value(local_speaker) AS wl, count(*) AS n_words, string_agg(text, ' ' ORDER BY word_ord) AS wt,
  list(s ORDER BY word_ord) AS ls, list(e ORDER BY word_ord) AS le, list(identity ORDER BY word_ord) AS li, count(DISTINCT coalesce(identity, '~')) AS kinds FROM k1 GROUP BY 1, 2, 3),
k3 AS (SELECT g.*, run, wsp, wl, n_words, wt, ls, le, li, kinds, count(run) OVER (PARTITION BY g.recording_id, g.seg_ord) > 1 AS many FROM good g LEFT JOIN k2 USING (recording_id, seg_ord)),
k4 AS (SELECT *, coalesce(CASE WHEN many THEN ls[1] ELSE s END, list_filter(ls, lambda x: x IS NOT NULL)[1], 0) AS s1,
  coalesce(CASE WHEN many THEN le[len(le)] ELSE e END, list_reverse(list_filter(le, lambda x: x IS NOT NULL))[1]) AS e1 FROM k3),
pieces AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY seg_ord, run) - 1 AS ord, seg_ord, coalesce(run, 0) AS run, s1 AS s, greatest(s1, coalesce(e1, s1)) AS e,
  coalesce(wsp, ss) AS speaker, coalesce(wl, sl) AS local_speaker,
  CASE WHEN kinds = 1 THEN coalesce(li[1], identity) WHEN len(list_filter(li, lambda i: i LIKE 'unresolved%')) > 0 THEN list_filter(li, lambda i: i LIKE 'unresolved%')[1]
    WHEN list_contains(li, 'human_verified') THEN 'partially_reviewed' ELSE identity END AS identity,
  confidence, CASE WHEN many THEN wt ELSE trim(line) END AS text, coalesce(n_words, 0) AS n_words FROM k4)"""
)
_JOINS = "b.speaker = f.speaker AND b.identity IS NOT DISTINCT FROM f.identity AND b.s - f.e <= 1250 AND b.e - f.t0 <= 30000"
TURNS_SQL = f"""WITH RECURSIVE {SPLIT_SQL},
tb AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY ord) AS rn FROM pieces WHERE trim(text) <> ''),
{fold_sql("tb", _JOINS, {"t0": ("b.s", "f.t0")})},
t0 AS (SELECT recording_id, grp AS turn_ord, list(s ORDER BY ord)[1] AS s, list(e ORDER BY ord DESC)[1] AS e, any_value(speaker) AS speaker, any_value(identity) AS identity, min(ord) AS first_ord, max(ord) AS last_ord,
  count(*) AS n_segments, string_agg(text, ' ' ORDER BY ord) AS text, list(confidence ORDER BY ord)[1] AS confidence, list(local_speaker ORDER BY ord) AS ll FROM fold GROUP BY 1, 2),
turns AS (SELECT * EXCLUDE (ll), list_reduce(ll, lambda a, x: CASE WHEN list_contains(string_split(a, ','), x) THEN a ELSE a || ',' || x END) AS local_speakers,
  greatest(0, s - greatest(0, coalesce(max(e) OVER (PARTITION BY recording_id ORDER BY turn_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS pause_before, printf('turn-%06d', turn_ord) AS turn_id FROM t0)
"""


def normal_words(spark, d):
    return S.normalize_words(D.words(spark, d), D.segments(spark, d))


def pieces(spark, d):
    return S.split_segments(normal_words(spark, d), D.segments(spark, d))


def turns(spark, d):
    return S.build_turns(pieces(spark, d))


@query("words_normalize", f"WITH {NORMAL_SQL} SELECT * FROM nw")
def words_normalize(spark, d):
    return normal_words(spark, d)


@query("segments_split", f"WITH {SPLIT_SQL} SELECT *, printf('segment-%06d', ord) AS segment_id FROM pieces")
def segments_split(spark, d):
    return pieces(spark, d)


@query("turns_build", TURNS_SQL + "SELECT * FROM turns")
def turns_build(spark, d):
    return turns(spark, d)


_MERGES = "b.speaker = f.speaker AND b.speaker <> 'SPEAKER_UNKNOWN' AND greatest(b.pause_before, b.s - f.e) < 2000 AND f.total + b.words <= 250"
PARAGRAPHS_SQL = (
    TURNS_SQL.rstrip()
    + f""", pb AS (SELECT recording_id, turn_ord, speaker, s, e, pause_before, text, len(regexp_split_to_array(text, '\\s+')) AS words, row_number() OVER (PARTITION BY recording_id ORDER BY turn_ord) AS rn FROM turns),
{fold_sql("pb", _MERGES, {"total": ("b.words", "f.total + b.words")}).replace("fold", "pfold")},
paragraphs AS (SELECT recording_id, grp AS paragraph, any_value(speaker) AS speaker, min(turn_ord) AS first_turn, max(turn_ord) AS last_turn, sum(words)::BIGINT AS words, string_agg(text, ' ' ORDER BY turn_ord) AS text FROM pfold GROUP BY 1, 2)
"""
)


@query("paragraphs_build", PARAGRAPHS_SQL + "SELECT * FROM paragraphs")
def paragraphs_build(spark, d):
    return S.build_paragraphs(turns(spark, d))


RUNS_SQL = (
    NORMAL_SQL
    + """,
r0 AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS c FROM nw WHERE s IS NOT NULL AND e > s AND regexp_matches(text, '[\\p{L}\\p{N}]') AND speaker <> 'SPEAKER_UNKNOWN' WINDOW w AS (PARTITION BY recording_id ORDER BY seg_ord, word_ord)),
r1 AS (SELECT *, sum(c) OVER (PARTITION BY recording_id ORDER BY seg_ord, word_ord) AS island FROM r0),
r2 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY recording_id, island ORDER BY seg_ord, word_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 450 THEN 0 ELSE 1 END AS n FROM r1),
r3 AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY seg_ord, word_ord) AS run FROM r2),
r4 AS (SELECT recording_id, run AS r, any_value(speaker) AS speaker, list(s ORDER BY seg_ord, word_ord)[1] AS s, max(e) AS e, count(*) AS n_words, count(DISTINCT seg_ord) AS n_segments, string_agg(text, ' ' ORDER BY seg_ord, word_ord) AS text FROM r3 GROUP BY 1, 2),
runs AS (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY recording_id ORDER BY s, e, r) - 1 AS run FROM r4)"""
)


@query("speaker_runs", f"WITH {RUNS_SQL} SELECT * FROM runs")
def speaker_runs(spark, d):
    return S.speaker_runs(normal_words(spark, d))


_GOES = "coalesce({0} <> '' AND NOT regexp_matches({0}, '[.!?]$') AND regexp_matches(regexp_extract(regexp_extract({1}, '^\\S+'), '\\p{{L}}'), '^\\p{{Ll}}$'), false)"
_CORE = "regexp_replace(regexp_extract({0}, '\\S+$'), '[\"'')\\]}} ]+$', '')"


@query(
    "neighbour_context",
    f"""WITH {RUNS_SQL}, c0 AS (SELECT *, lag(speaker) OVER w AS ps, lag(e) OVER w AS pe, lag(text) OVER w AS pt, lead(speaker) OVER w AS ns, lead(s) OVER w AS n0 FROM runs WINDOW w AS (PARTITION BY recording_id ORDER BY run))
SELECT recording_id, run, speaker, CASE WHEN s - pe <= 1250 THEN ps END AS "before", CASE WHEN n0 - e <= 1250 THEN ns END AS "after", coalesce(abs(s - pe) <= 120, false) AND {_GOES.format(_CORE.format("pt"), "text")} AS goes_on FROM c0""",
)
def neighbour_context(spark, d):
    return S.neighbour_context(S.speaker_runs(normal_words(spark, d)))


_UTTERANCES = f"""WITH RECURSIVE {NORMAL_SQL},
ub AS (SELECT *, regexp_matches(text, '[.!?]["'')\\]}} ]*$') AS ends, row_number() OVER (PARTITION BY recording_id ORDER BY s, e, seg_ord, word_ord) AS rn FROM nw WHERE s IS NOT NULL AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
{fold_sql("ub", "greatest(0, b.s - f.e) <= 350 AND NOT f.ends AND f.e - f.u0 < 12000", {"u0": ("b.s", "f.u0")})}
"""


@query(
    "lexical_utterances",
    _UTTERANCES + "SELECT recording_id, grp AS utterance, min(s) AS s, list(e ORDER BY rn DESC)[1] AS e, count(*) AS n_words, count(DISTINCT seg_ord) AS n_segments, string_agg(text, ' ' ORDER BY rn) AS text FROM fold GROUP BY 1, 2",
)
def lexical_utterances(spark, d):
    return S.utterances(normal_words(spark, d))


@query(
    "label_patterns",
    f"""WITH {NORMAL_SQL},
p0 AS (SELECT recording_id, seg_ord AS utterance, word_ord, speaker, s, e, CASE WHEN lag(speaker) OVER (PARTITION BY recording_id, seg_ord ORDER BY word_ord) = speaker THEN 0 ELSE 1 END AS c FROM nw WHERE s IS NOT NULL),
p1 AS (SELECT *, sum(c) OVER (PARTITION BY recording_id, utterance ORDER BY word_ord) AS run FROM p0),
p2 AS (SELECT recording_id, utterance, run, any_value(speaker) AS speaker, min(s) AS s, max(e) AS e FROM p1 GROUP BY 1, 2, 3),
p3 AS (SELECT recording_id, utterance, list(speaker ORDER BY run) AS l, list(s ORDER BY run) AS ls, list(e ORDER BY run) AS le FROM p2 GROUP BY 1, 2)
SELECT recording_id, utterance, l[1] AS "outer", l[2] AS middle, ls[2] AS s, le[2] AS e FROM p3 WHERE len(l) = 3 AND l[1] = l[3]""",
)
def label_patterns(spark, d):
    words = normal_words(spark, d).where("s is not null")
    return S.label_patterns(words.select("recording_id", F.col("seg_ord").alias("utterance"), F.col("word_ord").alias("ord"), "speaker", "s", "e"))


CHUNKS_SQL = f"""WITH RECURSIVE {D.WORDS_SQL}, {D.SEGS},
cb AS (SELECT recording_id * 1000000 + seg_ord AS recording_id, recording_id AS rec, seg_ord, word_ord, s, e, row_number() OVER (PARTITION BY recording_id, seg_ord ORDER BY word_ord) AS rn FROM words WHERE s IS NOT NULL AND e IS NOT NULL),
{fold_sql("cb", "NOT ((b.s - f.e >= 320 AND f.e - f.c0 >= 550) OR f.e - f.c0 >= 1250)", {"c0": ("b.s", "f.c0")})},
c1 AS (SELECT rec AS recording_id, seg_ord, grp, list(s ORDER BY rn)[1] AS s, list(e ORDER BY rn DESC)[1] AS e, count(*) AS n_words FROM fold GROUP BY 1, 2, 3
  UNION ALL SELECT recording_id, seg_ord, 0, coalesce(s, 0), greatest(coalesce(s, 0), coalesce(e, s, 0)), 0 FROM segs WHERE NOT EXISTS (SELECT 1 FROM cb WHERE rec = segs.recording_id AND cb.seg_ord = segs.seg_ord)),
chunks AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY seg_ord, grp) - 1 AS chunk, seg_ord, s, e, n_words FROM c1)
"""


def chunks(spark, d):
    return S.chunks(D.words(spark, d), D.segments(spark, d))


@query("word_chunks", CHUNKS_SQL + "SELECT * FROM chunks")
def word_chunks(spark, d):
    return chunks(spark, d)


_LABEL = "'C' || ((chunk * 7 + seg_ord) % 3)"
SMOOTH_SQL = (
    CHUNKS_SQL.rstrip()
    + f""", l0 AS (SELECT *, {_LABEL} AS label, coalesce(lag(seg_ord) OVER w = seg_ord AND e - s < 350 AND s - lag(e) OVER w < 250, false) AS copies FROM chunks WINDOW w AS (PARTITION BY recording_id ORDER BY chunk)),
l1 AS (SELECT recording_id, chunk, seg_ord, s, e, n_words, last_value(CASE WHEN NOT copies THEN label END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY chunk) AS label FROM l0)"""
)


def labelled(spark, d):
    return S.smooth_fragments(chunks(spark, d).withColumn("label", F.expr(_LABEL)))


@query("smooth_fragments", SMOOTH_SQL + " SELECT * FROM l1")
def smooth_fragments(spark, d):
    return labelled(spark, d)


MINOR_SQL = (
    SMOOTH_SQL
    + """, m0 AS (SELECT recording_id, seg_ord, label, sum(greatest(0, e - s)) AS total, min(chunk) AS seen FROM l1 GROUP BY 1, 2, 3),
m1 AS (SELECT recording_id, seg_ord, list(label ORDER BY total DESC, seen)[1] AS majority, count(*) AS n FROM m0 GROUP BY 1, 2),
m2 AS (SELECT l1.recording_id, l1.chunk, l1.seg_ord, l1.s, l1.e, l1.n_words, CASE WHEN n > 1 AND total < 850 THEN majority ELSE l1.label END AS label FROM l1 JOIN m0 USING (recording_id, seg_ord, label) JOIN m1 USING (recording_id, seg_ord))"""
)


@query("smooth_minorities", MINOR_SQL + " SELECT * FROM m2")
def smooth_minorities(spark, d):
    return S.smooth_minorities(labelled(spark, d))


@query(
    "first_seen_labels",
    MINOR_SQL + ", f0 AS (SELECT recording_id, label, row_number() OVER (PARTITION BY recording_id ORDER BY min(chunk)) - 1 AS k FROM m2 GROUP BY 1, 2) SELECT m2.*, printf('SPEAKER_%02d', k) AS speaker FROM m2 JOIN f0 USING (recording_id, label)",
)
def first_seen_labels(spark, d):
    return S.first_seen_labels(S.smooth_minorities(labelled(spark, d)))


@query(
    "scored_windows",
    TURNS_SQL + ", w AS (SELECT recording_id, turn_ord, s, e, unnest(range(s, e, 12000)) AS w_s FROM turns WHERE e > s) SELECT recording_id, turn_ord, w_s, least(e, w_s + 12000) AS w_e FROM w WHERE least(e, w_s + 12000) - w_s >= 250",
)
def scored_windows(spark, d):
    return S.scored_windows(turns(spark, d))


@query("word_numbers", f"WITH {NORMAL_SQL} SELECT recording_id, seg_ord, word_ord, text, s, row_number() OVER (PARTITION BY recording_id ORDER BY seg_ord, word_ord) - 1 AS word_index FROM nw")
def word_numbers(spark, d):
    return S.word_numbers(D.words(spark, d), D.segments(spark, d))


@query(
    "tokens",
    f"WITH {NORMAL_SQL} SELECT recording_id, seg_ord, word_ord, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g') AS token FROM nw",
)
def tokens(spark, d):
    return normal_words(spark, d).select("recording_id", "seg_ord", "word_ord", T.token(F.col("text")).alias("token"))
