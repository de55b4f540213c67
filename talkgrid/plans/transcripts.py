"""Rendered transcripts, cues and output names."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.functions import text as T
from talkgrid.operators import render as N
from talkgrid.operators import rules as R
from talkgrid.plans.registry import query
from talkgrid.plans.rules import _OBSERVED, _TONE, Speech, featured
from talkgrid.plans.sessions import PARAGRAPHS_SQL, SPLIT_SQL, TURNS_SQL
from talkgrid.session import durable
from talkgrid.sources import adapters as A

_PROFILES = "prof AS (SELECT * FROM (VALUES ('user', 'Ann <A&B>', 'adult'), ('assistant', 'assistant', 'child'), ('SPK_X', 'Guest', 'unspecified')) x(voice, label, role))"
_STAMP = "printf('%02d:%02d:%02d{1}%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_SHOWN = "CASE WHEN {0} = 'SPEAKER_UNKNOWN' THEN 'UNKNOWN' WHEN {1} <> '' AND {1} <> {0} THEN {1} || ' [' || {0} || ']' ELSE {0} END"
_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def profiles(spark):
    rows = [("user", "Ann <A&B>", "adult"), ("assistant", "assistant", "child"), ("SPK_X", "Guest", "unspecified")]
    return spark.createDataFrame(rows, "voice string, label string, role string")


@query("speaker_display", f"WITH {SPLIT_SQL}, {_PROFILES} SELECT recording_id, ord, {_SHOWN.format('p.speaker', 'label')} AS shown FROM pieces p LEFT JOIN prof ON voice = speaker")
def speaker_display(spark, d):
    rows = Speech(spark, d).pieces.join(profiles(spark).select(F.col("voice").alias("speaker"), "label"), "speaker", "left")
    return rows.select("recording_id", "ord", T.speaker_display(F.col("speaker"), F.col("label")).alias("shown"))


@query(
    "render_srt",
    f"""WITH {SPLIT_SQL}, {_PROFILES}, c AS (SELECT recording_id, ord, (row_number() OVER (PARTITION BY recording_id ORDER BY ord))::VARCHAR || chr(10) || {_STAMP.format('s', ',')} || ' --> ' || {_STAMP.format('e', ',')} || chr(10) || '[' || {_SHOWN.format('speaker', 'label')} || '] ' || trim(text) AS cue FROM pieces LEFT JOIN prof ON voice = speaker)
SELECT recording_id, string_agg(cue, chr(10) || chr(10) ORDER BY ord) || chr(10) AS text FROM c GROUP BY 1""",
)
def render_srt(spark, d):
    return N.cues(Speech(spark, d).pieces, profiles(spark), "srt")


@query(
    "render_vtt",
    f"""WITH {SPLIT_SQL}, {_PROFILES}, v AS (SELECT *, {_SHOWN.format('speaker', 'label')} AS shown FROM pieces LEFT JOIN prof ON voice = speaker),
c AS (SELECT recording_id, ord, {_STAMP.format('s', '.')} || ' --> ' || {_STAMP.format('e', '.')} || chr(10) || '<v ' || {_ESCAPED.format('shown')} || '>' || {_ESCAPED.format('trim(text)')} || '</v>' AS cue FROM v)
SELECT recording_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(cue, chr(10) || chr(10) ORDER BY ord) || chr(10) AS text FROM c GROUP BY 1""",
)
def render_vtt(spark, d):
    return N.cues(Speech(spark, d).pieces, profiles(spark), "vtt")


_SHARE = "floor(x * 100)::BIGINT + CASE WHEN x * 100 - floor(x * 100) > 0.5 OR (x * 100 - floor(x * 100) = 0.5 AND floor(x * 100)::BIGINT % 2 = 1) THEN 1 ELSE 0 END"
_LINES = (
    _TONE
    + f""", tl0 AS (SELECT recording_id, turn_ord, w_s, unnest([l0, l1, l2]) AS label, unnest([p0, p1, p2]) / 1000.0::DOUBLE AS x, unnest([0, 1, 2]) AS i FROM tone),
tl1 AS (SELECT recording_id, turn_ord, w_s, string_agg(CASE WHEN label = 'unknown' THEN 'unclassified' ELSE label END || ' ' || ({_SHARE})::VARCHAR || '%', ', ' ORDER BY i) AS shown FROM tl0 GROUP BY 1, 2, 3),
lines AS (SELECT recording_id, turn_ord, w_s, CASE WHEN turn_ord % 8 = 0 THEN 'unavailable' WHEN turn_ord % 3 = 0 THEN 'varies across ' || (turn_ord % 5)::VARCHAR || ' windows; ' || shown ELSE shown END AS line FROM tl1)"""
)


def tone_lines(sp):
    share = F.transform("scores", lambda x: F.struct(x["label"].alias("label"), (x["p"] / 1000.0).alias("p")))
    kind = F.when(F.col("turn_ord") % 8 == 0, "unavailable").otherwise("approximate_model_estimate")
    line = N.tone_line(share, F.col("turn_ord") % 5, F.col("turn_ord") % 3 == 0, kind)
    return sp.tone.select("recording_id", "turn_ord", "w_s", line.alias("line"))


@query("tone_lines", TURNS_SQL.rstrip() + _LINES + " SELECT * FROM lines")
def tone_line(spark, d):
    return tone_lines(Speech(spark, d))


# the tone that a turn shows here, made up from its number
_SIGNAL = "CASE WHEN turn_ord % 4 = 0 THEN NULL ELSE CASE WHEN turn_ord % 7 < 3 THEN 'happy' ELSE 'sad' END END"
_READABLE = (
    PARAGRAPHS_SQL.rstrip()
    + _OBSERVED[_OBSERVED.index(", ov AS") :]
    + f""", {_PROFILES},
sig AS (SELECT pfold.recording_id, pfold.grp AS paragraph, pfold.turn_ord, pfold.text, ob.observed, {_SIGNAL.replace('turn_ord', 'pfold.turn_ord')} AS tone FROM pfold JOIN ob USING (recording_id, turn_ord)),
cx0 AS (SELECT recording_id, paragraph, turn_ord, unnest(observed) AS o, generate_subscripts(observed, 1) AS i FROM sig),
cx AS (SELECT recording_id, paragraph, string_agg(o, '; ' ORDER BY k) AS context FROM (SELECT recording_id, paragraph, CASE o WHEN 'overlap' THEN 'overlapping speech' ELSE o END AS o, min(turn_ord * 100 + i) AS k FROM cx0
  WHERE o IN ('long pause before', 'overlap', 'interruption', 'elevated volume') GROUP BY 1, 2, 3) GROUP BY 1, 2),
tn0 AS (SELECT recording_id, paragraph, turn_ord, tone, lag(tone) OVER (PARTITION BY recording_id, paragraph ORDER BY turn_ord) AS before FROM sig WHERE tone IS NOT NULL),
tn1 AS (SELECT recording_id, paragraph, list(tone ORDER BY turn_ord) AS l FROM tn0 WHERE before IS DISTINCT FROM tone GROUP BY 1, 2),
blk AS (SELECT p.recording_id, p.paragraph, {_SHOWN.format('p.speaker', 'label')} || ':' || chr(10) || p.text || coalesce(chr(10) || '[Context: ' || context || ']', '')
  || coalesce(chr(10) || '[Vocal tone estimate: ' || CASE WHEN len(l) = 1 THEN l[1] ELSE 'varied (' || array_to_string(l[1:3], ' -> ') || ')' END || ']', '') AS block
  FROM paragraphs p LEFT JOIN cx USING (recording_id, paragraph) LEFT JOIN tn1 USING (recording_id, paragraph) LEFT JOIN prof ON voice = speaker),
who AS (SELECT recording_id, string_agg(CASE WHEN v = 'SPEAKER_UNKNOWN' THEN 'UNKNOWN' ELSE v END || CASE WHEN len(n) > 0 THEN ' (' || array_to_string(n, '; ') || ')' ELSE '' END, ', ' ORDER BY k) AS speakers
  FROM (SELECT recording_id, t.speaker AS v, min(turn_ord) AS k, list_filter([CASE WHEN any_value(label) <> t.speaker THEN any_value(label) END, CASE WHEN any_value(role) IN ('adult', 'child') THEN any_value(role) END], lambda x: x IS NOT NULL) AS n FROM turns t LEFT JOIN prof ON voice = t.speaker GROUP BY 1, 2) GROUP BY 1),
rec AS (SELECT DISTINCT conv_id AS recording_id, 'talks/' || conv_id || '.wav' AS source, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'en' END AS language, conv_id % 2 = 0 AS ready FROM conversations),
body AS (SELECT recording_id, string_agg(block, chr(10) || chr(10) ORDER BY paragraph) AS body FROM blk GROUP BY 1)
SELECT recording_id, concat_ws(chr(10), CASE WHEN ready THEN 'ANALYSIS-READY TRANSCRIPT' ELSE 'DRAFT: SPEAKER REVIEW REQUIRED' END, '=========================', 'Source: ' || source, 'Language: ' || coalesce(language, 'unknown'), 'Speakers: ' || coalesce(speakers, 'none detected'),
  '{N.PRESERVED}', '', 'TRANSCRIPT', '----------', '', coalesce(body, '[No speech was transcribed.]')) || chr(10) AS txt FROM rec LEFT JOIN who USING (recording_id) LEFT JOIN body USING (recording_id)"""
)


def recordings(spark, d):
    c = F.col("recording_id")
    return A.table(spark, d, "conversations").select(F.col("conv_id").alias("recording_id")).distinct().select(
        "recording_id", F.concat(F.lit("talks/"), c.cast("string"), F.lit(".wav")).alias("source"), F.when(c % 3 != 0, "en").alias("language"), (c % 2 == 0).alias("ready")
    )


def observed(sp):
    return durable(R.observations(featured(sp)).withColumn("tone", F.expr(_SIGNAL)))


@query("render_txt", _READABLE)
def render_txt(spark, d):
    return N.readable(recordings(spark, d), observed(Speech(spark, d)), profiles(spark))


_DETAILED = (
    _OBSERVED
    + _LINES[_LINES.index(", tn AS") :]
    + f""", {_PROFILES}, rec AS (SELECT DISTINCT conv_id AS recording_id, 'talks/' || conv_id || '.wav' AS source, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'en' END AS language FROM conversations),
first AS (SELECT recording_id, turn_ord, arg_min(line, w_s) AS line FROM lines GROUP BY 1, 2),
db AS (SELECT ob.recording_id, ob.turn_ord, '[' || {_STAMP.format('ob.s', '.')} || ' - ' || {_STAMP.format('ob.e', '.')} || '] ' || {_SHOWN.format('ob.speaker', 'label')} || ':' || chr(10) || trim(ob.text) || chr(10) || CASE WHEN ob.turn_ord % 3 = 1 THEN '{N.UNCERTAIN}' || chr(10) ELSE '' END
  || '[Observed: ' || CASE WHEN len(observed) > 0 THEN array_to_string(observed, '; ') ELSE 'no notable acoustic flags' END || ']' || chr(10) || '[Tone approx: ' || coalesce(line, 'not estimated') || ']' AS block FROM ob LEFT JOIN first USING (recording_id, turn_ord) LEFT JOIN prof ON voice = ob.speaker),
dd AS (SELECT recording_id, string_agg(block, chr(10) || chr(10) ORDER BY turn_ord) AS body FROM db GROUP BY 1)
SELECT recording_id, concat_ws(chr(10), 'TRANSCRIPT', '==========', 'Source: ' || source, 'Language: ' || coalesce(language, 'unknown'), '', {', '.join(f"'{x}'" for x in N.NOTICE)}, '', 'TRANSCRIPT', '----------', '', coalesce(body, '[No speech was transcribed.]')) || chr(10) AS txt FROM rec LEFT JOIN dd USING (recording_id)"""
)


@query("render_detailed", _DETAILED)
def render_detailed(spark, d):
    sp = Speech(spark, d)
    lines = tone_lines(sp).groupBy("recording_id", "turn_ord").agg(F.min_by("line", "w_s").alias("tone_line"))
    rows = observed(sp).join(lines, ["recording_id", "turn_ord"], "left")
    rows = rows.withColumn("tone_line", F.coalesce("tone_line", F.lit("not estimated"))).withColumn("uncertain", F.col("turn_ord") % 3 == 1)
    return N.detailed(recordings(spark, d), rows, profiles(spark))


@query(
    "output_names",
    """WITH s AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'a.b/' WHEN o_orderkey % 3 = 1 THEN 'x/y/' ELSE '' END || o_orderkey || '.wav' AS source FROM orders), f AS (SELECT source, unnest(['txt', 'detailed_txt', 'json', 'srt']) AS format FROM s)
SELECT source, format, CASE WHEN format = 'txt' THEN 'transcripts/' ELSE 'review/' END || source || '.' || CASE WHEN format = 'detailed_txt' THEN 'detailed.txt' ELSE format END AS path FROM f""",
)
def output_names(spark, d):
    k = F.col("o_orderkey") % 3
    folder = F.when(k == 0, "a.b/").when(k == 1, "x/y/").otherwise("")
    sources = A.table(spark, d, "orders").select(F.concat(folder, F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("source"))
    return N.output_names(sources, T.review_formats(F.lit(" JSON, srt,,srt")))


@query("tone_models", TURNS_SQL.rstrip() + _TONE + ", f AS (SELECT recording_id, model, min((turn_ord, w_s)) AS o FROM tone GROUP BY 1, 2) SELECT recording_id, string_agg(model, ',' ORDER BY o) AS models FROM f GROUP BY 1")
def tone_models(spark, d):
    models = F.transform(F.array_sort(F.collect_list(F.struct("turn_ord", "w_s", "model"))), lambda x: x["model"])
    return Speech(spark, d).tone.groupBy("recording_id").agg(F.array_join(F.array_distinct(models), ",").alias("models"))


@query(
    "tone_counters",
    TURNS_SQL.rstrip()
    + _TONE
    + """, n AS (SELECT recording_id, turn_ord, count(*) AS w, count(DISTINCT l0) > 1 AS varies, list(l0 ORDER BY w_s)[1] AS top FROM tone GROUP BY 1, 2)
SELECT t.recording_id, count(*) AS turns, count(w) AS scored, count(*) FILTER (WHERE w IS NULL) AS unavailable, count(*) FILTER (WHERE top = 'unknown') AS unclassified, count(*) FILTER (WHERE varies) AS mixed, coalesce(sum(w), 0)::BIGINT AS windows FROM turns t LEFT JOIN n USING (recording_id, turn_ord) GROUP BY 1""",
)
def tone_counters(spark, d):
    sp = Speech(spark, d)
    per = sp.tone.groupBy("recording_id", "turn_ord").agg(F.count("*").alias("w"), (F.count_distinct("l0") > 1).alias("varies"), F.min_by("l0", "w_s").alias("top"))
    rows = sp.turns.join(per, ["recording_id", "turn_ord"], "left")
    return rows.groupBy("recording_id").agg(
        F.count("*").alias("turns"), F.count("w").alias("scored"), F.count_if(F.col("w").isNull()).alias("unavailable"),
        F.count_if(F.col("top") == "unknown").alias("unclassified"), F.count_if("varies").alias("mixed"), F.coalesce(F.sum("w"), F.lit(0)).alias("windows"),
    )
