"""Samples, windows and loose values; counters, clips and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.functions import numbers as Z
from talkgrid.operators import intervals as I
from talkgrid.operators import signal as G
from talkgrid.operators import vectors as V
from talkgrid.plans.ranges import OVERLAPS_SQL
from talkgrid.plans.registry import query
from talkgrid.plans.rules import _REVIEW, Speech, reviewed
from talkgrid.plans.sessions import NORMAL_SQL, SPLIT_SQL, TURNS_SQL
from talkgrid.plans.state import _CHOSEN, chosen
from talkgrid.sources import adapters as A
from talkgrid.sources import speech as D

_LOOSE = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 'nan' WHEN event_id % 7 = 2 THEN 'abc' WHEN event_id % 7 = 3 THEN '' WHEN event_id % 7 = 4 THEN ' 12.5 ' ELSE CAST(event_id AS STRING) END"


@query("finite_numbers", f"WITH x AS (SELECT event_id, try_cast({_LOOSE} AS DOUBLE) AS v FROM events) SELECT event_id, v IS NOT NULL AND isfinite(v) AS finite, CASE WHEN v IS NOT NULL AND isfinite(v) THEN v ELSE -1 END AS number FROM x")
def finite_numbers(spark, d):
    raw = F.expr(_LOOSE)
    return A.table(spark, d, "events").select("event_id", Z.finite(raw).alias("finite"), Z.number(raw, -1.0).alias("number"))


@query("label_check", "SELECT p_partkey, length(trim(l)) > 0 AND length(l) <= 80 AND NOT regexp_matches(l, '[\\x00-\\x1f]') AS ok FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '  ' WHEN p_partkey % 4 = 1 THEN p_name || chr(9) WHEN p_partkey % 4 = 2 THEN repeat(p_name, 9) ELSE p_name END AS l FROM part)")
def label_check(spark, d):
    k = F.col("p_partkey") % 4
    label = F.when(k == 0, "  ").when(k == 1, F.concat("p_name", F.lit("\t"))).when(k == 2, F.repeat("p_name", 9)).otherwise(F.col("p_name"))
    return A.table(spark, d, "part").select("p_partkey", Z.label_ok(label).alias("ok"))


# a made-up signal of 500 samples a recording
_SAMPLES = "smp AS (SELECT event_id // 500 AS recording_id, list(CASE WHEN event_id % 97 = 0 THEN 1.0 ELSE (event_id * 7919 % 2001 - 1000) / 1500.0 END::DOUBLE ORDER BY event_id) AS x FROM events GROUP BY 1)"
_RMS = "sqrt(list_sum(list_transform({0}, lambda v: v * v)) / len({0}))"
_DB = "floor(20 * log10(greatest({0}, 1e-6)) * 1e4 + 0.5) / 1e4"


def samples(spark, d):
    k = F.col("event_id")
    value = F.when(k % 97 == 0, 1.0).otherwise((k * 7919 % 2001 - 1000) / 1500.0)
    rows = A.table(spark, d, "events").groupBy(F.expr("event_id div 500").alias("recording_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", value.alias("v")))).alias("x"))
    return rows.select("recording_id", F.transform("x", lambda v: v["v"]).alias("samples"))


@query(
    "signal_levels",
    f"""WITH {_SAMPLES} SELECT recording_id, {_DB.format(_RMS.format("x"))} AS rms_dbfs, {_DB.format("list_max(list_transform(x, lambda v: abs(v)))")} AS peak_dbfs,
floor((20 * log10({_RMS.format("x[(len(x) + 1) // 2 + 1:]")}) - 20 * log10({_RMS.format("x[:(len(x) + 1) // 2]")})) * 1e4 + 0.5) / 1e4 AS change_db, len(list_filter(x, lambda v: abs(v) >= 0.995)) / len(x)::DOUBLE AS clipped FROM smp""",
)
def signal_levels(spark, d):
    found = G.levels(samples(spark, d))
    return found.select("recording_id", *[V.rounded(F.col(c)).alias(c) for c in ("rms_dbfs", "peak_dbfs", "change_db")], "clipped")


@query("signal_pitch")
def signal_pitch(spark, d):
    # a tone for each customer, a second of it
    k = F.col("c_custkey")
    hertz = 80 + k % 40 * 10
    wave = F.transform(F.sequence(F.lit(0), F.lit(G.RATE // 4 - 1)), lambda i: F.sin(i * hertz * (2 * 3.141592653589793 / G.RATE)) * 0.5)
    return G.pitches(A.table(spark, d, "customer").where("c_custkey <= 200").select("c_custkey", hertz.alias("hertz"), wave.alias("samples"))).drop("samples")


_REF = "rwin AS (SELECT recording_id, ord, local_speaker AS speaker, s, e, (ord * 7 % 50) / 1000.0::DOUBLE AS rms, (ord * 3 % 40) / 2000.0::DOUBLE AS clipped FROM pieces WHERE e > s)"


@query(
    "reference_windows",
    f"""WITH {SPLIT_SQL}, {_REF}, m AS (SELECT w.recording_id, w.ord, sum(CASE WHEN regexp_matches(n.text, '[\\p{{L}}\\p{{N}}]') THEN least(w.e, n.e) - greatest(w.s, n.s) ELSE 0 END)::BIGINT AS speech, bool_or(n.ambiguous OR coalesce(n.secondary <> w.speaker, false)) AS disputed
  FROM rwin w JOIN nw n ON n.recording_id = w.recording_id AND n.local_speaker = w.speaker AND n.s < w.e AND n.e > w.s GROUP BY 1, 2),
x AS (SELECT w.recording_id, w.ord, w.e - w.s AS len, coalesce(speech, 0) AS speech, coalesce(disputed, false) AS disputed, CASE WHEN coalesce(speech, 0) < least(600.0, (w.e - w.s) * 0.25) THEN 'little_recognized_speech' WHEN rms < 0.002 OR clipped > 0.01 THEN 'clipping_or_silence' END AS rejected FROM rwin w LEFT JOIN m USING (recording_id, ord))
SELECT recording_id, ord, speech, disputed, rejected, rejected IS NULL AND len >= 800 AND speech >= 200 AS eligible, rejected IS NULL AND NOT disputed AND len >= 2500 AND speech >= 600 AS automatic FROM x""",
)
def reference_windows(spark, d):
    sp = Speech(spark, d)
    k = F.col("ord")
    windows = sp.pieces.where("e > s").select("recording_id", "ord", F.col("local_speaker").alias("speaker"), "s", "e", (k * 7 % 50 / 1000.0).alias("rms"), (k * 3 % 40 / 2000.0).alias("clipped"))
    words = sp.words.select("recording_id", "s", "e", "text", F.col("local_speaker").alias("speaker"), "secondary", "ambiguous")
    return G.reference_windows(windows, words).select("recording_id", "ord", "speech", "disputed", "rejected", "eligible", "automatic")


@query(
    "tone_eligibility",
    f"""WITH {SPLIT_SQL}, {_REF}, m AS (SELECT w.recording_id, w.ord, sum(least(w.e, n.e) - greatest(w.s, n.s))::BIGINT AS speech FROM rwin w JOIN nw n ON n.recording_id = w.recording_id AND n.s < w.e AND n.e > w.s GROUP BY 1, 2)
SELECT w.recording_id, w.ord, w.e - w.s >= 2500 AND rms >= 0.016 AND clipped / 4 <= 0.005 AND 2 * coalesce(speech, 0) >= w.e - w.s AS eligible FROM rwin w LEFT JOIN m USING (recording_id, ord)""",
)
def tone_eligibility(spark, d):
    sp = Speech(spark, d)
    k = F.col("ord")
    rows = sp.pieces.where("e > s").select("recording_id", "ord", "s", "e", (k * 7 % 50 / 1000.0).alias("rms"), (k * 3 % 40 / 2000.0).alias("clipped"))
    spoken = I.covered(rows, sp.words.where("s is not null").select("recording_id", "s", "e"), ["recording_id", "ord"])
    ok = G.tone_eligible(F.col("e") - F.col("s"), F.col("rms"), F.col("clipped") / 4, F.col("covered"))
    return rows.join(spoken, ["recording_id", "ord"]).select("recording_id", "ord", ok.alias("eligible"))


@query(
    "word_speakers",
    f"""WITH {SPLIT_SQL}, h AS (SELECT n.recording_id, n.seg_ord, n.word_ord, p.local_speaker AS speaker, sum(least(n.e, p.e) - greatest(n.s, p.s)) AS ms, min(p.ord) AS first FROM nw n JOIN pieces p ON p.recording_id = n.recording_id AND p.e > n.s AND p.s < n.e GROUP BY 1, 2, 3, 4),
b AS (SELECT *, row_number() OVER (PARTITION BY recording_id, seg_ord, word_ord ORDER BY ms DESC, first) AS k FROM h) SELECT n.recording_id, n.seg_ord, n.word_ord, b.speaker FROM nw n LEFT JOIN b ON b.recording_id = n.recording_id AND b.seg_ord = n.seg_ord AND b.word_ord = n.word_ord AND k = 1""",
)
def word_speakers(spark, d):
    sp = Speech(spark, d)
    key = ["recording_id", "seg_ord", "word_ord"]
    met = I.ms_join(sp.words.select(*key, "s", "e"), sp.pieces.select("recording_id", "ord", "s", "e", "local_speaker"))
    per = met.groupBy(*key, F.col("r_local_speaker").alias("speaker")).agg(F.sum(F.least("e", "r_e") - F.greatest("s", "r_s")).alias("ms"), F.min("r_ord").alias("first"))
    best = per.groupBy(*key).agg(F.min(F.struct((-F.col("ms")).alias("less"), "first", "speaker"))["speaker"].alias("speaker"))
    return sp.words.select(*key).join(best, key, "left")


@query("payload_overlaps", OVERLAPS_SQL + "SELECT recording_id, printf('turn-%06d', least(turn_ord, other_ord)) AS first, printf('turn-%06d', greatest(turn_ord, other_ord)) AS second, any_value(s) AS s, any_value(e) AS e FROM turn_overlaps GROUP BY recording_id, least(turn_ord, other_ord), greatest(turn_ord, other_ord)")
def payload_overlaps(spark, d):
    pair = lambda f: F.format_string("turn-%06d", f("turn_ord", "other_ord"))
    rows = Speech(spark, d).overlaps
    return rows.select("recording_id", pair(F.least).alias("first"), pair(F.greatest).alias("second"), "s", "e").dropDuplicates(["recording_id", "first", "second"])


@query(
    "pending_review",
    _REVIEW
    + """, seen AS (SELECT recording_id, turn_ord, bool_and(coalesce(identity IN ('human_verified', 'human_excluded'), false)) AS done, list_distinct(list(local_speaker)) AS locals FROM tw GROUP BY 1, 2),
pt AS (SELECT rv.recording_id, rv.turn_ord, locals FROM rv JOIN seen USING (recording_id, turn_ord) WHERE NOT done AND len(list_filter(review, lambda r: r <> 'check_word_timing')) > 0),
pl AS (SELECT recording_id, unnest(locals) AS l FROM pt UNION SELECT DISTINCT recording_id, local_speaker FROM pieces WHERE recording_id % 4 = 0 AND local_speaker = 'L_user')
SELECT recording_id, (SELECT count(*) FROM pt WHERE pt.recording_id = r.recording_id) AS turns, (SELECT count(*) FROM pl WHERE pl.recording_id = r.recording_id) AS "groups" FROM (SELECT DISTINCT recording_id FROM turns) r""",
)
def pending_review(spark, d):
    sp = Speech(spark, d)
    key = ["recording_id", "turn_ord"]
    seen = sp.turn_words.groupBy(*key).agg(F.min(F.coalesce(F.col("identity").isin("human_verified", "human_excluded"), F.lit(False))).alias("done"), F.collect_set("local_speaker").alias("locals"))
    open_turns = reviewed(sp).join(seen, key).where(~F.col("done") & (F.size(F.filter("review", lambda r: r != "check_word_timing")) > 0))
    unresolved = sp.pieces.where("recording_id % 4 = 0 and local_speaker = 'L_user'").select("recording_id", "local_speaker")
    groups = open_turns.select("recording_id", F.explode("locals").alias("local_speaker")).union(unresolved).distinct().groupBy("recording_id").agg(F.count("*").alias("groups"))
    rows = sp.turns.select("recording_id").distinct().join(open_turns.groupBy("recording_id").agg(F.count("*").alias("turns")), "recording_id", "left").join(groups, "recording_id", "left")
    return rows.select("recording_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("turns", "groups")])


_CLIP = "clip AS (SELECT recording_id, ord, s + 200 AS s, e - 100 AS e FROM pieces WHERE e - s > 700 AND ord % 2 = 1)"


@query(
    "clip_words",
    f"""WITH {SPLIT_SQL}, {_CLIP}, m AS (SELECT c.recording_id, c.ord, n.text, n.seg_ord, n.word_ord, n.s >= c.s AND n.e <= c.e AND n.e > n.s AS inside FROM clip c JOIN nw n ON n.recording_id = c.recording_id AND n.s < c.e AND n.e > c.s)
SELECT recording_id, ord, coalesce(string_agg(text, ' ' ORDER BY seg_ord, word_ord) FILTER (WHERE inside), '') AS text, count(*) FILTER (WHERE NOT inside) AS partial FROM m GROUP BY 1, 2""",
)
def clip_words(spark, d):
    sp = Speech(spark, d)
    clips = sp.pieces.where("e - s > 700 and ord % 2 = 1").select("recording_id", "ord", (F.col("s") + 200).alias("s"), (F.col("e") - 100).alias("e"))
    met = I.ms_join(clips, sp.words.where("s is not null").select("recording_id", "s", "e", "seg_ord", "word_ord", "text"))
    inside = (F.col("r_s") >= F.col("s")) & (F.col("r_e") <= F.col("e")) & (F.col("r_e") > F.col("r_s"))
    said = F.array_sort(F.array_compact(F.collect_list(F.when(inside, F.struct("r_seg_ord", "r_word_ord", "r_text")))))
    return met.groupBy("recording_id", "ord").agg(F.array_join(F.transform(said, lambda x: x["r_text"]), " ").alias("text"), F.count_if(~inside).alias("partial"))


@query(
    "clip_choices",
    _CHOSEN
    + f""", {_CLIP.replace("SELECT recording_id, ord,", "SELECT recording_id, ord, local_speaker AS local,")}, m AS (SELECT c.recording_id, c.ord, coalesce(p.choice, '') AS choice FROM clip c JOIN cpieces p ON p.recording_id = c.recording_id AND p.local = c.local AND p.s < c.e AND p.e > c.s)
SELECT recording_id, ord, array_to_string(list_sort(list_distinct(list(choice))), ',') AS choices, bool_and(choice NOT IN ('', 'unknown')) AS reviewed FROM m GROUP BY 1, 2""",
)
def clip_choices(spark, d):
    sp = Speech(spark, d)
    clips = sp.pieces.where("e - s > 700 and ord % 2 = 1").select("recording_id", "ord", F.col("local_speaker").alias("local"), (F.col("s") + 200).alias("s"), (F.col("e") - 100).alias("e"))
    met = I.ms_join(clips, chosen(sp)[1].select("recording_id", "local", "s", "e", "choice")).where("local = r_local")
    choice = F.coalesce("r_choice", F.lit(""))
    return met.groupBy("recording_id", "ord").agg(F.array_join(F.array_sort(F.collect_set(choice)), ",").alias("choices"), F.min(~choice.isin("", "unknown")).alias("reviewed"))


@query(
    "set_range",
    _CHOSEN
    + """, nx AS (SELECT recording_id, turn_ord, s + 100 AS s, s + 900 AS e FROM rg WHERE choice = 'V9' AND turn_ord % 4 = 0),
ct AS (SELECT r.recording_id, r.turn_ord, r.s, r.e, r.choice, n.s AS n_s, n.e AS n_e FROM rg r LEFT JOIN nx n ON n.recording_id = r.recording_id AND n.turn_ord = r.turn_ord AND r.e > n.s AND r.s < n.e)
SELECT recording_id, turn_ord, s, e, choice FROM ct WHERE n_s IS NULL UNION ALL SELECT recording_id, turn_ord, s, n_s, choice FROM ct WHERE s < n_s UNION ALL SELECT recording_id, turn_ord, n_e, e, choice FROM ct WHERE e > n_e UNION ALL SELECT recording_id, turn_ord, s, e, 'V5' FROM nx""",
)
def set_range(spark, d):
    from talkgrid.operators import state as M
    from talkgrid.plans.state import decisions

    t, _ = chosen(Speech(spark, d))
    ranges = decisions(t)[2]
    new = ranges.where("choice = 'V9' and turn_ord % 4 = 0").select("recording_id", "turn_ord", (F.col("s") + 100).alias("s"), (F.col("s") + 900).alias("e"), F.lit("V5").alias("choice"))
    return M.set_ranges(ranges, new)


@query(
    "cached_results",
    """WITH k AS (SELECT o_orderkey AS id, sha256('2|' || o_custkey || '|large|' || CASE WHEN o_orderkey % 5 = 0 THEN 'xx' ELSE o_orderstatus END || '|true') AS key FROM orders), c AS (SELECT DISTINCT sha256('2|' || o_custkey || '|large|O|true') AS key FROM orders WHERE o_orderkey % 2 = 0)
SELECT id, k.key, c.key IS NOT NULL AS hit FROM k LEFT JOIN c USING (key)""",
)
def cached_results(spark, d):
    from talkgrid.operators import state as M

    o = A.table(spark, d, "orders")
    status = F.when(F.col("o_orderkey") % 5 == 0, "xx").otherwise(F.col("o_orderstatus"))
    asked = o.select(F.col("o_orderkey").alias("id"), M.cache_key(F.lit(2), F.col("o_custkey"), F.lit("large"), status, F.lit(True)).alias("key"))
    cache = o.where("o_orderkey % 2 = 0").select(M.cache_key(F.lit(2), F.col("o_custkey"), F.lit("large"), F.lit("O"), F.lit(True)).alias("key"))
    return M.cached(asked, cache)


@query("registry_state", "SELECT label AS voice, sha256(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id)) AS state, count(*) AS n FROM embeddings GROUP BY 1")
def registry_state(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")), ",")
    return A.table(spark, d, "embeddings").groupBy(F.col("label").alias("voice")).agg(F.sha2(ids, 256).alias("state"), F.count("*").alias("n"))


@query(
    "identity_counters",
    f"""WITH {NORMAL_SQL}, v AS (SELECT DISTINCT recording_id, local_speaker, CASE WHEN recording_id % 3 = 0 THEN NULL WHEN local_speaker IN ('L_user', 'L_other') THEN 'V1' WHEN local_speaker = 'L_assistant' THEN CASE WHEN recording_id % 2 = 0 THEN 'V1' ELSE 'V2' END END AS voice FROM nw)
SELECT recording_id, count(*) AS locals, count(DISTINCT coalesce(voice, local_speaker)) AS "groups", count(*) - count(DISTINCT coalesce(voice, local_speaker)) AS merged, count(voice) AS matched, count(*) FILTER (WHERE voice IS NULL) AS unresolved FROM v GROUP BY 1""",
)
def identity_counters(spark, d):
    rows = Speech(spark, d).words.select("recording_id", "local_speaker").distinct()
    r, local = F.col("recording_id"), F.col("local_speaker")
    voice = F.when(r % 3 == 0, F.lit(None)).when(local.isin("L_user", "L_other"), "V1").when(local == "L_assistant", F.when(r % 2 == 0, "V1").otherwise("V2"))
    rows = rows.withColumn("voice", voice)
    groups = F.count_distinct(F.coalesce("voice", "local_speaker"))
    return rows.groupBy("recording_id").agg(F.count("*").alias("locals"), groups.alias("groups"), (F.count("*") - groups).alias("merged"), F.count("voice").alias("matched"), F.count_if(F.col("voice").isNull()).alias("unresolved"))


@query(
    "turn_queue",
    TURNS_SQL.rstrip() + ", q AS (SELECT recording_id, turn_ord, CASE WHEN identity = 'human_verified' THEN 'assigned' ELSE 'pending' END AS state FROM turns) SELECT recording_id, state, count(*) AS n, min(turn_ord) AS next FROM q GROUP BY 1, 2",
)
def turn_queue(spark, d):
    state = F.when(F.col("identity").eqNullSafe("human_verified"), "assigned").otherwise("pending")
    return Speech(spark, d).turns.groupBy("recording_id", state.alias("state")).agg(F.count("*").alias("n"), F.min("turn_ord").alias("next"))


@query(
    "restored_choices",
    """WITH m AS (SELECT o_orderkey AS id, sha256(o_custkey::VARCHAR) AS content, sha256('seg' || o_orderkey % 7) AS parts, 'choice ' || o_orderkey % 3 AS choice FROM orders WHERE o_orderkey % 2 = 0),
n AS (SELECT o_orderkey AS id, sha256((o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END)::VARCHAR) AS content, sha256('seg' || CASE WHEN o_orderkey % 14 = 0 THEN 99 ELSE o_orderkey % 7 END) AS parts FROM orders)
SELECT n.id, CASE WHEN m.content = n.content AND m.parts = n.parts THEN m.choice END AS choice, m.id IS NOT NULL AND NOT (m.content = n.content AND m.parts = n.parts) AS blocked FROM n LEFT JOIN m USING (id)""",
)
def restored_choices(spark, d):
    from talkgrid.operators import state as M

    o, k = A.table(spark, d, "orders"), F.col("o_orderkey")
    hashed = lambda x: F.sha2(x.cast("string"), 256)
    saved = o.where("o_orderkey % 2 = 0").select(k.alias("id"), hashed(F.col("o_custkey")).alias("content"), hashed(F.concat(F.lit("seg"), (k % 7).cast("string"))).alias("parts"), F.concat(F.lit("choice "), (k % 3).cast("string")).alias("choice"))
    now = o.select(k.alias("id"), hashed(F.col("o_custkey") + F.when(k % 10 == 0, 1).otherwise(0)).alias("content"), hashed(F.concat(F.lit("seg"), F.when(k % 14 == 0, 99).otherwise(k % 7).cast("string"))).alias("parts"))
    return M.restore(now, saved)


@query("synced_labels", f"WITH {SPLIT_SQL} SELECT recording_id, ord, CASE WHEN speaker = 'SPK_X' THEN 'user' ELSE speaker END AS speaker, CASE WHEN speaker IN ('user', 'SPK_X') THEN 'Ann' WHEN speaker = 'assistant' THEN 'Bot' END AS label FROM pieces")
def synced_labels(spark, d):
    from talkgrid.operators import state as M

    aliases = spark.createDataFrame([("SPK_X", "user")], "source string, target string")
    labels = spark.createDataFrame([("user", "Ann"), ("assistant", "Bot")], "voice string, label string")
    return M.sync_labels(Speech(spark, d).pieces.select("recording_id", "ord", "speaker"), aliases, labels)
