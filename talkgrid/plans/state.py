"""Manifest, packets, registry and review decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.functions import text as T
from talkgrid.operators import state as M
from talkgrid.plans.registry import query
from talkgrid.plans.rules import Speech, flat
from talkgrid.plans.sessions import NORMAL_SQL, TURNS_SQL
from talkgrid.sources import adapters as A
from talkgrid.sources import speech as D

_ORDER = {
    "id": "o_orderkey",
    "size": "o_custkey % 50",
    "now_size": "CASE WHEN o_orderkey % 13 = 0 THEN o_custkey % 50 + 1 ELSE o_custkey % 50 END",
    "algorithm": "CASE WHEN o_orderkey % 17 = 0 THEN 'sampled' ELSE 'sha256-full-v1' END",
    "status": "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'awaiting_review' ELSE 'failed' END",
    "completed": "o_orderkey % 19 <> 0",
    "retry": "o_orderkey % 23 = 0",
    "mtime": "o_orderkey % 5",
    "now_mtime": "CASE WHEN o_orderkey % 7 = 0 THEN 9 ELSE o_orderkey % 5 END",
    "settings": "o_orderkey % 2",
    "now_settings": "CASE WHEN o_orderkey % 29 = 0 THEN 5 ELSE o_orderkey % 2 END",
    "bad_output": "CASE WHEN o_orderkey % 31 = 0 THEN 'srt' END",
    "well_formed": "o_orderkey % 37 <> 0",
    "agrees": "o_orderkey % 41 <> 0",
    "available": "o_orderkey % 43 <> 0",
    "reprocess": "o_orderkey % 47 = 0",
    "moved": "o_orderkey % 9 = 0",
    "source_status": "CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 8 = 1 THEN 'stale' ELSE 'current' END",
    "groups": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 3 END",
    "turns": "o_orderkey % 4",
}
_M = f"WITH m AS (SELECT {D.made_sql(_ORDER)}, sha256(o_custkey::VARCHAR) AS sha, CASE WHEN o_orderkey % 13 = 1 THEN sha256('x') ELSE sha256(o_custkey::VARCHAR) END AS now_sha FROM orders)"


def packets(spark, d):
    rows = D.made(A.table(spark, d, "orders"), _ORDER)
    sha = F.sha2(F.col("o_custkey").cast("string"), 256)
    now = F.when(F.col("o_orderkey") % 13 == 1, F.sha2(F.lit("x"), 256)).otherwise(sha)
    mark = lambda size, mtime, hashed: F.struct(F.col("algorithm").alias("hash_algorithm"), hashed.alias("sha256"), F.col(size).alias("size"), F.col(mtime).alias("mtime"))
    return rows.withColumns({"fingerprint": mark("size", "mtime", sha), "now_fingerprint": mark("now_size", "now_mtime", now)})


@query("same_content", _M + " SELECT id, algorithm = 'sha256-full-v1' AND sha = now_sha AND size = now_size AS same FROM m")
def same_content(spark, d):
    return packets(spark, d).select("id", M.same_content("fingerprint", "now_fingerprint").alias("same"))


@query("readiness", _M + " SELECT id, greatest(coalesce(\"groups\", 0), turns) AS pending, greatest(coalesce(\"groups\", 0), turns) = 0 AND coalesce(source_status, 'current') IN ('current', 'metadata_equivalent') AS ready FROM m")
def readiness(spark, d):
    n = M.pending(F.col("groups"), F.col("turns"))
    return packets(spark, d).select("id", n.alias("pending"), M.is_ready(n, F.col("source_status")).alias("ready"))


@query(
    "completion_reason",
    _M
    + """ SELECT id, CASE WHEN status IS NULL THEN 'not previously processed' WHEN status = 'failed' OR NOT completed THEN 'previous status is ' || status WHEN retry THEN 'a processing stage requested retry'
WHEN size <> now_size OR sha <> now_sha OR mtime <> now_mtime THEN 'source changed' WHEN settings <> now_settings THEN 'processing settings changed' WHEN bad_output IS NOT NULL THEN 'required SRT output is missing or invalid' END AS reason FROM m""",
)
def completion_reason(spark, d):
    return M.completion(packets(spark, d)).select("id", "reason")


_LADDER = """CASE WHEN NOT well_formed OR NOT agrees THEN 'malformed_saved_state' WHEN NOT available THEN 'source_unavailable' WHEN algorithm <> 'sha256-full-v1' THEN 'recovery_required' WHEN sha <> now_sha OR size <> now_size THEN 'source_content_changed' WHEN reprocess THEN 'recovery_required'
WHEN mtime <> now_mtime OR moved OR coalesce(source_status, 'current') NOT IN ('current', 'metadata_equivalent') THEN 'metadata_equivalent' WHEN greatest(coalesce("groups", 0), turns) > 0 THEN 'pending_review' ELSE 'ready' END"""


def judged(spark, d):
    rows = packets(spark, d).withColumnsRenamed({"fingerprint": "stored", "now_fingerprint": "current", "agrees": "manifest_agrees"})
    return M.packet_status(rows.withColumn("pending", M.pending(F.col("groups"), F.col("turns"))))


@query("packet_status", _M + f", s AS (SELECT id, {_LADDER} AS state FROM m) SELECT id, state, state IN ('metadata_equivalent', 'pending_review', 'ready') AS allowed FROM s")
def packet_status(spark, d):
    return judged(spark, d).select("id", "state", "allowed")


@query("run_summary", _M + f", s AS (SELECT {_LADDER} AS state FROM m) SELECT state, count(*) AS n FROM s GROUP BY 1")
def run_summary(spark, d):
    return judged(spark, d).groupBy("state").agg(F.count("*").alias("n"))


@query(
    "review_queue",
    _M + f", s AS (SELECT id, {_LADDER} AS state, greatest(coalesce(\"groups\", 0), turns) AS pending FROM m) SELECT id, row_number() OVER (ORDER BY pending = 0, 'talk-' || id) AS place FROM s WHERE state IN ('metadata_equivalent', 'pending_review', 'ready') AND pending > 0",
)
def review_queue(spark, d):
    from pyspark.sql.window import Window

    rows = judged(spark, d).where("allowed and pending > 0")
    place = F.row_number().over(Window.orderBy(F.col("pending") == 0, F.concat(F.lit("talk-"), F.col("id").cast("string"))))
    return rows.select("id", place.cast("long").alias("place"))


@query(
    "publishable",
    _M
    + f""", s AS (SELECT id, {_LADDER} AS state, status, sha FROM m)
SELECT id, CASE WHEN status IS NULL THEN 'not processed' WHEN state NOT IN ('metadata_equivalent', 'ready') THEN state WHEN id % 10 = 3 THEN 'transcript was edited' END AS excluded, CASE WHEN status IS NOT NULL AND state IN ('metadata_equivalent', 'ready') AND id % 10 <> 3 THEN sha256(sha) END AS content FROM s""",
)
def publishable(spark, d):
    rows = judged(spark, d)
    reason = F.when(F.col("status").isNull(), "not processed").when(~F.col("state").isin("metadata_equivalent", "ready"), F.col("state")).when(F.col("id") % 10 == 3, "transcript was edited")
    return rows.withColumn("excluded", reason).select("id", "excluded", F.when(F.col("excluded").isNull(), F.sha2(F.col("stored.sha256"), 256)).alias("content"))


@query(
    "manifest_upsert",
    """WITH base AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0), ch AS (SELECT o_orderkey - o_orderkey % 4 AS id, 'new' AS status, o_totalprice AS price, o_orderkey AS ord FROM orders WHERE o_orderkey % 5 = 0),
last AS (SELECT id, status, price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS n FROM ch) WHERE n = 1)
SELECT * FROM base WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT * FROM last""",
)
def manifest_upsert(spark, d):
    o = A.table(spark, d, "orders")
    base = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    k = F.col("o_orderkey")
    changes = o.where("o_orderkey % 5 = 0").select((k - k % 4).alias("id"), F.lit("new").alias("status"), F.col("o_totalprice").alias("price"), k.alias("ord"))
    return M.upsert(base, changes, "id", "ord")


_OBS = "SELECT CASE WHEN event_id % 2 = 0 THEN user_id % 6 ELSE event_id % 6 END AS voice, {0} AS observation, event_id AS ord, event_id % 9 = 0 AS verified, event_id % 4 AS content FROM events"


@query(
    "observation_upsert",
    f"""WITH old AS ({_OBS.format('event_id')} WHERE event_id < 400), add0 AS (SELECT voice, observation, ord, verified, content FROM ({_OBS.format('event_id - 300 - event_id % 3')} WHERE event_id >= 400 AND event_id < 900)),
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY observation ORDER BY verified DESC, ord DESC) AS n FROM add0) WHERE n = 1),
tk AS (SELECT n.voice, n.observation, n.ord, n.verified, n.content FROM new n LEFT JOIN old o USING (observation) WHERE o.observation IS NULL OR (NOT (o.verified AND NOT n.verified) AND NOT (o.voice = n.voice AND o.verified = n.verified AND o.content = n.content))),
al AS (SELECT * FROM old WHERE observation NOT IN (SELECT observation FROM tk) UNION ALL SELECT * FROM tk)
SELECT voice, observation, ord, verified, content FROM (SELECT *, row_number() OVER (PARTITION BY voice, verified ORDER BY ord DESC) AS n FROM al) WHERE verified OR n <= 20""",
)
def observation_upsert(spark, d):
    e = A.table(spark, d, "events")
    k = F.col("event_id")
    of = lambda rows, key: rows.select(F.when(k % 2 == 0, F.col("user_id") % 6).otherwise(k % 6).alias("voice"), key.alias("observation"), k.alias("ord"), (k % 9 == 0).alias("verified"), (k % 4).alias("content"))
    return M.add_observations(of(e.where("event_id < 400"), k), of(e.where("event_id >= 400 and event_id < 900"), k - 300 - k % 3))


@query(
    "confirm_references",
    """WITH r AS (SELECT vec_id AS observation, label AS voice, vec_id % 3 AS session, vec_id % 4 <> 0 AS verified FROM embeddings), c AS (SELECT vec_id * 2 AS observation, (label + 1) % 10 AS voice, 1 AS session, true AS verified FROM embeddings WHERE vec_id % 3 = 1 AND vec_id < 100)
SELECT * FROM r WHERE NOT (verified AND session = 1) AND observation NOT IN (SELECT observation FROM c) UNION ALL SELECT * FROM c""",
)
def confirm_references(spark, d):
    e, k = A.table(spark, d, "embeddings"), F.col("vec_id")
    registry = e.select(k.alias("observation"), F.col("label").alias("voice"), (k % 3).alias("session"), (k % 4 != 0).alias("verified"))
    confirmed = e.where("vec_id % 3 = 1 and vec_id < 100").select((k * 2).alias("observation"), ((F.col("label") + 1) % 10).alias("voice"), F.lit(1).cast("long").alias("session"))
    return M.replace_references(registry, confirmed, confirmed.select("session").distinct())


@query(
    "alias_resolution",
    """WITH RECURSIVE m AS (SELECT c_custkey AS source, c_custkey + 1 + c_custkey % 3 AS target FROM customer WHERE c_custkey % 5 <> 0), w AS (SELECT source, target FROM m UNION ALL SELECT w.source, m.target FROM w JOIN m ON m.source = w.target)
SELECT source, max(target) AS target FROM w GROUP BY 1""",
)
def alias_resolution(spark, d):
    k = F.col("c_custkey")
    return M.resolve_aliases(A.table(spark, d, "customer").where("c_custkey % 5 <> 0").select(k.alias("ord"), k.alias("source"), (k + 1 + k % 3).alias("target")))


@query("agreed_aliases", "SELECT o_orderkey % 700 AS key, any_value(o_orderstatus) AS value FROM orders WHERE o_orderkey < 3000 GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def agreed_aliases(spark, d):
    return M.agreed_aliases(A.table(spark, d, "orders").where("o_orderkey < 3000").select((F.col("o_orderkey") % 700).alias("key"), F.col("o_orderstatus").alias("value")))


@query(
    "new_voice_ids",
    """WITH used AS (SELECT DISTINCT c_custkey * c_custkey % 90 AS n FROM customer WHERE c_custkey < 40), free AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM range(3, 400) r(k) WHERE k NOT IN (SELECT n FROM used)),
w AS (SELECT s_name AS key, row_number() OVER (ORDER BY s_name) AS i FROM supplier WHERE s_suppkey <= 60) SELECT key, printf('VOICE_%04d', k) AS voice FROM w JOIN free USING (i)""",
)
def new_voice_ids(spark, d):
    k = F.col("c_custkey")
    taken = A.table(spark, d, "customer").where("c_custkey < 40").select(F.format_string("VOICE_%04d", k * k % 90).alias("voice"))
    return M.new_voice_ids(taken, A.table(spark, d, "supplier").where("s_suppkey <= 60").select(F.col("s_name").alias("key")), 3)


@query(
    "registry_faults",
    """WITH p AS (SELECT CASE WHEN n_nationkey = 7 THEN 'Voice 7' ELSE printf('VOICE_%04d', n_nationkey) END AS voice FROM nation), o AS (SELECT printf('VOICE_%04d', c_nationkey + c_custkey % 2) AS voice, 'o' || (c_custkey - CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END) AS observation, CASE WHEN c_custkey % 33 = 0 THEN 3 ELSE 64 END AS length FROM customer)
SELECT 'bad voice id' AS fault, voice AS id FROM p WHERE NOT regexp_matches(voice, '^VOICE_[0-9]{4,}$') UNION ALL SELECT 'wrong dimension', observation FROM o WHERE length <> 64 UNION ALL SELECT 'repeated observation', observation FROM o GROUP BY observation HAVING count(*) > 1
UNION ALL SELECT 'unknown voice', observation FROM o WHERE voice NOT IN (SELECT voice FROM p)""",
)
def registry_faults(spark, d):
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    profiles = A.table(spark, d, "nation").select(F.when(n == 7, "Voice 7").otherwise(F.format_string("VOICE_%04d", n)).alias("voice"), F.lit(64).alias("dimension"))
    rows = A.table(spark, d, "customer").select(
        F.format_string("VOICE_%04d", F.col("c_nationkey") + k % 2).alias("voice"), F.concat(F.lit("o"), (k - F.when(k % 50 == 0, 1).otherwise(0)).cast("string")).alias("observation"), F.when(k % 33 == 0, 3).otherwise(64).alias("length")
    )
    return M.registry_faults(rows, profiles)




@query(
    "diarizer_row_parse",
    """WITH p AS (SELECT event_id, event_id % 20 < 2 AS bad, greatest(0, (event_id % 90 - 5) / 4.0::DOUBLE) AS s, (event_id % 70) / 4.0::DOUBLE AS e, CASE WHEN event_id % 2 = 0 THEN printf('SPEAKER_%02d', user_id % 4) ELSE 'SORTFORMER_' || upper(replace(event_type, ' ', '_')) END AS l,
CASE WHEN event_id % 2 = 0 THEN 'speaker_' || user_id % 4 ELSE event_type END AS m FROM events) SELECT event_id, CASE WHEN NOT bad THEN s END AS s, CASE WHEN NOT bad THEN greatest(s, e) END AS e, CASE WHEN NOT bad THEN l END AS speaker, CASE WHEN NOT bad THEN m END AS model_speaker, CASE WHEN bad THEN 'invalid segment' END AS error FROM p""",
)
def diarizer_row_parse(spark, d):
    k = F.col("event_id")
    label = F.when(k % 2 == 0, F.concat(F.lit("speaker_"), (F.col("user_id") % 4).cast("string"))).otherwise(F.col("event_type"))
    line = F.when(k % 20 == 0, "broken").when(k % 20 == 1, "x 1.0 spk").otherwise(F.concat(((k % 90 - 5) / 4.0).cast("string"), F.lit("  "), ((k % 70) / 4.0).cast("string"), F.lit("\t"), label))
    return M.parse_diarizer_rows(A.table(spark, d, "events").select("event_id", line.alias("line"))).drop("line")


@query(
    "diarization_validation",
    f"""WITH {D.MS_SQL}, {D.SEGS}, h AS (SELECT recording_id, count(*) AS segments, count(*) FILTER (WHERE speaker IS NOT NULL) AS labelled FROM segs GROUP BY 1), t AS (SELECT recording_id, count(*) AS intervals, count(DISTINCT role) AS labels FROM ms0 WHERE recording_id % 4 <> 0 GROUP BY 1)
SELECT recording_id, segments, labelled, coalesce(intervals, 0) AS intervals, coalesce(labels, 0) AS labels, CASE WHEN coalesce(intervals, 0) = 0 OR labels = 0 OR labelled = 0 THEN 'no usable speaker timeline or segment labels' WHEN labels < 2 THEN 'too few speakers' WHEN labels > 2 THEN 'too many speakers' END AS fault FROM h LEFT JOIN t USING (recording_id)""",
)
def diarization_validation(spark, d):
    t = A.segments(spark, d).where("recording_id % 4 <> 0").select("recording_id", "speaker")
    return M.diarization_faults(D.segments(spark, d), t, 2, 2)


@query("extension_list", "SELECT n_nationkey, list_sort(list_distinct(list_transform(list_filter(list_transform(string_split(' MP3, .wav ,,' || n_name || ',mp3', ','), lambda x: lower(trim(x))), lambda x: x <> ''), lambda x: CASE WHEN x LIKE '.%' THEN x ELSE '.' || x END)))[1] AS first FROM nation")
def extension_list(spark, d):
    raw = F.concat(F.lit(" MP3, .wav ,,"), "n_name", F.lit(",mp3"))
    return A.table(spark, d, "nation").select("n_nationkey", F.array_sort(T.extension_list(raw))[0].alias("first"))


_CHOICES = """ch_t AS (SELECT recording_id, turn_ord, list(local_speaker ORDER BY ord)[1] AS local, min(s) AS s, max(e) AS e FROM fold GROUP BY 1, 2),
gr AS (SELECT DISTINCT recording_id, local, CASE WHEN recording_id % 5 = 0 THEN 'ignore' WHEN local = 'L_user' THEN 'V1' END AS choice FROM ch_t WHERE recording_id % 2 = 0),
ov AS (SELECT recording_id, turn_ord, CASE WHEN turn_ord % 9 = 0 THEN 'unknown' ELSE 'V' || turn_ord % 3 END AS choice FROM ch_t WHERE turn_ord % 4 = 1),
rg AS (SELECT recording_id, turn_ord, s + 300 AS s, least(e, s + 2300) AS e, 'V9' AS choice FROM ch_t WHERE turn_ord % 6 = 2 AND e > s + 300 UNION ALL SELECT recording_id, turn_ord, s + 2300, s + 3000, 'V8' FROM ch_t WHERE turn_ord % 12 = 2 AND e >= s + 3000)"""
_CHOSEN = (
    TURNS_SQL.rstrip()
    + ", "
    + _CHOICES.replace("turn_ord, list(local_speaker", "grp AS turn_ord, list(local_speaker")
    + """, own AS (SELECT c.recording_id, c.turn_ord, c.local, c.s, c.e, coalesce(ov.choice, gr.choice) AS choice FROM ch_t c LEFT JOIN ov USING (recording_id, turn_ord) LEFT JOIN gr ON gr.recording_id = c.recording_id AND gr.local = c.local),
ce AS (SELECT recording_id, turn_ord, s AS b, e AS f FROM rg UNION ALL SELECT recording_id, turn_ord, e, e FROM own), cp AS (SELECT ce.recording_id, ce.turn_ord, coalesce(lag(f) OVER (PARTITION BY ce.recording_id, ce.turn_ord ORDER BY b, f), own.s) AS s, b AS e, local, choice FROM ce JOIN own USING (recording_id, turn_ord)),
cpieces AS (SELECT recording_id, turn_ord, local, s, e, choice FROM cp WHERE e > s UNION ALL SELECT rg.recording_id, rg.turn_ord, own.local, rg.s, rg.e, rg.choice FROM rg JOIN own USING (recording_id, turn_ord))"""
)


def review_turns(sp):
    from talkgrid.operators import sessions as S

    numbered = S.turn_numbers(sp.pieces)
    return numbered.groupBy("recording_id", F.col("grp").alias("turn_ord")).agg(F.min_by("local_speaker", "ord").alias("local"), F.min("s").alias("s"), F.max("e").alias("e"))


def decisions(t):
    n, r = F.col("turn_ord"), F.col("recording_id")
    groups = t.where("recording_id % 2 = 0").select("recording_id", "local").distinct().withColumn("choice", F.when(r % 5 == 0, "ignore").when(F.col("local") == "L_user", "V1"))
    overrides = t.where("turn_ord % 4 = 1").select("recording_id", "turn_ord", F.when(n % 9 == 0, "unknown").otherwise(F.concat(F.lit("V"), (n % 3).cast("string"))).alias("choice"))
    one = t.where("turn_ord % 6 = 2 and e > s + 300").select("recording_id", "turn_ord", (F.col("s") + 300).alias("s"), F.least("e", F.col("s") + 2300).alias("e"), F.lit("V9").alias("choice"))
    two = t.where("turn_ord % 12 = 2 and e >= s + 3000").select("recording_id", "turn_ord", (F.col("s") + 2300).alias("s"), (F.col("s") + 3000).alias("e"), F.lit("V8").alias("choice"))
    return groups, overrides, one.union(two)


def chosen(sp):
    from talkgrid.session import durable

    t = durable(review_turns(sp))
    return t, durable(M.resolve_choices(t, *decisions(t)))


@query("resolve_choices", _CHOSEN + " SELECT * FROM cpieces")
def resolve_choices(spark, d):
    return chosen(Speech(spark, d))[1]


@query(
    "range_faults",
    TURNS_SQL.rstrip()
    + """, t AS (SELECT recording_id, grp AS turn_ord, min(s) AS s, max(e) AS e FROM fold GROUP BY 1, 2), r AS (SELECT recording_id, turn_ord + CASE WHEN turn_ord % 7 = 0 THEN 100000 ELSE 0 END AS turn_ord, s + i * 500 - 100 * (turn_ord % 3) AS s, s + i * 500 + 600 + turn_ord % 2 * 300 AS e FROM t, range(3) x(i)),
j AS (SELECT r.*, t.s AS t_s, t.e AS t_e, max(r.e) OVER (PARTITION BY r.recording_id, r.turn_ord ORDER BY r.s, r.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r LEFT JOIN t USING (recording_id, turn_ord)),
f AS (SELECT recording_id, turn_ord, s, e, CASE WHEN t_s IS NULL THEN 'absent turn' WHEN NOT (t_s <= s AND s < e AND e <= t_e) THEN 'outside its turn' WHEN before > s THEN 'overlaps another range' END AS fault FROM j) SELECT * FROM f WHERE fault IS NOT NULL""",
)
def range_faults(spark, d):
    t = review_turns(Speech(spark, d)).drop("local")
    n, i = F.col("turn_ord"), F.col("i")
    r = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    r = r.select("recording_id", (n + F.when(n % 7 == 0, 100_000).otherwise(0)).alias("turn_ord"), (F.col("s") + i * 500 - 100 * (n % 3)).alias("s"), (F.col("s") + i * 500 + 600 + n % 2 * 300).alias("e"))
    return M.range_faults(t, r)


_OVERLAY = (
    _CHOSEN
    + """, wx AS (SELECT recording_id, seg_ord, word_ord, local_speaker, speaker, s, e FROM nw),
hit AS (SELECT w.recording_id, w.seg_ord, w.word_ord, list({'o': p.turn_ord::BIGINT * 100000000 + p.s, 'c': p.choice} ORDER BY p.turn_ord::BIGINT * 100000000 + p.s) FILTER (WHERE w.s + w.e < 2 * p.e) AS ins, list({'o': p.turn_ord::BIGINT * 100000000 + p.s, 'c': p.choice} ORDER BY p.turn_ord::BIGINT * 100000000 + p.s) FILTER (WHERE w.s + w.e = 2 * p.e) AS lst
  FROM wx w JOIN cpieces p ON p.recording_id = w.recording_id AND p.local = w.local_speaker AND w.s + w.e BETWEEN 2 * p.s AND 2 * p.e GROUP BY 1, 2, 3),
oc AS (SELECT w.*, CASE WHEN len(ins) > 0 THEN ins[1].c ELSE lst[len(lst)].c END AS choice FROM wx w LEFT JOIN hit USING (recording_id, seg_ord, word_ord)),
ow AS (SELECT recording_id, seg_ord, word_ord, local_speaker, choice, CASE WHEN choice IN ('unknown', 'ignore') THEN 'SPEAKER_UNKNOWN' ELSE coalesce(choice, speaker) END AS speaker,
  CASE WHEN choice = 'unknown' THEN 'unresolved_human' WHEN choice = 'ignore' THEN 'human_excluded' WHEN choice IS NOT NULL THEN 'human_verified' END AS identity FROM oc)"""
)


def overlaid(sp):
    _, pieces = chosen(sp)
    ordered = pieces.withColumn("ord", F.col("turn_ord") * 100_000_000 + F.col("s"))
    return M.overlay(sp.words, ordered)


@query("overlay_choices", _OVERLAY + " SELECT * FROM ow")
def overlay_choices(spark, d):
    return overlaid(Speech(spark, d))


@query(
    "group_status",
    _OVERLAY
    + """, g AS (SELECT recording_id, local_speaker, bool_or(choice IS NULL) AS op, bool_or(coalesce(choice = 'unknown', false)) AS un, list_sort(list_distinct(list(choice))) AS cs FROM ow GROUP BY 1, 2)
SELECT recording_id, local_speaker, CASE WHEN NOT op AND NOT un THEN CASE WHEN cs = ['ignore'] THEN 'human_excluded' WHEN len(cs) = 1 THEN 'human_verified' ELSE 'human_verified_mixed_cluster' END WHEN un THEN 'unresolved_human' END AS status,
CASE WHEN NOT op AND NOT un THEN array_to_string(list_filter(cs, lambda c: c <> 'ignore'), ',') END AS reviewed FROM g""",
)
def group_status(spark, d):
    return M.group_status(overlaid(Speech(spark, d)))


@query(
    "reference_coverage",
    _CHOSEN
    + """, rw AS (SELECT recording_id, ord, local_speaker AS local, s + 50 AS s, e + 200 AS e FROM pieces WHERE ord % 3 <> 0 AND ord % 11 <> 0 AND e + 200 > s + 50),
rc AS (SELECT w.recording_id, w.ord, w.s, w.e, count(DISTINCT coalesce(p.choice, '')) AS n, any_value(p.choice) AS profile, sum(least(w.e, p.e) - greatest(w.s, p.s))::BIGINT AS covered FROM rw w JOIN cpieces p ON p.recording_id = w.recording_id AND p.local = w.local AND p.e > w.s AND p.s < w.e GROUP BY 1, 2, 3, 4)
SELECT recording_id, ord, profile, covered FROM rc WHERE n = 1 AND profile IS NOT NULL AND profile NOT IN ('unknown', 'ignore') AND covered >= least(200, (e - s) / 4)""",
)
def reference_coverage(spark, d):
    sp = Speech(spark, d)
    windows = sp.pieces.select("recording_id", "ord", F.col("local_speaker").alias("local"), (F.col("s") + 50).alias("s"), (F.col("e") + 200).alias("e"), (F.col("ord") % 3 != 0).alias("eligible"), (F.col("ord") % 11 == 0).alias("excluded"))
    return M.reference_coverage(windows, chosen(sp)[1])


@query(
    "apply_identities",
    f"WITH {NORMAL_SQL} SELECT recording_id, seg_ord, word_ord, local_speaker, CASE WHEN recording_id % 3 = 0 OR local_speaker = 'SPEAKER_UNKNOWN' THEN speaker WHEN local_speaker = 'L_user' THEN 'VOICE_0001' WHEN local_speaker = 'L_assistant' THEN 'VOICE_0002' ELSE speaker END AS speaker, CASE WHEN recording_id % 3 <> 0 AND local_speaker IN ('L_user', 'L_assistant') THEN 'matched' END AS match_status FROM nw",
)
def apply_identities(spark, d):
    words = Speech(spark, d).words
    found = words.where("recording_id % 3 <> 0 and local_speaker in ('L_user', 'L_assistant')").select("recording_id", "local_speaker").distinct()
    found = found.withColumn("voice", F.when(F.col("local_speaker") == "L_user", "VOICE_0001").otherwise("VOICE_0002")).withColumn("status", F.lit("matched"))
    return M.apply_identities(words, found).select("recording_id", "seg_ord", "word_ord", "local_speaker", "speaker", "match_status")


@query(
    "secondary_consensus",
    f"""WITH {NORMAL_SQL}, p AS (SELECT recording_id, seg_ord, secondary, sum(greatest(0, e - s))::BIGINT AS ms, min(word_ord) AS first FROM nw WHERE s IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT *, sum(ms) OVER (PARTITION BY recording_id, seg_ord) AS total FROM p),
c AS (SELECT *, sum(ms) OVER (PARTITION BY recording_id, seg_ord)::BIGINT AS compared, row_number() OVER (PARTITION BY recording_id, seg_ord ORDER BY ms DESC, first) AS n FROM t WHERE secondary IS NOT NULL)
SELECT recording_id, seg_ord, CASE WHEN compared >= greatest(200.0, total / 2.0) AND 100 * ms >= 65 * compared THEN secondary END AS label, ms, compared FROM c WHERE n = 1""",
)
def secondary_consensus(spark, d):
    return M.secondary_consensus(Speech(spark, d).words.withColumn("ord", F.col("word_ord")), ["recording_id", "seg_ord"])


@query(
    "segment_majority",
    f"""WITH {NORMAL_SQL}, p AS (SELECT recording_id, seg_ord, speaker, sum(greatest(0, e - s))::BIGINT AS ms, row_number() OVER (PARTITION BY recording_id, seg_ord ORDER BY sum(greatest(0, e - s)) DESC, min(word_ord)) AS n FROM nw WHERE s IS NOT NULL GROUP BY 1, 2, 3)
SELECT recording_id, seg_ord, speaker, ms FROM p WHERE n = 1""",
)
def segment_majority(spark, d):
    return M.segment_majority(Speech(spark, d).words)


@query(
    "ensemble_agreement",
    f"WITH {NORMAL_SQL} SELECT recording_id, count(*) FILTER (WHERE secondary IS NOT NULL AND NOT ambiguous) AS annotated, count(*) FILTER (WHERE secondary = local_speaker AND NOT ambiguous) AS agreements, floor(count(*) FILTER (WHERE secondary = local_speaker AND NOT ambiguous)::DOUBLE / greatest(count(*) FILTER (WHERE secondary IS NOT NULL AND NOT ambiguous), 1) * 1e4 + 0.5) / 1e4 AS fraction FROM nw GROUP BY 1",
)
def ensemble_agreement(spark, d):
    rows = Speech(spark, d).words
    free = ~F.col("ambiguous")
    n, same = F.count_if(F.col("secondary").isNotNull() & free), F.count_if((F.col("secondary") == F.col("local_speaker")) & free)
    return rows.groupBy("recording_id").agg(n.alias("annotated"), same.alias("agreements"), (F.floor(same / F.greatest(n, F.lit(1)) * 1e4 + 0.5) / 1e4).alias("fraction"))


@query(
    "identity_windows",
    TURNS_SQL.rstrip()
    + f""", wi AS (SELECT recording_id, ord, local_speaker AS local, s, e, {D.made_sql(D.WINDOW)} FROM pieces WHERE ord % 2 = 0), al AS (SELECT * FROM (VALUES ('L_user', 'user'), ('L_other', 'user')) x(l, v)),
wj AS (SELECT w.recording_id, w.ord, bool_and(NOT n.ambiguous AND coalesce(b.v = a.v, false)) AS agreed, count(n.word_ord) AS n FROM wi w LEFT JOIN nw n ON n.recording_id = w.recording_id AND n.local_speaker = w.local AND n.s < w.e AND n.e > w.s LEFT JOIN al a ON a.l = w.local LEFT JOIN al b ON b.l = n.secondary GROUP BY 1, 2)
SELECT wi.recording_id, wi.ord, disagreement AND n > 0 AND local IN ('L_user', 'L_other') AND coalesce(agreed, false) AS agreed FROM wi JOIN wj USING (recording_id, ord)""",
)
def identity_windows(spark, d):
    from talkgrid.operators import intervals as I

    sp = Speech(spark, d)
    windows = D.made(sp.pieces.where("ord % 2 = 0").select("recording_id", "ord", "s", "e", F.col("local_speaker").alias("local")), D.WINDOW)
    voice = lambda c: F.when(F.col(c).isin("L_user", "L_other"), "user")
    words = sp.words.where("s is not null and e is not null").select("recording_id", "s", "e", "local_speaker", "secondary", "ambiguous")
    met = I.ms_join(windows, words).where("local = r_local_speaker").groupBy("recording_id", "ord").agg(F.min(~F.col("r_ambiguous") & F.coalesce(voice("r_secondary") == voice("local"), F.lit(False))).alias("every"))
    return windows.join(met, ["recording_id", "ord"], "left").select("recording_id", "ord", (F.col("disagreement") & F.coalesce("every", F.lit(False))).alias("agreed"))


@query("secondary_mapping")
def secondary_mapping(spark, d):
    from talkgrid.operators import identity as Y
    from talkgrid.operators import intervals as I

    t = D.timeline(spark, d)
    ms = F.sum(F.least("e", "r_e") - F.greatest("s", "r_s"))
    overlaps = I.ms_join(t.select("recording_id", "s", "e", "secondary"), t.select("recording_id", "s", "e", "speaker")).groupBy("recording_id", "secondary", F.col("r_speaker").alias("speaker")).agg(ms.alias("overlap"))
    return Y.map_labels(overlaps, t.groupBy("recording_id", "secondary").agg(F.sum(F.col("e") - F.col("s")).alias("total")))


@query("word_pairs")
def word_pairs(spark, d):
    from talkgrid.operators import identity as Y
    from talkgrid.operators import sessions as S

    words = S.word_numbers(D.words(spark, d), D.segments(spark, d)).select("recording_id", F.col("word_index").alias("ord"), T.token(F.col("text")).alias("token"))
    return Y.pair_words(words, words.where("ord % 7 <> 3"))
