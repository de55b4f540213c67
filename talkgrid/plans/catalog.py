"""Registered queries over the test tables, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.functions import text as T
from talkgrid.operators import attribution as W
from talkgrid.operators import intervals as I
from talkgrid.plans import ranges, refinement, rules, scalars, sessions, signals, state, transcripts, voices  # noqa: F401  register their queries
from talkgrid.plans.registry import ORACLES, QUERIES, query
from talkgrid.sources import adapters as A

__all__ = ["ORACLES", "QUERIES"]

_MERGED = """m0 AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY recording_id, speaker ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS n FROM timeline WHERE "end" > start),
m1 AS (SELECT *, sum(n) OVER (PARTITION BY recording_id, speaker ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m0),
merged AS (SELECT recording_id, speaker, min(start) AS start, max("end") AS "end", count(*) AS n_rows FROM m1 GROUP BY recording_id, speaker, island)"""


@query("interval_merge", f"WITH {A.TIMELINE_SQL}, {_MERGED.format(gap=0.0)} SELECT * FROM merged")
def interval_merge(spark, d):
    return I.merge(A.timeline(spark, d), ["recording_id", "speaker"])


@query(
    "interval_gaps",
    f"""WITH {A.TIMELINE_SQL}, {_MERGED.format(gap=0.0)},
g AS (SELECT recording_id, speaker, "end" AS start, lead(start) OVER (PARTITION BY recording_id, speaker ORDER BY start) AS "end" FROM merged) SELECT * FROM g WHERE "end" IS NOT NULL""",
)
def interval_gaps(spark, d):
    return I.gaps(A.timeline(spark, d), ["recording_id", "speaker"])


_EVENTS = """ev AS (SELECT a.recording_id, a.ord AS first_ord, b.ord AS second_ord, a.speaker, b.speaker AS other, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end"
FROM timeline a JOIN timeline b ON a.recording_id = b.recording_id AND a.ord < b.ord AND a.speaker <> b.speaker AND b."end" > a.start AND b.start < a."end")"""


@query("overlap_events", f"WITH {A.TIMELINE_SQL}, {_EVENTS} SELECT * FROM ev")
def overlap_events(spark, d):
    return I.overlap_events(A.timeline(spark, d))


@query(
    "overlapping_pairs",
    f"""WITH {A.TIMELINE_SQL}, {_EVENTS} SELECT recording_id, least(speaker, other) AS speaker_a, greatest(speaker, other) AS speaker_b, sum(round(("end" - start) * 1000)::BIGINT)::BIGINT AS overlap_ms
FROM ev GROUP BY 1, 2, 3 HAVING sum(round(("end" - start) * 1000)::BIGINT) >= 250""",
)
def overlapping_pairs(spark, d):
    return I.overlapping_pairs(A.timeline(spark, d))


@query(
    "overlap_matrix",
    f"""WITH {A.TIMELINE_SQL} SELECT a.recording_id, a.speaker, b.secondary, sum(round((least(a."end", b."end") - greatest(a.start, b.start)) * 1000)::BIGINT)::BIGINT AS overlap_ms
FROM timeline a JOIN timeline b ON a.recording_id = b.recording_id AND b."end" > a.start AND b.start < a."end" GROUP BY 1, 2, 3""",
)
def overlap_matrix(spark, d):
    t = A.timeline(spark, d)
    pairs = I.interval_join(t.select("recording_id", "start", "end", "speaker"), t.select("recording_id", "start", "end", "secondary"), "recording_id", 60.0)
    ms = F.round((F.least("end", "r_end") - F.greatest("start", "r_start")) * 1000).cast("long")
    return pairs.groupBy("recording_id", "speaker", F.col("r_secondary").alias("secondary")).agg(F.sum(ms).alias("overlap_ms"))


@query("timestamp_format", f"""WITH {A.SEGMENTS_SQL}, t AS (SELECT recording_id, seg_ord, round_even(start * 1000, 0)::BIGINT AS ms FROM segments)
SELECT recording_id, seg_ord, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS t FROM t""")
def timestamp_format(spark, d):
    return A.segments(spark, d).select("recording_id", "seg_ord", T.timestamp_text(F.col("start"), ",").alias("t"))


_SRT = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query("html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark, d):
    return A.table(spark, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@query(
    "sentence_ends",
    f"""WITH {A.SEGMENTS_SQL} SELECT recording_id, count(*) FILTER (WHERE regexp_matches(text, '[.!?]["'')\\]}} ]*$')) AS ended, count(*) AS n FROM segments GROUP BY 1""",
)
def sentence_ends(spark, d):
    return A.segments(spark, d).groupBy("recording_id").agg(F.count_if(T.ends_sentence(F.col("text"))).alias("ended"), F.count("*").alias("n"))


@query(
    "speaker_label",
    """WITH raw AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'spk-' || (user_id % 7)::VARCHAR WHEN 1 THEN '---' WHEN 2 THEN 'x' || '0012345678901' || (user_id % 10)::VARCHAR WHEN 3 THEN '_' || event_type || '!' ELSE event_type END AS l FROM events),
d AS (SELECT event_id, l, regexp_extract(l, '[0-9]+$') AS n, upper(trim(regexp_replace(l, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS safe FROM raw)
SELECT event_id, CASE WHEN n <> '' THEN 'SPEAKER_' || CASE WHEN n::HUGEINT < 10 THEN '0' ELSE '' END || n::HUGEINT::VARCHAR ELSE 'SORTFORMER_' || CASE WHEN safe = '' THEN 'UNKNOWN' ELSE safe END END AS label FROM d""",
)
def speaker_label(spark, d):
    user = lambda k: (F.col("user_id") % k).cast("string")
    kind = F.col("event_id") % 5
    raw = (
        F.when(kind == 0, F.concat(F.lit("spk-"), user(7))).when(kind == 1, F.lit("---")).when(kind == 2, F.concat(F.lit("x0012345678901"), user(10)))
        .when(kind == 3, F.concat(F.lit("_"), "event_type", F.lit("!"))).otherwise(F.col("event_type"))
    )
    return A.table(spark, d, "events").select("event_id", T.speaker_label(raw).alias("label"))


@query("manifest_pending", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice >= 1000)")
def manifest_pending(spark, d):
    o = A.table(spark, d, "orders")
    done = o.where("o_orderstatus = 'F' and o_totalprice >= 1000").select("o_orderkey")
    return o.select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("duplicate_check", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_check(spark, d):
    return A.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "even_sample",
    """WITH r AS (SELECT event_id, event_id // 500 AS rec, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_id // 500) AS n FROM events)
SELECT DISTINCT rec, event_id FROM r, range(64) k(k) WHERE n <= 64 OR i = floor(k * (n - 1) / 63.0)""",
)
def even_sample(spark, d):
    e = A.table(spark, d, "events").withColumn("rec", F.expr("event_id div 500"))
    i = F.row_number().over(Window.partitionBy("rec").orderBy("event_id")) - 1
    rows = e.select("rec", "event_id", i.alias("i"), F.count("*").over(Window.partitionBy("rec")).alias("n"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.floor(k * (F.col("n") - 1) / 63.0))
    return rows.where((F.col("n") <= 64) | F.array_contains(picks, F.col("i").cast("long"))).select("rec", "event_id")


_TM = """tm AS (SELECT recording_id, ord, speaker, secondary, round(start * 1000)::BIGINT AS s, round("end" * 1000)::BIGINT AS e FROM timeline)"""
_NEAR = """m AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY recording_id, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS n FROM p),
i AS (SELECT *, sum(n) OVER (PARTITION BY recording_id, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT recording_id, speaker, min(s) AS start, max(e) AS "end", count(*) AS n_rows FROM i GROUP BY recording_id, speaker, island"""


@query(
    "exclusive_intervals",
    f"""WITH {A.TIMELINE_SQL}, {_TM.replace('AS e FROM timeline', 'AS e0 FROM timeline').replace('tm AS', 'tm0 AS')}, tm AS (SELECT *, CASE WHEN ord % 13 = 0 THEN s ELSE e0 END AS e FROM tm0),
edges AS (SELECT a.recording_id, a.ord, a.speaker, a.s, greatest(b.s, a.s) AS bs, least(b.e, a.e) AS be FROM tm a JOIN tm b ON a.recording_id = b.recording_id AND a.speaker <> b.speaker AND b.e > a.s AND b.s < a.e
  UNION ALL SELECT recording_id, ord, speaker, s, e, e FROM tm),
g AS (SELECT *, coalesce(max(be) OVER (PARTITION BY recording_id, ord ORDER BY bs, be ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s) AS gs FROM edges),
p AS (SELECT DISTINCT recording_id, speaker, gs + 80 AS s, bs - 80 AS e FROM g WHERE bs - gs >= 660),
{_NEAR.format(gap=80)}""",
)
def exclusive_intervals(spark, d):
    t = A.timeline(spark, d)
    return W.exclusive(t.withColumn("end", F.when(F.col("ord") % 13 == 0, F.col("start")).otherwise(F.col("end"))))


@query(
    "recognized_speech",
    f"""WITH {A.SEGMENTS_SQL},
p AS (SELECT recording_id, speaker, greatest(0, round(start * 1000)::BIGINT - 60) AS s, round("end" * 1000)::BIGINT + 60 AS e FROM segments
  WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(text, '^(\\[.*\\]|\\(.*\\)|<.*>)$')),
{_NEAR.format(gap=350)}""",
)
def recognized_speech(spark, d):
    return W.recognized_speech(A.segments(spark, d))


@query(
    "label_votes",
    f"""WITH {A.TIMELINE_SQL}, {_TM},
v AS (SELECT a.recording_id, a.ord, a.e - a.s AS length, b.secondary AS label, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS ms FROM tm a JOIN tm b ON a.recording_id = b.recording_id AND b.e > a.s AND b.s < a.e GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS place, coalesce(lead(ms) OVER w, 0) AS second FROM v WINDOW w AS (PARTITION BY recording_id, ord ORDER BY ms DESC, label DESC)),
b AS (SELECT *, ms > 0 AND 100 * ms >= 60 * length AND 100 * (ms - second) >= 15 * length AS wins FROM r WHERE place = 1)
SELECT tm.recording_id, tm.ord, CASE WHEN wins THEN label END AS label, coalesce(NOT wins, false) AS ambiguous FROM tm LEFT JOIN b USING (recording_id, ord)""",
)
def label_votes(spark, d):
    t = A.timeline(spark, d)
    return W.label_votes(t, t.withColumnRenamed("secondary", "label"))


@query(
    "choices_at_midpoint",
    f"""WITH {A.TIMELINE_SQL}, {_TM},
j AS (SELECT a.recording_id, a.ord, b.secondary, b.ord AS turn, a.s + a.e < 2 * b.e AS inside FROM tm a JOIN tm b ON a.recording_id = b.recording_id AND a.speaker = b.speaker AND a.s + a.e BETWEEN 2 * b.s AND 2 * b.e),
c AS (SELECT recording_id, ord, coalesce(arg_min(secondary, turn) FILTER (WHERE inside), arg_max(secondary, turn) FILTER (WHERE NOT inside)) AS choice FROM j GROUP BY 1, 2)
SELECT tm.recording_id, tm.ord, choice FROM tm LEFT JOIN c USING (recording_id, ord)""",
)
def choices_at_midpoint(spark, d):
    t = A.timeline(spark, d)
    return W.choices_at(t, t.withColumnRenamed("secondary", "choice"))


@query(
    "sentence_continues",
    f"""WITH {A.SEGMENTS_SQL},
p AS (SELECT recording_id, seg_ord, text, lag(text) OVER (PARTITION BY recording_id ORDER BY seg_ord) AS prior FROM segments),
c AS (SELECT recording_id, seg_ord, regexp_replace(regexp_extract(prior, '\\S+$'), '["'')\\]}} ]+$', '') AS core, regexp_extract(regexp_extract(text, '^\\S+'), '\\p{{L}}') AS letter FROM p)
SELECT recording_id, seg_ord, coalesce(core <> '' AND NOT regexp_matches(core, '[.!?]$') AND regexp_matches(letter, '^\\p{{Ll}}$'), false) AS goes_on FROM c""",
)
def sentence_continues(spark, d):
    before = F.lag("text").over(Window.partitionBy("recording_id").orderBy("seg_ord"))
    rows = A.segments(spark, d).withColumn("prior", before)
    return rows.select("recording_id", "seg_ord", T.sentence_continues(F.col("prior"), F.col("text")).alias("goes_on"))


@query(
    "set_differences",
    """SELECT * FROM (SELECT coalesce(c_custkey, s_suppkey) AS key, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'unexpected' WHEN c_nationkey IS DISTINCT FROM s_nationkey THEN 'changed' END AS status
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey) WHERE status IS NOT NULL""",
)
def set_differences(spark, d):
    side = lambda name, p, k: A.table(spark, d, name).select(F.col(f"{p}_{k}").alias("key"), F.col(f"{p}_nationkey").alias("value"))
    return W.differences(side("customer", "c", "custkey"), side("supplier", "s", "suppkey"), "key", "value")
