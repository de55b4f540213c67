"""Joins and algebra of intervals, on the timelines of the events and the turns of the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.operators import intervals as I
from talkgrid.plans.registry import query
from talkgrid.plans.sessions import TURNS_SQL, pieces, turns
from talkgrid.sources import speech as D

_T = f"WITH {D.TIMELINE_SQL}"


def _of(speaker: int) -> str:
    return f"(SELECT * FROM tm WHERE speaker = 'SPK_{speaker}')"


def _merged(name: str, rows: str, keys: str, gap: int = 0) -> str:
    """CTE name of merged rows, through the running latest end."""
    return f"""{name}_0 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS n FROM {rows} WHERE e > s),
{name}_1 AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}_0),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e, count(*) AS n_rows FROM {name}_1 GROUP BY {keys}, island)"""


def _minus(name: str, rows: str, blockers: str, keys: str, more: str = "") -> str:
    """CTE name of what blockers leave of rows."""
    qualified = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""{name}_0 AS (SELECT {qualified}, a.s AS s0, greatest(b.s, a.s) AS b, least(b.e, a.e) AS f FROM {rows} a JOIN {blockers} b ON a.recording_id = b.recording_id AND b.e > a.s AND b.s < a.e {more}
  UNION ALL SELECT {keys}, s, e, e FROM {rows}),
{name}_1 AS (SELECT {keys}, coalesce(max(f) OVER (PARTITION BY {keys} ORDER BY b, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s0) AS s, b AS e FROM {name}_0),
{name} AS (SELECT * FROM {name}_1 WHERE e > s)"""


@query(
    "interval_left_join",
    f"""{_T}, q AS (SELECT recording_id, CASE WHEN ord % 10 = 0 THEN 0 ELSE ord END AS ord, CASE WHEN ord % 50 = 7 THEN NULL WHEN ord % 10 = 0 THEN 5000 ELSE s END AS s, CASE WHEN ord % 10 = 0 THEN 6000 ELSE e END AS e FROM tm WHERE speaker = 'SPK_0')
SELECT q.recording_id, q.ord, q.s, q.e, t.ord AS r_ord, t.s AS r_s, t.e AS r_e FROM q LEFT JOIN {_of(1)} t ON t.recording_id = q.recording_id AND t.e > q.s AND t.s < q.e""",
)
def interval_left_join(spark, d):
    t = D.timeline(spark, d)
    tenth = F.col("ord") % 10 == 0
    # repeated rows and rows without a start
    rows = t.where("speaker = 'SPK_0'").select(
        "recording_id", F.when(tenth, 0).otherwise(F.col("ord")).alias("ord"),
        F.when(F.col("ord") % 50 == 7, F.lit(None)).when(tenth, 5000).otherwise(F.col("s")).alias("s"), F.when(tenth, 6000).otherwise(F.col("e")).alias("e"),
    )
    return I.ms_join(rows, t.where("speaker = 'SPK_1'").select("recording_id", "ord", "s", "e"), "left").drop("r_recording_id")


@query(
    "timeline_coalesce",
    f"""{_T}, c0 AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND s - lag(e) OVER w <= 120 THEN 0 ELSE 1 END AS n FROM tm WINDOW w AS (PARTITION BY recording_id ORDER BY ord)),
c1 AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY ord) AS island FROM c0)
SELECT recording_id, any_value(speaker) AS speaker, list(s ORDER BY ord)[1] AS s, list(e ORDER BY ord DESC)[1] AS e, count(*) AS n_rows FROM c1 GROUP BY recording_id, island""",
)
def timeline_coalesce(spark, d):
    return I.coalesce_runs(D.timeline(spark, d))


_BLOCKERS = "(SELECT recording_id, s, CASE WHEN ord % 13 = 0 THEN s ELSE e END AS e FROM tm WHERE speaker = 'SPK_1')"


@query("interval_subtract", f"{_T}, {_minus('p', _of(0), _BLOCKERS, 'recording_id, ord')} SELECT * FROM p")
def interval_subtract(spark, d):
    t = D.timeline(spark, d)
    blockers = t.where("speaker = 'SPK_1'").withColumn("e", F.when(F.col("ord") % 13 == 0, F.col("s")).otherwise(F.col("e")))
    return I.subtract(t.where("speaker = 'SPK_0'"), blockers, ["recording_id", "ord"])


@query(
    "interval_intersect",
    f"""{_T}, {_merged('a', _of(0), 'recording_id')}, {_merged('b', _of(1), 'recording_id')},
x AS (SELECT a.recording_id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM a JOIN b ON a.recording_id = b.recording_id AND b.e > a.s AND b.s < a.e), {_merged('m', 'x', 'recording_id', 80)} SELECT * FROM m""",
)
def interval_intersect(spark, d):
    t = D.timeline(spark, d)
    one = lambda k: I.merge(t.where(f"speaker = 'SPK_{k}'"), ["recording_id"], 0, "s", "e")
    return I.intersect(one(0), one(1))


@query(
    "interval_covered",
    f"""{_T}, {_merged('b', _of(0), 'recording_id')}
SELECT a.recording_id, a.ord, sum(CASE WHEN b.s IS NULL THEN 0 ELSE least(a.e, b.e) - greatest(a.s, b.s) END)::BIGINT AS covered FROM {_of(2)} a LEFT JOIN b ON a.recording_id = b.recording_id AND b.e > a.s AND b.s < a.e GROUP BY 1, 2""",
)
def interval_covered(spark, d):
    t = D.timeline(spark, d)
    return I.covered(t.where("speaker = 'SPK_2'"), I.merge(t.where("speaker = 'SPK_0'"), ["recording_id"], 0, "s", "e"), ["recording_id", "ord"])


@query(
    "overlap_regions",
    f"""{_T}, x AS (SELECT a.recording_id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM tm a JOIN tm b ON a.recording_id = b.recording_id AND a.ord < b.ord AND a.speaker <> b.speaker AND b.e > a.s AND b.s < a.e AND a.e > a.s AND b.e > b.s),
{_merged('m', 'x', 'recording_id', 20)} SELECT * FROM m""",
)
def overlap_regions(spark, d):
    return I.overlap_regions(D.timeline(spark, d))


_CORRECTIONS = """cor AS (SELECT recording_id, k * 30000 + 7000 AS s, k * 30000 + 7000 + 9000 + (k % 5) * 4000 AS e, 'SPK_' || (k % 3)::VARCHAR AS original, 'SPK_' || ((k + 1) % 3)::VARCHAR AS refined
  FROM (SELECT DISTINCT recording_id FROM tm), range(200) r(k))"""


@query(
    "relabel_interval",
    f"""{_T}, {_CORRECTIONS},
hit AS (SELECT t.recording_id, t.ord, greatest(t.s, c.s) AS s, least(t.e, c.e) AS e, c.refined AS speaker FROM tm t JOIN cor c ON t.recording_id = c.recording_id AND t.speaker = c.original AND c.e > t.s AND c.s < t.e),
ed AS (SELECT recording_id, ord, s AS b, e AS f FROM hit UNION ALL SELECT recording_id, ord, e, e FROM tm),
rest AS (SELECT ed.recording_id, ed.ord, coalesce(lag(f) OVER (PARTITION BY ed.recording_id, ed.ord ORDER BY b, f), tm.s) AS s, b AS e, speaker FROM ed JOIN tm USING (recording_id, ord)),
al AS (SELECT * FROM rest WHERE e > s UNION ALL SELECT * FROM hit),
i0 AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS c FROM al WINDOW w AS (PARTITION BY recording_id ORDER BY s, e, ord)),
i1 AS (SELECT *, sum(c) OVER (PARTITION BY recording_id ORDER BY s, e, ord ROWS UNBOUNDED PRECEDING) AS island FROM i0),
i2 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY recording_id, island ORDER BY s, e, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 20 THEN 0 ELSE 1 END AS n FROM i1),
i3 AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY s, e, ord ROWS UNBOUNDED PRECEDING) AS grp FROM i2)
SELECT recording_id, any_value(speaker) AS speaker, min(s) AS s, max(e) AS e, count(*) AS n_pieces FROM i3 GROUP BY recording_id, grp""",
)
def relabel_interval(spark, d):
    t = D.timeline(spark, d)
    k = F.col("k")
    corrections = t.select("recording_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(199)))).select(
        "recording_id", (k * 30000 + 7000).cast("long").alias("s"), (k * 30000 + 16000 + k % 5 * 4000).cast("long").alias("e"),
        F.concat(F.lit("SPK_"), (k % 3).cast("string")).alias("original"), F.concat(F.lit("SPK_"), ((k + 1) % 3).cast("string")).alias("refined"),
    )
    return I.relabel(t, corrections)


@query(
    "boundary_split",
    f"""{_T}, cuts AS (SELECT DISTINCT recording_id, speaker, unnest([s, e]) AS t FROM tm WHERE ord % 7 = 0),
pts AS (SELECT a.recording_id, a.ord, a.speaker AS local, t FROM tm a JOIN cuts c ON a.recording_id = c.recording_id AND a.speaker = c.speaker AND t > a.s AND t < a.e UNION SELECT recording_id, ord, speaker, s FROM tm UNION SELECT recording_id, ord, speaker, e FROM tm),
n AS (SELECT recording_id, ord, local, t AS s, lead(t) OVER (PARTITION BY recording_id, ord ORDER BY t) AS e FROM pts) SELECT * FROM n WHERE e IS NOT NULL""",
)
def boundary_split(spark, d):
    t = D.timeline(spark, d).withColumnRenamed("speaker", "local")
    return I.split_at(t, t.where("ord % 7 = 0"), ["recording_id", "ord"])


@query(
    "clean_spans",
    f"""{_T}, ev AS (SELECT DISTINCT a.recording_id, greatest(a.s, b.s) - 150 AS s, least(a.e, b.e) + 150 AS e FROM tm a JOIN tm b ON a.recording_id = b.recording_id AND a.ord < b.ord AND a.speaker <> b.speaker AND b.e > a.s AND b.s < a.e),
{_minus('p', 'tm', 'ev', 'recording_id, ord')} SELECT * FROM p WHERE e - s >= 2500""",
)
def clean_spans(spark, d):
    t = D.timeline(spark, d)
    return I.subtract(t, I.overlap_union(t, 150), ["recording_id", "ord"]).where("e - s >= 2500")


_SPANS = f"{_merged('m', 'tm', 'recording_id, speaker')}"


@query(
    "fixed_windows",
    f"""{_T}, {_SPANS}, w0 AS (SELECT recording_id, speaker, e - 100 AS b, unnest(range(s + 100, e - 100 - 800 + 1, 6000)) AS w_s FROM m WHERE e - s - 200 >= 800),
w1 AS (SELECT recording_id, speaker, w_s, least(w_s + 6000, b) AS w_e, row_number() OVER (PARTITION BY recording_id, speaker ORDER BY w_s) - 1 AS win, count(*) OVER (PARTITION BY recording_id, speaker) AS n FROM w0)
SELECT recording_id, speaker, w_s, w_e, win FROM w1 WHERE n <= 64 OR win IN (SELECT (j * (n - 1)) // 63 FROM range(64) r(j))""",
)
def fixed_windows(spark, d):
    spans = I.merge(D.timeline(spark, d), ["recording_id", "speaker"], 0, "s", "e")
    return I.fixed_windows(spans, ["recording_id", "speaker"])


_PARTS = """tot AS (SELECT recording_id, speaker, sum(e - s) AS total FROM m GROUP BY 1, 2),
np AS (SELECT *, least(12, greatest(1, total // 2000)) AS n FROM tot WHERE total >= 1000),
parts AS (SELECT recording_id, speaker, unnest(range(n::BIGINT)) AS part, total::DOUBLE / n AS share FROM np)"""


def _parts(spans):
    return I.equal_parts(spans.groupBy("recording_id", "speaker").agg(F.sum(F.col("e") - F.col("s")).alias("total")), ["recording_id", "speaker"])


@query("equal_partition", f"{_T}, {_SPANS}, {_PARTS} SELECT recording_id, speaker, part, part * share AS \"offset\", least(6000.0::DOUBLE, share) AS length FROM parts")
def equal_partition(spark, d):
    return _parts(I.merge(D.timeline(spark, d), ["recording_id", "speaker"], 0, "s", "e"))


@query(
    "virtual_slices",
    f"""{_T}, {_SPANS}, {_PARTS},
laid AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY recording_id, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v FROM m),
hit AS (SELECT l.recording_id, l.speaker, part, l.s AS i_s, v, greatest(v, part * share) AS a, least(v + e - l.s, part * share + least(6000, share)) AS b FROM laid l JOIN parts USING (recording_id, speaker))
SELECT recording_id, speaker, part, round(i_s + a - v, 3) AS s, round(i_s + b - v, 3) AS e FROM hit WHERE b > a""",
)
def virtual_slices(spark, d):
    spans = I.merge(D.timeline(spark, d), ["recording_id", "speaker"], 0, "s", "e")
    found = I.virtual_slices(spans, _parts(spans), ["recording_id", "speaker"])
    return found.withColumn("s", F.round("s", 3)).withColumn("e", F.round("e", 3))


@query(
    "nearest_label",
    f"""{_T}, x AS (SELECT a.recording_id, a.ord, b.speaker AS label, row_number() OVER (PARTITION BY a.recording_id, a.ord ORDER BY abs(b.s - a.s), b.ord) AS k
  FROM (SELECT * FROM tm WHERE ord % 3 = 0) a JOIN (SELECT * FROM tm WHERE ord % 3 <> 0 AND ord % 4 <> 1) b USING (recording_id)) SELECT recording_id, ord, label FROM x WHERE k = 1""",
)
def nearest_label(spark, d):
    t = D.timeline(spark, d)
    return I.nearest(t.where("ord % 3 = 0"), t.where("ord % 3 <> 0 and ord % 4 <> 1").withColumn("label", F.col("speaker")), ["recording_id"])


OVERLAPS_SQL = (
    TURNS_SQL.rstrip()
    + """, ov AS (SELECT a.recording_id, a.turn_ord, b.turn_ord AS other_ord, a.speaker, b.speaker AS other, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM turns a JOIN turns b
  ON a.recording_id = b.recording_id AND a.turn_ord < b.turn_ord AND a.speaker <> b.speaker AND b.e > a.s AND b.s < a.e
  AND NOT EXISTS (SELECT 1 FROM turns k WHERE k.recording_id = a.recording_id AND k.turn_ord > a.turn_ord AND k.turn_ord < b.turn_ord AND k.s >= a.e)),
turn_overlaps AS (SELECT recording_id, turn_ord, other_ord, other, s, e, true AS earlier FROM ov UNION ALL SELECT recording_id, other_ord, turn_ord, speaker, s, e, false FROM ov)
"""
)


@query("turn_overlaps", OVERLAPS_SQL + "SELECT * FROM turn_overlaps")
def turn_overlaps(spark, d):
    return I.turn_overlaps(turns(spark, d))


@query("overlapping_starts", OVERLAPS_SQL + "SELECT recording_id, turn_ord, max(other_ord) AS starts_with FROM turn_overlaps WHERE NOT earlier GROUP BY 1, 2")
def overlapping_starts(spark, d):
    return I.turn_overlaps(turns(spark, d)).where("not earlier").groupBy("recording_id", "turn_ord").agg(F.max("other_ord").alias("starts_with"))


RAW_SQL = (
    TURNS_SQL.rstrip()
    + """, raw AS (SELECT DISTINCT a.recording_id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e,
  CASE WHEN (a.s, a.ord) < (b.s, b.ord) THEN a.local_speaker ELSE b.local_speaker END AS speaker, CASE WHEN (a.s, a.ord) < (b.s, b.ord) THEN b.local_speaker ELSE a.local_speaker END AS other
  FROM pieces a JOIN pieces b ON a.recording_id = b.recording_id AND a.ord < b.ord AND a.local_speaker <> b.local_speaker AND b.e > a.s AND b.s < a.e)
"""
)


def raw_events(spark, d):
    return I.raw_overlaps(pieces(spark, d).withColumn("speaker", F.col("local_speaker")))


@query("raw_overlaps", RAW_SQL + "SELECT * FROM raw")
def raw_overlaps(spark, d):
    return raw_events(spark, d)


@query(
    "overlap_attach",
    RAW_SQL
    + """SELECT t.recording_id, t.turn_ord, count(r.s) AS n_events, coalesce(sum(r.e - r.s), 0)::BIGINT AS event_ms, CASE WHEN count(r.s) > 0 THEN 'uncertain' ELSE 'assigned' END AS status
FROM turns t LEFT JOIN raw r ON r.recording_id = t.recording_id AND r.s < t.e AND r.e > t.s GROUP BY 1, 2""",
)
def overlap_attach(spark, d):
    met = I.ms_join(turns(spark, d).select("recording_id", "turn_ord", "s", "e"), raw_events(spark, d), "left")
    n = F.count("r_s")
    return met.groupBy("recording_id", "turn_ord").agg(
        n.alias("n_events"), F.coalesce(F.sum(F.col("r_e") - F.col("r_s")), F.lit(0)).alias("event_ms"), F.when(n > 0, "uncertain").otherwise("assigned").alias("status")
    )
