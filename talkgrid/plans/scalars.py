"""Scalar, array, map, hash and statistical functions on the tables, and small rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.functions import numbers as Z
from talkgrid.functions import text as T
from talkgrid.operators import vectors as V
from talkgrid.plans.registry import query
from talkgrid.plans.voices import UNITS_SQL, _centre, observations
from talkgrid.sources import adapters as A


@query(
    "whitespace",
    "WITH x AS (SELECT p_partkey, '  ' || chr(160) || p_name || chr(9) || chr(8195) || ' ' || p_brand || chr(10) AS t FROM part), y AS (SELECT p_partkey, trim(regexp_replace(t, '[\\s\\x{A0}\\x{2003}]+', ' ', 'g')) AS clean FROM x) SELECT p_partkey, clean, len(string_split(clean, ' ')) AS n FROM y",
)
def whitespace(spark, d):
    text = F.concat(F.lit("   "), "p_name", F.lit("\t "), "p_brand", F.lit("\n"))
    clean = T.one_space(text)
    return A.table(spark, d, "part").select("p_partkey", clean.alias("clean"), F.size(F.split(clean, " ")).alias("n"))


@query("truncated_ids", "SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderstatus)[1:24] AS id24, sha256(o_orderkey::VARCHAR)[1:16] AS id16 FROM orders")
def truncated_ids(spark, d):
    key = F.col("o_orderkey").cast("string")
    return A.table(spark, d, "orders").select("o_orderkey", T.short_id(24, key, F.col("o_orderstatus")).alias("id24"), T.short_id(16, key).alias("id16"))


@query("canonical_json", """SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def canonical_json(spark, d):
    fields = {"status": F.col("o_orderstatus"), "key": F.col("o_orderkey"), "custkey": F.col("o_custkey")}
    return A.table(spark, d, "orders").select("o_orderkey", F.sha2(T.canonical_json(fields), 256).alias("digest"))


@query("script_json", "SELECT page_id, replace(html, '<', '\\u003c') AS embedded FROM pages")
def script_json(spark, d):
    from talkgrid.operators.render import embedded

    return A.table(spark, d, "pages").select("page_id", embedded(F.col("html")).alias("embedded"))


@query("round_half_even", "SELECT event_id, round_even((event_id % 1000) / 8.0, 0) AS whole, round_even((event_id % 1000) / 16.0, 1) AS tenth FROM events")
def round_half_even(spark, d):
    k = F.col("event_id") % 1000
    return A.table(spark, d, "events").select("event_id", Z.half_even(k / 8.0).alias("whole"), Z.half_even(k / 16.0, 1).alias("tenth"))


@query("percent_text", "SELECT event_id, round_even((event_id % 201)::DOUBLE / 200::DOUBLE * 100::DOUBLE, 0)::BIGINT || '%' AS share FROM events")
def percent_text(spark, d):
    from talkgrid.operators.render import percent

    return A.table(spark, d, "events").select("event_id", percent(F.col("event_id") % 201 / 200.0).alias("share"))


_R6 = "floor(({0}) * 1e6 + 0.5) / 1e6"


@query(
    "series_statistics",
    f"SELECT event_type, {_R6.format('avg(x)')} AS mean, {_R6.format('stddev_pop(x)')} AS deviation, median(x) AS middle, {_R6.format('quantile_cont(x, 0.2)')} AS low FROM (SELECT event_type, (event_id * 7 % 1001)::DOUBLE AS x FROM events) GROUP BY 1",
)
def series_statistics(spark, d):
    rows = A.table(spark, d, "events").select("event_type", (F.col("event_id") * 7 % 1001).cast("double").alias("x"))
    stats = {"mean": F.avg("x"), "deviation": F.stddev_pop("x"), "middle": F.percentile("x", 0.5), "low": F.percentile("x", 0.2)}
    return rows.groupBy("event_type").agg(*[(V.rounded(v, 6) if k != "middle" else v).alias(k) for k, v in stats.items()])


@query(
    "array_tools",
    """WITH a AS (SELECT user_id, list(event_type ORDER BY event_id) AS l, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1)
SELECT user_id, len(list_distinct(l)) AS kinds, array_to_string(l[1:3], ',') AS head, (SELECT string_agg(x, ',') FROM (SELECT unnest(list_filter(ids[1:9], lambda x, i: i % 2 = 1))::VARCHAR AS x)) AS alternate, list_contains(l, 'purchase') AS bought, len(list_filter(ids, lambda i: i % 2 = 0)) = len(ids) AS even FROM a""",
)
def array_tools(spark, d):
    rows = A.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    kinds, ids = F.transform("x", lambda v: v["event_type"]), F.transform("x", lambda v: v["event_id"])
    every_other = F.filter(F.slice(ids, 1, 9), lambda _, i: i % 2 == 0)
    return rows.select(
        "user_id", F.size(F.array_distinct(kinds)).alias("kinds"), F.array_join(F.slice(kinds, 1, 3), ",").alias("head"), F.array_join(F.transform(every_other, lambda v: v.cast("string")), ",").alias("alternate"),
        F.array_contains(kinds, "purchase").alias("bought"), F.forall(ids, lambda v: v % 2 == 0).alias("even"),
    )


@query(
    "map_rewrite",
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' ELSE c_mktsegment END AS choice, CASE WHEN c_custkey % 3 = 0 THEN 'V' || c_custkey % 5 ELSE 'none' END AS found FROM customer",
)
def map_rewrite(spark, d):
    k = F.col("c_custkey")
    one = F.create_map(F.lit("segment"), F.col("c_mktsegment"))
    two = F.when(k % 3 == 0, F.create_map(F.lit("voice"), F.concat(F.lit("V"), (k % 5).cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    both = F.transform_values(F.map_concat(one, two), lambda _, v: F.when(v == "BUILDING", "unknown").otherwise(v))
    return A.table(spark, d, "customer").select("c_custkey", F.try_element_at(both, F.lit("segment")).alias("choice"), F.coalesce(F.try_element_at(both, F.lit("voice")), F.lit("none")).alias("found"))


@query(
    "packet_digest",
    "SELECT o_orderkey, sha256('1|' || o_orderkey || '|' || o_custkey) AS digest, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS valid FROM orders",
)
def packet_digest(spark, d):
    from talkgrid.operators import state as M

    k = F.col("o_orderkey")
    own = M.cache_key(F.lit(1), k, F.col("o_custkey"))
    rows = A.table(spark, d, "orders").select("o_orderkey", own.alias("digest"), F.when(k % 5 != 0, own).otherwise(F.lit("0")).alias("review_id"), F.when(k % 7 != 0, 1).otherwise(2).alias("version"))
    return rows.select("o_orderkey", "digest", ((F.col("digest") == F.col("review_id")) & (F.col("version") == 1)).alias("valid"))


@query(
    "group_evidence",
    f"""{UNITS_SQL}, wo AS (SELECT voice, session * 2 + ord % 2 AS part, least(30, greatest(1, clean_seconds)) AS w, unit, clean_seconds, verified FROM obs), {_centre('c', 'wo', 'voice', 'w')},
g AS (SELECT voice, sum(round(clean_seconds * 10)::BIGINT)::BIGINT AS tenths, count(*) AS windows, bool_or(NOT verified) AS any_flag, bool_and(clean_seconds > 0.85) AS every_flag FROM wo GROUP BY 1),
h AS (SELECT wo.voice, floor(min(list_dot_product(unit, c)) * 1e4 + 0.5) / 1e4 AS least FROM wo JOIN c USING (voice) GROUP BY 1) SELECT * FROM g JOIN h USING (voice)""",
)
def group_evidence(spark, d):
    rows = observations(spark, d).withColumn("w", F.least(F.lit(30.0), F.greatest(F.lit(1.0), F.col("clean_seconds"))))
    near = rows.join(V.centroids(rows, ["voice"], weight="w").drop("n_vectors"), "voice")
    return near.groupBy("voice").agg(
        F.sum(F.round(F.col("clean_seconds") * 10).cast("long")).alias("tenths"), F.count("*").alias("windows"), F.max(~F.col("verified")).alias("any_flag"),
        F.min(F.col("clean_seconds") > 0.85).alias("every_flag"), V.rounded(F.min(V.dot("unit", "centroid"))).alias("least"),
    )


@query("annotation_frame", f"WITH {A.TIMELINE_SQL} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start, \"end\", ord) - 1 AS label, speaker, start, \"end\" FROM timeline")
def annotation_frame(spark, d):
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("recording_id").orderBy("start", "end", "ord")) - 1
    return A.timeline(spark, d).select("recording_id", n.cast("long").alias("label"), "speaker", "start", "end")
