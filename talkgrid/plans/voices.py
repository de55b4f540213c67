"""Voices: vectors, references, matches and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.operators import vectors as V
from talkgrid.plans.registry import query
from talkgrid.session import durable
from talkgrid.sources import adapters as A

_UNIT = "list_transform({0}, lambda x: floor(x / sqrt(list_dot_product({0}, {0})) * 1e7 + 0.5) / 1e7)"
_R4 = "floor(({0}) * 1e4 + 0.5) / 1e4"
UNITS_SQL = f"WITH {A.WINDOWS_SQL}, obs AS (SELECT voice, session, vec_id AS ord, clean_seconds, verified, {_UNIT.format('embedding')} AS unit FROM windows)"


def _centre(name: str, rows: str, keys: str, weight: str | None = None) -> str:
    mean = f"sum(x * {weight}) / sum({weight})" if weight else "avg(x)"
    more = f", {weight}" if weight else ""
    return f"""{name}_0 AS (SELECT {keys}{more}, unnest(unit) AS x, unnest(range(len(unit))) AS pos FROM {rows}), {name}_1 AS (SELECT {keys}, pos, {mean} AS m, count(*) AS n FROM {name}_0 GROUP BY {keys}, pos),
{name}_2 AS (SELECT {keys}, list(m ORDER BY pos) AS v, max(n) AS n_vectors FROM {name}_1 GROUP BY {keys}), {name} AS (SELECT {keys}, n_vectors, {_UNIT.format('v')} AS c FROM {name}_2)"""


def observations(spark, d):
    return A.windows(spark, d).select("voice", "session", F.col("vec_id").alias("ord"), "clean_seconds", "verified", V.normalize("embedding").alias("unit"))


def _total(v: str):
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


@query("vector_normalize", f"{UNITS_SQL} SELECT ord, round(list_sum(unit), 4) AS total, {_R4.format('list_dot_product(unit, unit)')} AS length FROM obs")
def vector_normalize(spark, d):
    return observations(spark, d).select("ord", F.round(_total("unit"), 4).alias("total"), V.rounded(V.dot("unit", "unit")).alias("length"))


@query("plain_cosine", f"WITH {A.WINDOWS_SQL} SELECT a.vec_id, {_R4.format('list_cosine_similarity(a.embedding, b.embedding)')} AS cosine FROM windows a JOIN windows b ON b.vec_id = a.vec_id + 10")
def plain_cosine(spark, d):
    w = A.windows(spark, d).select("vec_id", "embedding")
    other = w.select((F.col("vec_id") - 10).alias("vec_id"), F.col("embedding").alias("other"))
    return w.join(other, "vec_id").select("vec_id", V.rounded(V.cosine("embedding", "other")).alias("cosine"))


@query("vector_centroids", f"{UNITS_SQL}, {_centre('c', 'obs', 'voice, session')} SELECT voice, session, n_vectors, round(list_sum(c), 4) AS total FROM c")
def vector_centroids(spark, d):
    return V.centroids(observations(spark, d), ["voice", "session"]).select("voice", "session", "n_vectors", F.round(_total("centroid"), 4).alias("total"))


@query(
    "weighted_centroids",
    f"{UNITS_SQL}, wo AS (SELECT *, least(30, greatest(1, clean_seconds)) AS w FROM obs), {_centre('c', 'wo', 'voice', 'w')} SELECT voice, n_vectors, round(list_sum(c), 4) AS total FROM c",
)
def weighted_centroids(spark, d):
    rows = observations(spark, d).withColumn("w", F.least(F.lit(30.0), F.greatest(F.lit(1.0), F.col("clean_seconds"))))
    return V.centroids(rows, ["voice"], weight="w").select("voice", "n_vectors", F.round(_total("centroid"), 4).alias("total"))


CONDITIONS_SQL = (
    UNITS_SQL
    + f""", good AS (SELECT * FROM obs WHERE verified AND clean_seconds >= 0.8), lg AS (SELECT * FROM good WHERE clean_seconds >= 2.5),
sh AS (SELECT *, (row_number() OVER (PARTITION BY voice, session ORDER BY ord) - 1) % 2 AS pool FROM good WHERE clean_seconds < 2.5), {_centre('lc', 'lg', 'voice, session')}, {_centre('sc', 'sh', 'voice, session')},
lm AS (SELECT voice, session, list(unit ORDER BY ord) AS members FROM lg GROUP BY 1, 2 HAVING count(*) >= 2),
ok AS (SELECT voice, session FROM sh JOIN sc USING (voice, session) GROUP BY 1, 2 HAVING count(*) >= 5 AND sum(clean_seconds) >= 8 - 1e-9 AND min(list_dot_product(unit, c)) >= 0.70),
pl AS (SELECT sh.* FROM sh JOIN ok USING (voice, session)), {_centre('pc', 'pl', 'voice, session, pool')}, pu AS (SELECT voice, session, pool, c AS unit FROM pc), {_centre('px', 'pu', 'voice, session')},
pm AS (SELECT voice, session, list(unit ORDER BY pool) AS members FROM pu GROUP BY 1, 2),
cond AS (SELECT voice, session, 'long' AS kind, members, c FROM lm JOIN lc USING (voice, session) UNION ALL SELECT voice, session, 'short', members, c FROM pm JOIN px USING (voice, session))"""
)


def kept(spark, d):
    """The observations, normalised once for all that reads them."""
    return durable(observations(spark, d))


def conditions(every):
    return durable(V.reference_conditions(every))


@query("reference_conditions", CONDITIONS_SQL + " SELECT voice, session, kind, len(members) AS n, round(list_sum(c), 4) AS total FROM cond")
def reference_conditions(spark, d):
    return conditions(kept(spark, d)).select("voice", "session", "kind", F.size("members").alias("n"), F.round(_total("centroid"), 4).alias("total"))


_SECOND = "list_reverse_sort(list_transform(members, lambda m: list_dot_product(q.unit, m)))[2]"
CONSENSUS_SQL = CONDITIONS_SQL + f", sco AS (SELECT q.ord AS query, c.voice, max(least(list_dot_product(q.unit, c.c), {_SECOND})) AS score FROM obs q, cond c WHERE NOT q.verified GROUP BY 1, 2)"


def unverified(every):
    return every.where("not verified").select(F.col("ord").alias("query"), F.col("unit").alias("vector"), "voice", "session", "clean_seconds")


@query("consensus_similarity", CONSENSUS_SQL + f" SELECT query, voice, {_R4.format('score')} AS score FROM sco")
def consensus_similarity(spark, d):
    every = kept(spark, d)
    return V.consensus(unverified(every), conditions(every)).withColumn("score", V.rounded(F.col("score")))


def roles(spark, d):
    voice = F.col("voice")
    return A.windows(spark, d).select("voice").distinct().withColumn("role", F.when(voice % 3 == 0, "child").otherwise("adult"))


@query(
    "nearest_profiles",
    CONSENSUS_SQL
    + f""", rk AS (SELECT *, {_R4.format('score')} AS similarity, row_number() OVER (PARTITION BY query ORDER BY score DESC, voice) AS rank FROM sco), top AS (SELECT * FROM rk WHERE rank <= 3 AND score >= 0)
SELECT query, rank, voice, similarity, rank = 1 AND similarity >= CASE WHEN voice % 3 = 0 THEN 0.85 ELSE 0.80 END AND similarity - coalesce(lead(similarity) OVER (PARTITION BY query ORDER BY rank), -1) >= 0.20 AS suggested FROM top""",
)
def nearest_profiles(spark, d):
    every = kept(spark, d)
    return V.suggestions(V.consensus(unverified(every), conditions(every)), roles(spark, d))


# windows of a speaker of a recording: of one voice mostly, the others disputed or outliers
_LOCAL = "ord // 20 AS rec, ord, unit, ord % 5 = 0 AS disputed"


def local_windows(spark, d):
    return observations(spark, d).select(F.expr("ord div 20").alias("rec"), "ord", "unit", (F.col("ord") % 5 == 0).alias("disputed"))


@query(
    "medoid_anchor",
    f"""{UNITS_SQL}, lw AS (SELECT {_LOCAL} FROM obs WHERE voice IN (1, 2, 3)),
md AS (SELECT a.rec, a.ord, median(floor(list_dot_product(a.unit, b.unit) * 1e6 + 0.5) / 1e6) AS m FROM lw a JOIN lw b ON a.rec = b.rec WHERE (NOT a.disputed AND NOT b.disputed) OR a.rec IN (SELECT rec FROM lw GROUP BY 1 HAVING bool_and(disputed)) GROUP BY 1, 2),
me AS (SELECT rec, list(ord ORDER BY m DESC, ord)[1] AS medoid FROM md GROUP BY 1)
SELECT a.rec, a.ord, medoid, floor(list_dot_product(a.unit, b.unit) * 1e6 + 0.5) / 1e6 AS agreement, floor(list_dot_product(a.unit, b.unit) * 1e6 + 0.5) / 1e6 >= 0.45 AND NOT a.disputed AS retained FROM lw a JOIN me USING (rec) JOIN lw b ON b.rec = a.rec AND b.ord = medoid""",
)
def medoid_anchor(spark, d):
    rows = local_windows(spark, d).join(observations(spark, d).where("voice in (1, 2, 3)").select("ord"), "ord", "left_semi")
    return V.medoid_evidence(rows, ["rec"]).select("rec", "ord", "medoid", "agreement", "retained")


@query(
    "trimmed_centroids",
    f"""{UNITS_SQL}, {_centre('c0', 'obs', 'voice, session')}, nr AS (SELECT o.*, n_vectors, floor(list_dot_product(unit, c) * 1e6 + 0.5) / 1e6 AS sim FROM obs o JOIN c0 USING (voice, session)),
ct AS (SELECT voice, session, quantile_cont(sim, 0.2) AS cut FROM nr GROUP BY 1, 2), k0 AS (SELECT nr.*, n_vectors < 4 OR sim >= cut AS keep FROM nr JOIN ct USING (voice, session)),
k1 AS (SELECT voice, session, unit FROM (SELECT *, count(*) FILTER (WHERE keep) OVER (PARTITION BY voice, session) AS nk FROM k0) WHERE keep OR nk < 2), {_centre('c1', 'k1', 'voice, session')}
SELECT voice, session, max(n_vectors) AS n_vectors, median(floor(list_dot_product(unit, c) * 1e6 + 0.5) / 1e6) AS cohesion FROM k1 JOIN c1 USING (voice, session) GROUP BY 1, 2""",
)
def trimmed_centroids(spark, d):
    return V.trimmed_centroids(observations(spark, d), ["voice", "session"]).select("voice", "session", "n_vectors", "cohesion")


@query(
    "nearest_centroid",
    f"""{UNITS_SQL}, an AS (SELECT session, voice AS cluster, unit FROM obs WHERE clean_seconds >= 0.8 AND ord % 2 = 0), {_centre('c', 'an', 'session, cluster')},
x AS (SELECT o.session, o.ord, cluster, row_number() OVER (PARTITION BY o.session, o.ord ORDER BY floor(list_dot_product(o.unit, c.c) * 1e9 + 0.5) DESC, cluster) AS k FROM obs o JOIN c USING (session)) SELECT session, ord, cluster FROM x WHERE k = 1""",
)
def nearest_centroid(spark, d):
    rows = observations(spark, d)
    return V.nearest_centroid(rows, rows.where("clean_seconds >= 0.8 and ord % 2 = 0").withColumnRenamed("voice", "cluster"), "session")


@query(
    "profile_catalog",
    CONDITIONS_SQL
    + """ SELECT voice, 'voice ' || voice AS label, CASE WHEN voice % 3 = 0 THEN 'child' ELSE 'adult' END AS role, count(*) FILTER (WHERE verified) AS verified_windows, count(DISTINCT session) FILTER (WHERE verified) AS sessions,
sum(CASE WHEN verified THEN round(clean_seconds * 10)::BIGINT ELSE 0 END)::BIGINT AS tenths, voice % 5 = 4 AS archived, CASE WHEN voice IN (SELECT voice FROM cond WHERE voice NOT IN (7, 8)) THEN 'ready' WHEN bool_or(verified) THEN 'collecting' ELSE 'untrained' END AS training_status
FROM (SELECT voice, session, clean_seconds, verified AND voice <> 7 AND (voice <> 8 OR ord % 100 = 8) AS verified FROM obs) GROUP BY voice""",
)
def profile_catalog(spark, d):
    rows = observations(spark, d).withColumn("verified", F.expr("verified and voice <> 7 and (voice <> 8 or ord % 100 = 8)"))
    ready = conditions(kept(spark, d)).where("voice not in (7, 8)").select("voice").distinct().withColumn("ready", F.lit(True))
    per = rows.groupBy("voice").agg(
        F.count_if("verified").alias("verified_windows"), F.count_distinct(F.when(F.col("verified"), F.col("session"))).alias("sessions"),
        F.sum(F.when(F.col("verified"), F.round(F.col("clean_seconds") * 10).cast("long")).otherwise(0)).alias("tenths"), F.max("verified").alias("any"),
    )
    status = F.when(F.col("ready"), "ready").when(F.col("any"), "collecting").otherwise("untrained")
    out = per.join(ready, "voice", "left").join(roles(spark, d), "voice")
    return out.select("voice", F.concat(F.lit("voice "), F.col("voice").cast("string")).alias("label"), "role", "verified_windows", "sessions", "tenths", (F.col("voice") % 5 == 4).alias("archived"), status.alias("training_status"))


@query(
    "profile_refresh",
    f"{UNITS_SQL}, {_centre('c', 'obs', 'voice')} SELECT voice, round(list_sum(any_value(c)), 4) AS total, count(DISTINCT session) AS sessions_seen, sum(least(300, round(clean_seconds * 100)::BIGINT))::BIGINT AS hundredths, 'available' AS status FROM obs JOIN c USING (voice) GROUP BY 1",
)
def profile_refresh(spark, d):
    rows = observations(spark, d)
    per = rows.groupBy("voice").agg(F.count_distinct("session").alias("sessions_seen"), F.sum(F.least(F.lit(300), F.round(F.col("clean_seconds") * 100).cast("long"))).alias("hundredths"))
    out = V.centroids(rows, ["voice"]).join(per, "voice")
    return out.select("voice", F.round(_total("centroid"), 4).alias("total"), "sessions_seen", "hundredths", F.lit("available").alias("status"))


_EVIDENCE = "ev AS (SELECT c_custkey AS id, c_custkey % 170 / 10.0::DOUBLE AS clean_seconds, c_custkey % 5 AS window_count, c_custkey % 97 / 100.0::DOUBLE AS cohesion, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS word_timing, c_custkey % 4 AS recognized_words, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 13 / 10.0::DOUBLE END AS recognized_seconds FROM customer)"
_SPOKEN = "(NOT coalesce(word_timing, false) OR (recognized_words >= {} AND coalesce(recognized_seconds, 0) >= {}))"


@query(
    "evidence_eligibility",
    f"""WITH {_EVIDENCE} SELECT id, clean_seconds >= 12 AND window_count >= 3 AND cohesion >= 0.4 AND {_SPOKEN.format(3, 1.0)} AS enroll, clean_seconds >= 4 AND window_count >= 2 AND cohesion >= 0.4 AND {_SPOKEN.format(2, 0.5)} AS "update",
clean_seconds >= 2 AND window_count >= 1 AND cohesion >= 0.4 AND {_SPOKEN.format(1, 0.2)} AS "match", clean_seconds >= 2 AND window_count >= 2 AND cohesion >= 0.4 AS merge FROM ev""",
)
def evidence_eligibility(spark, d):
    k = F.col("c_custkey")
    rows = A.table(spark, d, "customer").select(
        k.alias("id"), (k % 170 / 10.0).alias("clean_seconds"), (k % 5).alias("window_count"), (k % 97 / 100.0).alias("cohesion"), F.when(k % 7 != 0, k % 2 == 0).alias("word_timing"),
        (k % 4).alias("recognized_words"), F.when(k % 11 != 0, k % 13 / 10.0).alias("recognized_seconds"),
    )
    return rows.select("id", *[V.eligible(p).alias(p) for p in ("enroll", "update", "match", "merge")])


_TRIALS = (
    CONDITIONS_SQL
    + f""", q AS (SELECT * FROM obs WHERE verified), true_left AS (SELECT DISTINCT a.ord FROM q a JOIN q b ON a.voice = b.voice AND a.session <> b.session),
sc1 AS (SELECT q.ord, c.voice, max(least(list_dot_product(q.unit, c.c), {_SECOND})) AS score FROM q JOIN cond c ON c.session <> q.session WHERE q.ord IN (SELECT ord FROM true_left) GROUP BY 1, 2),
al AS (SELECT q.ord, q.voice AS truth, v.voice, coalesce(score, -1) AS score FROM q CROSS JOIN (SELECT DISTINCT voice FROM obs) v LEFT JOIN sc1 ON sc1.ord = q.ord AND sc1.voice = v.voice WHERE q.ord IN (SELECT ord FROM true_left)),
rk AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, voice DESC) AS k, lead(score) OVER (PARTITION BY ord ORDER BY score DESC, voice DESC) AS nxt FROM al),
tr AS (SELECT *, score >= CASE WHEN voice % 3 = 0 THEN 0.78 ELSE 0.70 END AND score - coalesce(nxt, -1) >= 0.15 AS accepted FROM rk WHERE k = 1)"""
)


@query(
    "evaluate_leave_one_out",
    _TRIALS + " SELECT count(*) AS trials, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE accepted AND voice <> truth) AS incorrect, count(*) FILTER (WHERE NOT accepted) AS abstentions FROM tr",
)
def evaluate_leave_one_out(spark, d):
    every = kept(spark, d)
    rows = every.where("verified")
    # of the true voice something must be left without the observation's recording
    left = rows.groupBy("voice").agg(F.count_distinct("session").alias("n")).where("n > 1").select("voice")
    queries = rows.join(left, "voice", "left_semi").select(F.col("ord").alias("query"), F.col("unit").alias("vector"), "session", F.col("voice").alias("truth"))
    scores = V.consensus(queries, conditions(every), apart="session")
    voices = every.select("voice").distinct()
    full = V.against_all(queries.select("query"), voices).join(scores, ["query", "voice"], "left").withColumn("score", F.coalesce("score", F.lit(-1.0)))
    best = V.winners(full, descending=True).join(roles(spark, d), "voice").join(queries.select("query", "truth"), "query")
    accepted = (F.col("score") >= F.when(F.col("role") == "child", V.MATCH_CHILD).otherwise(V.MATCH)) & (F.col("margin") >= V.MARGIN)
    return best.withColumn("accepted", accepted).agg(
        F.count("*").alias("trials"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("accepted") & (F.col("voice") != F.col("truth"))).alias("incorrect"), F.count_if(~F.col("accepted")).alias("abstentions")
    )


# groups: the unverified windows of a voice in a recording, with a few of another voice among them
_GROUPS = (
    CONDITIONS_SQL
    + f""", gw AS (SELECT session * 100 + CASE WHEN ord % 12 = 0 THEN (voice + 1) % 10 ELSE voice END AS grp, ord, unit, clean_seconds, ord % 8 <> 4 AS retained, ord % 24 = 4 AS disputed FROM obs WHERE NOT verified), {_centre('gc', "(SELECT * FROM gw WHERE retained AND NOT disputed)", 'grp')},
gq AS (SELECT 1000000 + grp AS id, c AS unit FROM gc UNION ALL SELECT ord, unit FROM gw),
gs AS (SELECT q.id, c.voice, max(least(list_dot_product(q.unit, c.c), {_SECOND})) AS score FROM gq q, cond c GROUP BY 1, 2),
gr AS (SELECT *, score - coalesce(lead(score) OVER w, -1) AS margin, row_number() OVER w AS k FROM gs WINDOW w AS (PARTITION BY id ORDER BY score DESC, voice)), gb AS (SELECT * FROM gr WHERE k = 1),
best AS (SELECT gc.grp, voice, score, margin, CASE WHEN voice % 3 = 0 THEN 0.78 ELSE 0.70 END AS need FROM gc JOIN gb ON id = 1000000 + gc.grp),
vt AS (SELECT gw.grp, count(*) FILTER (WHERE retained AND NOT disputed) AS compared, count(*) FILTER (WHERE retained AND NOT disputed AND gb.voice = best.voice AND gb.score >= need AND gb.margin >= 0.15) AS votes, count(*) AS every_n,
  count(*) FILTER (WHERE gb.voice = best.voice AND gb.score >= need AND gb.margin >= 0.15) AS every_votes, count(*) FILTER (WHERE disputed) AS n_disputed, count(*) FILTER (WHERE NOT disputed) AS undisputed, count(*) FILTER (WHERE NOT disputed AND NOT retained) AS outliers,
  sum(CASE WHEN retained AND NOT disputed THEN round(clean_seconds * 1000)::BIGINT ELSE 0 END) AS clean_ms FROM gw JOIN best USING (grp) JOIN gb ON gb.id = gw.ord GROUP BY 1),
bl AS (SELECT grp, voice, score, margin, votes, compared, list_filter([CASE WHEN clean_ms < 2000 THEN 'insufficient_query_audio' END, CASE WHEN compared < 2 THEN 'insufficient_independent_windows' WHEN 10 * votes < 8 * compared THEN 'inconsistent_window_matches' END,
  CASE WHEN undisputed >= 3 AND outliers * 5 > undisputed THEN 'mixed_voice_evidence' END, CASE WHEN n_disputed > 0 AND 10 * every_votes < 8 * every_n THEN 'unresolved_disputed_voice_evidence' END,
  CASE WHEN score < need THEN 'insufficient_verified_reference_match' END, CASE WHEN margin < 0.15 THEN 'ambiguous_profile_match' END], lambda x: x IS NOT NULL) AS blockers FROM best JOIN vt USING (grp))"""
)


@query("identify_gates", _GROUPS + f" SELECT grp, voice, {_R4.format('score')} AS similarity, {_R4.format('margin')} AS margin, votes, compared, array_to_string(blockers, ',') AS blockers, CASE WHEN len(blockers) = 0 THEN 'matched' ELSE 'unresolved' END AS status FROM bl")
def identify_gates(spark, d):
    from talkgrid.operators import identity as Y

    every = kept(spark, d)
    o = every.where("not verified")
    grp = F.col("session") * 100 + F.when(F.col("ord") % 12 == 0, (F.col("voice") + 1) % 10).otherwise(F.col("voice"))
    rows = o.select(grp.alias("grp"), "ord", "unit", "clean_seconds", (F.col("ord") % 8 != 4).alias("retained"), (F.col("ord") % 24 == 4).alias("disputed"))
    out = Y.gates(rows, conditions(every), roles(spark, d))
    return out.select("grp", "voice", V.rounded(F.col("score")).alias("similarity"), V.rounded(F.col("margin")).alias("margin"), "votes", "compared", F.array_join("blockers", ",").alias("blockers"), F.when(F.size("blockers") == 0, "matched").otherwise("unresolved").alias("status"))


@query(
    "evidence_summary",
    """WITH w AS (SELECT user_id, event_id % 6 <> 1 AS retained, event_id % 4 = 0 AS disputed FROM events)
SELECT user_id, count(*) FILTER (WHERE NOT disputed AND NOT retained) AS outliers, count(*) FILTER (WHERE disputed) AS disputed, count(*) FILTER (WHERE NOT disputed) >= 3 AND count(*) FILTER (WHERE NOT disputed AND NOT retained) * 5 > count(*) FILTER (WHERE NOT disputed) AS mixed FROM w GROUP BY 1""",
)
def evidence_summary(spark, d):
    from talkgrid.operators import identity as Y

    e = F.col("event_id")
    return Y.summary(A.table(spark, d, "events").select("user_id", (e % 6 != 1).alias("retained"), (e % 4 == 0).alias("disputed")), ["user_id"]).select("user_id", "outliers", F.col("n_disputed").alias("disputed"), "mixed")


@query("local_groups")
def local_groups(spark, d):
    from talkgrid.operators import identity as Y

    # a recording for every session, with clusters of the windows of a voice cut in three
    rows = observations(spark, d).withColumn("local", F.concat(F.lit("S"), F.col("voice").cast("string"), F.lit("_"), (F.col("ord") % 7 % 3).cast("string")))
    evidence = V.centroids(rows, ["session", "local"]).join(rows.groupBy("session", "local").agg(F.sum("clean_seconds").alias("clean_seconds"), F.count("*").alias("window_count")), ["session", "local"])
    evidence = evidence.select(F.col("session").alias("recording_id"), "local", F.col("centroid").alias("vector"), (F.col("window_count") >= 2).alias("usable"))
    apart = spark.createDataFrame([(0, "S1_0", "S1_1"), (1, "S2_0", "S2_2")], "recording_id long, a string, b string")
    return Y.local_groups(evidence, apart)


@query("voice_clusters")
def voice_clusters(spark, d):
    from talkgrid.operators import identity as Y

    rows = observations(spark, d).where("ord < 300").select(F.expr("ord div 60").alias("recording_id"), "ord", F.col("unit").alias("vector"))
    return Y.clusters(rows)
