"""Vector similarity: normalisation, cosine, centroids, reference conditions, consensus, candidates and medoids.

Vectors are array<double>; those of observations are stored normalised, to
seven places. Scores are compared after rounding to four places where a rule
says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A best candidate is suggested from so high a similarity on (a child's higher), if it leads the next by LEAD.
SUGGEST, SUGGEST_CHILD, LEAD = 0.80, 0.85, 0.20
#: A match needs so high a similarity (a child's higher) and so much margin.
MATCH, MATCH_CHILD, MARGIN = 0.70, 0.78, 0.15
#: Seconds of a long clip and of a usable one; short ones count in so many, of so many seconds, so alike.
LONG, USABLE, SHORT_CLIPS, SHORT_SECONDS, SHORT_ALIKE = 2.5, 0.8, 5, 8.0, 0.70
#: References up to so many rows are sent to all tasks; more are met in blocks.
BROADCAST_ROWS, BLOCKS = 2000, 16
#: Queries and members that meet in a cell, about, and members of a condition in a block, at most.
CELL_QUERIES, CELL_MEMBERS, BLOCK_MEMBERS = 8192, 32768, 16384


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _bind(value: Column, use) -> Column:
    """use(value) with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize(v: Column | str) -> Column:
    """v over its length, each part to seven places; an empty or zero vector is an error."""
    v = F.col(v) if isinstance(v, str) else v
    unit = lambda n: F.transform(v, lambda x: F.floor(x / n * 1e7 + 0.5) / 1e7)
    return F.when(v.isNotNull(), _bind(F.sqrt(dot(v, v)), lambda n: F.when(n > 0, unit(n)).otherwise(F.raise_error(F.lit("a vector must not be empty or zero")).cast("array<double>"))))


def similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of normalised vectors; different lengths are an error."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Plain cosine, 0 where a vector has no length."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def rounded(x: Column, places: int = 4) -> Column:
    scale = 10.0**places
    return F.floor(x * scale + 0.5) / scale


def centroids(rows: DataFrame, keys: list[str], vector: str = "unit", weight: str | None = None) -> DataFrame:
    """Normalised mean of the vectors of each key, and how many there are.

    With weight they count by it, negative weights as 0; where none is positive
    they count alike.
    """
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    parts = rows.select(*keys, w.alias("__w"), F.posexplode(vector).alias("__pos", "__x")).groupBy(*keys, "__pos")
    parts = parts.agg(F.sum(F.col("__x") * F.col("__w")).alias("sum"), F.sum("__w").alias("w"), F.avg("__x").alias("plain"), F.count("*").alias("n"))
    mean = F.when(F.col("w") > 0, F.col("sum") / F.col("w")).otherwise(F.col("plain")) if weight else F.col("plain")
    lists = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", mean.alias("__m")))), lambda p: p["__m"]).alias("mean"), F.max("n").alias("n_vectors"))
    return lists.select(*keys, "n_vectors", normalize("mean").alias("centroid"))


def reference_conditions(observations: DataFrame) -> DataFrame:
    """voice, session, kind, members and centroid: what of a voice's verified observations(voice, session, ord, clean_seconds, verified, unit) supports it in a session.

    Two long clips are a condition; so are enough short ones that are alike, as
    the two centroids of every other one.
    """
    good = observations.where(f"verified and clean_seconds >= {USABLE}")
    key = ["voice", "session"]
    long = good.where(f"clean_seconds >= {LONG}")
    members = long.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "unit"))), lambda x: x["unit"]).alias("members"), F.count("*").alias("n")).where("n >= 2")
    of_long = members.join(centroids(long, key), key).select(*key, F.lit("long").alias("kind"), "members", "centroid")
    short = good.where(f"clean_seconds < {LONG}").withColumn("pool", (F.row_number().over(Window.partitionBy(*key).orderBy("ord")) - 1) % 2)
    whole = centroids(short, key)
    alike = short.join(whole, key).groupBy(*key).agg(F.count("*").alias("n"), F.sum("clean_seconds").alias("seconds"), F.min(similarity("unit", "centroid")).alias("least"))
    # a sum of tenths may fall short of its bound by the last bit
    enough = alike.where((F.col("n") >= SHORT_CLIPS) & (F.col("seconds") >= SHORT_SECONDS - 1e-9) & (F.col("least") >= SHORT_ALIKE)).select(*key)
    pools = centroids(short.join(enough, key, "left_semi"), [*key, "pool"]).select(*key, "pool", F.col("centroid").alias("unit"))
    both = pools.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pool", "unit"))), lambda x: x["unit"]).alias("members"))
    of_short = both.join(centroids(pools, key), key).select(*key, F.lit("short").alias("kind"), "members", "centroid")
    return of_long.unionByName(of_short)


def against_all(queries: DataFrame, references: DataFrame) -> DataFrame:
    """Each query row with each reference row.

    References of a checked size are sent to all tasks; otherwise both sides are
    dealt by a block of the references.
    """
    if references.count() <= BROADCAST_ROWS:
        return queries.crossJoin(F.broadcast(references))
    block = F.pmod(F.xxhash64(*references.columns), F.lit(BLOCKS))
    return queries.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long")))).join(references.withColumn("__block", block), "__block").drop("__block")


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors as rows; different lengths are an error."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(vectors) and len(pc.unique(pc.list_value_length(vectors))) > 1:
        raise ValueError("vectors differ in length")
    return values.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def _bytes(vectors: pa.ListArray) -> pa.BinaryArray:
    """Each vector as the bytes of its doubles, which are dealt out and read much faster than lists."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.concatenate([[0], 8 * np.cumsum(pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False))])
    return pa.Array.from_buffers(pa.binary(), len(vectors), [vectors.is_valid().buffers()[1], pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.set_column(b.schema.get_field_index("vector"), "vector", _bytes(b["vector"]))


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members without unset ones, those near the centroid first, as they reach its similarity soonest."""
    for b in batches:
        packed = []
        for i in range(b.num_rows):
            centre = _matrix(b["centroid"].slice(i, 1))[0]
            members = _matrix(pc.drop_null(b["members"][i].values))
            if len(members) and members.shape[1] != len(centre):
                raise ValueError("vectors differ in length")
            members = members[~np.isnan(members).any(axis=1)]
            packed.append((members[np.argsort(-(members @ centre), kind="stable")] if len(members) else members).tobytes())
        b = b.set_column(b.schema.get_field_index("centroid"), "centroid", _bytes(b["centroid"]))
        yield b.set_column(b.schema.get_field_index("members"), "members", pa.array(packed, pa.binary()))


def _two_best(vectors: np.ndarray, members: np.ndarray, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two highest similarities of each vector to members; a vector is done once both reach enough."""
    first, second = np.full(len(vectors), -np.inf), np.full(len(vectors), -np.inf)
    live, at, step = np.arange(len(vectors)), 0, 64
    while at < len(members) and len(live):
        found = vectors[live] @ members[at : at + step].T
        each, top = np.arange(len(live)), found.argmax(axis=1)
        a = found[each, top]
        found[each, top] = -np.inf
        b = found.max(axis=1)
        x, y = first[live], second[live]
        first[live], second[live] = np.maximum(x, a), np.maximum(np.minimum(x, a), np.maximum(y, b))
        live = live[second[live] < enough[live]]
        at, step = at + step, min(2 * step, 512)
    return first, second


def _cell(queries: pa.Table, blocks: pa.Table) -> pa.Table:
    """query, voice, cond, cap, s1, s2 of queries(query, vector, own, q, p) with blocks(voice, cond, own, whole, centroid, members, q, p), vectors as bytes.

    cap is the similarity to a condition's centroid, s1 and s2 are the highest
    ones to members, as far as they matter under cap. Conditions that are here
    as a whole are one row a voice, in which all three are the score.
    """
    names, voice = ["query", "voice", "cond", "cap", "s1", "s2"], blocks["voice"].combine_chunks()
    vectors = queries["vector"].combine_chunks()
    ok = np.array(vectors.is_valid())
    if len(pc.unique(pc.binary_length(vectors.drop_null()))) > 1:
        raise ValueError("vectors differ in length")
    matrix = np.frombuffer(b"".join(vectors.drop_null().to_pylist())).reshape(ok.sum(), -1) if ok.any() else np.zeros((0, 0))
    ok[ok] = ~np.isnan(matrix).any(axis=1)
    full = np.zeros((len(ok), matrix.shape[1]))
    full[np.asarray(vectors.is_valid())] = matrix
    places = np.ascontiguousarray(full.T)
    own, others = queries["own"].combine_chunks(), blocks["own"].to_pylist()
    at: dict = {}
    for i, (v, cond) in enumerate(zip(voice.to_pylist(), blocks["cond"].to_pylist(), strict=True)):
        at.setdefault(v, {}).setdefault(cond, []).append(i)
    out = []

    def put(rows: np.ndarray, i: int, cond: int, *scores: np.ndarray) -> None:
        columns = [pa.array(x, from_pandas=True) for x in scores]
        out.append(pa.table([queries["query"].combine_chunks().take(pa.array(rows)), voice.take(pa.array(np.full(len(rows), i))), pa.array(np.full(len(rows), cond)), *columns], names=names))

    for mine in at.values():
        best, seen = np.full(len(ok), -np.inf), np.zeros(len(ok), dtype=bool)
        for cond, parts in mine.items():
            i = parts[0]
            meets = np.asarray(pc.not_equal(own, pa.scalar(others[i], own.type)).fill_null(False))
            centre = np.frombuffer(blocks["centroid"][i].as_py())
            members = np.frombuffer(b"".join(blocks["members"][k].as_py() for k in parts)).reshape(-1, max(1, len(centre)))
            if ok.any() and len(centre) != full.shape[1]:
                raise ValueError("vectors differ in length")
            seen |= meets
            rows = np.flatnonzero(meets & ok)
            cap = np.zeros(len(rows))
            for x, c in zip(places, centre, strict=False):  # summed as elsewhere, one place after another
                cap = cap + x[rows] * c
            whole = blocks["whole"][i].as_py()
            if whole:
                rows, cap = rows[cap > best[rows]], cap[cap > best[rows]]
            s1, s2 = _two_best(full[rows], members, cap)
            if whole:
                best[rows] = np.maximum(best[rows], np.where(s2 == -np.inf, cap, np.minimum(cap, s2)))
            elif len(rows):
                put(rows, i, cond, cap, s1, s2)
        # none to say of queries without a vector
        rows = np.flatnonzero(seen & ((best > -np.inf) | ~ok))
        if len(rows):
            score = np.where(ok[rows], best[rows], np.nan)
            put(rows, i, -1, score, score, score)
    return pa.concat_tables(out) if out else pa.table([queries["query"].combine_chunks()[:0], voice[:0], pa.array([], pa.int64()), *[pa.array([], pa.float64())] * 3], names=names)


def consensus(queries: DataFrame, conditions: DataFrame, apart: str | None = None) -> DataFrame:
    """query, voice and score: the best over a voice's conditions of the lesser of the similarity to the centroid and that to the second nearest member.

    queries(query, vector, ...). With apart, a column of both, conditions of the
    query's own value do not count. Queries and blocks of members meet in cells
    of a bounded size. As the centroid bounds a score, a condition is done for a
    query once two members reach it; otherwise all members are compared.
    """
    every = F.size("members")
    other = lambda default: F.col(apart).cast("string") if apart else F.lit(default)
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    refs = conditions.select("voice", F.xxhash64(*conditions.columns).bitwiseAND((1 << 63) - 1).alias("cond"), other("reference").alias("own"), "centroid", "members")
    sizes = conditions.agg(F.sum(every).alias("n"), F.max(every).alias("most")).first()
    q, p = -(-queries.count() // CELL_QUERIES) or 1, -(-(sizes["n"] or 0) // CELL_MEMBERS) or 1
    deal = lambda to: F.explode(F.sequence(F.lit(0), F.lit(to - 1)))
    blocks = refs.where(every > 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((every - 1) / BLOCK_MEMBERS).cast("int"))))
    blocks = blocks.select("voice", "cond", "own", (every <= BLOCK_MEMBERS).alias("whole"), "centroid", F.slice("members", F.col("block") * BLOCK_MEMBERS + 1, F.lit(BLOCK_MEMBERS)).alias("members"), F.pmod(F.xxhash64("cond", "block"), F.lit(p)).cast("int").alias("p"))
    blocks = blocks.mapInArrow(_pack_blocks, f"voice {kind(conditions, 'voice')}, cond long, own string, whole boolean, centroid binary, members binary, p int").withColumn("q", deal(q))
    rows = queries.select("query", "vector", other("query").alias("own")).mapInArrow(_pack_queries, f"query {kind(queries, 'query')}, vector binary, own string")
    rows = rows.withColumn("q", F.pmod(F.xxhash64("query"), F.lit(q)).cast("int")).withColumn("p", deal(p))
    met = rows.groupBy("q", "p").cogroup(blocks.groupBy("q", "p")).applyInArrow(_cell, f"query {kind(queries, 'query')}, voice {kind(conditions, 'voice')}, cond long, cap double, s1 double, s2 double")
    if (sizes["most"] or 0) <= BLOCK_MEMBERS:  # all conditions are whole
        return met.groupBy("query", "voice").agg(F.max("cap").alias("score"))
    second = F.get(F.sort_array(F.flatten(F.collect_list(F.array("s1", "s2"))), asc=False), F.lit(1))
    of_each = met.groupBy("query", "voice", "cond").agg(F.max("cap").alias("cap"), second.alias("second"))
    return of_each.groupBy("query", "voice").agg(F.max(F.least("cap", "second")).alias("score"))


def suggestions(scores: DataFrame, profiles: DataFrame, k: int = 3) -> DataFrame:
    """query, rank, voice, similarity and suggested of the k best scores that are not negative, equal ones by voice. profiles(voice, role)."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "voice")
    best = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where("score >= 0")
    best = best.withColumn("similarity", rounded(F.col("score"))).withColumn("next", F.lead("similarity").over(Window.partitionBy("query").orderBy("rank"))).join(profiles, "voice", "left")
    enough = F.col("similarity") >= F.when(F.col("role") == "child", SUGGEST_CHILD).otherwise(SUGGEST)
    lead = F.col("similarity") - F.coalesce("next", F.lit(-1.0)) >= LEAD
    return best.select("query", F.col("rank").cast("long").alias("rank"), "voice", "similarity", ((F.col("rank") == 1) & enough & lead).alias("suggested"))


def winners(scores: DataFrame, descending: bool = False) -> DataFrame:
    """query, voice, score and margin over the next (over -1 without one) of the best score; of equal ones the first voice, or the last if descending."""
    order = [F.desc("score"), F.desc("voice") if descending else F.col("voice")]
    w = Window.partitionBy("query").orderBy(*order)
    top = scores.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    rows = top.withColumn("next", F.lead("score").over(Window.partitionBy("query").orderBy("rank"))).where("rank = 1")
    return rows.select("query", "voice", "score", (F.col("score") - F.coalesce("next", F.lit(-1.0))).alias("margin"))


def medoid_evidence(windows: DataFrame, keys: list[str], keep: float = 0.45) -> DataFrame:
    """windows(keys, ord, unit, disputed) with agreement, their similarity to the key's medoid, and retained.

    The medoid is the undisputed window (any, if all are disputed) with the
    highest median similarity to those like it, the first of equal ones. A key
    has a bounded number of windows.
    """
    cols = ["ord", "unit", "disputed"]
    all_disputed = F.min(F.col("disputed").cast("int")).over(Window.partitionBy(*keys)) == 1
    rows = windows.select(*keys, *cols, (~F.col("disputed") | all_disputed).alias("counts"))
    other = rows.select(*keys, *[F.col(c).alias(f"o_{c}") for c in (*cols, "counts")])
    medians = rows.where("counts").join(other.where("o_counts"), keys).groupBy(*keys, "ord").agg(F.percentile(rounded(dot("unit", "o_unit"), 6), 0.5).alias("m"))
    chosen = medians.groupBy(*keys).agg(F.min(F.struct((-F.col("m")).alias("less"), "ord"))["ord"].alias("medoid"))
    centre = rows.join(chosen, keys).where("ord = medoid").select(*keys, F.col("unit").alias("centre"), "medoid")
    out = rows.join(centre, keys).withColumn("agreement", rounded(dot("unit", "centre"), 6))
    return out.select(*keys, "ord", "unit", "disputed", "medoid", "agreement", ((F.col("agreement") >= keep) & ~F.col("disputed")).alias("retained"))


def trimmed_centroids(rows: DataFrame, keys: list[str], share: float = 0.2) -> DataFrame:
    """Centroid, number and median similarity of each key; of four or more vectors those below the share's quantile are left out, unless fewer than two stay."""
    first = centroids(rows, keys)
    near = rows.join(first.withColumnRenamed("centroid", "c0"), keys).withColumn("sim", rounded(dot("unit", "c0"), 6))
    cut = near.groupBy(*keys).agg(F.percentile("sim", share).alias("cut"))
    kept = near.join(cut, keys).withColumn("keep", (F.col("n_vectors") < 4) | (F.col("sim") >= F.col("cut")))
    kept = kept.withColumn("keep", F.col("keep") | (F.count_if("keep").over(Window.partitionBy(*keys)) < 2)).where("keep")
    again = centroids(kept.drop("n_vectors"), keys)
    sims = kept.drop("n_vectors").join(again, keys).groupBy(*keys).agg(F.percentile(rounded(dot("unit", "centroid"), 6), 0.5).alias("cohesion"))
    return again.join(sims, keys)


def nearest_centroid(rows: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """rows(key, ord, unit, ...) with cluster, that of the anchors(key, cluster, unit) whose centroid is nearest, the first of equal ones."""
    centres = centroids(anchors, [key, "cluster"]).select(key, "cluster", "centroid")
    met = rows.select(key, "ord", "unit").join(centres, key)
    best = met.groupBy(key, "ord").agg(F.min(F.struct((-rounded(dot("unit", "centroid"), 9)).alias("less"), "cluster"))["cluster"].alias("cluster"))
    return rows.select(key, "ord").join(best, [key, "ord"])


def eligible(purpose: str, seconds: str = "clean_seconds", windows: str = "window_count", cohesion: str = "cohesion") -> Column:
    """Whether evidence is enough to enroll, update, match or merge a voice; spoken words count where their timing is known."""
    least = {"enroll": (12.0, 3, 3, 1.0), "update": (4.0, 2, 2, 0.5), "match": (2.0, 1, 1, 0.2), "merge": (2.0, 2, None, None)}[purpose]
    enough = (F.col(seconds) >= least[0]) & (F.col(windows) >= least[1]) & (F.col(cohesion) >= 0.40)
    if least[2] is None:
        return F.coalesce(enough, F.lit(False))
    spoken = (F.coalesce("recognized_words", F.lit(0)) >= least[2]) & (F.coalesce("recognized_seconds", F.lit(0.0)) >= least[3])
    return F.coalesce(enough & (~F.coalesce("word_timing", F.lit(False)) | spoken), F.lit(False))
