"""Who a recording's local speakers are: gates of a match, groups of clusters, clustering, and label mapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.operators import vectors as V
from talkgrid.operators.rules import listed
from talkgrid.session import durable

MERGE = 0.72


def summary(windows: DataFrame, keys: list[str]) -> DataFrame:
    """outliers, n_disputed and mixed of each key's windows(retained, disputed): mixed if of three or more undisputed ones over a fifth are outliers."""
    free = ~F.col("disputed")
    per = windows.groupBy(*keys).agg(F.count_if(free).alias("n_free"), F.count_if(free & ~F.col("retained")).alias("outliers"), F.count_if("disputed").alias("n_disputed"))
    return per.withColumn("mixed", (F.col("n_free") >= 3) & (5 * F.col("outliers") > F.col("n_free")))


def gates(windows: DataFrame, conditions: DataFrame, profiles: DataFrame) -> DataFrame:
    """grp, voice, score, margin, votes, compared and blockers (in order) of groups with windows(grp, ord, unit, clean_seconds, retained, disputed).

    The group's centroid proposes the voice; its windows vote for it by the same
    rule. profiles(voice, role).
    """
    good = windows.where("retained and not disputed")
    part = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast(windows.schema[c].dataType)
    ask = lambda df, vector: df.select(F.struct(part(df, "grp").alias("grp"), part(df, "ord").alias("ord")).alias("query"), F.col(vector).alias("vector"))
    # groups and windows meet the conditions in one comparison
    asked = ask(V.centroids(good, ["grp"]), "centroid").unionByName(ask(windows.drop("grp"), "unit"))
    found = durable(V.winners(V.consensus(asked, conditions))).select("query.*", "voice", "score", "margin")
    of_group = found.where("ord is null").join(profiles, "voice", "left")
    best = of_group.select("grp", "voice", "score", "margin", F.when(F.col("role") == "child", V.MATCH_CHILD).otherwise(V.MATCH).alias("need"))
    each = found.where("ord is not null").select("ord", F.col("voice").alias("w_voice"), F.col("score").alias("w_score"), F.col("margin").alias("w_margin"))
    rows = windows.join(best, "grp").join(each, "ord")
    vote = (F.col("w_voice") == F.col("voice")) & (F.col("w_score") >= F.col("need")) & (F.col("w_margin") >= V.MARGIN)
    counts = F.col("retained") & ~F.col("disputed")
    votes = rows.groupBy("grp").agg(
        F.count_if(counts).alias("compared"), F.count_if(counts & vote).alias("votes"), F.count("*").alias("every_n"), F.count_if(vote).alias("every_votes"),
        F.sum(F.when(counts, F.round(F.col("clean_seconds") * 1000).cast("long")).otherwise(0)).alias("clean_ms"),
    )
    out = best.join(votes, "grp").join(summary(windows, ["grp"]), "grp")
    blockers = listed(
        (F.col("clean_ms") < 2000, "insufficient_query_audio"),
        (F.col("compared") < 2, "insufficient_independent_windows"),
        ((F.col("compared") >= 2) & (10 * F.col("votes") < 8 * F.col("compared")), "inconsistent_window_matches"),
        (F.col("mixed"), "mixed_voice_evidence"),
        ((F.col("n_disputed") > 0) & (10 * F.col("every_votes") < 8 * F.col("every_n")), "unresolved_disputed_voice_evidence"),
        (F.col("score") < F.col("need"), "insufficient_verified_reference_match"),
        (F.col("margin") < V.MARGIN, "ambiguous_profile_match"),
    )
    return out.select("grp", "voice", "score", "margin", "votes", "compared", blockers.alias("blockers"))


def assign(proposals: DataFrame, incompatible: DataFrame) -> DataFrame:
    """recording_id, grp, voice, accepted of proposals(recording_id, grp, voice, score, margin): the best first, unless a group that must not be the same has that voice already.

    incompatible(recording_id, a, b). A recording has few groups.
    """
    pairs = incompatible.groupBy("recording_id").agg(F.collect_set(F.concat_ws("\n", "a", "b")).alias("apart"))
    rows = proposals.join(pairs, "recording_id", "left").withColumn("apart", F.coalesce("apart", F.array().cast("array<string>")))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        apart = {tuple(x.split("\n")) for x in df["apart"].iloc[0]}
        done: list[tuple[str, object]] = []
        out = []
        for r in df.sort_values(["score", "grp", "voice", "margin"], ascending=False).itertuples():
            clash = any(v == r.voice and ((g, r.grp) in apart or (r.grp, g) in apart) for g, v in done)
            if not clash:
                done.append((r.grp, r.voice))
            out.append((r.recording_id, r.grp, r.voice, not clash))
        return pd.DataFrame(out, columns=["recording_id", "grp", "voice", "accepted"])

    return rows.groupBy("recording_id").applyInPandas(run, f"recording_id long, grp string, voice {proposals.schema['voice'].dataType.simpleString()}, accepted boolean")


def local_groups(evidence: DataFrame, incompatible: DataFrame, least_groups: int = 1) -> DataFrame:
    """recording_id, local and grp, the first label of the group: clusters(recording_id, local, vector, usable) that are one voice.

    Pairs are merged from the most alike on, if every pair between the two
    groups is alike enough and none must be kept apart, while more than
    least_groups are left. A recording has few local speakers.
    """
    pairs = incompatible.groupBy("recording_id").agg(F.collect_set(F.concat_ws("\n", "a", "b")).alias("apart"))
    rows = evidence.join(pairs, "recording_id", "left").withColumn("apart", F.coalesce("apart", F.array().cast("array<string>")))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("local")
        apart = {frozenset(x.split("\n")) for x in df["apart"].iloc[0]}
        vectors = {r.local: np.asarray(r.vector) for r in df.itertuples() if r.usable}
        names = list(vectors)
        alike = {frozenset((a, b)): float(vectors[a] @ vectors[b]) for i, a in enumerate(names) for b in names[i + 1 :] if frozenset((a, b)) not in apart}
        group = {x: frozenset([x]) for x in df["local"]}
        for score, a, b in sorted(((s, *sorted(p)) for p, s in alike.items() if s >= MERGE), reverse=True):
            x, y = group[a], group[b]
            if len(set(group.values())) <= least_groups:
                break
            if x != y and all(alike.get(frozenset((p, q)), -1.0) >= MERGE for p in x for q in y):
                for m in x | y:
                    group[m] = x | y
        return pd.DataFrame({"recording_id": df["recording_id"], "local": df["local"], "grp": [min(group[x]) for x in df["local"]]})

    return rows.groupBy("recording_id").applyInPandas(run, "recording_id long, local string, grp string")


def complete_link(vectors: np.ndarray, counts: set[int]) -> dict[int, list[int]]:
    """Labels for each wanted number of clusters, merged by the least greatest cosine distance; labels by first member."""
    n = len(vectors)
    far = 1.0 - vectors @ vectors.T
    np.fill_diagonal(far, np.inf)
    members = {i: [i] for i in range(n)}
    out: dict[int, list[int]] = {}
    while True:
        if len(members) in counts:
            labels = [0] * n
            for k, c in enumerate(sorted(members.values(), key=min)):
                for i in c:
                    labels[i] = k
            out[len(members)] = labels
        if len(members) <= max(1, min(counts, default=1)):
            return out
        live = sorted(members)
        part = far[np.ix_(live, live)]
        i, j = divmod(int(np.argmin(part)), len(live))
        a, b = sorted((live[i], live[j]))
        members[a] += members.pop(b)
        far[a] = far[:, a] = np.maximum(far[a], far[b])
        far[a, a] = np.inf


def silhouette(vectors: np.ndarray, labels: list[int]) -> float:
    far = 1.0 - vectors @ vectors.T
    np.fill_diagonal(far, 0.0)
    own = np.asarray(labels)
    total = np.stack([far[:, own == k].sum(axis=1) for k in range(own.max() + 1)], axis=1)
    size = np.bincount(own)
    scores = []
    for i, k in enumerate(own):
        if size[k] == 1:
            scores.append(0.0)
            continue
        a = total[i, k] / (size[k] - 1)
        b = min(total[i, j] / size[j] for j in range(len(size)) if j != k)
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores))


def cluster_labels(vectors: np.ndarray, least: int = 1, most: int = 8) -> list[int]:
    """Cluster of each vector: the number asked for, or the one with the best silhouette less what single members and more clusters cost; one cluster if none parts well."""
    n = len(vectors)
    least, most = max(1, min(least, n)), max(1, min(most, n))
    if least == most:
        return [0] * n if least == 1 else complete_link(vectors, {least})[least]
    if least >= n:
        return list(range(n))
    if n < 3:
        return [0] * n
    best, chosen = -np.inf, [0] * n
    for k, labels in sorted(complete_link(vectors, set(range(max(2, least), min(most, n - 1) + 1))).items()):
        single = int((np.bincount(labels) < 2).sum())
        score = silhouette(vectors, labels) - 0.07 * single - 0.004 * max(0, k - 2)
        if score > best:
            best, chosen = score, labels
    return [0] * n if least == 1 and best < 0.25 else chosen


def clusters(rows: DataFrame, least: int = 1, most: int = 8) -> DataFrame:
    """recording_id, ord, cluster of rows(recording_id, ord, vector). A recording's vectors fit in one task, as its chunks do."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("ord")
        matrix = np.stack(df["vector"].to_numpy()).astype(np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-8)
        return pd.DataFrame({"recording_id": df["recording_id"], "ord": df["ord"], "cluster": cluster_labels(matrix, least, most)})

    return rows.groupBy("recording_id").applyInPandas(run, "recording_id long, ord long, cluster long")


def best_assignment(matrix: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of rows and columns with the largest sum (shortest augmenting paths)."""
    flipped = matrix.shape[0] > matrix.shape[1]
    cost = -(matrix.T if flipped else matrix)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = slack < low[free]
            low[free[better]], way[free[better]] = slack[better], j0
            j1 = free[np.argmin(low[free])]
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flipped else (a, b) for a, b in pairs)


def map_labels(overlaps: DataFrame, totals: DataFrame) -> DataFrame:
    """recording_id, secondary, proposed, speaker (null unless confident), overlap and margin in milliseconds.

    overlaps(recording_id, secondary, speaker, overlap) and totals(recording_id,
    secondary, total). Labels are matched one to one with the largest overlap;
    a match is sure from 500 ms, 60 % of the label and a lead of 15 % on.
    """
    rows = overlaps.join(totals, ["recording_id", "secondary"])

    def run(df: pd.DataFrame) -> pd.DataFrame:
        a, b = sorted(df["secondary"].unique()), sorted(df["speaker"].unique())
        matrix = np.zeros((len(a), len(b)))
        for r in df.itertuples():
            matrix[a.index(r.secondary), b.index(r.speaker)] += r.overlap
        total = dict(zip(df["secondary"], df["total"], strict=True))
        out = []
        for i, j in best_assignment(matrix):
            x = matrix[i, j]
            if x <= 0:
                continue
            lead = x - max((matrix[i, k] for k in range(len(b)) if k != j), default=0.0)
            sure = x >= 500 and 100 * x >= 60 * total[a[i]] and 100 * lead >= 15 * total[a[i]]
            out.append((df["recording_id"].iloc[0], a[i], b[j], b[j] if sure else None, int(x), int(lead)))
        return pd.DataFrame(out, columns=["recording_id", "secondary", "proposed", "speaker", "overlap", "margin"])

    return rows.groupBy("recording_id").applyInPandas(run, "recording_id long, secondary string, proposed string, speaker string, overlap long, margin long")


def matching_blocks(left: list[str], right: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places of the longest common runs, then of those left and right of them."""
    import difflib

    for block in difflib.SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks():
        for k in range(block.size):
            yield block.a + k, block.b + k


def pair_words(words: DataFrame, recognized: DataFrame) -> DataFrame:
    """recording_id, ord, other_ord: words(recording_id, ord, token) paired with recognized ones by runs of equal tokens."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("ord"), right.sort_values("ord")
        pairs = list(matching_blocks(left["token"].tolist(), right["token"].tolist()))
        key = left["recording_id"].iloc[0] if len(left) else 0
        return pd.DataFrame({"recording_id": [key] * len(pairs), "ord": [left["ord"].iloc[i] for i, _ in pairs], "other_ord": [right["ord"].iloc[j] for _, j in pairs]}).astype("int64")

    # columns of their own, as both sides may come from one table
    names = ["recording_id", "ord", "token"]
    left, right = (df.select(*[F.col(c).alias(c) for c in names]) for df in (words, recognized))
    return left.groupBy("recording_id").cogroup(right.groupBy("recording_id")).applyInPandas(run, "recording_id long, ord long, other_ord long")
