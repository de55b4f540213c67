"""The operators on rows whose results are known."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrid.functions import text as T
from talkgrid.operators import attribution as W
from talkgrid.operators import identity as Y
from talkgrid.operators import intervals as I
from talkgrid.operators import rules as R
from talkgrid.operators import sessions as S
from talkgrid.operators import state as M
from talkgrid.operators import vectors as V

PIECE = "recording_id string, ord int, s long, e long, speaker string, identity string, text string"


def test_timestamps(spark):
    got = spark.createDataFrame([(3661.2346,), (None,), (-1.0,), (float("nan"),)], "s double").select(T.timestamp_text(F.col("s")).alias("t"))
    assert [r.t for r in got.collect()] == ["01:01:01.235", "00:00:00.000", "00:00:00.000", "00:00:00.000"]


def test_turns_merge_and_cap(spark):
    rows = [
        ("r", 1, 0, 1000, "A", None, " Hello "), ("r", 2, 1100, 2000, "A", None, "there"), ("r", 3, 3500, 4000, "A", None, "gap"), ("r", 4, 4100, 5000, "B", None, "x"),
        ("r", 5, 5100, 5200, "B", "unresolved", "other identity"), ("r", 6, 5250, 5300, "B", "unresolved", "  "), ("r", 7, 5300, 5200, "B", "unresolved", "end before start"),
    ]
    turns = S.build_turns(spark.createDataFrame(rows, PIECE)).orderBy("turn_ord").collect()
    assert [(r.text, r.n_segments, r.pause_before) for r in turns] == [("Hello there", 2, 0), ("gap", 1, 1500), ("x", 1, 100), ("other identity end before start", 2, 100)]
    assert turns[3].e == 5300 and turns[3].turn_id == "turn-000003"
    long = [("r", i, 1000 * i, 1000 * i + 900, "A", None, "w") for i in range(70)]
    assert [r.n_segments for r in S.build_turns(spark.createDataFrame(long, PIECE)).orderBy("turn_ord").collect()] == [30, 30, 10]


def test_paragraphs_keep_unknown_turns_apart(spark):
    turns = [("r", i, 1000 * i, 1000 * i + 500, who, pause, text) for i, (who, pause, text) in enumerate([("A", 0, "one"), ("A", 0, "two"), ("A", 2500, "three"), (S.UNKNOWN, 0, "x"), (S.UNKNOWN, 0, "y"), ("A", 0, "w " * 249), ("A", 0, "one more"), ("A", 0, " ")])]
    df = spark.createDataFrame(turns, "recording_id string, turn_ord int, s long, e long, speaker string, pause_before long, text string")
    got = S.build_paragraphs(df).orderBy("paragraph").collect()
    assert [(r.first_turn, r.last_turn, r.words) for r in got] == [(0, 1, 2), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 249), (6, 6, 2)]


def test_segments_split_by_speaker(spark):
    segs = spark.createDataFrame([("r", 1, 0, 2000, "S0", None, None, None, "How are you? Fine.")], "recording_id string, seg_ord int, s long, e long, speaker string, local_speaker string, identity string, confidence long, text string")
    words = [("r", 1, 0, "How", 0, 400, "S0"), ("r", 1, 1, "are you?", 400, 1000, "S0"), ("r", 1, 2, "Fine.", 1200, 1800, "S1")]
    words = spark.createDataFrame(words, "recording_id string, seg_ord int, word_ord int, text string, s long, e long, speaker string")
    words = words.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("local_speaker", "string"), ("score", "long"), ("secondary", "string"), ("ambiguous", "boolean"), ("identity", "string"))])
    got = S.split_segments(S.normalize_words(words, segs), segs).orderBy("ord").collect()
    assert [(r.text, r.speaker, r.s, r.e, r.segment_id) for r in got] == [("How are you?", "S0", 0, 1000, "segment-000000"), ("Fine.", "S1", 1200, 1800, "segment-000001")]


def test_bucketed_join_equals_plain_join(spark):
    rng = random.Random(3)
    rows = [(1, i, a := rng.uniform(0, 300), a + rng.uniform(0, 90)) for i in range(120)]
    t = spark.createDataFrame(rows, "recording_id int, ord int, start double, end double")
    got = {(r.ord, r.r_ord) for r in I.interval_join(t, t, "recording_id", 20.0).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if b[3] > a[2] and b[2] < a[3]}


def test_left_interval_join_keeps_rows_apart(spark):
    q = spark.createDataFrame([(1, 0, 10), (1, 0, 10), (1, None, 5), (1, 50, 60), (2, 0, 10)], "recording_id int, s long, e long")
    t = spark.createDataFrame([(1, 5, 6, "x"), (1, 60, 70, "y")], "recording_id int, s long, e long, label string")
    got = sorted(((r.recording_id, r.s, r.r_label) for r in I.ms_join(q, t, "left").collect()), key=str)
    assert got == sorted([(1, 0, "x"), (1, 0, "x"), (1, None, None), (1, 50, None), (2, 0, None)], key=str)


def test_interval_algebra(spark):
    spans = lambda *x: spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(x)], "recording_id int, ord int, s long, e long")
    pairs = lambda df: sorted((r.s, r.e) for r in df.collect())
    assert pairs(I.subtract(spans((0, 100)), spans((20, 30), (25, 40), (50, 50), (90, 200)), ["recording_id", "ord"])) == [(0, 20), (40, 50), (50, 90)]
    assert pairs(I.intersect(spans((0, 100), (300, 400)), spans((50, 90), (95, 350)))) == [(50, 100), (300, 350)]
    t = spark.createDataFrame([(1, 0, 0, 1000, "A"), (1, 1, 1020, 1040, "B"), (1, 2, 1100, 2000, "A")], "recording_id int, ord int, s long, e long, speaker string")
    assert pairs(I.coalesce_runs(t)) == [(0, 1000), (1020, 1040), (1100, 2000)]
    fix = spark.createDataFrame([(1, 400, 500, "A", "B")], "recording_id int, s long, e long, original string, refined string")
    assert sorted((r.s, r.e, r.speaker) for r in I.relabel(t, fix).collect()) == [(0, 400, "A"), (400, 500, "B"), (500, 1000, "A"), (1020, 1040, "B"), (1100, 2000, "A")]
    assert pairs(I.fixed_windows(spans((0, 15_000)), ["recording_id", "ord"]).select(F.col("w_s").alias("s"), F.col("w_e").alias("e"))) == [(100, 6100), (6100, 12_100), (12_100, 14_900)]


def test_relabel_counts_rows_without_length(spark):
    t = spark.createDataFrame([(1, 0, 0, 1000, "A"), (1, 1, 450, 450, "A"), (1, 2, 2000, 2000, "A")], "recording_id int, ord int, s long, e long, speaker string")
    fix = spark.createDataFrame([(1, 400, 500, "A", "B")], "recording_id int, s long, e long, original string, refined string")
    assert sorted((r.s, r.e, r.speaker, r.n_pieces) for r in I.relabel(t, fix).collect()) == [(0, 400, "A", 1), (400, 500, "B", 2), (500, 1000, "A", 1)]


def test_exclusive_pieces_count_once(spark):
    # two rows of one speaker that end apart, cut at one place by an empty row of another
    t = spark.createDataFrame([(1, 0, 0.0, 9.0, "A"), (1, 1, 0.0, 8.0, "A"), (1, 2, 4.0, 4.0, "B")], "recording_id int, ord int, start double, end double, speaker string")
    assert sorted((r.start, r.end, r.n_rows) for r in W.exclusive(t).collect()) == [(80, 3920, 1), (4080, 8920, 2)]


def test_overlap_union_equals_pairs(spark):
    rng = random.Random(11)
    rows = [(r, i, s := rng.randrange(0, 4000, 20), s + rng.choice([0, 20, 60, 200, 300]), rng.choice("ABC")) for r in (1, 2) for i in range(60)]
    got = sorted(map(tuple, I.overlap_union(spark.createDataFrame(rows, "recording_id int, ord int, s long, e long, speaker string"), 15).select("recording_id", "s", "e").collect()))
    want = []
    for r, s, e in sorted({(a[0], max(a[2], b[2]) - 15, min(a[3], b[3]) + 15) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[4] != b[4] and b[3] > a[2] and b[2] < a[3]}):
        if want and want[-1][0] == r and s <= want[-1][2]:
            want[-1] = (r, want[-1][1], max(want[-1][2], e))
        else:
            want.append((r, s, e))
    assert len(want) > 5 and got == want


def test_even_pick_equals_linspace(spark):
    for n in (65, 100, 127, 1000):
        rows = spark.range(n).where(I.even_pick(F.col("id"), F.lit(n), 64))
        assert [r.id for r in rows.collect()] == sorted({int(k * (n - 1) / 63) for k in range(64)})


def test_labels(spark):
    names = ["speaker_0", "a b!", "---", "x12345678901", "s007", ""]
    got = spark.createDataFrame([(x,) for x in names], "l string").select(T.speaker_label(F.col("l")).alias("x"))
    assert [r.x for r in got.collect()] == ["SPEAKER_00", "SORTFORMER_A_B", "SORTFORMER_UNKNOWN", "SPEAKER_12345678901", "SPEAKER_07", "SORTFORMER_UNKNOWN"]


def test_extensions_and_formats(spark):
    one = spark.range(1)
    assert one.select(T.extension_list(F.lit("MP3, .wav,,mp3")).alias("x")).first().x == [".mp3", ".wav"]
    assert one.select(T.review_formats(F.lit("srt, VTT")).alias("x")).first().x == ["json", "srt", "vtt"]
    for bad in (T.extension_list(F.lit(" , ")), T.review_formats(F.lit("pdf"))):
        with pytest.raises(Exception, match="needed|unknown"):
            one.select(bad.alias("x")).collect()


def test_vectors_refuse_nonsense(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0])], "a array<double>, b array<double>")
    for bad in (V.similarity("a", "b"), V.normalize(F.array(F.lit(0.0))), V.normalize(F.array().cast("array<double>"))):
        with pytest.raises(Exception, match="length|zero"):
            rows.select(bad.alias("x")).collect()
    assert rows.select(V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("x")).first().x == 0.0


def test_blocks_meet_all_references(spark, monkeypatch):
    q, r = spark.range(7).withColumnRenamed("id", "query"), spark.range(50).withColumnRenamed("id", "voice")
    monkeypatch.setattr(V, "BROADCAST_ROWS", 10)
    assert V.against_all(q, r).distinct().count() == 350


def test_consensus_in_cells_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    refs = [(f"v{i % 3}", i % 4, [unit(rng.normal(size=6) + i % 3) for _ in range(2 + 5 * i)], unit(rng.normal(size=6) + i % 3)) for i in range(8)]
    ask = [(i, unit(rng.normal(size=6)), i % 4) for i in range(60)] + [(60, None, 1)]
    conditions = spark.createDataFrame(refs, "voice string, session int, members array<array<double>>, centroid array<double>")
    queries = spark.createDataFrame(ask, "query int, vector array<double>, session int")
    for sizes in ((4096, 16384, 4096), (16, 20, 7)):
        for name, x in zip(("CELL_QUERIES", "CELL_MEMBERS", "BLOCK_MEMBERS"), sizes, strict=True):
            monkeypatch.setattr(V, name, x)
        for apart in (None, "session"):
            want = {}
            for q, vector, session in ask:
                for voice, other, members, centre in refs:
                    if not apart or session != other:
                        one = None if vector is None else min(float(np.dot(vector, centre)), sorted(float(np.dot(vector, m)) for m in members)[-2])
                        want[q, voice] = one if one is None else max(one, want.get((q, voice), -2.0))
            met = V.consensus(queries, conditions, apart)
            # in place of each query with each member, cells
            assert "CartesianProduct" not in (plan := met._jdf.queryExecution().toString()) and "NestedLoop" not in plan
            got = {(r.query, r.voice): r.score for r in met.collect()}
            assert got.keys() == want.keys() and all(got[k] == want[k] if want[k] is None else abs(got[k] - want[k]) < 1e-12 for k in want)


def test_consensus_deals_out_bytes(spark, monkeypatch):
    # lists dealt out to cells, and gathered again for conditions that no block had cut, took most of the time
    refs = [("a", 0, [[1.0, 0.0], None, [0.6, 0.8], [float("nan"), 1.0]], [0.8, 0.6]), ("b", 1, [[0.0, 1.0], [0.6, 0.8], [0.8, 0.6]], [0.0, 1.0])]
    conditions = spark.createDataFrame(refs, "voice string, session int, members array<array<double>>, centroid array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, None, 1), (4, [None, 1.0], 1)], "query int, vector array<double>, session int")
    for most in (16384, 2):
        monkeypatch.setattr(V, "BLOCK_MEMBERS", most)
        met = V.consensus(queries, conditions)
        plan = met._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 2 and ("collect_list" in plan) == (most == 2)
        got = {(r.query, r.voice): None if r.score is None else round(r.score, 9) for r in met.collect()}
        assert got == {(1, "a"): 0.6, (1, "b"): 0.0, (2, "a"): 0.0, (2, "b"): 0.8} | {(q, v): None for q in (3, 4) for v in "ab"}
    for bad in ([1.0], [1.0, 0.0, 0.0]):
        with pytest.raises(Exception, match="vectors differ in length"):
            V.consensus(spark.createDataFrame([(1, bad, 0)], queries.schema), conditions).collect()


@pytest.mark.parametrize("name", ["nearest_profiles", "identify_gates"])
def test_observations_are_normalised_once(spark, monkeypatch, name):
    # each branch of the conditions, and the queries, read and normalised the table anew
    from talkgrid.plans import catalog

    read = lambda df: "Relation" in df._jdf.queryExecution().optimizedPlan().toString()
    again, conditions, consensus = [], V.reference_conditions, V.consensus
    monkeypatch.setattr(V, "reference_conditions", lambda df: again.append(read(df)) or conditions(df))
    monkeypatch.setattr(V, "consensus", lambda q, c: again.append(read(q)) or consensus(q, c))
    assert not catalog.QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()
    assert again == [False, False]


def test_reference_conditions_of_short_clips(spark):
    def score(clips):
        rows = [("v", 0, i, sec, True, vec) for i, (sec, vec) in enumerate(clips)]
        obs = spark.createDataFrame(rows, "voice string, session int, ord int, clean_seconds double, verified boolean, unit array<double>")
        query = spark.createDataFrame([(1, [1.0, 0.0])], "query int, vector array<double>")
        got = V.consensus(query, V.reference_conditions(obs)).collect()
        return got[0].score if got else -1.0

    one, other = [1.0, 0.0], [0.0, 1.0]
    assert score([(1.6, one)] * 5) > 0.99
    assert score([(2.0, one)] * 4) == score([(1.0, one)] * 5) == score([(0.4, one)] * 30) == score([(2.0, one)] * 4 + [(2.0, other)]) == -1.0
    assert score([(2.5, one)] * 2) > 0.99 and score([(2.5, one)]) == -1.0


def test_local_groups_and_clusters(spark):
    schema = "recording_id long, local string, vector array<double>, usable boolean"
    near = [(1, "A", [1.0, 0.0, 0.0], True), (1, "B", [0.995, 0.0999, 0.0], True), (1, "C", [0.0, 1.0, 0.0], True), (2, "A", [1.0, 0.0, 0.0], True), (2, "B", [1.0, 0.0, 0.0], True), (3, "A", [1.0, 0.0, 0.0], True), (3, "B", [1.0, 0.0, 0.0], False)]
    apart = spark.createDataFrame([(2, "B", "A")], "recording_id long, a string, b string")
    got = {(r.recording_id, r.local): r.grp for r in Y.local_groups(spark.createDataFrame(near, schema), apart).collect()}
    assert got == {(1, "A"): "A", (1, "B"): "A", (1, "C"): "C", (2, "A"): "A", (2, "B"): "B", (3, "A"): "A", (3, "B"): "B"}
    rng = np.random.Generator(np.random.PCG64(1))
    base = np.eye(8)[[0, 1, 2]]
    points = np.repeat(base, 10, axis=0) + rng.normal(0, 0.05, (30, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    labels = Y.cluster_labels(points)
    assert labels == [k // 10 for k in range(30)] and Y.cluster_labels(points, 3, 3) == labels
    # one voice with even noise parts badly
    alone = np.eye(64)[0] + rng.normal(0, 0.05, (12, 64))
    alone /= np.linalg.norm(alone, axis=1, keepdims=True)
    assert set(Y.cluster_labels(alone)) == {0} and Y.cluster_labels(points[:2]) == [0, 0]


def test_best_assignment_equals_brute_force():
    from itertools import permutations

    rng = np.random.Generator(np.random.PCG64(4))
    for shape in ((1, 1), (2, 3), (4, 2), (4, 4), (5, 5)):
        for _ in range(20):
            m = rng.integers(0, 50, shape).astype(float)
            pairs = Y.best_assignment(m)
            wide = m if shape[0] <= shape[1] else m.T
            best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
            assert sum(m[i, j] for i, j in pairs) == best and len(pairs) == min(shape)


def test_label_mapping_needs_a_lead(spark):
    overlaps = spark.createDataFrame([(1, "X", "A", 10_000), (1, "X", "B", 10_000), (2, "X", "A", 900), (2, "Y", "B", 800)], "recording_id long, secondary string, speaker string, overlap long")
    totals = spark.createDataFrame([(1, "X", 20_000), (2, "X", 1000), (2, "Y", 1000)], "recording_id long, secondary string, total long")
    got = {(r.recording_id, r.secondary): r.speaker for r in Y.map_labels(overlaps, totals).collect()}
    assert got == {(1, "X"): None, (2, "X"): "A", (2, "Y"): "B"}


def test_greedy_assignment(spark):
    rows = [(1, "a", "V1", 0.9, 0.3), (1, "b", "V1", 0.8, 0.3), (1, "c", "V1", 0.7, 0.3)]
    proposals = spark.createDataFrame(rows, "recording_id long, grp string, voice string, score double, margin double")
    apart = spark.createDataFrame([(1, "b", "a")], "recording_id long, a string, b string")
    assert {r.grp: r.accepted for r in Y.assign(proposals, apart).collect()} == {"a": True, "b": False, "c": True}


def test_word_pairs(spark):
    rows = lambda words: spark.createDataFrame([(1, i, w) for i, w in enumerate(words.split())], "recording_id long, ord long, token string")
    got = {(r.ord, r.other_ord) for r in Y.pair_words(rows("a b x c d"), rows("b c d a")).collect()}
    assert got == {(3, 1), (4, 2), (1, 0)}


def test_overlay_at_boundaries(spark):
    words = spark.createDataFrame([("r", 1, 0, "L", "x", 4000, 6000), ("r", 1, 1, "L", "x", 10_000, 10_000), ("r", 1, 2, "L", "x", None, None), ("r", 1, 3, "L", "x", 10_400, 10_600)], "recording_id string, seg_ord int, word_ord int, local_speaker string, speaker string, s long, e long")
    pieces = spark.createDataFrame([("r", "L", 0, 0, 5000, "V1"), ("r", "L", 1, 5000, 10_000, "ignore")], "recording_id string, local string, ord long, s long, e long, choice string")
    got = {r.word_ord: (r.speaker, r.identity) for r in M.overlay(words, pieces).collect()}
    assert got == {0: (S.UNKNOWN, "human_excluded"), 1: (S.UNKNOWN, "human_excluded"), 2: ("x", None), 3: ("x", None)}


def test_alias_chains_are_followed(spark):
    chain = spark.createDataFrame([(i, f"v{i}", f"v{i + 1}") for i in range(40)], "ord int, source string, target string")
    assert {r.target for r in M.resolve_aliases(chain).collect()} == {"v40"}


def test_strong_labels(spark):
    score = lambda *x: F.array(*[F.struct(F.lit(a).alias("label"), F.lit(p).alias("p")) for a, p in x])
    got = spark.range(1).select(
        R.strong_label(score(("happy", 900), ("sad", 100))).alias("a"), R.strong_label(score(("happy", 840), ("sad", 100))).alias("b"),
        R.strong_label(score(("neutral", 950), ("sad", 10))).alias("c"), R.strong_label(score(("sad", 600), ("angry", 900))).alias("d"), R.strong_label(score(("angry", 1000))).alias("e"),
    ).first()
    assert tuple(got) == ("happy", None, None, "angry", "angry")
