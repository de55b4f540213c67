"""Grouping of ordered rows of a recording into segments, turns, paragraphs, chunks, utterances and runs. Times are in whole milliseconds unless a name says seconds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.functions import text as T

TURN_GAP, TURN_CAP = 1250, 30_000
PARAGRAPH_PAUSE, PARAGRAPH_WORDS = 2000, 250
RUN_GAP = 450
CHUNK_GAP, CHUNK_LEAST, CHUNK_MOST = 320, 550, 1250
UTTERANCE_GAP, UTTERANCE_MOST = 350, 12_000
UNKNOWN = "SPEAKER_UNKNOWN"


def fold_groups(rows: DataFrame, keys: list[str], order: list[str], needs: list[str], step: Callable[[Any, tuple], tuple[Any, bool]]) -> DataFrame:
    """rows with grp, the number from 0 of each row's group within its keys.

    For groups whose end depends on where they began, which no window can say:
    step(state, values of needs) gives the new state and whether the row begins
    a group; the state is None at the first row of a key. Rows stream through in
    order, so a long recording takes no more memory than a batch.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", grp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, grp = None, None, -1
        for batch in batches:
            names = batch.schema.names
            lists = lambda cs: zip(*(batch.column(names.index(c)).to_pylist() for c in cs), strict=True)  # noqa: E731, B023
            out = []
            for k, values in zip(lists(keys), lists(needs), strict=True):
                if k != key:
                    key, state, grp = k, None, -1
                state, begins = step(state, values)
                grp += begins
                out.append(grp)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*names, "grp"])

    # by a hash, as a repartition by the keys of a join above is left out, and the join's own may be read in another order
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def in_order(order: list[str], value: Column | str, mark: str = " ") -> Column:
    """The values of a group, joined in order."""
    value = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("__v")))), lambda x: x["__v"]), mark)


def normalize_words(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Words of non-blank segments with the speaker, local speaker and identity that they inherit; fallback if they had no speaker."""
    segs = segments.where(F.trim("text") != "").select(
        "recording_id", "seg_ord", F.col("identity").alias("seg_identity"),
        F.coalesce("speaker", F.lit(UNKNOWN)).alias("seg_speaker"),
        F.coalesce("local_speaker", "speaker", F.lit(UNKNOWN)).alias("seg_local"),
    )
    rows = words.where(F.trim("text") != "").join(segs, ["recording_id", "seg_ord"])
    return rows.select(
        "recording_id", "seg_ord", "word_ord", F.trim("text").alias("text"), "s", "e", "score", "secondary", "ambiguous",
        F.coalesce("speaker", "seg_speaker").alias("speaker"),
        F.coalesce("local_speaker", "seg_local").alias("local_speaker"),
        F.coalesce("identity", "seg_identity").alias("identity"),
        F.col("speaker").isNull().alias("fallback"),
    )


def word_runs(words: DataFrame) -> DataFrame:
    """Normalized words with run, the number from 0 of their run of one (speaker, local speaker) in the segment."""
    w = Window.partitionBy("recording_id", "seg_ord").orderBy("word_ord")
    key = F.struct("speaker", "local_speaker")
    return words.withColumn("c", F.coalesce((F.lag(key).over(w) != key).cast("long"), F.lit(0))).withColumn("run", F.sum("c").over(w)).drop("c")


def turn_words(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """Normalized words with turn_ord, the turn that their piece of a segment is in."""
    turns = turn_numbers(pieces).select("recording_id", "seg_ord", "run", F.col("grp").alias("turn_ord"))
    return word_runs(words).join(turns, ["recording_id", "seg_ord", "run"])


def split_segments(words: DataFrame, segments: DataFrame) -> DataFrame:
    """One row for each run of words of one (speaker, local speaker) in a segment, or for the whole segment if it has one such pair.

    words are normalized. Missing times come from the timed words; no end is
    before its start; a blank segment gives no row; ids count in order.
    """
    runs = word_runs(words)
    ends = lambda f, c: F.get(F.transform(F.filter(f("ws"), lambda x: x[c].isNotNull()), lambda x: x[c]), F.lit(0))
    same, back = (lambda c: F.col(c)), (lambda c: F.reverse(F.col(c)))
    grouped = runs.groupBy("recording_id", "seg_ord", "run").agg(
        F.first("speaker").alias("w_speaker"), F.first("local_speaker").alias("w_local"), F.count("*").alias("n_words"),
        F.array_sort(F.collect_list(F.struct("word_ord", "text", "s", "e", "identity"))).alias("ws"),
    )
    identities = F.transform("ws", lambda x: x["identity"])
    unresolved = F.get(F.filter(identities, lambda i: i.startswith("unresolved")), F.lit(0))
    grouped = grouped.select(
        "recording_id", "seg_ord", "run", "w_speaker", "w_local", "n_words",
        F.array_join(F.transform("ws", lambda x: x["text"]), " ").alias("w_text"),
        F.col("ws")[0]["s"].alias("w_s"), F.element_at("ws", -1)["e"].alias("w_e"),
        ends(same, "s").alias("first_s"), ends(back, "e").alias("last_e"),
        F.forall(identities, lambda i: i.eqNullSafe(identities[0])).alias("one"), identities[0].alias("w_identity"),
        unresolved.alias("unresolved"), F.exists(identities, lambda i: F.coalesce(i == "human_verified", F.lit(False))).alias("verified"),
    )
    segs = segments.where(F.trim("text") != "")
    rows = segs.join(grouped, ["recording_id", "seg_ord"], "left").withColumn("n_runs", F.count("run").over(Window.partitionBy("recording_id", "seg_ord")))
    many = F.col("n_runs") > 1
    # runs of one pair that comes back are apart, but a segment of one pair alone is whole
    start = F.coalesce(F.when(many, F.col("w_s")).otherwise(F.col("s")), "first_s", F.lit(0))
    end = F.coalesce(F.when(many, F.col("w_e")).otherwise(F.col("e")), "last_e")
    identity = F.when(F.col("one"), F.coalesce("w_identity", "identity")).when(F.col("unresolved").isNotNull(), F.col("unresolved")).when(F.col("verified"), F.lit("partially_reviewed")).otherwise(F.col("identity"))
    seg_speaker = F.coalesce("speaker", F.lit(UNKNOWN))
    order = Window.partitionBy("recording_id").orderBy("seg_ord", "run")
    return rows.select(
        "recording_id",
        (F.row_number().over(order) - 1).cast("long").alias("ord"),
        "seg_ord",
        F.coalesce("run", F.lit(0).cast("long")).alias("run"),
        start.alias("s"),
        F.greatest(start, F.coalesce(end, start)).alias("e"),
        F.coalesce("w_speaker", seg_speaker).alias("speaker"),
        F.coalesce("w_local", "local_speaker", seg_speaker).alias("local_speaker"),
        identity.alias("identity"),
        "confidence",
        F.when(many, F.col("w_text")).otherwise(F.trim("text")).alias("text"),
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
    ).withColumn("segment_id", F.format_string("segment-%06d", "ord"))


def turn_numbers(segments: DataFrame, gap: int = TURN_GAP, cap: int = TURN_CAP) -> DataFrame:
    """Non-blank segments with the number of their turn.

    A segment joins the turn before it if speaker and identity are the same, it
    begins at most gap after the end of the last segment, and the turn stays
    within cap.
    """

    def step(state, row):
        speaker, identity, start, end = row
        if state is not None and state[:2] == (speaker, identity) and start - state[3] <= gap and end - state[2] <= cap:
            return (speaker, identity, state[2], end), False
        return (speaker, identity, start, end), True

    rows = segments.where(F.trim("text") != "").withColumn("speaker", F.coalesce("speaker", F.lit(UNKNOWN)))
    rows = rows.withColumn("text", F.trim("text")).withColumn("e", F.greatest("s", F.coalesce("e", "s")))
    return fold_groups(rows, ["recording_id"], ["ord"], ["speaker", "identity", "s", "e"], step)


def build_turns(segments: DataFrame) -> DataFrame:
    """One row per turn of segments(recording_id, ord, s, e, speaker, identity, text, ...), with its pause before, the time since the latest end before it.

    The first segment gives start, identity and confidence, the last one the end.
    """
    optional = [F.min_by("confidence", "ord").alias("confidence")] if "confidence" in segments.columns else []
    if "local_speaker" in segments.columns:
        locals_ = F.transform(F.array_sort(F.collect_list(F.struct("ord", "local_speaker"))), lambda x: x["local_speaker"])
        optional.append(F.array_join(F.array_distinct(locals_), ",").alias("local_speakers"))
    turns = turn_numbers(segments).groupBy("recording_id", F.col("grp").alias("turn_ord")).agg(
        F.min_by("s", "ord").alias("s"), F.max_by("e", "ord").alias("e"), F.first("speaker").alias("speaker"), F.first("identity").alias("identity"),
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count("*").alias("n_segments"), in_order(["ord"], "text").alias("text"), *optional,
    )
    before = Window.partitionBy("recording_id").orderBy("turn_ord").rowsBetween(Window.unboundedPreceding, -1)
    pause = F.greatest(F.lit(0), F.col("s") - F.greatest(F.max("e").over(before), F.lit(0)))
    return turns.withColumn("pause_before", F.coalesce(pause, F.greatest("s", F.lit(0)))).withColumn("turn_id", F.format_string("turn-%06d", "turn_ord"))


def paragraph_numbers(turns: DataFrame, pause: int = PARAGRAPH_PAUSE, most: int = PARAGRAPH_WORDS) -> DataFrame:
    """Non-blank turns with the number of their paragraph.

    Turns of one known speaker go together while the pause, as stored or since
    the last turn's end, is under pause and they have at most most words.
    """

    def step(state, row):
        speaker, start, end, stored, words = row
        if state is not None:
            gap = stored if start is None or state[1] is None else max(stored, start - state[1])
            if state[0] == speaker != UNKNOWN and gap < pause and state[2] + words <= most:
                return (speaker, end, state[2] + words), False
        return (speaker, end, words), True

    rows = turns.where(F.trim("text") != "").withColumn("speaker", F.coalesce("speaker", F.lit(UNKNOWN))).withColumn("text", F.trim("text"))
    rows = rows.withColumn("words", F.size(F.split("text", r"\s+"))).withColumn("pause_before", F.coalesce("pause_before", F.lit(0)))
    return fold_groups(rows, ["recording_id"], ["turn_ord"], ["speaker", "s", "e", "pause_before", "words"], step)


def build_paragraphs(turns: DataFrame) -> DataFrame:
    """One row per paragraph: speaker, first and last turn, words and text."""
    return paragraph_numbers(turns).groupBy("recording_id", F.col("grp").alias("paragraph")).agg(
        F.first("speaker").alias("speaker"), F.min("turn_ord").alias("first_turn"), F.max("turn_ord").alias("last_turn"),
        F.sum("words").alias("words"), in_order(["turn_ord"], "text").alias("text"),
    )


def run_words(words: DataFrame, gap: int = RUN_GAP) -> DataFrame:
    """Lexical words of known speakers with run, their run of one speaker in which each begins at most gap after the latest end.

    words(recording_id, seg_ord, word_ord, s, e, speaker, text); those without
    times, letters, length or a known speaker are passed over. Runs are numbered
    by start, then end.
    """
    rows = words.where(F.col("s").isNotNull() & F.col("e").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]") & known("speaker"))
    rows = rows.withColumn("s", F.greatest("s", F.lit(0))).where("e > s")
    w = Window.partitionBy("recording_id").orderBy("seg_ord", "word_ord")
    island = rows.withColumn("c", F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("int"), F.lit(1))).withColumn("island", F.sum("c").over(w))
    # within an island the latest end of all is that of the run, as a run begins after every end before it
    inside = Window.partitionBy("recording_id", "island").orderBy("seg_ord", "word_ord")
    prior = F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    cut = island.withColumn("b", F.coalesce((F.col("s") - prior > gap).cast("int"), F.lit(1))).withColumn("r", F.sum("b").over(w)).drop("c", "island", "b")
    whole = Window.partitionBy("recording_id", "r")
    first = F.first("s").over(whole.orderBy("seg_ord", "word_ord"))
    number = F.dense_rank().over(Window.partitionBy("recording_id").orderBy("first", "last", "r")) - 1
    return cut.withColumn("first", first).withColumn("last", F.max("e").over(whole)).withColumn("run", number.cast("long")).drop("first", "last", "r")


def speaker_runs(words: DataFrame, gap: int = RUN_GAP) -> DataFrame:
    """One row for each run of run_words()."""
    return run_words(words, gap).groupBy("recording_id", "run").agg(
        F.first("speaker").alias("speaker"), F.min_by("s", F.struct("seg_ord", "word_ord")).alias("s"), F.max("e").alias("e"),
        F.count("*").alias("n_words"), F.count_distinct("seg_ord").alias("n_segments"), in_order(["seg_ord", "word_ord"], "text").alias("text"),
    )


def known(speaker: str) -> Column:
    """The label names somebody."""
    return ~F.coalesce(F.col(speaker), F.lit("")).isin("", UNKNOWN, "None")


BY_TIME = ["s", "e", "seg_ord", "word_ord"]


def utterance_words(words: DataFrame, gap: int = UTTERANCE_GAP, most: int = UTTERANCE_MOST) -> DataFrame:
    """utterance, the number of each lexical word's utterance: words by time, whoever speaks, up to a pause over gap, a sentence's end, or most since the first start."""

    def step(state, row):
        start, end, ends = row
        if state is not None and max(0, start - state[1]) <= gap and not state[2] and state[1] - state[0] < most:
            return (state[0], end, ends), False
        return (start, end, ends), True

    rows = words.where(F.col("s").isNotNull() & F.col("e").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))
    rows = rows.withColumn("ends", T.ends_sentence(F.trim("text")))
    return fold_groups(rows, ["recording_id"], BY_TIME, ["s", "e", "ends"], step).withColumnRenamed("grp", "utterance").drop("ends")


def utterances(words: DataFrame, gap: int = UTTERANCE_GAP, most: int = UTTERANCE_MOST) -> DataFrame:
    """One row for each utterance of utterance_words()."""
    order = BY_TIME
    return utterance_words(words, gap, most).groupBy("recording_id", "utterance").agg(
        F.min("s").alias("s"), F.max_by("e", F.struct(*order)).alias("e"), F.count("*").alias("n_words"),
        F.count_distinct("seg_ord").alias("n_segments"), in_order(order, "text").alias("text"),
    )


def chunks(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Short windows of a segment's timed words; a segment without any is one chunk of its own times.

    A word begins a chunk after a pause of CHUNK_GAP if the chunk has CHUNK_LEAST,
    or if it has CHUNK_MOST.
    """

    def step(state, row):
        start, end = row
        if state is not None:
            length = state[1] - state[0]
            if not ((start - state[1] >= CHUNK_GAP and length >= CHUNK_LEAST) or length >= CHUNK_MOST):
                return (state[0], end), False
        return (start, end), True

    timed = words.where("s is not null and e is not null")
    found = fold_groups(timed.select("recording_id", "seg_ord", "word_ord", "s", "e"), ["recording_id", "seg_ord"], ["word_ord"], ["s", "e"], step)
    found = found.groupBy("recording_id", "seg_ord", "grp").agg(F.min_by("s", "word_ord").alias("s"), F.max_by("e", "word_ord").alias("e"), F.count("*").alias("n_words"))
    start = F.coalesce("s", F.lit(0))
    bare = segments.join(timed.select("recording_id", "seg_ord").distinct(), ["recording_id", "seg_ord"], "left_anti")
    bare = bare.select("recording_id", "seg_ord", F.lit(0).cast("long").alias("grp"), start.alias("s"), F.greatest(start, F.coalesce("e", start)).alias("e"), F.lit(0).cast("long").alias("n_words"))
    number = F.row_number().over(Window.partitionBy("recording_id").orderBy("seg_ord", "grp")) - 1
    return found.union(bare).select("recording_id", number.cast("long").alias("chunk"), "seg_ord", "s", "e", "n_words")


def smooth_fragments(chunks: DataFrame, length: int = 350, gap: int = 250) -> DataFrame:
    """Labels of chunks, where one under length and less than gap after the one before it in its segment takes that one's label.

    Whether a chunk copies does not depend on the labels, so a chain of copies
    ends at the last chunk that does not.
    """
    w = Window.partitionBy("recording_id").orderBy("chunk")
    copies = (F.lag("seg_ord").over(w) == F.col("seg_ord")) & (F.col("e") - F.col("s") < length) & (F.col("s") - F.lag("e").over(w) < gap)
    marked = chunks.withColumn("own", F.when(~F.coalesce(copies, F.lit(False)), F.struct("label")))
    return marked.withColumn("label", F.last("own", ignorenulls=True).over(w)["label"]).drop("own")


def smooth_minorities(chunks: DataFrame, least: int = 850) -> DataFrame:
    """Labels with less than least in a segment of several labels become the segment's majority, of equal ones the first."""
    totals = chunks.groupBy("recording_id", "seg_ord", "label").agg(F.sum(F.greatest(F.col("e") - F.col("s"), F.lit(0))).alias("total"), F.min("chunk").alias("first"))
    w = Window.partitionBy("recording_id", "seg_ord")
    ranked = totals.withColumn("majority", F.first("label").over(w.orderBy(F.desc("total"), "first"))).withColumn("n", F.count("*").over(w))
    new = ranked.select("recording_id", "seg_ord", "label", F.when((F.col("n") > 1) & (F.col("total") < least), F.col("majority")).otherwise(F.col("label")).alias("new"))
    return chunks.join(new, ["recording_id", "seg_ord", "label"]).drop("label").withColumnRenamed("new", "label")


def first_seen_labels(chunks: DataFrame) -> DataFrame:
    """Labels renamed SPEAKER_00, SPEAKER_01, ... by where they are first seen."""
    first = chunks.groupBy("recording_id", "label").agg(F.min("chunk").alias("first"))
    number = (F.row_number().over(Window.partitionBy("recording_id").orderBy("first")) - 1).cast("int")
    names = first.select("recording_id", "label", F.format_string("SPEAKER_%02d", number).alias("speaker"))
    return chunks.join(names, ["recording_id", "label"])


def scored_windows(turns: DataFrame, most: int = 12_000, least: int = 250) -> DataFrame:
    """Windows of at most most over each turn, until less than least is left."""
    begin = F.explode(F.sequence(F.col("s"), F.greatest("s", F.col("e") - 1), F.lit(most).cast("long"))).alias("w_s")
    rows = turns.where("e > s").select("recording_id", "turn_ord", "s", "e", begin).withColumn("w_e", F.least("e", F.col("w_s") + most))
    return rows.where(F.col("w_e") - F.col("w_s") >= least).select("recording_id", "turn_ord", "w_s", "w_e")


def word_numbers(words: DataFrame, segments: DataFrame) -> DataFrame:
    """word_index: the place from 0 of each non-blank word of a non-blank segment in its recording."""
    rows = words.where(F.trim("text") != "").join(segments.where(F.trim("text") != "").select("recording_id", "seg_ord"), ["recording_id", "seg_ord"], "left_semi")
    number = F.row_number().over(Window.partitionBy("recording_id").orderBy("seg_ord", "word_ord")) - 1
    return rows.select("recording_id", "seg_ord", "word_ord", "text", "s", number.cast("long").alias("word_index"))


def label_patterns(utterance_words: DataFrame) -> DataFrame:
    """Utterances whose words have exactly three runs of labels of which the outer two are equal: recording_id, utterance, outer, middle and the middle's times.

    utterance_words(recording_id, utterance, ord, speaker, s, e).
    """
    w = Window.partitionBy("recording_id", "utterance").orderBy("ord")
    rows = utterance_words.withColumn("c", F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("int"), F.lit(1))).withColumn("run", F.sum("c").over(w))
    runs = rows.groupBy("recording_id", "utterance", "run").agg(F.first("speaker").alias("speaker"), F.min("s").alias("s"), F.max("e").alias("e"))
    at = lambda k, c: F.max(F.when(F.col("run") == k, F.col(c)))
    found = runs.groupBy("recording_id", "utterance").agg(F.max("run").alias("n"), at(1, "speaker").alias("outer"), at(3, "speaker").alias("last"), at(2, "speaker").alias("middle"), at(2, "s").alias("s"), at(2, "e").alias("e"))
    return found.where("n = 3 and outer = last").select("recording_id", "utterance", "outer", "middle", "s", "e")


def neighbour_context(runs: DataFrame, near: int = 1250, seam: int = 120) -> DataFrame:
    """Speakers of the runs before and after within near, and whether a sentence goes on over a seam of at most seam."""
    w = Window.partitionBy("recording_id").orderBy("run")
    before, after = F.lag(F.struct("speaker", "e", "text")).over(w), F.lead(F.struct("speaker", "s", "text")).over(w)
    rows = runs.withColumn("p", before).withColumn("n", after)
    close = lambda gap, most: F.coalesce(gap <= most, F.lit(False))
    left, right = F.col("s") - F.col("p.e"), F.col("n.s") - F.col("e")
    return rows.select(
        "recording_id", "run", "speaker",
        F.when(close(left, near), F.col("p.speaker")).alias("before"),
        F.when(close(right, near), F.col("n.speaker")).alias("after"),
        (close(F.abs(left), seam) & T.sentence_continues(F.col("p.text"), F.col("text"))).alias("goes_on"),
    )
