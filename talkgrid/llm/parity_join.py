"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is XOR-hashed into a sketch of 64-bit words:
each shingle flips the bits of its hash in one word. The number of words in
which two sketches differ is at most the size of the sets' symmetric
difference, and two sets of sizes a and b with a Jaccard index of at least t
differ in at most (1 - t) / (1 + t) * (a + b) shingles. A sketch of more words
than that bound must therefore agree in a whole word (pigeonhole), so documents
meet on (band, word number, word). Bands of sizes grow by 1 / t; a document
joins its own band and the next one. A word without a shingle says nothing, so
a document leaves out its empty words where it has more others than it can
differ in: one of these then agrees. Candidates of large buckets
are compared by bit sketches, in which each shingle flips one bit and whose
Hamming distance is a lower bound too; all are verified on their shingle sets.

Equal sets are one class before anything is joined. Within a bucket only links
that can still connect something are verified: first each class against the
bucket's most central class, then pairs whose classes are still in different
components. Each linked pair of different classes is thus either verified or
already connected, and no bucket is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.llm._arrow import in_small_batches
from talkgrid.llm._graph import connected_components
from talkgrid.llm._words import mix, slices, word_hashes
from talkgrid.session import durable

_U = np.uint64
_C1, _C2, _C3 = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)

#: Classes of a bucket that are compared with each other in one cell.
BLOCK = 512

#: Columns of _sets().
SETS = "doc_id long, n_shingles long, c1 long, c2 long, th long"


def _shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and where each document begins (and the end)."""
    words, first = word_hashes(data, offsets)
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(at[-1], dtype=np.uint64)
    total = max(0, len(words) - width + 1)
    rolled = np.zeros(total, dtype=np.uint64)
    for k in range(width):
        rolled = mix(rolled * _C1 + words[k : k + total] + _U(k + 1))
    keep = np.zeros(len(out), dtype=bool)
    for i in range(len(n)):
        a, b = at[i], at[i + 1]
        if counts[i] >= width:
            own = rolled[first[i] : first[i + 1] - width + 1]
        elif counts[i]:  # the whole short sequence is the only shingle
            own = np.zeros(1, dtype=np.uint64)
            for k, w in enumerate(words[first[i] : first[i + 1]]):
                own = mix(own * _C2 + w + _U(k + 1))
        else:
            continue
        own = np.sort(own)
        out[a:b] = own
        keep[a] = True
        keep[a + 1 : b] = own[1:] != own[:-1]
    starts = np.concatenate([[0], np.cumsum(keep)])[at]
    return out[keep], starts


def bands(threshold: tuple[int, int], size: int) -> np.ndarray:
    """Upper ends of the bands of sizes up to size and one more."""
    num, den = threshold
    ends = [1 * den // num]
    while ends[-1] < size:
        ends.append((ends[-1] + 1) * den // num)
    return np.array([*ends, (ends[-1] + 1) * den // num], dtype=np.int64)


def _sketch_keys(hashes: np.ndarray, starts: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of all documents, one after another, and where each document's begin (and the end)."""
    num, den = threshold
    n = np.diff(starts)
    ends = bands(threshold, int(n.max(initial=1)))
    own = np.searchsorted(ends, n)
    doc = np.repeat(np.arange(len(n)), n)
    spot, flips = mix(hashes + _C3) >> _U(32), mix(hashes ^ _C1)
    parts, owners = [], []
    for step in (0, 1):
        band = own + step
        # the most shingles in which two sets of up to ends[band] shingles can differ, and this set and another
        most = (den - num) * 2 * ends[band] // (den + num)
        own_most = (den - num) * (n + np.minimum(ends[band], n * den // num)) // (den + num)
        # some words more than needed, as a few may be empty; where no shingle may differ only equal sets can be linked
        words = np.where((n > 0) & (most > 0), most + 2 + most // 16, 0)
        base = np.concatenate([[0], np.cumsum(words)])
        sketch = np.zeros(base[-1], dtype=np.uint64)
        live = words[doc] > 0
        w = (spot[live] * words[doc[live]].astype(np.uint64)) >> _U(32)
        np.bitwise_xor.at(sketch, base[doc[live]] + w.astype(np.int64), flips[live])
        of = np.repeat(np.arange(len(n)), words)
        filled = np.bincount(of[sketch != 0], minlength=len(n))
        number = np.arange(len(sketch)) - base[of]
        keep = (sketch != 0) | (filled <= own_most)[of]
        sketch, of, number = sketch[keep], of[keep], number[keep].astype(np.uint64)
        parts.append(mix(mix(sketch + _C3) ^ (number * _C1 + band[of].astype(np.uint64) * _C2)))
        owners.append(of)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.searchsorted(owner[order], np.arange(len(n) + 1))


def _class_ids(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for c in (_C1, _C2):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ c))])
        out.append(mix(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(np.uint64) * _C3).view(np.int64))
    return out[0], out[1]


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                hashes, starts = _shingles(data, offsets, width)
                c1, c2 = _class_ids(hashes, starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(np.diff(starts)), pa.array(c1), pa.array(c2), batch.column(2)[a:b]],
                    names=["doc_id", "n_shingles", "c1", "c2", "th"],
                )

    return run


def _keys(width: int, threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                hashes, starts = _shingles(data, offsets, width)
                c1, _ = _class_ids(hashes, starts)
                keys, at = _sketch_keys(hashes, starts, threshold)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(c1), lists], names=["c1", "keys"])

    return run


def _members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                hashes, starts = _shingles(data, offsets, width)
                c1, _ = _class_ids(hashes, starts)
                raw = hashes.tobytes()
                sets = [raw[8 * i : 8 * j] for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c1), pa.array(sets, pa.binary())], names=["c1", "members"])

    return run


def _verify(threshold: tuple[int, int]):
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok = np.zeros(len(u), dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = sorted((len(x), len(y)))
                if den * small < num * large:
                    continue
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                same = int((merged[1:] == merged[:-1]).sum())
                ok[i] = den * same >= num * (small + large - same)
            yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], names=["u", "v"])

    return run


def _linked(pairs: DataFrame, members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Those of pairs(u, v) whose sets are alike enough."""
    x = members.select(F.col("c1").alias("u"), F.col("members").alias("x"))
    y = members.select(F.col("c1").alias("v"), F.col("members").alias("y"))
    # shuffled at every size: the sets grow with the corpus
    return pairs.hint("merge").join(x, "u").hint("merge").join(y, "v").select("u", "v", "x", "y").mapInArrow(_verify(threshold), "u long, v long")


def _parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parity sketches of a power of two of bits, two or more a shingle; a longer one folds into a shorter one by XOR."""
    for batch in batches:
        sizes, sketches = [], []
        for raw in batch.column(1):
            h = mix(np.frombuffer(raw.as_buffer(), np.uint64) ^ _C2)
            words = 1 << max(2, (len(h) // 32).bit_length())
            sketch = np.zeros(words, dtype=np.uint64)
            np.bitwise_xor.at(sketch, ((h >> _U(6)) & _U(words - 1)).astype(np.int64), _U(1) << (h & _U(63)))
            sizes.append(len(h))
            sketches.append(sketch.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())], names=["c1", "n", "sketch"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each cell; a batch's last cell goes on in the next batch."""
    names = ["key", "i", "j", "block", "c1", "label", "n", "sketch"]
    held = None
    for batch in batches:
        now = {k: c.to_numpy(zero_copy_only=False) for k, c in zip(names, batch.columns, strict=True)}
        held = now if held is None else {k: np.concatenate([held[k], now[k]]) for k in names}
        size = len(held["key"])
        if not size:
            continue
        new = np.ones(size, dtype=bool)
        new[1:] = (held["key"][1:] != held["key"][:-1]) | (held["i"][1:] != held["i"][:-1]) | (held["j"][1:] != held["j"][:-1])
        at = np.flatnonzero(new)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield {k: x[a:b] for k, x in held.items()}
        held = {k: x[at[-1] :] for k, x in held.items()}
    if held is not None and len(held["key"]):
        yield held


def _close(threshold: tuple[int, int]):
    """Pairs of a cell that are in different components and whose sketches are near enough."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [], [], 0
        for cell in _cells(batches):
            if len(cell["c1"]) < 2:
                continue
            left = np.flatnonzero(cell["block"] == cell["i"][0])
            right = np.flatnonzero(cell["block"] == cell["j"][0])
            sketches = [np.frombuffer(x, np.uint64) for x in cell["sketch"]]
            words = min(map(len, sketches))
            folded = np.stack([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in sketches])
            n, c1, label = cell["n"].astype(np.int64), cell["c1"], cell["label"]
            total = n[left][:, None] + n[right][None, :]
            small = np.minimum(n[left][:, None], n[right][None, :])
            ok = (den * small >= num * (total - small)) & (label[left][:, None] != label[right][None, :])
            far = np.zeros(total.shape, dtype=np.int64)
            for w in range(words):
                far += np.bitwise_count(folded[left, w][:, None] ^ folded[right, w][None, :])
            ok &= far <= (den - num) * total // (den + num)
            x, y = np.nonzero(ok)
            u, v = c1[left[x]], c1[right[y]]
            us.append(np.minimum(u, v))
            vs.append(np.maximum(u, v))
            held += len(u)
            if held > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])
                us, vs, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _close_pairs(still: DataFrame, sketches: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Distinct pairs(u, v) of classes that share a bucket, are in different components and have near sketches.

    A bucket is cut into blocks of about BLOCK classes, and each pair of blocks
    is a cell of its own, so a large bucket is spread over many tasks and its
    pairs are compared in place; only near ones become rows.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = still.withColumn("block", F.pmod(F.xxhash64("c1"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c1", "label").join(sketches, "c1")
    rows = rows.select("key", "i", "j", "block", "c1", "label", "n", "sketch").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(_close(threshold), "u long, v long").distinct()


def jaccard_components(docs: DataFrame, width: int = 3, threshold: tuple[int, int] = (9, 10), text_hash: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id.

    Documents link when the Jaccard index of their sets of width-word shingles
    is at least threshold, a fraction; component_id is the least doc_id that
    links reach. class_id is shared by documents with equal sets. Null texts,
    texts without words and empty texts have no shingles and link with nothing;
    a text with fewer words than width is one shingle. Rows with equal doc_id
    count as documents of their own; a null doc_id never is a component's least
    (a component of such rows alone has a null component_id). Other columns are
    ignored; an empty table gives no row.
    """
    read = in_small_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))
    )
    rows = durable(read.mapInArrow(_sets(width), SETS))
    # one set of keys for each class, so that no key is hot by copies; the keys are dealt out once and compared in place
    classes = read.select("text").mapInArrow(_keys(width, threshold), "c1 long, keys array<long>").where("size(keys) > 0").dropDuplicates(["c1"])
    spread = classes.select("c1", F.explode("keys").alias("key"))
    buckets = durable(spread.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1"))

    central = buckets.groupBy("c1").agg(F.sum("size").alias("weight"))
    weighted = durable(buckets.select("key", "c1").join(central, "c1"))
    pivots = weighted.groupBy("key").agg(F.max(F.struct("weight", "c1")).alias("top")).select("key", F.col("top.c1").alias("u"))
    first = durable(weighted.join(pivots, "key").where("u <> c1").select(F.least("u", "c1").alias("u"), F.greatest("u", "c1").alias("v")).distinct())

    # one text for each class that has a candidate
    wanted = rows.join(buckets.select("c1").distinct(), "c1").groupBy("c1").agg(F.min(F.struct("doc_id", "th")).alias("x")).select("x.doc_id", "x.th").distinct()
    chosen = (F.col("r.th") == F.col("w.th")) & F.col("r.doc_id").eqNullSafe(F.col("w.doc_id"))
    texts = read.alias("r").join(wanted.alias("w").hint("merge"), chosen, "left_semi")
    members = durable(texts.select("text").mapInArrow(_members(width), "c1 long, members binary").dropDuplicates(["c1"]))
    links = durable(_linked(first, members, threshold))

    labels = connected_components(links)
    placed = weighted.join(labels.withColumnRenamed("node", "c1"), "c1", "left").select("key", "c1", F.coalesce("label", "c1").alias("label"))
    open_keys = placed.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("size")).where("a <> b and size > 2")  # the only pair of a bucket of two is in first
    still = durable(placed.join(open_keys.select("key", "size"), "key"))
    sketches = durable(members.join(still.select("c1").distinct(), "c1", "left_semi").mapInArrow(_parity, "c1 long, n int, sketch binary"))
    second = durable(_close_pairs(still, sketches, threshold).join(first, ["u", "v"], "left_anti"))
    more = durable(_linked(second, members, threshold))
    if not more.isEmpty():
        names = labels.withColumnRenamed("node", "u")
        named = more.join(names, "u", "left").select(F.coalesce("label", "u").alias("u"), "v")
        named = named.join(names.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("label", "v").alias("v"))
        again = connected_components(named)
        ends = more.select(F.col("u").alias("node")).union(more.select("v")).distinct()
        labels = labels.join(ends, "node", "full").select("node", F.coalesce("label", "node").alias("label"))
        over = again.toDF("label", "to")
        labels = durable(labels.join(over, "label", "left").select("node", F.coalesce("to", "label").alias("label")))

    classes = durable(rows.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("least")).join(labels.withColumnRenamed("node", "c1"), "c1", "left").withColumn("label", F.coalesce("label", "c1")))
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = durable(classes.join(least, "label").select("c1", "c2", "component_id", "label"))
    out = rows.join(named, ["c1", "c2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("c1").alias("class_id"), "label", "th"
    )
    return out if text_hash else out.drop("label", "th")



def keep_first(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """The rows of docs, all columns, that are first in their component: with the least doc_id, then the least hash of the text.

    Rows without shingles stay, and of equal rows one; a component of rows with
    a null doc_id keeps one of them.
    """
    found = jaccard_components(docs, width, threshold, text_hash=True)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    first = found.where("n_shingles > 0").groupBy("label").agg(F.min(rank).alias("f")).select("f.doc_id", "f.th")
    first = durable(first.union(found.where("n_shingles = 0").select("doc_id", "th")).distinct())
    x, y = docs.withColumn("__th", F.xxhash64("text")).alias("x"), first.alias("y")
    rows = x.join(y, F.col("x.doc_id").cast("long").eqNullSafe(F.col("y.doc_id")) & (F.col("x.__th") == F.col("y.th")), "left_semi")
    return rows.drop("__th").dropDuplicates(["doc_id", "text"])
