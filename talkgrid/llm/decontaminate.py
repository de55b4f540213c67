"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A passage is contaminated by a benchmark item of n words when its edit distance
in words to the whole item is at most n / 5. Windows of an item's size are
embedded by CGK random walks (a walk repeats or leaves the current word by a
random bit of that word and step), which turn edit distance into Hamming
distance; each repetition samples a few steps of its own walk as a key, and an
item and a window with an equal key are compared by the exact distance. The
repetitions are the number that reaches the target recall on edited copies of
the items themselves. Where that takes more than MOST_REPETITIONS, which are
classes of long items, nothing is sampled: a block of windows is compared with
every item of the class that has enough word pairs of its own in it.

Windows that cannot be near any item are not embedded: k edits of n words leave
at least n - 1 - 2k of the item's word pairs whole, so a window with fewer word
pairs of its class than the least of this over the class is skipped, and so is
a candidate with fewer pairs of its item. The nearest passage begins with a word
that it shares with the item, one of the item's first k + 1, so other windows
are skipped too. That loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.llm._arrow import in_small_batches
from talkgrid.llm._words import mix, slices, word_hashes
from talkgrid.session import durable

_U = np.uint64
#: Items of fewer words have no edits allowed and are matched word for word.
MIN_WORDS = 5
#: Items that are sent to every worker at once; a larger benchmark goes in several passes.
ITEMS_PER_PASS = 20_000
TARGET_RECALL, SAMPLED_STEPS, MOST_REPETITIONS, COPIES = 0.995, 2, 48, 400
_PAIR_BITS = 22
#: Classes that have a bit of their own in the table of word pairs; more of them share bits.
_CLASS_BITS = 16
#: Bytes of the windows that are embedded at once.
PROBE_BYTES = 4 << 20

HITS = "doc_id long, item_id long, first_word long, last_word long, distance int"


def allowed(n: int) -> int:
    return n // 5


def edit_search(pattern: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance of the whole pattern to a substring of text, and where the first such ends (bit-parallel)."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best, at = full, 0, n, n, 0
    for pos, word in enumerate(text, 1):
        eq = pattern.get(word, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, at = score, pos
    return best, at


def passage_start(words: list[int], text: list[int]) -> int:
    """The last start in text from which all of text is as near to words as any such part is."""
    n = len(words)
    full, top = (1 << n) - 1, 1 << (n - 1)
    pattern = masks(words[::-1])
    pv, mv, score, best, at = full, 0, n, n, 0
    for pos, word in enumerate(reversed(text), 1):
        eq = pattern.get(word, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # unlike a search, the part is held to the end of text
        ph, mh = ((ph << 1) | 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, at = score, pos
    return len(text) - at


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def walk_keys(tokens: np.ndarray, plan: np.ndarray) -> np.ndarray:
    """Repetitions x rows: keys of the CGK walks over the rows of tokens (0 pads), from the words at the steps that plan samples."""
    reps, (count, width) = len(plan), tokens.shape
    seeds = mix(np.arange(reps, dtype=np.uint64) * _U(1_000_003) + _U(17))[:, None]
    at = np.zeros((reps, count), dtype=np.int64)
    key = np.repeat(seeds, count, axis=1)
    rows = np.arange(count) * width
    cells = np.arange(reps)[:, None] * (count * width) + rows
    flat = tokens.ravel()
    for step in range(int(plan.max()) + 1):
        if step % 64 == 0:
            bits = mix(flat ^ (seeds + _U(step))).ravel()
        here = np.minimum(at, width - 1)
        sampled = np.flatnonzero((plan == step).any(axis=1))
        if len(sampled):
            key[sampled] = mix(key[sampled] ^ np.where(at[sampled] < width, flat[rows + here[sampled]], _U(0)))
        at += ((bits[cells + here] >> _U(step % 64)) & _U(1)).astype(np.int64)
    return key


def _walks(tokens: np.ndarray, plan: np.ndarray) -> np.ndarray:
    """walk_keys() of many rows, in parts of bounded size."""
    size = max(1, PROBE_BYTES // (8 * tokens.shape[1] * len(plan)))
    return np.concatenate([walk_keys(tokens[a : a + size], plan) for a in range(0, len(tokens), size)], axis=1)


def _pair_hashes(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * _U(3) + words[1:])


def _run_hashes(words: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all runs of m words."""
    count = max(0, len(words) - m + 1)
    out = mix(words[:count])
    for k in range(1, m):
        out = mix(out * _U(3) + words[k : k + count])
    return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _U((1 << _PAIR_BITS) - 1)).astype(np.int64)


class Index:
    """LSH tables of one pass of items, by classes of item lengths."""

    def __init__(self, item_ids: list[int], texts: list[str]):
        column = pa.array(texts, pa.string())
        items: list[tuple[int, np.ndarray]] = []
        for a, b, data, offsets in slices(column):
            words, first = word_hashes(data, offsets)
            items += [(item_ids[a + i], words[first[i] : first[i + 1]]) for i in range(b - a)]
        short = [x for x in items if 0 < len(x[1]) < MIN_WORDS]
        items = sorted((x for x in items if len(x[1]) >= MIN_WORDS), key=lambda x: len(x[1]))
        self.items = items + short
        self.short = []
        for m in sorted({len(w) for _, w in short}):
            at = np.array([i for i, (_, w) in enumerate(self.items) if len(w) == m])
            keys = np.concatenate([_run_hashes(self.items[i][1], m) for i in at])
            order = np.argsort(keys, kind="stable")
            self.short.append((m, keys[order], at[order]))
        self.patterns = [masks(w.tolist()) for _, w in items]
        self.own_pairs = [np.unique(_pair_hashes(w)) for _, w in items]
        self.pairs = np.zeros(1 << _PAIR_BITS, dtype=np.uint16)
        self.leads = np.zeros(1 << _PAIR_BITS, dtype=np.uint16)
        self.classes = []
        low = 0
        while low < len(items):
            n = len(items[low][1])
            high = low
            while high < len(items) and len(items[high][1]) * 8 <= n * 9:
                high += 1
            bit = np.uint16(1 << len(self.classes) % _CLASS_BITS)
            for own in self.own_pairs[low:high]:
                self.pairs[_slot(own)] |= bit
            for _, w in items[low:high]:
                self.leads[_slot(w[: allowed(len(w)) + 1])] |= bit
            self.classes.append(self._class(low, high) | {"bit": bit})
            low = high

    def _class(self, low: int, high: int) -> dict:
        n, most = len(self.items[low][1]), len(self.items[high - 1][1])
        width = most + allowed(most)
        rng = np.random.Generator(np.random.PCG64(n))
        plan = np.array([np.sort(rng.choice(2 * n, SAMPLED_STEPS, replace=False)) for _ in range(MOST_REPETITIONS)])
        rows = np.zeros((high - low, width), dtype=np.uint64)
        for i in range(low, high):
            rows[i - low, : len(self.items[i][1])] = self.items[i][1]
        copies = self._edited(rows[rng.integers(0, high - low, COPIES)], rng)
        # as found by any repetition so far: copies that are hard to find are so in all of them
        found = np.logical_or.accumulate(_walks(copies[0], plan) == _walks(copies[1], plan), axis=0).mean(axis=1)
        need = max(4, int(np.argmax(found >= TARGET_RECALL)) + 1) if found[-1] >= TARGET_RECALL else 0
        tables = []
        for keys in _walks(rows, plan[:need]) if need else ():
            order = np.argsort(keys, kind="stable")
            tables.append((keys[order], order + low))
        # the bound falls by one at each multiple of 5, so the shortest item need not have the least
        least = min(k - 1 - 2 * allowed(k) for k in range(n, most + 1))
        out = {"n": n, "most": most, "width": width, "least": max(1, least), "plan": plan[:need], "tables": tables, "stride": max(1, n // 8), "low": low}
        return out if tables else out | self._own_pairs(low, high)

    def _own_pairs(self, low: int, high: int) -> dict:
        """The word pairs of a class with the items that have them, and how many of its own each item needs."""
        own = self.own_pairs[low:high]
        pairs, at = np.concatenate(own), np.repeat(np.arange(high - low), [len(x) for x in own])
        order = np.argsort(pairs, kind="stable")
        needs = np.array([len(w) - 1 - 2 * allowed(len(w)) for _, w in self.items[low:high]])
        return {"pairs": pairs[order], "owners": at[order], "needs": needs}

    @staticmethod
    def _edited(rows: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and copies of them with the most edits that are allowed, from where a window of them can begin."""
        out = np.zeros_like(rows)
        for i, row in enumerate(rows):
            words = row[row != 0].tolist()
            for _ in range(allowed(len(words))):
                at, kind = int(rng.integers(0, len(words))), int(rng.integers(0, 3))
                words[at : at + (kind != 0)] = [] if kind == 1 else [int(rng.integers(1, 1 << 62))]
            begin = set(row[: allowed(int(np.count_nonzero(row))) + 1].tolist())
            words = words[next(j for j, w in enumerate(words) if w in begin) :]
            out[i, : len(words)] = words[: rows.shape[1]]
        return rows, out

    def search(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, first word, last word + 1, distance) of the near passages of a slice of documents."""
        total = len(words)
        if not total or not self.items:
            return
        yield from self._exact(words, first)
        hashes = _pair_hashes(words)
        pair = np.zeros(total, dtype=np.uint16)
        pair[:-1] = self.pairs[_slot(hashes)]
        pair[first[1:-1][(first[1:-1] > 0) & (first[1:-1] <= total)] - 1] = 0
        lead = self.leads[_slot(words)]
        hits = np.zeros(total + 1, dtype=np.int32)
        for c in self.classes:
            np.cumsum((pair & c["bit"]) != 0, out=hits[1:])
            grid = np.arange(0, total, c["stride"])
            reach = np.minimum(grid + c["stride"] + c["width"], total)
            near = grid[hits[reach] - hits[grid] >= c["least"]]
            if not len(near):
                continue
            if not c["tables"]:
                yield from self._compare(c, words, first, near)
                continue
            starts = np.unique((near[:, None] + np.arange(c["stride"])[None, :]).ravel())
            starts = starts[starts < total]
            starts = starts[((lead[starts] & c["bit"]) != 0) & (hits[np.minimum(starts + c["width"], total)] - hits[starts] >= c["least"])]
            doc = np.searchsorted(first, starts, side="right") - 1
            stop = first[doc + 1]
            keep = stop - starts >= c["n"] - allowed(c["n"])
            starts, doc, stop = starts[keep], doc[keep], stop[keep]
            yield from self._probe(c, words, hashes, first, starts, doc, stop)

    def _exact(self, words, first) -> Iterator[tuple[int, int, int, int, int]]:
        """The first place of each short item in each document."""
        for m, keys, items in self.short:
            hashes = _run_hashes(words, m)
            lo, hi = np.searchsorted(keys, hashes, side="left"), np.searchsorted(keys, hashes, side="right")
            at = np.flatnonzero(hi > lo)
            rows = np.searchsorted(first, at, side="right") - 1
            inside = at + m <= first[rows + 1]
            seen = set()
            for x, row in zip(at[inside].tolist(), rows[inside].tolist(), strict=True):
                for item in items[lo[x] : hi[x]].tolist():
                    if (row, item) not in seen:
                        seen.add((row, item))
                        yield row, item, x - int(first[row]), x + m - int(first[row]), 0

    def _compare(self, c: dict, words, first, near) -> Iterator[tuple[int, int, int, int, int]]:
        """The passages that begin in the blocks at near, without sampling."""
        for start in near.tolist():
            end = min(start + c["stride"] + c["width"], len(words))
            row = int(np.searchsorted(first, start, side="right")) - 1
            while row < len(first) - 1 and first[row] < end:
                a, b = max(int(first[row]), start), min(int(first[row + 1]), end)
                hashes = _pair_hashes(words[a:b])
                lo, hi = np.searchsorted(c["pairs"], hashes, side="left"), np.searchsorted(c["pairs"], hashes, side="right")
                owners = [c["owners"][x:y] for x, y in zip(lo, hi, strict=True) if y > x]
                count = np.bincount(np.concatenate(owners), minlength=len(c["needs"])) if owners else np.zeros(len(c["needs"]), dtype=np.int64)
                for i in np.flatnonzero(count >= c["needs"]).tolist():
                    item = c["low"] + i
                    n = len(self.items[item][1])
                    distance, at = edit_search(self.patterns[item], n, words[a:b].tolist())
                    if distance <= allowed(n):
                        yield row, item, *self._passage(item, words, int(first[row]), (distance, a, a + at)), distance
                row += 1

    def _probe(self, c: dict, words, hashes, first, starts, doc, stop) -> Iterator[tuple[int, int, int, int, int]]:
        """The nearest passage of each item and document around the windows that meet the item."""
        found: dict[tuple[int, int], list[int]] = {}
        size = max(1, PROBE_BYTES // (8 * c["width"] * len(c["plan"])))
        for z in range(0, len(starts), size):
            at = starts[z : z + size, None] + np.arange(c["width"])[None, :]
            tokens = np.where(at < stop[z : z + size, None], words[np.minimum(at, len(words) - 1)], _U(0))
            for got, (keys, items) in zip(walk_keys(tokens, c["plan"]), c["tables"], strict=True):
                lo, hi = np.searchsorted(keys, got, side="left"), np.searchsorted(keys, got, side="right")
                for x in np.flatnonzero(hi > lo).tolist():
                    for item in items[lo[x] : hi[x]].tolist():
                        found.setdefault((item, int(doc[z + x])), []).append(int(starts[z + x]))
        for (item, row), places in found.items():
            n = len(self.items[item][1])
            k = allowed(n)
            begin, end = int(first[row]), int(first[row + 1])
            own = self.own_pairs[item]
            places = sorted(set(places))
            a, b = max(begin, places[0] - k), min(end, places[0] + n + 2 * k)
            best = None
            # windows that overlap are searched as one
            for start in [*places[1:], None]:
                if start is not None and start - k <= b:
                    b = min(end, start + n + 2 * k)
                    continue
                met = hashes[a : b - 1]
                near = np.minimum(np.searchsorted(own, met), len(own) - 1)
                if np.count_nonzero(own[near] == met) >= n - 1 - 2 * k:
                    distance, stop_at = edit_search(self.patterns[item], n, words[a:b].tolist())
                    if distance <= k and (best is None or distance < best[0]):
                        best = distance, a, a + stop_at
                if start is not None:
                    a, b = max(begin, start - k), min(end, start + n + 2 * k)
            if best:
                yield row, item, *self._passage(item, words, begin, best), best[0]

    def _passage(self, item: int, words, begin: int, best: tuple[int, int, int]) -> tuple[int, int]:
        """Where the passage begins and ends in its document, of which the first word is begin."""
        _, low, end = best
        own = self.items[item][1].tolist()
        low = max(low, end - len(own) - allowed(len(own)))
        return low + passage_start(own, words[low:end].tolist()) - begin, end - begin


def _passes(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """The indexes of the items, each with whether it is the only one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    parts = max(1, -(-items.count() // ITEMS_PER_PASS))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield Index([r.item_id for r in rows], [r.text for r in rows]), parts == 1


def _search(index, keep_all: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            ids, texts = batch.column(names.index("doc_id")), batch.column(names.index("text"))
            marked = np.zeros(batch.num_rows, dtype=bool)
            hits: list[tuple] = []
            for a, b, data, offsets in slices(texts):
                words, first = word_hashes(data, offsets)
                for row, item, start, end, distance in index.value.search(words, first):
                    marked[a + row] = True
                    hits.append((a + row, index.value.items[item][0], start, end, distance))
            if keep_all:
                yield batch.filter(pa.array(~marked))
                continue
            columns = list(zip(*hits, strict=True)) or [()] * 5
            at = pa.array(columns[0], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), *(pa.array(x, t) for x, t in zip(columns[1:], [pa.int64()] * 3 + [pa.int32()], strict=True))], names=["doc_id", "item_id", "first_word", "last_word", "distance"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and the nearest passage (words first_word to last_word, end exclusive, and its distance).

    One row for each document and item with a passage within the distance; the
    documents without one have no row. Null or empty texts and items match
    nothing; a null doc_id stays null (its
    rows are told apart by item only); other columns are ignored; an empty
    table on either side gives no row; repeated documents give equal rows once.
    """
    spark: SparkSession = docs.sparkSession
    rows = in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    out = None
    for index, alone in _passes(benchmark):
        sent = spark.sparkContext.broadcast(index)
        found = rows.mapInArrow(_search(sent, False), HITS)
        if not alone:  # one index at a time, on the driver too
            found = durable(found)
            sent.destroy()
        out = found if out is None else out.union(found)
    best = F.min(F.struct("distance", "first_word", "last_word")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.first_word", "b.last_word", "b.distance")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text has no near passage of the benchmark."""
    rows = in_small_batches(docs)
    for index, alone in _passes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        rows = rows.mapInArrow(_search(sent, True), docs.schema)
        if not alone:
            rows = durable(rows)
            sent.destroy()
    return rows
