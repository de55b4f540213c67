"""Exact substring deduplication by deep-shallow suffix sorting.

Every byte goes that is covered by a string of WIDTH bytes which also starts
anywhere else. The string at a start is found through its anchor, the least of
its hashed K-grams: equal strings have equal anchors at equal offsets, so only
suffixes that begin at anchors are sorted (a sparse suffix array), in groups of
one K-gram. Consecutive starts with one anchor form a run; a run whose whole
text occurs twice is settled by a count. What is left is sorted within its
group: multikey quicksort on 8-byte words to a shallow depth, then blind tries
for the groups with longer common prefixes, once to the right of the anchor and
once, reversed, to the left. The common prefixes of both orders give the starts
whose strings are shared.

A group too large for one task is split by one step of distributed multikey
quicksort: all members are compared with one pivot, which settles the starts
that they share with it, and go on in subgroups by where they leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.llm._arrow import in_small_batches
from talkgrid.llm._words import mix, powers, prefix_sums, slices
from talkgrid.session import durable

WIDTH, K = 400, 32
#: Members of a group that one task sorts.
MOST = 1000
#: Words of 8 bytes that multikey quicksort compares before the tries take over.
SHALLOW = 4
_U = np.uint64
_PLACE = _U((1 << 28) - 1)

ANCHORS = "g long, e long, doc_id long, th long, p long, low int, high int"
ITEMS = "kind int, g long, doc_id long, th long, p long, low int, high int, at int, context binary"


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, anchor place, first and last start of each run (places in the slice), the anchor's hash and the run's hash."""
    n = len(data)
    grams = n - K + 1
    windows = n - WIDTH + 1
    if windows <= 0:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    sums = prefix_sums(data)
    _, down = powers(n + 1)
    h = mix((sums[K:] - sums[:-K]) * down[:grams])
    span = WIDTH - K + 1
    packed = np.full(-(-grams // span) * span + span, ~_U(0), dtype=np.uint64)
    packed[:grams] = (h & ~_PLACE) | np.arange(grams, dtype=np.uint64)
    table = packed.reshape(-1, span)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    valid = np.arange(windows) + WIDTH <= offsets[row + 1]
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~valid[1:]
    last = np.flatnonzero(stop)
    p = anchor[first]
    whole = (sums[last + WIDTH] - sums[first]) * down[first]
    shape = (p - first).astype(np.uint64) * _U(1009) + (last - first).astype(np.uint64)
    return row[first], p, first, last, h[p].view(np.int64), mix(mix(whole) + shape).view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes = batch.column(0), batch.column(2)
        for a, _, data, offsets in slices(batch.column(1)):
            row, p, first, last, g, e = runs(data, offsets)
            at = pa.array(row + a)
            columns = [g, e, ids.take(at), hashes.take(at), p - offsets[row], (p - last).astype(np.int32), (p - first).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=["g", "e", "doc_id", "th", "p", "low", "high"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, doc_id, th, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            data = text.encode()
            for w in wanted:
                p, low, high = w["p"], w["low"], w["high"]
                out.append((1, w["g"], doc_id, th, p, low, high, high, data[p - high : p - low + WIDTH]))
        yield _items(out)


def _items(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.int32()] * 3, pa.binary()]
    names = ["kind", "g", "doc_id", "th", "p", "low", "high", "at", "context"]
    columns = list(zip(*rows, strict=True)) or [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return low


def blind_trie(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """members in the order of their strings, and the common prefix of each with the one before (0 for the first).

    Inner nodes hold only a depth and the branching bytes; a string goes down
    blindly to some leaf, is compared with it once, and is hung in where they
    differ. A string that ends at a node sorts before its branches (key -1).
    """
    root: list | int = members[0]

    def byte(s: bytes, d: int) -> int:
        return s[d] if d < len(s) else -1

    for m in members[1:]:
        s, node = strings[m], root
        while isinstance(node, list):
            b = byte(s, node[0])
            node = node[1][b if b in node[1] else next(iter(node[1]))]
        leaf = node if not isinstance(node, tuple) else node[0]
        d = common(s, strings[leaf])
        if d == len(s) == len(strings[leaf]):
            d += 1  # equal strings share a leaf
        parent, node = None, root
        while isinstance(node, list) and node[0] < d:
            parent, node = (node, byte(s, node[0])), node[1][byte(s, node[0])]
        if isinstance(node, list) and node[0] == d:
            node[1][byte(s, d)] = m
            continue
        if d > len(s):
            new: list | tuple = (*node, m) if isinstance(node, tuple) else (node, m)
        else:
            new = [d, {byte(strings[leaf], d): node, byte(s, d): m}]
        if parent is None:
            root = new
        else:
            parent[0][1][parent[1]] = new
    order: list[int] = []
    lcp: list[int] = []
    todo: list[tuple] = [(root, 0)]
    while todo:
        node, d = todo.pop()
        if isinstance(node, list):
            below = sorted(node[1])
            todo += [(node[1][b], node[0]) for b in below[:0:-1]] + [(node[1][below[0]], d)]
        elif isinstance(node, tuple):
            for i, m in enumerate(node):
                order.append(m)
                lcp.append(len(strings[m]) if i else d)
        else:
            order.append(node)
            lcp.append(d)
    return order, lcp


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of strings, and the common prefix of each with the one before it (0 for the first)."""
    order: list[int] = []
    lcp: list[int] = []

    def shallow(members: list[int], depth: int, first: int) -> None:
        """members agree in depth bytes; first is the common prefix with what came before."""
        if len(members) == 1:
            order.append(members[0])
            lcp.append(first)
            return
        if depth >= 8 * SHALLOW:
            o, c = blind_trie(strings, members)
            order.extend(o)
            lcp.extend([first, *c[1:]])
            return
        keys = [strings[m][depth : depth + 8] for m in members]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        parts: tuple[list[int], list[int], list[int]] = ([], [], [])
        for m, k in zip(members, keys, strict=True):
            parts[0 if k < pivot else 1 if k == pivot else 2].append(m)
        before = first
        for part, deeper in zip(parts, (0, 8 if len(pivot) == 8 else 0, 0), strict=True):
            if not part:
                continue
            if part is not parts[0] and order and before is None:
                before = -1  # known when both neighbours are placed
            if deeper or len(part) == 1:
                shallow(part, depth + deeper, -1 if before is None else before)
            elif part is parts[1]:  # equal strings that end here
                for i, m in enumerate(part):
                    order.append(m)
                    lcp.append(len(strings[m]) if i else (-1 if before is None else before))
            else:
                shallow(part, depth, -1 if before is None else before)
            before = None

    shallow(list(range(len(strings))), 0, 0)
    for i in range(1, len(order)):
        if lcp[i] == -1:
            lcp[i] = common(strings[order[i - 1]], strings[order[i]])
    return order, lcp


def _shared(strings: list[bytes]) -> np.ndarray:
    """Common prefixes of all pairs of a bounded group, through its suffix order."""
    order, lcp = deep_shallow(strings)
    m = len(order)
    out = np.zeros((m, m), dtype=np.int32)
    steps = np.array(lcp, dtype=np.int32)
    for i in range(m - 1):
        out[i, i + 1 :] = np.minimum.accumulate(steps[i + 1 :])
    out = np.maximum(out, out.T)
    place = np.empty(m, dtype=np.int64)
    place[order] = np.arange(m)
    return out[place][:, place]


def _intervals(cover: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _solve_group(rows: list[tuple]) -> Iterator[tuple]:
    """Shared offsets of a group's members, as (0, g, doc_id, th, p, low, high)."""
    if len(rows) == 2:
        (x, y) = rows
        right = common(x[7][x[6] :], y[7][y[6] :])
        left = common(x[7][: x[6]][::-1], y[7][: y[6]][::-1])
        for r in rows:
            low, high = max(r[4], WIDTH - right), min(r[5], left)
            if low <= high:
                yield (0, *r[:4], low, high)
        return
    right = _shared([r[7][r[6] :] for r in rows])
    left = _shared([r[7][: r[6]][::-1] for r in rows])
    low = np.maximum(WIDTH - right, 0)
    np.fill_diagonal(low, WIDTH)
    for i, r in enumerate(rows):
        a, b = np.maximum(low[i], r[4]), np.minimum(left[i], r[5])
        ok = a <= b
        cover = np.zeros(WIDTH + 2, dtype=np.int64)
        np.add.at(cover, a[ok], 1)
        np.add.at(cover, b[ok] + 1, -1)
        for x, y in _intervals(np.cumsum(cover) > 0):
            yield (0, *r[:4], x, y)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    out: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            if held and held[0][0] != row[0]:
                out += [(*x, 0, b"") for x in _solve_group(held)] if len(held) > 1 else []
                held = []
            held.append(row)
        yield _items(out)
        out = []
    if len(held) > 1:
        yield _items([(*x, 0, b"") for x in _solve_group(held)])


def _against_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of large groups with their group's pivot: shared offsets of both, and the members' subgroups."""
    for batch in batches:
        out, known = [], set()
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _, g, doc_id, th, p, low, high, at, context, v = row
            if (doc_id, th, p) == (v["doc_id"], v["th"], v["p"]):
                continue
            right = common(context[at:], v["context"][v["at"] :])
            left = common(context[:at][::-1], v["context"][: v["at"]][::-1])
            a, b = max(low, WIDTH - right), min(high, left)
            if a <= b:
                out.append((0, g, doc_id, th, p, a, b, 0, b""))
                a, b = max(v["low"], WIDTH - right), min(v["high"], left)
                if a <= b:
                    known.add((0, g, v["doc_id"], v["th"], v["p"], a, b, 0, b""))
            if left < high:
                out.append((1, _subgroup(g, 0, left, context[at - left - 1]), doc_id, th, p, max(low, left + 1), high, at, context))
            b = min(high, left, WIDTH - right - 1)
            if low <= b:
                out.append((1, _subgroup(g, 1, right, context[at + right]), doc_id, th, p, low, b, at, context))
        yield _items([*out, *known])


def _subgroup(*parts: int) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little", signed=True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text; keeps bytes, as a cut may split a character."""
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            data = (text or "").encode()
            kept, at, removed, n = [], 0, 0, 0
            for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                if a > at or not n:
                    n += 1
                    kept.append(data[at:a])
                    removed += b - a
                    at = b
                elif b > at:
                    removed += b - at
                    at = b
            kept.append(data[at:])
            out.append((doc_id, len(data), removed, n, b"".join(kept)))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans and kept, the bytes that are left.

    Null texts are empty; texts of fewer than WIDTH bytes lose nothing; a
    repeated row is an occurrence elsewhere; a null doc_id is kept; other
    columns are ignored; an empty table gives no row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th")))
    anchors = durable(rows.where(F.octet_length("text") >= WIDTH).mapInArrow(_anchors, ANCHORS))
    # counted before anything is joined, so that copies meet in sums only; what is joined by a key can be split
    first = F.min(F.struct("doc_id", "th", "p", "low", "high"))
    classes = durable(anchors.groupBy("g", "e").agg(F.count("*").alias("n"), first.alias("f")))
    undecided = durable(classes.groupBy("g").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("g"))
    settled = anchors.join(classes.where("n > 1").select("g", "e"), ["g", "e"]).select("doc_id", "th", (F.col("p") - F.col("high")).alias("a"), (F.col("p") - F.col("low") + WIDTH).alias("b"))
    wanted = classes.join(undecided, "g").select("g", "f.*").groupBy("doc_id", "th").agg(F.collect_list(F.struct("g", "p", "low", "high")).alias("wanted"))

    x, w = rows.alias("x"), wanted.alias("w")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))
    texts = x.join(w, same("x", "w")).select("text", "x.doc_id", "x.th", "wanted")
    items = durable(texts.mapInArrow(_contexts, ITEMS).dropDuplicates(["g", "doc_id", "th", "p"]))
    found = []
    while True:
        large = durable(items.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("g"))
        none = large.isEmpty()
        small = items if none else items.join(large, "g", "left_anti").select(*items.columns)
        # by a hash, as a repartition by the key of the join above is left out, and the join's own may be read in another order
        found.append(durable(small.repartition(F.xxhash64("g")).sortWithinPartitions("g").mapInArrow(_solve, ITEMS).select("doc_id", "th", "p", "low", "high")))
        if none:
            break
        big = items.join(large, "g", "left_semi").select(*items.columns)
        pivots = durable(big.groupBy("g").agg(F.min(F.struct("doc_id", "th", "p", "low", "high", "at", "context")).alias("v")))
        step = durable(big.join(pivots, "g").select(*items.columns, "v").mapInArrow(_against_pivot, ITEMS))
        found.append(step.where("kind = 0").select("doc_id", "th", "p", "low", "high").distinct())
        items = step.where("kind = 1")
    spans = settled
    for part in found:
        spans = spans.union(part.select("doc_id", "th", (F.col("p") - F.col("high")).cast("long").alias("a"), (F.col("p") - F.col("low") + WIDTH).cast("long").alias("b")))
    per = durable(spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    y = per.alias("y")
    return x.join(y, same("x", "y"), "left").select("x.doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
