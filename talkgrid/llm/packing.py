"""Harmonic packing of tokenised documents into fixed-length sequences.

A piece whose length lies in (capacity / (k + 1), capacity / k] is in class k,
and every bin of class k takes exactly k pieces, so a worker fills its bins
without knowing any other worker's. Documents are cut first: whole capacities,
then a few pieces at the upper edge of a class, where a full bin wastes least.
What a worker cannot fill goes on to fewer and fewer groups, and the pieces of
the last unfilled bin of each class, a bounded rest, are placed together.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.llm._arrow import in_small_batches
from talkgrid.session import durable

CAPACITY = 2048
END_ID = 1
# Strings that are single ids of the vocabulary wherever a text holds them.
ADDED = {"<|endoftext|>": 50256}
#: A document's rest is cut into at most so many pieces.
REST_PIECES = 3
#: Groups of leftovers that meet in one group of the next level.
FAN_IN = 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class_k int, sequence_id long, offset long, grp int, ord long"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The byte-level BPE of a public vocabulary; ids equal those of the tokenizers library for the same file."""
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(vocabulary.removesuffix(".json") + ".tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def token_ids(text: str | None, vocabulary: str) -> np.ndarray:
    """A document's ids with the end id."""
    ids = encoder(vocabulary).encode(text or "", allowed_special="all")
    ids.append(END_ID)
    return np.array(ids, dtype="<u4")


def cuts(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document, in order.

    A rest is cut at the upper edge of the next smaller class until a full bin
    of what is left would waste at most a 64th of it, or it has REST_PIECES.
    """
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    pieces = 1
    while rest:
        k = capacity // rest
        if pieces == REST_PIECES or capacity - k * rest <= k * (rest // 64):
            return [*out, rest]
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
        pieces += 1
    return out


class _Bins:
    """Open bins by class; full ones are given out."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next, self.open = capacity, base, {}

    def add(self, row: list) -> list[list]:
        k = self.capacity // row[2]
        held = self.open.setdefault(k, [])
        held.append(row)
        if len(held) < k:
            return []
        del self.open[k]
        offset = 0
        for r in held:
            r[6], r[7] = self.next, offset
            offset += r[2]
        self.next += 1
        return held


def _to_batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(10)]
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class_k", "sequence_id", "offset", "grp", "ord"])


def _first_level(capacity: int, vocabulary: str):
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        bins, order = _Bins(capacity, part << 32), 0
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_ids(text, vocabulary)
                start = 0
                for n in cuts(len(ids), capacity):
                    crc = zlib.crc32(ids[start : start + n].tobytes())
                    out += bins.add([doc_id, start, n, crc, len(ids), capacity // n, None, None, part, order])
                    start += n
                    order += 1
            yield _to_batch(out)
        yield _to_batch([r for held in bins.open.values() for r in held])

    return run


def _next_level(capacity: int, level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        bins, out = _Bins(capacity, (level << 58) | (part << 32)), []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += bins.add(list(row))
            yield _to_batch(out)
            out = []
        rest = [r for held in bins.open.values() for r in held]
        yield _to_batch(_first_fit(rest, capacity, bins.next) if last else rest)

    return run


def _first_fit(rows: list[list], capacity: int, base: int) -> list[list]:
    """The last unfilled bin of each class together, longest piece first.

    There is at most one such bin a class, so the rows are bounded by the
    capacity and not by the corpus.
    """
    rooms: list[int] = []
    for r in sorted(rows, key=lambda r: (-r[2], r[8], r[9])):
        at = next((i for i, room in enumerate(rooms) if room >= r[2]), len(rooms))
        if at == len(rooms):
            rooms.append(capacity)
        r[6], r[7] = base + at, capacity - rooms[at]
        rooms[at] -= r[2]
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Pieces of all documents with their sequence and their place in it.

    Null texts are empty and give the end id alone; a null doc_id stays null;
    repeated rows are separate documents; other columns are ignored; an empty
    table gives no piece. Sequence ids are unique, not consecutive.
    """
    spark = docs.sparkSession
    rows = in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    packed = durable(rows.mapInArrow(_first_level(capacity, vocabulary), PIECES))
    done, left = [packed.where("sequence_id is not null")], packed.where("sequence_id is null")
    groups, level = max(1, packed.rdd.getNumPartitions()), 1
    while True:
        groups = -(-groups // FAN_IN)
        # by group, so that each task holds what FAN_IN tasks of the level before have left
        left = left.withColumn("grp", (F.col("grp") / FAN_IN).cast("int"))
        dealt = left.repartition(groups, "grp").sortWithinPartitions("class_k", "ord", "doc_id", "start")
        if groups == 1:
            done.append(dealt.coalesce(1).mapInArrow(_next_level(capacity, level, True), PIECES))
            break
        step = durable(dealt.mapInArrow(_next_level(capacity, level, False), PIECES))
        done.append(step.where("sequence_id is not null"))
        left = step.where("sequence_id is null")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class_k")
