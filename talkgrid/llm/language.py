"""Multilingual mixture inference of a document's language proportions.

Each language has a smoothed distribution of byte 4-grams within words, learned
from labelled documents. A word's likelihood under a language is the product
over its 4-grams. Expectation-maximisation estimates the document's language
proportions; of the nested sets of its likeliest languages the one with the
best penalised likelihood (half a logarithm of the number of words for each
language) is kept, and the largest proportion in it is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrid.llm._arrow import in_small_batches, unused
from talkgrid.llm._words import _LOWER, slices

#: The model is fitted on about so many labelled documents of each language, chosen by a hash of doc_id.
SAMPLE_PER_LANGUAGE = 2000
BINS = 1 << 16
SMOOTHING = 0.5
#: Rounds of a document go on until none of its proportions moves by more.
STILL = 1e-3
UNKNOWN = "und"
#: Labels that a model can tell apart; more of them are an error, as its table of BINS for each is sent to all workers.
MOST_LABELS = 1000
_SPACE = np.uint32(32)

_LETTERS = _LOWER.copy()
_LETTERS[:128] = np.where((_LETTERS[:128] >= 97) & (_LETTERS[:128] <= 122), _LETTERS[:128], 32)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 4-gram bin at each byte of a word or before one, the word of each such byte, and the first word of each document."""
    n = len(data)
    x = np.full(n + 4 + len(offsets), 32, dtype=np.uint8)
    shift = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) + 1  # a space before each document
    x[np.arange(n) + shift] = _LETTERS[data]
    space = x == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:])  # the byte before each word
    word = np.cumsum(space[:-1] & ~space[1:]) - 1
    a, b, c, d = (x[k : len(x) - 3 + k].astype(np.uint32) for k in range(4))
    c = np.where(space[1 : len(x) - 2] & True, _SPACE, c)
    d = np.where(space[1 : len(x) - 2] | space[2 : len(x) - 1], _SPACE, d)
    gram = a | b << np.uint32(8) | c << np.uint32(16) | d << np.uint32(24)
    use = ~(space[: len(gram)] & space[1 : len(gram) + 1])
    gram = gram[use] * np.uint32(0x9E3779B1)
    word = word[: len(use)][use]
    at = offsets + np.arange(len(offsets))
    return ((gram ^ gram >> np.uint32(15)) >> np.uint32(3)) & np.uint32(BINS - 1), word, np.searchsorted(starts, at)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # BINS x languages, log likelihoods

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gram, word, first = _grams(data, offsets)
        count = int(word[-1]) + 1 if len(word) else 0
        out = np.stack([np.bincount(word, weights=s[gram], minlength=count) for s in self.scores.T], axis=1) if count else np.zeros((0, len(self.languages)))
        return out, first

    def proportions(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents x languages; 0 in all languages for a document without words."""
        scores, first = self.words(data, offsets)
        docs, languages = len(first) - 1, len(self.languages)
        out = np.zeros((docs, languages))
        counts = np.diff(first)
        live = np.flatnonzero(counts)
        if not len(live):
            return out
        doc = np.repeat(np.arange(len(live)), counts[live])
        at = np.concatenate([[0], np.cumsum(counts[live])[:-1]])
        top = scores.max(axis=1, keepdims=True)
        likely = np.exp(scores - top)
        base = np.add.reduceat(top[:, 0], at)
        single = np.add.reduceat(scores, at, axis=0)
        shares, total = _em(likely, doc, at, np.full((len(live), languages), 1 / languages))
        penalty = 0.5 * np.log(counts[live] + 1.0)
        best = single.max(axis=1)
        chosen = np.zeros((len(live), languages), dtype=bool)
        chosen[np.arange(len(live)), single.argmax(axis=1)] = True
        out[live] = shares
        # documents that no mixture could explain enough better stay with one language
        open_docs = np.flatnonzero(base + total - best > penalty)
        if len(open_docs) and languages > 1:
            pick = np.isin(doc, open_docs)
            sub_doc = np.searchsorted(open_docs, doc[pick])
            n = counts[live][open_docs]
            sub_at = np.concatenate([[0], np.cumsum(n)[:-1]])
            order = np.argsort(-shares[open_docs], axis=1, kind="stable")
            value = best[open_docs] - penalty[open_docs]
            for k in range(2, languages + 1):
                inside = np.zeros((len(open_docs), languages), dtype=bool)
                np.put_along_axis(inside, order[:, :k], True, axis=1)
                part, ll = _em(likely[pick], sub_doc, sub_at, inside / k)
                now = base[open_docs] + ll - k * penalty[open_docs]
                better = now > value
                value = np.where(better, now, value)
                chosen[open_docs[better]] = inside[better]
                out[live[open_docs[better]]] = part[better]
        out[live] *= chosen
        return out


def _em(likely: np.ndarray, doc: np.ndarray, at: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document and the logarithm of its likelihood; documents that have converged leave the rounds."""
    n = np.diff(np.append(at, len(doc)))
    shares = shares.copy()
    live, rows, own = np.arange(len(n)), likely, doc
    while len(live):
        parts = rows * shares[live][own]
        parts /= np.maximum(parts.sum(axis=1, keepdims=True), 1e-300)
        begins = np.concatenate([[0], np.cumsum(n[live])[:-1]])
        now = np.add.reduceat(parts, begins, axis=0) / n[live][:, None]
        moving = np.abs(now - shares[live]).max(axis=1) > STILL
        shares[live] = now
        stay = moving[own]
        rows, live = rows[stay], live[moving]
        own = np.repeat(np.arange(len(live)), n[live])
    total = np.log(np.maximum((likely * shares[doc]).sum(axis=1), 1e-300))
    return shares, np.add.reduceat(total, at)


def fit(docs: DataFrame, usable: Column | None = None) -> Model:
    """A model of the languages in docs.lang, from the rows where usable holds and lang is not null."""
    rows = docs.where("lang is not null and text is not null")
    rows = (rows if usable is None else rows.where(usable)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages are labelled")
    languages = tuple(sorted(counts))
    if not languages:
        return Model((), np.zeros((BINS, 0)))
    chance = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, SAMPLE_PER_LANGUAGE / n))) for k, n in counts.items()])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < chance * 1_000_003).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(languages), BINS), dtype=np.int64)
        for batch in batches:
            own = np.array([languages.index(x) for x in batch.column(0).to_pylist()])
            for a, b, data, offsets in slices(batch.column(1)):
                gram, word, first = _grams(data, offsets)
                doc = np.searchsorted(first, word, side="right") - 1
                held += np.bincount(own[a:b][doc] * BINS + gram, minlength=held.size).reshape(held.shape)
        lang, gram = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(gram), pa.array(held[lang, gram])], names=["l", "g", "n"])

    # at most BINS rows for each language; languages are the values of a label
    summed = in_small_batches(sample).mapInArrow(run, "l long, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((BINS, len(languages)))
    table[summed["g"].to_numpy(), summed["l"].to_numpy()] = summed["n"].to_numpy()
    return Model(languages, np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * BINS)))


def _predict(model, letters_at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.value.languages, UNKNOWN], dtype=object)
        for batch in batches:
            flag = batch.schema.names.index(letters_at)
            letters = np.array(batch.column(flag).fill_null(False))
            lang, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            for a, b, data, offsets in slices(batch.column(batch.schema.names.index("text"))) if len(names) > 1 else ():
                shares = model.value.proportions(data, offsets)
                lang[a:b] = shares.argmax(axis=1)
                score[a:b] = shares.max(axis=1)
            lang[~letters] = len(names) - 1
            score[~letters] = 0
            kept = [(n, c) for k, (n, c) in enumerate(zip(batch.schema.names, batch.columns, strict=True)) if k != flag]
            kept += [("lang_pred", pa.array(names[lang], pa.string())), ("lang_score", pa.array(np.clip(score, 0, 1)))]
            yield pa.RecordBatch.from_arrays([c for _, c in kept], names=[n for n, _ in kept])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and lang_score (the share of that language) after its columns.

    Null texts and texts without a letter are UNKNOWN with score 0, as is every
    text when the model has no language; ties go to the first language by name;
    repeated rows are predicted alike; columns named lang_pred and lang_score
    are replaced, those of any other name are kept; an empty table gives no row.
    """
    own = docs.drop("lang_pred", "lang_score")
    letters = unused("letters", own.columns)
    asked = own.withColumn(letters, F.col("text").rlike(r"\p{L}"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields) + ", lang_pred string, lang_score double"
    return in_small_batches(asked).mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), letters), schema)
