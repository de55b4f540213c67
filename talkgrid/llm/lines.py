"""Line deduplication by an exact set-similarity join, with SQL functions only.

A line is the set of its lower-cased words. Words are ordered by rarity (their
corpus frequency, counted in BUCKETS hash buckets, then their hash), which is a
global order. Two sets of sizes a and b with a Jaccard index of at least 9/10
share a word among the first a - ceil(0.9 a) + 1 of one and the first
b - ceil(0.9 b) + 1 of the other, so lines meet on these prefix words. Length
and position filters and a parity sketch, whose Hamming distance is at most the
symmetric difference, come before the exact test on the sets. Semi-joins stop
at a line's first match, so no group is expanded into its pairs. Two different
sets of fewer than 9 and 10 words are never similar enough, so smaller lines,
down to a single word, meet as equal sets only.

A line is removed when an earlier line, by doc_id and line number, is similar;
it does not matter whether that line is removed itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrid.session import durable

#: Similar lines have a Jaccard index of at least NUM / DEN.
NUM, DEN = 9, 10
#: Word frequencies are counted in so many hash buckets, a bounded table.
BUCKETS = 1 << 16
#: Ranks are so few that the JVM keeps their boxed values.
RANKS = 128
#: Up to so many texts with lines to compare are told to all tasks by 8 bytes each; more of them are joined.
BROADCAST_TEXTS = 1 << 21
_HASH_BITS = 51
_MASK = (1 << _HASH_BITS) - 1
# What separates words in a line, besides a space.
_SPACES = "\t\x0b\x0c\r"


def _spaced(text: Column) -> Column:
    """Lower-cased text with one kind of space in its lines; replacing scans bytes and mostly finds nothing."""
    text = F.lower(text)
    for c in _SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _words(spaced: Column) -> Column:
    """The words in order, through a one-character split only."""
    return F.array_remove(F.split(spaced, " "), "")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _ranks(rows: DataFrame) -> Column:
    """A literal array of each bucket's rank by how many words of the corpus it holds, a third of a doubling a step.

    Any ranks give the same result, these a fast one: rare kinds of space are not
    told from words, and what is empty between two spaces counts as a word.
    """
    text = F.lower("text")
    for c in "\n\t\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    # outer generators, as the optimizer evaluates the argument of the others twice
    words = rows.select(F.explode_outer(F.split(text, " ")).alias("w"))
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.count("*").alias("n"))
    ranked = counts.select("b", F.least(F.lit(RANKS - 1), F.floor(F.log2("n") * 3)).alias("r"))
    # at most BUCKETS rows, kept as one literal; its text stands in every plan that the driver holds, so the numbers are short
    table = [0] * BUCKETS
    for row in ranked.collect():
        table[row.b] = row.r
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def _tokens(line: Column, ranks: Column) -> Column:
    """Sorted values of a line's words: the rank in the high bits, the hash below."""
    # never null, so that the values are sorted without boxing
    rank = lambda h: F.coalesce(F.get(ranks, _bucket(h)), F.lit(0).cast("long"))
    value = lambda h: F.shiftleft(rank(h), _HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit(_MASK)))
    return F.sort_array(F.transform(F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))), value))


def _parity(tokens: Column) -> Column:
    """A 64-bit parity sketch: each word flips one bit."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))


def _earlier(a: str, b: str) -> Column:
    order = lambda t: F.struct(*[F.col(f"{t}.{c}") for c in ("doc_id", "line_no", "sh")])
    return order(a) < order(b)


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and removed, the sorted numbers (from 0) of the lines to remove; documents without any have no row.

    Null texts have no lines; lines without a word stay; a null doc_id comes before
    all others; rows with equal doc_id and text count as one document; of lines
    at one position of different texts with equal doc_id a hash decides; other
    columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    spaced = rows.select("doc_id", F.xxhash64("text").alias("th"), _spaced(F.col("text")).alias("text"))
    ranks = _ranks(rows)
    lines = spaced.select("doc_id", "th", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    # generated, so that the filter is not pushed below it and the sets are made once
    sets = lines.select("doc_id", "th", "line_no", F.explode_outer(F.array(_tokens(F.col("line"), ranks))).alias("tokens")).where(F.size("tokens") > 0)
    n = F.size("tokens")
    prefix = n - F.ceil(n * NUM / DEN).cast("int") + 1
    joins = n * 2 + 1 >= (DEN + NUM) // (DEN - NUM)
    described = durable(
        sets.select(
            "doc_id", "th", "line_no", F.xxhash64("tokens").alias("sh"), n.alias("n"),
            F.when(joins, F.slice("tokens", F.lit(1), prefix)).alias("prefix"),
            F.when(joins, _parity(F.col("tokens"))).alias("x"),
        )
    )
    first = F.min(F.struct("doc_id", "line_no", "th", "prefix", "x")).alias("f")
    classes = durable(described.groupBy("sh", "n").agg(first, F.count("*").alias("lines")).select("sh", "n", "lines", "f.*"))
    buckets = classes.where("prefix is not null").select("sh", "n", "doc_id", "line_no", "x", F.posexplode("prefix").alias("i", "token"))

    def fits(s: str, r: str) -> Column:
        """In whole numbers, and the dearest test last: most rows of a token meet only themselves."""
        sizes = F.col(f"{s}.n") + F.col(f"{r}.n")
        left_over = F.least(F.col(f"{s}.n") - F.col(f"{s}.i"), F.col(f"{r}.n") - F.col(f"{r}.i"))
        return (
            (F.col(f"{s}.token") == F.col(f"{r}.token"))
            & ((F.col(f"{s}.sh") != F.col(f"{r}.sh")) | (F.col(f"{s}.n") != F.col(f"{r}.n")))
            & (DEN * F.least(f"{s}.n", f"{r}.n") >= NUM * F.greatest(f"{s}.n", f"{r}.n"))
            & ((NUM + DEN) * left_over >= NUM * sizes)
            & ((NUM + DEN) * F.bit_count(F.col(f"{s}.x").bitwiseXOR(F.col(f"{r}.x"))) <= (DEN - NUM) * sizes)
        )

    # whoever has a partner here is one, so these rows are both sides of the exact join
    near = durable(buckets.alias("s").join(buckets.alias("r"), fits("s", "r"), "left_semi"))
    tokens = _tokens_again(spaced, classes.join(near.select("sh", "n").distinct(), ["sh", "n"], "left_semi"), ranks)
    full = near.join(tokens, ["sh", "n"])
    shared = F.size(F.array_intersect("s.tokens", "r.tokens"))
    exact = fits("s", "r") & _earlier("r", "s") & (DEN * shared >= NUM * (F.col("s.n") + F.col("r.n") - shared))
    similar = full.alias("s").join(full.alias("r"), exact, "left_semi").select("sh", "n").distinct()

    # the classes that lose a line, so that the lines of a common one are joined and not grouped
    marked = classes.join(similar.withColumn("near", F.lit(True)), ["sh", "n"], "left").where("near or lines > 1")
    marked = durable(marked.select("sh", "n", F.col("doc_id").alias("d"), F.col("line_no").alias("l"), F.coalesce("near", F.lit(False)).alias("near")))
    again = ~(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line_no") == F.col("l")))
    return (
        described.select("doc_id", "th", "line_no", "sh", "n")
        .join(marked, ["sh", "n"])
        .where(F.col("near") | again)
        .groupBy("doc_id", "th")
        .agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    )


def _tokens_again(spaced: DataFrame, classes: DataFrame, ranks: Column) -> DataFrame:
    """sh, n and tokens of classes, from the texts of their first lines."""
    wanted = durable(classes.groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("numbers")))
    if wanted.count() <= BROADCAST_TEXTS:
        spaced = spaced.join(F.broadcast(wanted.select("th")), "th", "left_semi")
    x, w = spaced.alias("x"), wanted.alias("w")
    texts = x.join(w, F.col("x.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("x.th") == F.col("w.th"))).select("text", "numbers")
    # generated, so that each text is split once
    split = texts.select("numbers", F.explode_outer(F.array(F.split("text", "\n"))).alias("lines"))
    again = split.select(F.explode_outer(F.transform("numbers", lambda i: F.get("lines", i))).alias("line"))
    tokens = again.select(_tokens(F.col("line"), ranks).alias("tokens")).select(F.xxhash64("tokens").alias("sh"), F.size("tokens").alias("n"), "tokens")
    return durable(tokens.dropDuplicates(["sh", "n"]))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without the removed lines; a document that loses all its lines with a word goes, and so do no others.

    Null texts and texts without a word stay as they are; repeated rows are cut
    alike; columns of any name are kept.
    """
    x, y = docs.alias("x"), removed_lines(docs).alias("y")
    lines = F.filter(F.split("x.text", "\n"), lambda _, i: ~F.array_contains(F.col("y.removed"), i))
    left = F.array_join(lines, "\n")
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.xxhash64(F.col("x.text").cast("string")) == F.col("y.th"))
    rows = x.join(y, same, "left").where(F.col("y.removed").isNull() | left.rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(F.col("y.removed").isNull(), F.col("x.text")).otherwise(left)
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"x.`{c}`").alias(c) for c in docs.columns])
