"""Risk-controlled quality rules, with SQL functions only.

Each rule rejects a document whose statistic exceeds a cutoff. Cutoffs are
chosen per stratum on labelled documents. Those are allowed whose count of
rejected good documents is so small that, by the exact binomial tail, a false
rejection rate above RISK / rules has a probability of at most
ERROR / (rules * strata) of giving it (Bonferroni). Allowed cutoffs are nested,
so the choice among them is free: it goes to the one that catches most bad
documents for the good ones that it loses. A stratum with too few labels gets
no cutoff and rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.llm._scan import bind
from talkgrid.session import durable

#: False rejections of good documents by all rules together, and the chance that a cutoff breaks its part of it.
RISK, ERROR = 0.02, 0.05
#: A share of the good documents that is lost weighs as much as so large a share of the bad ones that is caught.
GOOD_WEIGHT = 5
#: Statistics are compared in thousandths, beyond so many of them in steps of a thousandth of their size.
FINE = 20_000
WINDOW = 5
#: Tables of cutoffs up to so many rows are broadcast; larger ones are joined.
BROADCAST_ROWS = 10_000

# What a word and a symbol is.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_SPACE_RUN = r"[\x20\x09-\x0D]+"


def _repeat_words(words: Column) -> Column:
    """Words inside a window of WINDOW words that the text has twice or more; windows are told apart by 64-bit hashes."""

    def covered(grams: Column) -> Column:
        ranked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def positions(r: Column) -> Column:
            again = F.filter(r, lambda x, i: F.coalesce(F.get(r, i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(r, i + 1)["g"] == x["g"], F.lit(False)))
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        def total(p: Column) -> Column:
            parts = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return bind(bind(ranked, positions), total)

    def of_hashes(h: Column) -> Column:
        grams = F.transform(F.slice(h, F.lit(1), F.size(h) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
        return bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(bind(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of each row of docs; null texts have no words; a null stratum stays null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.col(stratum).cast("string").alias("stratum"), text.alias("t"))
    rows = rows.withColumn("words", F.filter(F.split("t", _SPACE_RUN), lambda w: w != "")).withColumn(
        "lines", F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    )
    return rows.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _thousandths(top: str, bottom: str) -> Column:
    v = F.floor(1000 * F.col(top) / F.greatest(F.col(bottom), F.lit(1))).cast("long")
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(v, F.lit(1)))) - 3).cast("long")
    return F.when(v <= FINE, v).otherwise(v - v % F.greatest(step, F.lit(1)))


#: Rules by name: a statistic that is larger for worse documents.
RULES = {
    "symbols": lambda: _thousandths("n_symbols", "word_chars"),
    "dup_lines": lambda: _thousandths("n_dup_lines", "n_lines"),
    "repeats": lambda: _thousandths("n_repeat_words", "n_words"),
    "long_words": lambda: _thousandths("word_chars", "n_words"),
    "short_words": lambda: _thousandths("n_words", "word_chars"),
}


def allowed_rejections(n: Column, risk: float, error: Column) -> Column:
    """The most false rejections k among n with P(Binomial(n, risk) <= k) <= error, or -1."""
    log_error = F.log(error)
    odds = F.lit(risk / (1 - risk))
    start = n * F.log(F.lit(1 - risk))
    first = F.struct(start.alias("p"), start.alias("c"), F.when(start <= log_error, 0).otherwise(-1).cast("long").alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] + F.log((n - i + 1) / i * odds)
        high, low = F.greatest(acc["c"], p), F.least(acc["c"], p)
        c = high + F.log1p(F.exp(low - high))
        return F.struct(p.alias("p"), c.alias("c"), F.when(c <= log_error, i).otherwise(acc["k"]).alias("k"))

    # beyond the mean the tail is about a half and no longer under any error
    steps = F.filter(F.sequence(F.lit(0).cast("long"), F.ceil(n * risk)), lambda i: i > 0)
    return F.aggregate(steps, first, step, lambda acc: acc["k"])


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, rule, n (good labelled documents), allowed, cutoff; one row for each that can be controlled."""
    judged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    # a labelled document counts once a stratum, however often its row is repeated; of different rows the worst values count
    values = {k: F.max(v()).alias(k) for k, v in RULES.items()}
    held = stats.where(~F.col("base_failed")).join(judged, "doc_id").groupBy("stratum", "doc_id", "q").agg(*values.values())
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("value")) for k in RULES]))
    counts = held.select("stratum", "q", values.alias("v")).groupBy("stratum", "v.rule", "v.value")
    counts = durable(counts.agg(F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") != 1).alias("bad")))
    totals = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.sum("bad").alias("n_bad"))
    strata = max(1, totals.select("stratum").distinct().count())
    each = totals.withColumn("allowed", allowed_rejections(F.col("n"), risk / len(RULES), F.lit(error / len(RULES) / strata)))
    # at most FINE rows and 9,000 for each power of ten beyond, for each stratum and rule
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select("stratum", "rule", "value", *[F.coalesce(F.sum(k).over(above), F.lit(0)).alias(k) for k in ("good", "bad")])
    gain = F.col("bad") / F.greatest("n_bad", F.lit(1)) - GOOD_WEIGHT * F.col("good") / F.greatest("n", F.lit(1))
    r, e = ranked.alias("r"), each.where("allowed >= 0").alias("e")
    return (
        r.join(e, F.col("r.stratum").eqNullSafe(F.col("e.stratum")) & (F.col("r.rule") == F.col("e.rule")))
        .select("r.*", "n", "n_bad", "allowed")
        .where("good <= allowed")
        .withColumn("gain", gain)
        .where("gain > 0")
        .groupBy("stratum", "rule")
        .agg(F.max("n").alias("n"), F.max("allowed").alias("allowed"), F.max(F.struct("gain", "value"))["value"].alias("cutoff"))
    )


def filter_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules.

    Null texts have no words and fail; a null stratum is one of its own;
    repeated rows are judged alike and count once where cutoffs are chosen;
    labels of one document count once, and as good only if all are; other
    columns are ignored; without labels only the base rules reject; an empty
    table gives no row.
    """
    stats = durable(statistics(docs, stratum))
    limits = durable(cutoffs(stats, labels).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits")))
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    over = F.array_compact(F.array(*[F.when(v() > F.col("limits")[k], F.lit(k)) for k, v in RULES.items()]))
    x, y = stats.alias("x"), limits.alias("y")
    return x.join(y, F.col("x.stratum").eqNullSafe(F.col("y.stratum")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(over) == 0)).alias("kept"),
        over.alias("failed_rules"),
    )
