"""Licence families of paragraphs, with SQL functions only over the corpus.

A multinomial logistic regression over word 2- and 3-grams is trained on the
driver, on edited copies of the notices below and on a bounded sample of corpus
paragraphs as the unknown class. Its threshold is calibrated on held-out
paragraphs: the lowest probability that at most FALSE_RATE of the held-out
unknown ones, parts of notices among them, reach. A prediction holds only if a
notice of the family shares CONFIRM of its 2-grams with the paragraph. A
paragraph is a line of the text, or a window of lines without an empty one
between them, as notices are often wrapped. Windows
begin and end where a 2- or 3-gram of a notice does and have at most as many
lines as the longest notice has words. Of windows of one family that overlap the
one that shares most stays, then the shortest, and a window inside one that
shares more goes.

Paragraphs that share no 2-gram with any notice are unknown by construction and
are not scored.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkgrid.llm._scan import running
from talkgrid.session import durable

#: Documents whose paragraphs train the unknown class, those with the least hashes of doc_id and text.
SAMPLE_DOCUMENTS = 300
COPIES, EPOCHS, RATE, DECAY = 40, 60, 0.3, 1e-3
LEAST_PROBABILITY, FALSE_RATE, CONFIRM = 0.5, 0.02, 0.6
UNKNOWN = "unknown"

# Short notices of each family.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This project is licensed under the terms of the MIT license.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Words that make no evidence by themselves.
STOP = frozenset("a an and any are as at be by can for in is it of on or that the this to under use with you".split())
_WORD_BREAK = r"[^\p{L}\p{N}]+"
_WORD = r"[\p{L}\p{N}]"


def words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def grams(tokens: list[str], n: int) -> list[str]:
    """n-grams other than those of STOP words alone."""
    return [" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1) if not STOP.issuperset(tokens[i : i + n])]


#: Lines of a window, at most: a notice can be wrapped after each word.
MOST_LINES = max(len(words(t)) for texts in NOTICES.values() for t in texts)


def ordinary(text: str) -> list[str]:
    """The lines with a word, without those that are parts of a wrapped notice."""
    notices = [set(grams(words(t), 2)) for texts in NOTICES.values() for t in texts]
    out: list[str] = []
    run: list[str] = []
    for line in [*text.split("\n"), ""]:
        if words(line):
            run.append(line)
            continue
        for i, here in enumerate(run):
            own = set(grams(words(here), 2))
            near = [p for p in notices if own & p]
            around = set(grams(words("\n".join(run[max(0, i - MOST_LINES) : i + MOST_LINES])), 2)) if near else set()
            # a line that has enough by itself is left to train()
            if not any(len(around & p) >= CONFIRM * len(p) > len(own & p) for p in near):
                out.append(here)
        run = []
    return out


class Classifier:
    """Families, the weights of each gram, biases and the threshold."""

    def __init__(self, families: list[str], weights: dict[str, list[float]], bias: list[float], threshold: float):
        self.families, self.weights, self.bias, self.threshold = families, weights, bias, threshold


def train(unknown: list[str], seed: int = 5) -> Classifier:
    """Fit on edited notices and on unknown paragraphs, one half; calibrate on the other."""
    rng = random.Random(seed)
    families = [*NOTICES, UNKNOWN]
    vocabulary = {g: i for i, g in enumerate(dict.fromkeys(g for texts in NOTICES.values() for t in texts for n in (2, 3) for g in grams(words(t), n)))}
    filler = [w for t in unknown[:200] for w in words(t)] or ["text"]
    pairs = [{g for g in grams(words(t), 2)} for texts in NOTICES.values() for t in texts]
    rows: list[tuple[list[int], int]] = []

    def add(tokens: list[str], family: int) -> None:
        rows.append((sorted({vocabulary[g] for n in (2, 3) for g in grams(tokens, n) if g in vocabulary}), family))

    for family, texts in enumerate(NOTICES.values()):
        for t in texts:
            for _ in range(COPIES):
                tokens = [w for w in words(t) if rng.random() > 0.05] or words(t)
                around = [rng.choice(filler) for _ in range(rng.randrange(0, 8))]
                cut = rng.randrange(len(around) + 1)
                add(around[:cut] + tokens + around[cut:], family)
    for t in unknown:
        tokens = words(t)
        own = set(grams(tokens, 2))
        if not any(len(own & p) >= CONFIRM * len(p) for p in pairs if p):
            add(tokens, len(families) - 1)
    # unknown paragraphs with parts of notices, so that a part alone is not enough
    for texts in NOTICES.values():
        for t in texts:
            for _ in range(COPIES // 4):
                tokens = words(t)
                n = len(tokens) // 3
                if n < 2:
                    continue
                at = rng.randrange(len(tokens) - n + 1)
                add([rng.choice(filler) for _ in range(6)] + tokens[at : at + n] + [rng.choice(filler) for _ in range(6)], len(families) - 1)
    rng.shuffle(rows)
    half = len(rows) // 2
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))

    def dense(part):
        x, y = np.zeros((len(part), len(vocabulary))), np.zeros((len(part), len(families)))
        for i, (f, k) in enumerate(part):
            x[i, f], y[i, k] = 1, 1
        return x, y

    def probabilities(x):
        z = x @ w + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    x, y = dense(rows[:half])
    for _ in range(EPOCHS):
        for a in range(0, len(x), 64):
            gap = probabilities(x[a : a + 64]) - y[a : a + 64]
            w -= RATE * (x[a : a + 64].T @ gap / 8 + DECAY * w)
            b -= RATE * gap.sum(axis=0) / 64
    x, y = dense(rows[half:])
    p = probabilities(x)
    held = p[y[:, -1] == 1, :-1].max(axis=1, initial=0)
    threshold = max(LEAST_PROBABILITY, float(np.quantile(held, 1 - FALSE_RATE)) + 1e-6) if len(held) else LEAST_PROBABILITY
    return Classifier(families, {g: w[i].round(6).tolist() for g, i in vocabulary.items()}, b.round(6).tolist(), threshold)


def _grams(n: int) -> Column:
    """The n-grams that begin in a line, and the lines where they end; every holds the line's words and the next two of its run."""
    end = lambda i: F.when(i + n <= F.size("own"), F.col("line_no")).otherwise(F.get("after", i + n - 1 - F.size("own"))["line_no"])
    found = F.transform("own", lambda w, i: F.struct(F.concat_ws(" ", w, *[F.get("every", i + k) for k in range(1, n)]).alias("g"), end(i).alias("e")))
    return F.filter(found, lambda x: x["e"].isNotNull())


def _prefix_tree(choices: list[str]) -> str:
    """A regular expression of the choices that tests each character once."""
    heads: dict[str, list[str]] = {}
    for c in choices:
        heads.setdefault(c[:1], []).append(c[1:])
    parts = [head + _prefix_tree(rest) if head else "" for head, rest in sorted(heads.items(), reverse=True)]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), _WORD_BREAK), lambda w: w != "")


def _lines(docs: DataFrame, lead: str) -> DataFrame:
    """doc_id, th, run, line_no, own (words), after (the next two words of the run) and every (both) of the lines that can hold a gram."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.lower("text").rlike(lead))
    # generated, so that each step is evaluated once
    parts = texts.select("doc_id", F.xxhash64("text").alias("th"), F.explode_outer(F.array(F.split("text", "\n"))).alias("parts"))
    runs = parts.select("doc_id", "th", "parts", F.explode_outer(F.array(running(F.col("parts"), lambda x: F.when(x.rlike(_WORD), 0).otherwise(1)))).alias("runs"))
    line = lambda x, i: F.struct(F.get("runs", i).alias("run"), x.alias("line"), F.get("parts", i + 1).alias("n1"), F.get("parts", i + 2).alias("n2"))
    lines = runs.select("doc_id", "th", F.posexplode_outer(F.transform("parts", line)).alias("line_no", "x")).select("doc_id", "th", "line_no", "x.*")
    lines = lines.where(F.col("line").rlike(_WORD) & F.lower(F.concat_ws(" ", "line", "n1")).rlike(lead))
    named = lambda c, k: F.transform(_words(F.coalesce(F.col(c), F.lit(""))), lambda w: F.struct(w.alias("w"), (F.col("line_no") + k).alias("line_no")))
    after = F.when(F.col("n1").rlike(_WORD), F.slice(F.concat(named("n1", 1), named("n2", 2)), 1, 2)).otherwise(F.slice(named("n1", 1), 1, 0))
    out = lines.select("doc_id", "th", "run", "line_no", F.explode_outer(F.array(F.struct(_words(F.col("line")).alias("own"), after.alias("after")))).alias("x"))
    out = out.select("doc_id", "th", "run", "line_no", "x.*")
    # generated, as its uses are evaluated once for each word
    return out.select("*", F.explode_outer(F.array(F.concat("own", F.transform("after", lambda x: x["w"])))).alias("every"))


def _least_windows(found: DataFrame) -> DataFrame:
    """Of the windows of a run, those that stay: the best ones first, each against those kept before."""
    key = F.struct((-F.col("shared")).alias("less"), (F.col("b") - F.col("a")).alias("n"), "a", "b", "family", "probability", "template", "shared")
    runs = found.groupBy("doc_id", "th", "run").agg(F.array_sort(F.collect_list(key)).alias("all"))

    def beats(c: Column, x: Column) -> Column:
        same = (c["family"] == x["family"]) & (c["a"] <= x["b"]) & (x["a"] <= c["b"])
        return same | ((c["shared"] > x["shared"]) & (c["a"] <= x["a"]) & (x["b"] <= c["b"]) & (c["n"] > x["n"]))

    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda c: beats(c, x)), acc).otherwise(F.concat(acc, F.array(x))))
    out = runs.select("doc_id", F.explode(kept).alias("x"))
    return out.select("doc_id", *[F.col("x")[c].alias(c) for c in ("a", "b", "family", "probability", "template", "shared")])


def find_licences(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its first line, from 0), last_line (inclusive), family, probability, template, shared (of the template's 2-grams).

    One row for each paragraph of a licence family; of templates that share as
    much the first by text is named. Null and empty texts have none; repeated
    rows give one row; a null doc_id is kept; other columns are ignored; an
    empty table gives no row.
    """
    spark = docs.sparkSession
    # picked by 16 bytes a row, so that no task sends texts that are not used
    named = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("h"), F.xxhash64("text").alias("th"))
    least = named.orderBy("h", "th").limit(SAMPLE_DOCUMENTS).collect()
    own = docs.where("text is not null").select(F.col("text").cast("string").alias("text"))
    sample = own.where(F.xxhash64("text").isin([r.th for r in least])).distinct().collect() if least else []
    model = train(sorted({line for r in sample for line in ordinary(r.text)}))
    pairs = sorted(g for g in model.weights if g.count(" ") == 1)

    # every 2-gram has one of these words, which is cheap to test on the whole line
    lead = sorted({max((w for w in g.split(" ") if w not in STOP), key=len) for g in pairs})
    lines = _lines(docs, "(?<![a-z0-9])" + _prefix_tree(lead) + "(?![a-z0-9])")
    own = lines.select("doc_id", "th", "run", F.col("line_no").alias("s"), F.explode_outer(F.array_distinct(F.concat(_grams(2), _grams(3)))).alias("x")).select("doc_id", "th", "run", "s", "x.*")
    table, templates = _features(spark, model)
    met = durable(own.join(F.broadcast(table.select("g")), "g"))
    # a window has no more of a notice than its run
    enough = F.array(*[F.sum(F.get("t", F.lit(k))) >= CONFIRM * n for k, (_, _, n) in enumerate(templates)])
    runs = met.select("doc_id", "th", "run", "g").distinct().join(F.broadcast(table), "g").groupBy("doc_id", "th", "run").agg(enough.alias("enough")).where(F.array_contains("enough", True)).alias("y")
    x = met.alias("x")
    met = x.join(runs, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.th") == F.col("y.th")) & (F.col("x.run") == F.col("y.run")), "left_semi")
    # the windows from each line where a gram begins: every gram counts from the line where it first ends
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("s") - (MOST_LINES - 1)), F.col("s"))).alias("a")
    window = ["doc_id", "th", "run", "a"]
    reached = met.select("doc_id", "th", "run", start, "s", "e", "g").where(F.col("e") < F.col("a") + MOST_LINES)
    reached = reached.groupBy(*window, "g").agg(F.min("e").alias("b"), F.min("s").alias("s"))
    sums = reached.join(F.broadcast(table), "g").groupBy(*window, "b").agg(
        F.min("s").alias("s"),
        *[F.sum(F.get("w", F.lit(k))).alias(f"z{k}") for k in range(len(model.families))],
        *[F.sum(F.get("t", F.lit(k))).alias(f"t{k}") for k in range(len(templates))],
    )
    so_far = Window.partitionBy(*window).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*window)
    sums = sums.select(
        *window, "b", F.min("s").over(whole).alias("s"),
        *[(F.sum(f"z{k}").over(so_far) + F.lit(model.bias[k])).alias(f"z{k}") for k in range(len(model.families))],
        *[F.sum(f"t{k}").over(so_far).alias(f"t{k}") for k in range(len(templates))],
    ).where("s = a")
    # few rows; a stage of their own keeps the generated code small
    z = durable(sums.select(*window, "b", F.array(*[f"z{k}" for k in range(len(model.families))]).alias("z"), F.array(*[f"t{k}" for k in range(len(templates))]).alias("t")))
    names = F.split(F.lit("\n".join(model.families)), "\n")
    top = F.array_max("z")
    best = z.select(
        *window, "b", "t",
        F.element_at(names, F.array_position("z", top).cast("int")).alias("family"),
        (1 / F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max("z")))).alias("probability"),
    )
    best = best.where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold))
    notices = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"family": f, "template": t, "n": n, "k": k} for k, (f, t, n) in enumerate(templates)])), "array<struct<family:string,template:string,n:int,k:int>>")).alias("r")).select("r.*")
    compared = best.join(F.broadcast(notices), "family").withColumn("shared", F.get("t", F.col("k")) / F.col("n")).where(F.col("shared") >= CONFIRM)
    named = compared.groupBy(*window, "b", "family", "probability").agg(F.min(F.struct(-F.col("shared"), "template", "shared")).alias("c"))
    kept = _least_windows(named.select(*window, "b", "family", "probability", "c.template", "c.shared"))
    return kept.select("doc_id", F.col("a").cast("long").alias("paragraph"), F.col("b").cast("long").alias("last_line"), "family", "probability", "template", "shared").distinct()


def _features(spark: SparkSession, model: Classifier) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """One row for each gram of the notices: its weights, and the notices that have it as a 2-gram; the notices with their numbers of 2-grams."""
    templates = sorted(((f, t, set(grams(words(t), 2))) for f, texts in NOTICES.items() for t in texts), key=lambda x: x[1])
    rows = [{"g": g, "w": w, "t": [int(g in own) for _, _, own in templates]} for g, w in model.weights.items()]
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<g:string,w:array<double>,t:array<int>>>")).alias("r")).select("r.*")
    return table, [(f, t, len(own)) for f, t, own in templates]
