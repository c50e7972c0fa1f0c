"""Licence paragraphs: a softmax regression over word n-grams, calibrated, and confirmed by templates.

The model is fitted once on the short templates below, on variants of them (words before, after or left out,
denials as the unknown class), and on a bounded sample of the corpus' own lines as the unknown class. A curve
fitted on held-out folds turns its margin between known and unknown into a probability. A paragraph is what
blank lines part, so a notice wrapped over lines is one. What is scored is the place where a template's
three-word n-grams stand, with a few words before it, however long the paragraph around it is; then the
predicted family has to be that of the template. All of it is joins with fixed small tables, in DataFrame
functions alone.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .linear import platt

UNKNOWN = "unknown"
#: Notices by which works state their licence, by family.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "This software is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Distributed under the terms of the MIT License, see the LICENSE file."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache License, Version 2.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Licensed under the GNU General Public License, version 2 or later.", "Released under the GPL version 3."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL version 3."],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program.", "Released under the AGPL version 3."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the BSD 3-Clause License.", "Released under the BSD License.", "Use of this source code is governed by a BSD-style license."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission."],
}
#: Headings that name a licence if a line holds nothing else, and names in SPDX identifiers.
TITLES = {
    "mit": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT Licence"],
    "apache-2.0": ["Apache License", "Apache License 2.0", "Apache License Version 2.0", "Apache-2.0"],
    "gpl": ["GNU General Public License", "GNU GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0"],
    "lgpl": ["GNU Lesser General Public License", "LGPLv3", "LGPL-2.1", "LGPL-3.0"],
    "agpl": ["GNU Affero General Public License", "AGPLv3", "AGPL-3.0"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "The BSD License"],
    "mpl-2.0": ["Mozilla Public License", "Mozilla Public License 2.0", "MPL-2.0"],
    "isc": ["ISC License", "The ISC License"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "cc0": ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0", "The Unlicense"],
}
SPDX = {"mit": ["MIT"], "apache-2.0": ["Apache-2.0"], "gpl": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"], "lgpl": ["LGPL-2.1-or-later", "LGPL-3.0-only"], "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "mpl-2.0": ["MPL-2.0"], "isc": ["ISC"], "cc-by": ["CC-BY-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc0": ["CC0-1.0"]}
NOTICES = {family: [*texts, *(f"SPDX-License-Identifier: {x}" for x in SPDX.get(family, []))] for family, texts in TEMPLATES.items()}
DENIALS = "not never".split()
#: The longest n-gram, lines of the corpus in the unknown class at most, learning passes, folds of the calibration, words before a notice that are scored with it, and the bounds that a prediction has to pass.
GRAMS, NEGATIVES, PASSES, FOLDS, CONTEXT, PROBABILITY, CONTAINMENT = 3, 2000, 300, 3, 4, 0.5, 0.8
SCALE = 4.0


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits (A-Z is lower-cased; other bytes part words, so only ASCII matters)."""
    return re.findall("[a-z0-9.]+(?<![.])", text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + n]) for n in range(1, GRAMS + 1) for k in range(len(words) - n + 1)}


class Softmax:
    """A sparse softmax regression; a paragraph's n-grams count 1/sqrt(number of its n-grams) times SCALE."""

    def __init__(self, classes: list[str]):
        self.classes, self.weights, self.bias, self.curve = classes, {}, [0.0] * len(classes), (1.0, 0.0)

    def margin(self, grams: set[str]) -> float:
        """Log odds of all known classes against the unknown one (the last), before calibration."""
        k = SCALE / math.sqrt(max(1, len(grams)))
        x = np.array(self.bias) + k * sum((np.array(self.weights[g]) for g in grams if g in self.weights), np.zeros(len(self.bias)))
        return float(np.logaddexp.reduce(x[:-1]) - x[-1])

    def fit(self, rows: list[tuple[set[str], int, float]], passes: int = PASSES, rate: float = 2.0, decay: float = 2e-4) -> Softmax:
        """rows: n-grams, class, weight. Gradient steps on all rows (a few thousand, from the templates and the bounded sample)."""
        names = sorted(set().union(*(g for g, _, _ in rows)))
        at = {g: k for k, g in enumerate(names)}
        x, y = np.zeros((len(rows), len(names) + 1)), np.zeros((len(rows), len(self.classes)))
        for k, (grams, label, _) in enumerate(rows):
            x[k, [at[g] for g in grams]] = SCALE / math.sqrt(max(1, len(grams)))
            x[k, -1] = 1
            y[k, label] = 1
        weight = np.array([r[2] for r in rows])[:, None]
        weight /= weight.sum()
        w, speed = np.zeros((x.shape[1], y.shape[1])), 0.0
        for _ in range(passes):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            speed = 0.9 * speed - rate * (x.T @ ((p - y) * weight) + decay * w)
            w = w + speed
        self.weights = {g: w[k].tolist() for g, k in at.items() if np.abs(w[k]).max() > 1e-6}
        self.bias = w[-1].tolist()
        return self


def variants(words: list[str], before: list[str]) -> list[list[str]]:
    """A notice's words, and variants: with words before or after, or one of its outer words left out."""
    w = words
    return [w, ["copyright", "2020", "the", "authors", *w], [*before[:CONTEXT], *w], [*w, "see", "the", "file", "for", "details"], *([w[1:], w[:-1]] if len(w) > 5 else [])]


def denials(words: list[str]) -> list[list[str]]:
    """A notice denied before it begins, or after its first is, was or are."""
    out = [[*p, d, *words] for d in DENIALS for p in ([], ["this", "is"], ["it", "was"], ["they", "are"], ["the", "code", "is"])]
    at = next((k for k, w in enumerate(words) if w in ("is", "was", "are")), None)
    return out if at is None else [*out, *([*words[: at + 1], d, *words[at + 1 :]] for d in DENIALS)]


#: What parts paragraphs: a blank line or several.
BLANK = r"(?:\r\n|\r|\n)[ \t]*(?:[\r\n][ \t]*)*(?:\r\n|\r|\n)"


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, row, para (from 0), text: what blank lines part in whole texts, empty ones left out; row tells rows of docs apart."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return own.select("doc_id", "row", F.posexplode(F.split("text", BLANK)).alias("para", "text")).where(F.length("text") > 0)


def words_col(line: Column) -> Column:
    """The column form of words_of()."""
    return F.regexp_extract_all(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[a-z0-9.]+(?<![.])"), F.lit(0))


def gram_hash(words: Column, i, n: int) -> Column:
    """XXH64 of the n words from position i (from 0)."""
    return F.xxhash64(*[F.get(words, i + k) for k in range(n)])


def grams_col(words: Column, n: int) -> Column:
    """Hashes of the n-grams of a paragraph with at least n words."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: gram_hash(words, i, n))


def all_grams(words: Column) -> Column:
    """The column form of grams_of(), as hashes."""
    return F.array_distinct(F.concat(*[F.when(F.size(words) >= n, grams_col(words, n)).otherwise(F.array().cast("array<bigint>")) for n in range(1, GRAMS + 1)]))


def train(spark: SparkSession, docs: DataFrame, negatives: int = NEGATIVES) -> Softmax:
    """The model. Its unknown class learns from about `negatives` corpus lines that share no two-word n-gram with a template, and from denials."""
    classes = [*NOTICES, UNKNOWN]
    notices = {family: [words_of(t) for t in [*texts, *TITLES.get(family, [])]] for family, texts in NOTICES.items()}
    known = set().union(*(grams_of(w) for texts in notices.values() for w in texts))
    pairs = {g for g in known if " " in g}
    n = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) <= int(1e6 * min(1.0, negatives / 4 / max(1, n))))
    lines = part.select(F.explode(F.split(F.col("text").cast("string"), "[\r\n]+")).alias("line")).where(F.length("line").between(1, 1000))
    lines = [words_of(r["line"]) for r in lines.orderBy(F.xxhash64("line"), "line").limit(negatives).collect()]
    before = [w[:CONTEXT] for w in lines if len(w) >= CONTEXT and not grams_of(w) & pairs] or [[]]
    # Classes weigh alike, and the unknown one as much as all others.
    own = [[(grams_of(v), k) for i, w in enumerate(texts) for v in variants(w, before[(31 * k + i) % len(before)])] for k, texts in enumerate(notices.values())]
    rows = [(g, k, 1 / len(group)) for group in own for g, k in group]
    # N-grams that no template has tell unknown lines apart only through the bias; the shared ones matter.
    other = [set(g) for g in sorted({tuple(sorted(g & known)) for g in map(grams_of, lines) if not g & pairs})]
    plain = "the of and to a in is this that license licensed under public general version software work free copyright permission".split()
    other += [{w} for w in plain] + [grams_of(["the", w, "of", "the"]) for w in plain]
    denied = [grams_of(d) for texts in notices.values() for w in texts for d in denials(w)]
    rows += [(g, len(classes) - 1, len(own) / 2 / len(group)) for group in (other, denied) for g in group]
    # The curve is fitted on margins of rows that the model of their fold has not seen.
    margins, truth = [], []
    for f in range(FOLDS):
        model = Softmax(classes).fit([r for k, r in enumerate(rows) if k % FOLDS != f], PASSES // 2)
        held = [r for k, r in enumerate(rows) if k % FOLDS == f]
        margins += [model.margin(g) for g, _, _ in held]
        truth += [float(k < len(classes) - 1) for _, k, _ in held]
    model = Softmax(classes).fit(rows)
    model.curve = platt(np.array(margins), np.array(truth))
    return model


def scan(spark: SparkSession, docs: DataFrame, model: Softmax | None = None) -> DataFrame:
    """doc_id, para, at, family, probability, containment: the notices of a known licence family.

    A notice is a place (its first word's number in the paragraph) that holds CONTAINMENT of the three-word
    n-grams of one of the family's templates within a template's length, or a line that is nothing but a
    licence's name (there `at` is minus one minus the line's number). The family is the most probable one and the
    calibrated probability that it is known, times that of the family, has to be PROBABILITY. Repeated notices
    and rows are found each; a notice that is denied is not one. Null and empty texts have none; texts of any
    length are read whole; other columns are ignored; an empty table gives no rows.
    """
    model = model or train(spark, docs)
    k = len(model.classes)
    # These tables come from the fixed templates and the bounded sample, so they can always be broadcast.
    known = sorted(g for g, w in model.weights.items() if any(abs(x) > 1e-6 for x in w))
    named = spark.createDataFrame([(g.split(" "), [float(x) for x in model.weights[g]]) for g in known], "words array<string>, w array<double>")
    weights = named.select(F.element_at(all_grams(F.col("words")), -1).alias("h"), "w")
    marks = [(f"{name}:{i}", name, pos, len(w), w[pos : pos + GRAMS]) for name, texts in NOTICES.items() for i, w in enumerate(map(words_of, texts)) for pos in range(len(w) - GRAMS + 1)]
    templates = spark.createDataFrame(marks, "template string, family string, pos int, n int, words array<string>").select("template", "family", "pos", "n", gram_hash(F.col("words"), F.lit(0), GRAMS).alias("h"))
    signs = [r["h"] for r in templates.select("h").distinct().collect()]  # some 400 hashes of fixed templates
    blocks = common.once(paragraphs(docs), "words", words_col(F.col("text"))).where(F.size("words") >= GRAMS).select("doc_id", "row", "para", "words")
    # Places without any three-word n-gram of a template can't be confirmed, whatever their probability.
    places = F.filter(F.sequence(F.lit(0), F.size("words") - GRAMS), lambda i: gram_hash(F.col("words"), i, GRAMS).isin(signs))
    blocks = common.once(blocks, "places", places).where(F.size("places") > 0)
    blocks = common.cut(spark, blocks.withColumn("block", F.monotonically_increasing_id()), "licence-blocks")
    hits = blocks.select("block", F.explode("places").alias("i"), "words").select("block", "i", gram_hash(F.col("words"), F.col("i"), GRAMS).alias("h"))
    hits = hits.join(F.broadcast(templates), "h").withColumn("step", (F.col("i") - F.col("pos")) / F.col("n"))
    # An occurrence is what would begin within a template's length; such ranges overlap by half.
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.floor("step").alias("at")), F.struct(F.lit(1).alias("kind"), F.floor(F.col("step") + 0.5).alias("at")))
    hits = hits.withColumn("where", F.explode(kinds)).groupBy("block", "template", "family", "n", "where").agg(F.countDistinct("pos").alias("m"), F.min("i").alias("at"), (F.max("i") + GRAMS).alias("end"))
    hits = hits.withColumn("containment", F.col("m") / (F.col("n") - (GRAMS - 1))).where(F.col("containment") >= CONTAINMENT)
    spans = hits.groupBy("block", "at", "end", "family").agg(F.max("containment").alias("containment")).join(blocks, "block")
    first = F.greatest(F.col("at") - CONTEXT, F.lit(0))
    spans = spans.select("doc_id", "row", "para", "at", "end", "family", "containment", F.slice("words", first + 1, F.col("end") - first).alias("words"))
    titles = {" ".join(words_of(t)): family for family, texts in TITLES.items() for t in texts}
    lines = paragraphs(docs).where(F.col("text").rlike(r"(?i)licen[sc]e|CC[- ]?BY|CC0|GPL|MPL-2|Apache-2"))
    lines = lines.select("doc_id", "row", "para", F.posexplode(F.split("text", "[\r\n]+")).alias("line", "t")).where(F.length("t").between(3, 100))
    lines = common.once(lines, "words", words_col(F.col("t"))).withColumn("family", F.try_element_at(F.create_map(*[F.lit(x) for kv in titles.items() for x in kv]), F.array_join("words", " "))).where("family is not null")
    spans = spans.unionByName(lines.select("doc_id", "row", "para", (-1 - F.col("line")).alias("at"), (-F.col("line")).alias("end"), "family", F.lit(1.0).alias("containment"), "words"))
    spans = common.cut(spark, spans.select("doc_id", "row", "para", "at", "end", "family", "containment", F.xxhash64("words").alias("key"), all_grams(F.col("words")).alias("grams")), "licence-spans")
    # Equal words are classified once.
    each = spans.groupBy("key").agg(F.first("grams").alias("grams")).select("key", F.size("grams").alias("n"), F.explode("grams").alias("h"))
    sums = each.join(F.broadcast(weights), "h", "left").groupBy("key", "n").agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)])
    logits = F.array(*[F.lit(model.bias[i]) + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * SCALE / F.sqrt("n") for i in range(k - 1)])
    sums = sums.select("key", logits.alias("x"), (F.lit(model.bias[-1]) + F.coalesce(F.col(f"s{k - 1}"), F.lit(0.0)) * SCALE / F.sqrt("n")).alias("other")).withColumn("top", F.array_max("x"))
    sums = sums.withColumn("all", F.aggregate("x", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top"))))
    sure = 1 / (1 + F.exp(-(model.curve[0] * (F.col("top") + F.log("all") - F.col("other")) + model.curve[1])))
    best = sums.select("key", F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("x", F.col("top")).cast("int")).alias("family"), (sure / F.col("all")).alias("probability")).where(F.col("probability") >= PROBABILITY)
    found = spans.join(best, ["key", "family"]).groupBy("doc_id", "row", "para", "at", "family").agg(F.max("end").alias("end"), F.max("probability").alias("probability"), F.max("containment").alias("containment"))
    # Templates overlap in words; of places that overlap the first is the notice. A window holds one paragraph's notices.
    until = F.max("end").over(Window.partitionBy("doc_id", "row", "para", "family").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("until", until).where(F.col("until").isNull() | (F.col("at") >= F.col("until"))).select("doc_id", "para", "at", "family", "probability", "containment")


def licences(spark: SparkSession, docs: DataFrame, model: Softmax | None = None) -> DataFrame:
    """One row per input row: doc_id, n_paragraphs (with a licence), n_notices, families (sorted, distinct), probability (the best; null if none).

    Rows with equal doc_id are told apart by nothing else, so each shows what any of them holds; a null doc_id shows nothing.
    """
    found = scan(spark, docs, model).where("doc_id is not null").groupBy(F.col("doc_id").alias("k")).agg(F.countDistinct("para").alias("n_paragraphs"), F.countDistinct("para", "at").alias("n_notices"), F.sort_array(F.collect_set("family")).alias("families"), F.max("probability").alias("probability"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return own.join(found, own.doc_id == found.k, "left").select("doc_id", zero("n_paragraphs"), zero("n_notices"), F.coalesce("families", F.array().cast("array<string>")).alias("families"), "probability")
