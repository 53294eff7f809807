"""License scans: a trained paragraph classifier, by DataFrame functions alone.

Sparse one-against-rest logistic regression over word 1- and 2-grams identifies
licence families; the vocabulary are the grams of the notices. Examples are
notices of each family, whole and in part, and a bounded sample of the corpus's
own paragraphs (those of the least hash); their features come from DataFrame
functions, the proximal-gradient fit of some thousand short rows runs in the
driver. The logit of the class "unknown" comes from the notices alone, the
probability from a logistic curve fitted on notices that were held out whole, and
a prediction is confirmed by the share of a notice's 2-grams that the paragraph has.

Most texts are out after one look at their words: no paragraph is above "unknown"
without a gram of those that are heavy, since the others together weigh too little.
The few texts with a word of a heavy gram are written and worked on line by line.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glasspane.llm.rows import saved

#: Families and notices by which they are known.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0 1.0)."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
    ("proprietary", "All rights reserved."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl-3.0", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Licensed under the ISC License."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License)."),
    ("eupl-1.2", "Licensed under the EUPL, Version 1.2 or later, as soon as they will be approved by the European Commission."),
    ("artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("wtfpl", "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("odbl-1.0", "This database is made available under the Open Database License."),
    ("public-domain", "This work has been dedicated to the public domain and may be used without restriction."),
)
FAMILIES = tuple(dict.fromkeys(f for f, _ in NOTICES))
#: Paragraphs of the corpus taken as examples of no licence.
SAMPLE = 4000
STEPS = 400
SPARSITY = 0.001
#: Notices held out for the calibration, by their number: every third of those whose family has others.
HELD_OUT = frozenset([i for i, (f, _) in enumerate(NOTICES) if sum(g == f for g, _ in NOTICES) > 1][::3])
#: Share of a notice's 2-grams that confirms a prediction, and the probability from which one is told without that (half of all examples are
#: ordinary paragraphs, so weak signs of a family stay far below a half).
CONFIRMED, LIKELY = 0.6, 0.08


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used: an array of one binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs(w: Column) -> Column:
    """Pairs of neighbours, and a null at the end; the intersections that they are used in drop both nulls and repeats."""
    return F.zip_with(w, F.slice(w, 2, 1 << 30), lambda x, y: F.concat(x, F.lit(" "), y))


def _constant(value: object, kind: str) -> Column:
    """A constant of a nested type, folded once by the optimizer."""
    return F.from_json(F.lit(json.dumps(value)), kind)


@dataclass
class Model:
    vocabulary: list[str]
    weights: list[list[float]]  # of each gram of the vocabulary, by family; grams without a weight are left out
    bias: list[float]
    unknown: float = 0.0
    seen: list[int] | None = None  # sampled paragraphs with each gram of the vocabulary
    scale: tuple[float, float] = (1.0, 0.0)  # slope and offset that turn the best logit into a probability

    def logits(self, w: Column) -> Column:
        """The families' logits of an array of words."""
        weights = _constant(self.weights, "array<array<double>>")
        add = lambda a, i: F.zip_with(a, F.get(weights, i), lambda x, y: x + y)
        return F.aggregate(_places(w, self.vocabulary), F.lit(self.bias), add)

    def heavy_words(self) -> list[str]:
        """Words of which every paragraph above "unknown" has one.

        Grams are taken as light, those most common in the sampled paragraphs
        first, as long as no family reaches "unknown" with all of them together. A
        paragraph above it has another gram; of a 2-gram, its rarer word stands
        for it.
        """
        gain = np.maximum(0.0, np.array(self.weights, float).reshape(len(self.vocabulary), len(self.bias)))
        total, heavy = np.array(self.bias), set()
        seen = dict(zip(self.vocabulary, self.seen))
        for i in sorted(range(len(self.vocabulary)), key=lambda i: (-self.seen[i], gain[i].max(), self.vocabulary[i])):
            if (total + gain[i]).max() <= self.unknown:
                total = total + gain[i]
            else:
                heavy.add(min(self.vocabulary[i].split(), key=lambda x: (seen.get(x, 0), -len(x), x)))
        return sorted(heavy)


def _grams(w: Column) -> Column:
    """The words and the pairs of neighbours."""
    return F.concat(w, _pairs(w))


def _places(w: Column, vocabulary: list[str]) -> Column:
    """Places in the vocabulary of the grams that the words have, each once."""
    known = _constant(vocabulary, "array<string>")
    return F.transform(F.array_intersect(known, _grams(w)), lambda g: (F.array_position(known, g) - 1).cast("int"))


def _notices(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, {FAMILIES.index(f)}, '{t.replace(chr(39), chr(39) * 2)}')" for i, (f, t) in enumerate(NOTICES))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(notice, family, text)")


def _examples(notices: DataFrame) -> DataFrame:
    """Each notice whole, without its first or last words, and between other words."""
    w = words(F.col("text"))
    n = F.size("w")
    parts = [F.col("w")]
    # a rest of less than three words tells too little
    rest = lambda k: F.when(n - k >= 3, n - k).otherwise(n)
    parts += [F.slice("w", F.when(n - k >= 3, 1 + k).otherwise(1), rest(k)) for k in (1, 2)]
    parts += [F.slice("w", F.lit(1), rest(k)) for k in (1, 2)]
    parts += [F.concat(F.split(F.lit("copyright 2024 the authors"), " "), "w"), F.concat("w", F.split(F.lit("see the license file for details"), " "))]
    return notices.withColumn("w", w).select("notice", "family", F.explode(F.array(*parts)).alias("w"))


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The lines with words, numbered from 0, beside all other columns of ``docs``."""
    kept = [c for c in docs.columns if c not in (text, "paragraph", "content")]
    lines = docs.select(*kept, F.posexplode(F.split(F.col(text), "\n", -1)).alias("paragraph", "content"))
    return lines.where(F.rlike("content", F.lit("[A-Za-z0-9]")))


def _notice_words(n: int) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in NOTICES[n][1].lower()).split()


def _notice_grams(n: int) -> set[str]:
    got = _notice_words(n)
    return {*got, *(f"{a} {b}" for a, b in zip(got, got[1:]))}


def _notice_pairs() -> list[dict]:
    return [{"family": FAMILIES.index(f), "pairs": sorted(g for g in _notice_grams(n) if " " in g)} for n, (f, _) in enumerate(NOTICES)]


def _notice_likeness(w: Column, family: Column | None = None) -> Column:
    """Largest share of a notice's 2-grams that the words have (of the notices of one family, or of all)."""
    notices = _constant(_notice_pairs(), "array<struct<family:int,pairs:array<string>>>")
    if family is not None:
        notices = F.filter(notices, lambda x: x["family"] == family)
    share = lambda pairs: F.array_max(F.transform(notices, lambda x: F.size(F.array_intersect(x["pairs"], pairs)) / F.size(x["pairs"])))
    return _bound(w, lambda w: _bound(_pairs(w), share))


def _enough(w: Column, without: Column | None = None) -> Column:
    """Whether the words have enough 2-grams of some notice, in any order (no part of the words has more), of which ``without`` has not enough."""
    known = _constant(sorted({p for n in _notice_pairs() for p in n["pairs"]}), "array<string>")
    notices = _constant(_notice_pairs(), "array<struct<family:int,pairs:array<string>>>")
    share = lambda x, near: F.size(F.array_intersect(x["pairs"], near)) / F.size(x["pairs"])
    of = lambda words_: F.array_intersect(known, _pairs(words_))
    if without is None:
        return _bound(of(w), lambda near: (F.size(near) > 0) & F.exists(notices, lambda x: share(x, near) >= CONFIRMED))
    more = lambda near, less: F.exists(notices, lambda x: (share(x, near) >= CONFIRMED) & (share(x, less) < CONFIRMED))
    return _bound(of(w), lambda near: _bound(of(without), lambda less: (F.size(near) > F.size(less)) & more(near, less)))


def _like_any(rows: DataFrame, w: Column) -> DataFrame:
    return rows.where(_enough(w))


def _fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of each family by proximal gradient steps; equal rows are one, with their weights together."""
    rows, at = np.unique(np.concatenate([x, y], axis=1), axis=0, return_inverse=True)
    weight = np.bincount(at.ravel(), weights=np.broadcast_to(weight, (len(x), 1)).ravel())[:, None]
    x, y = rows[:, : x.shape[1]].astype(float), rows[:, x.shape[1] :].astype(float)
    k = y.shape[1]
    w, bias, rate = np.zeros((x.shape[1], k)), np.full(k, -2.0), 2.0
    for _ in range(STEPS):
        error = weight * (1 / (1 + np.exp(-(x @ w + bias))) - y)
        bias -= rate * error.sum(axis=0)
        w -= rate * (x.T @ error)
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * SPARSITY / k)
    return w, bias


def _calibrated(top: np.ndarray, right: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from the best logit to the share of right families (Platt's fit, on held-out rows)."""
    weight = weight / max(weight.sum(), 1e-12)
    # Platt's targets stay off 0 and 1, so the fit is finite however well the classes part
    n = max(1.0, right.sum()), max(1.0, (1 - right).sum())
    target = np.where(right > 0, (n[0] + 1) / (n[0] + 2), 1 / (n[1] + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * top + b)))
        g = np.array([(weight * (p - target) * top).sum(), (weight * (p - target)).sum()])
        v = weight * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * top * top).sum(), (v * top).sum()], [(v * top).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        size = min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - size * step[0], b - size * step[1]
    return float(max(a, 1e-3)), float(b)


def train(docs: DataFrame, text: str = "text") -> Model:
    """Fits the classifier; the corpus gives at most ``SAMPLE`` paragraphs, those of the least hash."""
    spark, k = docs.sparkSession, len(FAMILIES)
    lines = paragraphs(docs.select(text), text)
    # equal paragraphs are one example; only those with hashes in the lowest share, about twice the sample, are sent on
    hashed = lines.select(F.xxhash64("content").alias("h"), "content")
    distinct = hashed.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    highest = int(-(2**63) + min(1.0, 2 * SAMPLE / max(1, distinct)) * (2**64 - 1))
    sample = hashed.where(F.col("h") <= min(highest, 2**63 - 1)).dropDuplicates(["h"]).orderBy("h").limit(SAMPLE)
    sample = sample.select("h", words(F.col("content")).alias("w"))
    other = sample.where(F.coalesce(_notice_likeness(F.col("w")), F.lit(0.0)) < CONFIRMED)
    examples = _examples(_notices(spark)).select("notice", "family", F.array_distinct(F.array_compact(_grams(F.col("w")))).alias("g")).collect()
    vocabulary = sorted({g for n in range(len(NOTICES)) for g in _notice_grams(n)})  # a fixed number, from the notices
    rest = other.select(_places(F.col("w"), vocabulary).alias("f")).collect()
    place = {g: i for i, g in enumerate(vocabulary)}
    feats = [[place[g] for g in r["g"] if g in place] for r in examples] + [r["f"] for r in rest]
    x = np.zeros((len(feats), len(vocabulary)), np.float32)
    for i, f in enumerate(feats):
        x[i, f] = 1
    family = np.array([r["family"] for r in examples] + [-1] * len(rest))
    y = (family[:, None] == np.arange(k)).astype(np.float32)
    weight = np.where(family < 0, 0.5 / max(1, len(rest)), 0.5 / len(examples))[:, None]
    # whole notices are held out for the calibration, of families that have others; then all rows are fitted
    held = np.array([r["notice"] in HELD_OUT for r in examples] + [i % 3 == 0 for i in range(len(rest))])
    trial, trial_bias = _fitted(x[~held], y[~held], weight[~held])
    z = x[held] @ trial + trial_bias
    right = (z.argmax(axis=1) == family[held]).astype(float)
    w, bias = _fitted(x, y, weight)
    used = np.flatnonzero(np.abs(w).max(axis=1) > 0)
    model = Model([vocabulary[i] for i in used], w[used].tolist(), bias.tolist(), seen=x[len(examples) :].sum(axis=0)[used].astype(int).tolist())
    clear = (x[: len(examples)] @ w + bias)[np.arange(len(examples)), family[: len(examples)]].min()
    # sampled paragraphs have no label and may hold reworded notices: between no word at all and the least clear notice
    model.scale = _calibrated(z.max(axis=1), right, weight[held, 0])
    model.unknown = float((min(bias.max(), clear - 1e-6) + clear) / 2)
    return model


def _classified(rows: DataFrame, model: Model) -> DataFrame:
    """``i`` (family's number), ``probability`` and ``likeness`` of the words ``w`` of every row that is no "unknown"."""
    kept = rows.columns
    z = rows.withColumn("z", _bound(F.col("w"), model.logits)).withColumn("top", F.array_max("z")).where(F.col("top") > model.unknown)
    sure = 1 / (1 + F.exp(-(F.col("top") * model.scale[0] + model.scale[1])))
    got = z.select(*kept, (F.array_position("z", F.col("top")) - 1).cast("int").alias("i"), sure.alias("probability"))
    got = got.withColumn("likeness", _notice_likeness(F.col("w"), F.col("i")))
    return got.where((F.col("probability") >= LIKELY) | (F.col("likeness") >= CONFIRMED))


def _wrapped(docs: DataFrame, model: Model) -> DataFrame:
    """Notices that run over lines of one paragraph: the least runs of lines that confirm a family, none within another.

    Lines without words part paragraphs. A run ends where the lines between its
    first and its last have twice the words of the longest notice.
    """
    room = 2 * max(len(t.split()) for _, t in NOTICES)
    known = _constant(sorted({p for n in _notice_pairs() for p in n["pairs"]}), "array<string>")
    begun = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"), F.lit(False).alias("over"))

    def longer(a: Column, line: Column) -> Column:
        over = a["over"] | (F.size(line) == 0) | (a["words"] >= room)
        return F.struct((a["n"] + F.when(over, 0).otherwise(1)).alias("n"), (a["words"] + F.size(line)).alias("words"), over.alias("over"))

    def runs(lines: Column) -> Column:
        """From each line with a notice's pair in it, or over its end, the lines that a run may take, cut off before the rows are made."""
        ahead = lambda i: F.coalesce(F.slice(F.get(lines, i + 1), 1, 1), F.array().cast("array<string>"))
        begins = lambda w, i: F.size(F.array_intersect(known, _pairs(F.concat(w, ahead(i))))) > 0
        starts = F.filter(F.transform(lines, lambda w, i: F.when(F.when(F.size(w) > 0, begins(w, i)).otherwise(False), i)), lambda i: i.isNotNull())
        after = lambda i: F.aggregate(F.slice(lines, i + 2, F.lit(room + 1)), begun, longer)["n"]
        return F.transform(starts, lambda i: _bound(after(i), lambda n: F.struct(i.alias("paragraph"), n.alias("n"), F.slice(lines, i + 1, n + 1).alias("lines"))))

    # texts that have enough of some notice anywhere are few: written, so that their lines are worked out once
    near = saved(docs.where(F.contains("text", F.lit("\n")) & _bound(words(F.col("text")), lambda w: _enough(w))), "near-notices")
    near = near.withColumn("row", F.monotonically_increasing_id())  # numbered before the runs are made: those of one text share it
    rows = near.select("row", "doc_id", F.explode(_bound(F.transform(F.split("text", "\n", -1), words), runs)).alias("r"))
    rows = rows.select("row", "doc_id", "r.paragraph", "r.n", "r.lines").where("n > 0")
    # a least run has enough of a notice of which its first line alone has not
    rows = rows.where(_bound(F.flatten("lines"), lambda w: _enough(w, F.get("lines", F.lit(0)))))
    rows = rows.select("row", "doc_id", "paragraph", "lines", F.explode(F.sequence(F.lit(2), F.col("n") + 1)).alias("k"))
    rows = _like_any(rows.withColumn("w", F.flatten(F.slice("lines", F.lit(1), F.col("k")))), F.col("w"))
    got = _classified(rows, model).where(F.col("likeness") >= CONFIRMED)
    for inner in (F.slice("lines", F.lit(2), F.col("k") - 1), F.slice("lines", F.lit(1), F.col("k") - 1)):
        got = got.where(_notice_likeness(F.flatten(inner), F.col("i")) < CONFIRMED)
    # one notice may have several least runs: from the top, those that meet no earlier one
    run = F.struct("paragraph", (F.col("paragraph") + F.col("k")).alias("end"), "probability", "likeness")
    found = got.groupBy("row", "doc_id", "i").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    apart = lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] > x["paragraph"]), a).otherwise(F.concat(a, F.array(x)))
    found = found.select("doc_id", "i", F.explode(F.aggregate("runs", F.slice("runs", 1, 0), apart)).alias("r"))
    return found.select("doc_id", "r.paragraph", "i", "r.probability", "r.likeness")


def scan(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, paragraph, family, probability, likeness, confirmed`` of every line that is no "unknown" (likely, or confirmed by a notice), and of confirmed notices over several lines.

    ``paragraph`` is the number, from 0, of the line or of the first of the lines;
    parts of a notice may have unconfirmed rows beside it. Null and empty texts
    have none; repeated rows give their findings each; other columns do not matter.
    """
    heavy = _constant(model.heavy_words(), "array<string>")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.arrays_overlap(F.split(F.lower(text), "[^a-z0-9]+"), heavy))
    docs = saved(docs, "with-licence-words")
    lines = paragraphs(docs).select("doc_id", "paragraph", words(F.col("content")).alias("w")).where(F.arrays_overlap("w", heavy))
    got = _classified(lines, model).drop("w").unionByName(_wrapped(docs, model))
    return got.select("doc_id", "paragraph", F.get(F.lit(list(FAMILIES)), F.col("i")).alias("family"), "probability", "likeness", (F.col("likeness") >= CONFIRMED).alias("confirmed"))
