"""Licence scan: a trained paragraph classifier over sparse word n-grams.

A softmax regression with a lasso penalty is fitted on the driver, on varied
copies of the families' templates and on at most SAMPLE paragraphs of the corpus
as the unknown class; a temperature is then calibrated on variants that were
held out. Word frequencies are over all paragraphs, and so is the threshold: at
most FALSE_SHARE of all unknown paragraphs reach it. Scoring is DataFrame
functions only: the n-grams with weights become literals. A paragraph is scored
if it has a word of a set that leaves out only words whose n-grams, all
together, cannot lift a family over the unknown class, so none is lost. A
prediction is confirmed when the paragraph holds most of the word pairs of one
of the family's templates.

A paragraph is a line. A licence may be wrapped over several, none of which says
enough: so neighbouring lines that each have a word of that set are scored
together as well, from each on up to WRAPPED words, and such a paragraph counts
if it is confirmed, none of its lines is so alone, and no paragraph that overlaps
it has more of a template. It takes the place of its lines.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c

# The wording by which texts name their licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is licensed under the terms of the Apache 2.0 license.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL version 2 or later.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "This code is distributed under a BSD style license.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.",
        "This work has been dedicated to the public domain.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright holder. All rights reserved. No part of this publication may be reproduced or distributed without prior written permission.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ],
}
#: Sentences that use the same words and name no licence.
OTHERS = [
    "The driver must show a valid license to the officer on request.", "She applied for a fishing license under the new rules.", "The public library is free of charge for all visitors.",
    "All rights and duties of the members are described below.", "He reserved a table at the restaurant for the following day.", "The general public was asked to comment on the draft version.",
    "Permission to enter the building is granted at the front desk.", "This work was done under difficult conditions and without modification.", "The commons was used for grazing and the source of the river lies above it.",
    "The software was late, and its documentation files were not delivered.", "Apache helicopters and a mit of wool were shown.", "Attribution of the painting to the master is not certain.",
    "The copyright office is open to any person on working days.", "The foundation published a new version of its terms.",
]
UNKNOWN = "unknown"
#: Paragraphs of the corpus that are learned as unknown, and variants of each template.
SAMPLE, VARIANTS = 1500, 40
#: Share of unknown paragraphs that may pass as a family, in calibration; share of a template's word pairs that confirms.
FALSE_SHARE, CONFIRMS = 0.002, 0.6
LASSO, STEPS = 5e-4, 300
#: Words of a paragraph of several lines, at most: twice the longest template; and so lines.
WRAPPED = 2 * max(len(text.split()) for texts in TEMPLATES.values() for text in texts)
TOKEN = "[^A-Za-z0-9\\x{80}-\\x{10FFFF}]+"
_SPLIT = re.compile("[^A-Za-z0-9\u0080-\U0010ffff]+")


def tokens(text: str) -> list[str]:
    return [x for x in _SPLIT.split(text.lower()) if x]


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)}


@dataclass
class LicenceModel:
    families: list[str]
    base: list[float]
    weights: dict[str, list[float]]  # n-gram -> weight in each family, the last one being unknown
    cues: list[str]  # words, of which each n-gram with a weight has one
    sieve: list[str]  # words, without any of which no paragraph can be of a family
    temperature: float
    threshold: float


def varied(words: list[str], filler: list[str], draw: np.random.Generator) -> list[str]:
    """A copy with some words lost or replaced, and others around it."""
    kept = [filler[draw.integers(len(filler))] if draw.random() < 0.06 else w for w in words if draw.random() > 0.06]
    around = [filler[k] for k in draw.integers(len(filler), size=draw.integers(0, 12))]
    cut = int(draw.integers(len(around) + 1))
    return around[:cut] + kept + around[cut:]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def licence_grams(spread: dict[str, int], lines: int) -> list[str]:
    """Runs of two and three words of the templates, without pairs of words that are both in over a hundredth of all lines."""
    found = {g for texts in TEMPLATES.values() for text in texts for g in grams(tokens(text))}
    usual = {w for w, n in spread.items() if n > 0.01 * max(100, lines)}
    return sorted(g for g in found if g.count(" ") == 2 or (g.count(" ") == 1 and not set(g.split()) <= usual))


def needed(weights: dict[str, list[float]], base: list[float], spread: dict[str, int]) -> list[str]:
    """Words, the frequent ones left out as far as their n-grams' weights together stay under what a family lacks."""
    gains = {g: np.maximum(0, np.array(w[:-1]) - w[-1]) for g, w in weights.items()}
    lacks, out = base[-1] - np.array(base[:-1]) - 1e-6, set()
    for word in sorted({x for g in weights for x in g.split()}, key=lambda x: (-spread.get(x, 0), x)):
        if (sum((v for g, v in gains.items() if set(g.split()) <= out | {word}), np.zeros(len(lacks))) < lacks).all():
            out.add(word)
    return sorted({x for g in weights for x in g.split()} - out)


def fit(paragraphs: list[str], seed: int = 11, spread: dict[str, int] | None = None) -> LicenceModel:
    """Train on templates and the given paragraphs (unknown); calibrate on every fourth example. spread: lines that have a word."""
    draw = np.random.default_rng(seed)
    plain = [tokens(p) for p in [*paragraphs, *OTHERS * 8]]
    filler = sorted({w for p in plain for w in p}) or ["word"]
    families = [*TEMPLATES, UNKNOWN]
    rows, y = [p for p in plain if p], [len(TEMPLATES)] * sum(map(bool, plain))
    for k, texts in enumerate(TEMPLATES.values()):
        for text in texts:
            words = tokens(text)
            # Exact copies too, so that a short template needs nothing around it.
            rows += [words] * (VARIANTS // 4) + [varied(words, filler, draw) for _ in range(VARIANTS)]
            y += [k] * (VARIANTS // 4 + VARIANTS)
    y = np.array(y)
    spread = Counter(w for p in plain[: len(paragraphs)] for w in set(p)) if spread is None else spread
    held = np.arange(len(rows)) % 4 == 3
    seen: dict[str, int] = {}
    for row in (r for r, h in zip(rows, held, strict=True) if not h):
        for g in grams(row):
            seen[g] = seen.get(g, 0) + 1
    wanted = {g for text in [*sum(TEMPLATES.values(), []), *OTHERS] for g in grams(tokens(text))}
    features = sorted(g for g in wanted if seen.get(g, 0) >= 8)
    at = {g: k for k, g in enumerate(features)}
    x = np.zeros((len(rows), len(features)))
    for k, row in enumerate(rows):
        x[k, [at[g] for g in grams(row) if g in at]] = 1
    target, share = np.eye(len(families))[y], 1 / np.bincount(y[~held], minlength=len(families))
    weight = share[y[~held]] / len(families)
    w = v = np.zeros((len(features), len(families)))
    b = u = np.zeros(len(families))
    scale, t0 = 0.5 * (np.linalg.norm(x[~held] * np.sqrt(weight)[:, None], 2) ** 2 + 1), 1.0
    for _ in range(STEPS):
        off = (softmax(x[~held] @ v + u) - target[~held]) * weight[:, None]
        new = v - x[~held].T @ off / scale
        new = np.sign(new) * np.maximum(0, np.abs(new) - LASSO / scale)
        new_b = u - off.sum(0) / scale
        t1 = (1 + np.sqrt(1 + 4 * t0 * t0)) / 2
        v, u = new + (t0 - 1) / t1 * (new - w), new_b + (t0 - 1) / t1 * (new_b - b)
        w, b, t0 = new, new_b, t1
    # A text without any cue must be unknown, as it is never scored.
    b[-1] = max(b[-1], b[:-1].max() + 2.0)
    z = x[held] @ w + b
    marks = np.geomspace(0.2, 5, 40)
    loss = [-np.log(np.maximum(softmax(z / s)[np.arange(held.sum()), y[held]], 1e-12)).mean() for s in marks]
    heat = float(marks[int(np.argmin(loss))])
    wrong = softmax(z / heat)[y[held] == len(TEMPLATES), :-1].max(1, initial=0)
    threshold = max(0.5, float(np.quantile(wrong, 1 - FALSE_SHARE)) if len(wrong) else 0.5)
    kept = [k for k in range(len(features)) if np.any(w[k])]
    cues = sorted({word for k in kept for word in features[k].split()})
    weights = {features[k]: w[k].tolist() for k in kept}
    return LicenceModel(families, b.tolist(), weights, cues, needed(weights, b.tolist(), spread), heat, threshold)


def split_lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, paragraph, words: each line of docs; row is the number of its document."""
    words = F.filter(F.split(F.lower("line"), TOKEN), lambda w: w != "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).select("row", "doc_id", "paragraph", words.alias("words"))


def wrapped(lines: DataFrame) -> DataFrame:
    """lines (row, doc_id, paragraph, words) with n_lines 1, and from each line that a neighbour follows as many together as have WRAPPED words."""
    order = W.partitionBy("row").orderBy("paragraph")
    runs = lines.withColumn("run", F.col("paragraph") - F.row_number().over(order))
    after = W.partitionBy("row", "run").orderBy("paragraph").rowsBetween(0, WRAPPED - 1)
    # A line that is longer does not fit, however long it is, so no more of it is held.
    runs = runs.withColumn("next", F.collect_list(F.slice("words", 1, WRAPPED + 1)).over(after)).where(F.size("next") > 1)
    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit(0).alias("n"), F.lit(True).alias("fits"))
    step = lambda acc, w: F.when(acc["fits"] & (F.size(acc["words"]) + F.size(w) <= WRAPPED), F.struct(F.concat(acc["words"], w).alias("words"), (acc["n"] + 1).alias("n"), F.lit(True).alias("fits"))).otherwise(F.struct(acc["words"].alias("words"), acc["n"].alias("n"), F.lit(False).alias("fits")))
    runs = runs.withColumn("whole", F.aggregate("next", start, step))
    several = runs.where("whole.n > 1").select("row", "doc_id", "paragraph", F.col("whole.words").alias("words"), F.col("whole.n").alias("n_lines"))
    return lines.select("row", "doc_id", "paragraph", "words", F.lit(1).alias("n_lines")).unionByName(several)


def line_counts(docs: DataFrame) -> tuple[dict[str, int], int]:
    """Over all lines of docs: how many have each word of the templates and of OTHERS, and how many have words at all."""
    own = sorted({w for text in [*sum(TEMPLATES.values(), []), *OTHERS] for w in tokens(text)})
    has = F.array_union(F.array_intersect("words", F.expr(strings(own))), F.array(F.lit("")))
    found = split_lines(docs).where(F.size("words") > 0).select(F.explode(has).alias("word")).groupBy("word").count().collect()
    spread = {r["word"]: r["count"] for r in found}
    return spread, spread.pop("", 0)


def learned(docs: DataFrame, spread: dict[str, int], lines: int, sample: int = SAMPLE) -> LicenceModel:
    """A model whose unknown class has seen at most `sample` paragraphs of docs: one of each of the texts with the least hashes."""
    marked = docs.select("text", F.xxhash64("text").alias("mark")).where("text is not null")
    least = marked.select("mark").distinct().orderBy("mark").limit(sample)
    line = F.split("text", "\n")
    rows = marked.join(F.broadcast(least), "mark").dropDuplicates(["mark"])
    rows = rows.select(F.element_at(line, (F.pmod("mark", F.size(line)) + 1).cast("int")).alias("line"))
    # Some of them name a licence; the templates' word pairs tell.
    pairs = [set(zip(w, w[1:], strict=False)) for texts in TEMPLATES.values() for w in map(tokens, texts)]
    found = sorted(r[0] for r in rows.collect())
    named = set(licence_grams(spread, lines))
    plain = lambda p: not grams(tokens(p)) & named and all(len(set(zip(w := tokens(p), w[1:], strict=False)) & s) < 0.5 * len(s) for s in pairs)  # noqa: E731, B023
    return fit([p for p in found if plain(p)], spread=spread)


def calibrated(model: LicenceModel, scored: DataFrame, lines: int) -> LicenceModel:
    """The model with the threshold that at most FALSE_SHARE of all unknown paragraphs reach.

    scored: what scored_lines() finds in all documents, which have `lines`
    lines with words. Those without n-grams of a licence are unknown; lines
    that were not scored are below any threshold.
    """
    if not lines:
        return model
    # Log odds in hundredths: a table of bounded size, whatever the corpus.
    odds = F.floor(-100 * F.log(F.greatest(1 / F.col("probability") - 1, F.lit(1e-12)))).cast("int")
    scored = scored.where("n_lines = 1")
    wrong = ~F.col("named") & (F.col("family") != UNKNOWN) & (F.col("probability") >= 0.5)
    found = scored.groupBy("named", F.when(wrong, odds).alias("odds")).count().collect()
    left = math.floor(FALSE_SHARE * (lines - sum(r["count"] for r in found if r["named"])))
    for r in sorted((r for r in found if r["odds"] is not None), key=lambda r: -r["odds"]):
        left -= r["count"]
        if left < 0:
            return replace(model, threshold=1 / (1 + math.exp(-(r["odds"] + 1) / 100)))
    return replace(model, threshold=0.5)


def train(docs: DataFrame, sample: int = SAMPLE) -> LicenceModel:
    """learned() with the counts of all lines of docs, calibrated() on all of them."""
    spread, lines = line_counts(docs)
    model = learned(docs, spread, lines, sample)
    return calibrated(model, scored_lines(docs, model, licence_grams(spread, lines)), lines)


def strings(values: Iterable[str]) -> str:
    return "array(" + ", ".join(f"'{x}'" for x in values) + ")"


def numbers(values: Iterable[float]) -> str:
    return "array(" + ", ".join(f"{float(x)!r}D" for x in values) + ")"


def scored_lines(docs: DataFrame, model: LicenceModel, marks: Iterable[str] = ()) -> DataFrame:
    """row, doc_id, paragraph, n_lines, pairs, family (the best one, or unknown), probability, named (has one of marks): all lines, and lines together, that may be of a family."""
    # Stored, for these are few, and the optimizer would compute the scores again for each use.
    lines = c.staged(split_lines(docs).where(F.arrays_overlap("words", F.expr(strings(model.sieve or [""])))), "cued-lines")
    lines = wrapped(lines)

    def runs(n: int) -> Column:
        last = F.size("words") - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.array_join(F.slice("words", k + 1, n), " "))).otherwise(F.array().cast("array<string>"))

    lines = lines.withColumn("pairs", F.array_distinct(runs(2)))
    # As text, since thousands of literals are slow to make one by one; grams hold letters and digits only.
    keys = strings(model.weights)
    known = F.expr(f"map_from_arrays({keys}, array({', '.join(numbers(w) for w in model.weights.values())}))")
    all_grams = F.concat("words", "pairs", runs(3))
    found, marked = F.array_intersect(all_grams, F.expr(keys)), F.arrays_overlap(all_grams, F.expr(strings([*marks, ""])))
    lines = c.staged(lines.select("row", "doc_id", "paragraph", "n_lines", "pairs", found.alias("found"), marked.alias("named")).where(F.size("found") > 0), "licence-grams")
    logits = F.aggregate("found", F.expr(numbers(model.base)), lambda acc, g: F.zip_with(acc, F.element_at(known, g), lambda a, b: a + b))
    lines = lines.withColumn("logits", F.transform(logits, lambda z: z / F.lit(model.temperature)))
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda acc, z: acc + F.exp(z - F.array_max("logits")))
    best = F.array_position("logits", top).cast("int")
    lines = lines.select("row", "doc_id", "paragraph", "n_lines", "pairs", F.element_at(F.array([F.lit(f) for f in model.families]), best).alias("family"), (1 / total).alias("probability"), "named")
    return c.staged(lines, "scored-lines")


def scan_licences(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """The paragraphs that name a licence: lines, and lines together where it is wrapped.

    docs: doc_id, text; further columns are ignored. Returns a row for each
    paragraph whose best family reaches the calibrated threshold: doc_id,
    paragraph (the number of its first line, from 0), n_lines, family,
    probability, overlap (share of the word pairs of the family's nearest
    template), confirmed (overlap of at least CONFIRMS; always so for several
    lines). Null and empty texts and the unknown class give no rows;
    rows that repeat give rows that repeat; an empty table gives none.
    """
    return above(scored_lines(docs, model), model)


def above(scored: DataFrame, model: LicenceModel) -> DataFrame:
    """The lines of scored_lines() that reach the threshold, as in scan_licences()."""
    lines = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold))

    def overlap(text: str) -> Column:
        own = sorted({" ".join(x) for x in zip(tokens(text), tokens(text)[1:], strict=False)})
        return F.size(F.array_intersect("pairs", F.expr(strings(own)))) / F.lit(float(len(own)))

    share = F.lit(0.0)
    for family, texts in TEMPLATES.items():
        share = F.when(F.col("family") == family, F.greatest(*map(overlap, texts))).otherwise(share)
    lines = lines.withColumn("overlap", share).withColumn("confirmed", F.col("overlap") >= CONFIRMS)
    # What else there is of this family within reach: bounded lists.
    near = W.partitionBy("row", "family").orderBy("paragraph").rangeBetween(-WRAPPED, WRAPPED)
    mark = F.struct((F.col("confirmed") & (F.col("n_lines") == 1)).alias("alone"), "confirmed", "overlap", (-F.col("n_lines")).alias("short"), (-F.col("paragraph")).alias("early"))
    lines = lines.where("n_lines = 1 OR confirmed").withColumn("mark", mark)
    lines = lines.withColumn("others", F.collect_list(F.struct("mark", "paragraph", "n_lines")).over(near))
    met = lambda x: (x["paragraph"] < F.col("paragraph") + F.col("n_lines")) & (F.col("paragraph") < x["paragraph"] + x["n_lines"])
    lines = lines.where(F.col("mark.alone") | ~F.exists("others", lambda x: met(x) & (x["mark"] > F.col("mark"))))
    return lines.select("doc_id", "paragraph", "n_lines", "family", "probability", "overlap", "confirmed")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """train() and scan_licences() on all documents, scored once; the latter says what holds for nulls, empty texts and repeated rows."""
    docs = c.table(spark, sf_dir, "documents")
    spread, lines = line_counts(docs)
    model = learned(docs, spread, lines)
    scored = scored_lines(docs, model, licence_grams(spread, lines))
    return above(scored, calibrated(model, scored, lines))
