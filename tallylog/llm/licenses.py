"""Licence scans: a trained paragraph classifier and a template comparison, in DataFrame functions only.

A multinomial logistic regression over the words and word pairs of a paragraph, present or
not, tells licence families apart; its features are the ones of the templates below, and the
fit weighs those that ordinary text has too.  It is fit on the driver: families from variations of
the templates, ``unknown`` from a bounded sample of the corpus's own lines (SAMPLE_LINES
whole lines of SAMPLE_DOCS different texts, by the smallest hashes), and a temperature that
calibrates the probabilities from the variations held back.  A prediction is confirmed if enough of the
word pairs of one of the family's templates are in the paragraph.

Paragraphs are lines, and blocks of lines between blank ones.  Only paragraphs that can hold
enough of a template's pairs are scored, each different one once: with more than 40 % of the
pairs missing there is no match, so one of the template's rarest 40 % and one more is there.

Defined results: a null text or one without a licence paragraph has family null,
probability 0, overlap 0 and no paragraphs; of several families in a text the one of the
greatest overlap, then probability, then name is reported, with the number of confirmed
paragraphs; repeated rows get equal results; other columns, whatever their names, aren't
looked at; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.llm.common import materialise

UNKNOWN = "unknown"
SAMPLE_DOCS, SAMPLE_LINES = 400, 4000
LEAST, OVERLAP = 0.5, 0.6
VARIATIONS = 60
SEED = 7
_WORD = re.compile(r"[a-z0-9]+")

#: fixed values: the usual short notices and openings of the licence families
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "Licensed under the GNU General Public License, version 2."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Released under the BSD 2-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "Licensed under the ISC License."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "Released under CC0 1.0 Universal; dedicated to the public domain."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."),
]


def grams(text: str) -> set[str]:
    words = _WORD.findall(text.lower())
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def gram_array(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.isNotNull())))


def variations(rng: np.random.Generator, text: str, fillers: list[str]) -> list[str]:
    """The notice with words lost, or within other words, or with a name and a year before it."""
    words, found = text.split(), [text]
    while len(found) < VARIATIONS:
        keep = [w for w in words if rng.random() > (0.1 if len(words) > 6 else 0.0)]
        before = " ".join(rng.choice(fillers, rng.integers(0, 8))) if fillers else ""
        after = " ".join(rng.choice(fillers, rng.integers(0, 8))) if fillers else ""
        name = f"Copyright {rng.integers(1990, 2030)} the authors." if rng.random() < 0.2 else ""
        found.append(" ".join([before, name, *keep, after]))
    return found


class Classifier:
    """Weights by feature and family, the last family being ``unknown``."""

    def __init__(self, negatives: list[str], steps: int = 300):
        rng = np.random.default_rng(SEED)
        self.families = [*dict.fromkeys(f for f, _ in TEMPLATES), UNKNOWN]
        common: dict[str, int] = {}
        for text in negatives:
            for g in grams(text):
                common[g] = common.get(g, 0) + 1
        # however often ordinary text has a word, the fit weighs it
        self.features = sorted({g for _, t in TEMPLATES for g in grams(t)})
        at = {g: k for k, g in enumerate(self.features)}
        fillers = [w for t in negatives[:200] for w in t.split()[:20]]
        rows, labels = [], []
        for family, text in TEMPLATES:
            for x in variations(rng, text, fillers):
                rows.append(grams(x))
                labels.append(self.families.index(family))
        loose = sorted({w for _, t in TEMPLATES for w in _WORD.findall(t.lower())})
        for text in [*negatives, *(" ".join(rng.choice(loose, rng.integers(1, 6))) for _ in range(1000))]:
            rows.append(grams(text))
            labels.append(len(self.families) - 1)
        x = np.zeros((len(rows), len(self.features)), np.float32)
        for k, row in enumerate(rows):
            x[k, [at[g] for g in row if g in at]] = 1
        y = np.eye(len(self.families), dtype=np.float32)[labels]
        fit, held = np.arange(len(rows)) % 5 > 0, np.arange(len(rows)) % 5 == 0
        w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
        for _ in range(steps):
            slope = (softmax(x[fit] @ w + b) - y[fit]) / fit.sum()
            speed_w = 0.9 * speed_w + x[fit].T @ slope + 1e-5 * w
            speed_b = 0.9 * speed_b + slope.sum(0)
            w, b = w - 5 * speed_w, b - 5 * speed_b
        self.weights = np.where(np.abs(w) < 1e-3, 0, w)
        logits = x[held] @ self.weights + b
        losses = {t: -np.log(np.maximum((softmax(logits / t) * y[held]).sum(1), 1e-9)).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
        self.temperature = min(losses, key=losses.get)
        self.bias = b
        #: pairs without which no template is held to OVERLAP, the ones that ordinary text has least, and a word of each
        self.pairs = sorted({g for _, t in TEMPLATES for g in needed(pairs_of(t), common)})
        self.cues = sorted({min(g.split(), key=lambda w: (common.get(w, 0), w)) for g in self.pairs})


def needed(pairs: set[str], common: dict[str, int]) -> list[str]:
    """The rarest ``pairs``, as many as leave too few others for OVERLAP."""
    least = next(n for n in range(1, len(pairs) + 1) if n / len(pairs) >= OVERLAP)
    return sorted(pairs, key=lambda g: (common.get(g, 0), g))[: len(pairs) - least + 1]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(df: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Classifier:
    """Fit with ``unknown`` paragraphs: of ``sample_docs`` different texts ``sample_lines`` different lines, both of the smallest hashes; lines that hold a template are none."""
    texts = df.where(df[text_col].isNotNull()).select(F.xxhash64(df[text_col]).alias("hash"), df[text_col].alias("text"))
    chosen = texts.select("hash").distinct().orderBy("hash").limit(sample_docs)
    held = texts.join(F.broadcast(chosen), "hash", "left_semi").dropDuplicates(["hash"])
    lines = held.select(F.explode(F.split("text", "\n")).alias("line")).distinct().orderBy(F.xxhash64("line"), "line").limit(sample_lines)
    sample = [r["line"] for r in lines.collect()]
    exact = [grams(t) for _, t in TEMPLATES]
    return Classifier([x for x in sample if not any(len(t & grams(x)) >= 0.6 * len(t) for t in exact)])


def paragraphs(text: Column) -> Column:
    """Different lines, and different blocks of several lines."""
    blocks = F.filter(F.split(text, r"\n[ \t]*\n"), lambda b: F.contains(F.trim(b), F.lit("\n")))
    return F.array_distinct(F.concat(F.split(text, "\n"), blocks))


def bounded_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the model, read from one literal, so that no Python runs outside the driver."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(x.replace(' ', ': ') for x in schema.split(', '))}>>")))


def scored(units: DataFrame, model: Classifier) -> DataFrame:
    """(unit, family, probability, overlap) of the different paragraphs ``unit`` that aren't ``unknown`` and are confirmed."""
    held = materialise(keyed(units).distinct(), "paragraphs")
    return held.join(scored_keys(held, model), "paragraph").select("unit", "family", "probability", "overlap")


def keyed(units: DataFrame) -> DataFrame:
    """``units`` with a digest of the paragraph, so that the text itself needn't be grouped and joined by."""
    return units.withColumn("paragraph", F.sha2("unit", 256))


def scored_keys(held: DataFrame, model: Classifier) -> DataFrame:
    """``scored`` for different paragraphs (paragraph, unit), named by their digests."""
    spark = held.sparkSession
    known = F.split(F.lit("\n".join(model.features)), "\n")
    hits = held.select("paragraph", F.explode(F.array_intersect(gram_array(word_array(F.col("unit"))), known)).alias("gram"))
    rows = [(g, k, float(v)) for g, row in zip(model.features, model.weights, strict=True) for k, v in enumerate(row) if v]
    weights = bounded_table(spark, rows, "gram string, class int, weight double")
    base = [(k, float(v)) for k, v in enumerate(model.bias)]
    shares = [(k, f, g, len(p)) for k, (f, t) in enumerate(TEMPLATES) for p in [pairs_of(t)] for g in p]
    templates = bounded_table(spark, shares, "template int, family string, gram string, size int")
    # the weights of one paragraph side by side; adding them up in fixed point keeps reruns alike
    total = hits.join(weights, "gram").groupBy("paragraph", "class").agg(F.sum(F.round(F.col("weight") * 1e9).cast("long")).alias("w"))
    wide = total.groupBy("paragraph").agg(*[F.coalesce(F.sum(F.when(F.col("class") == k, F.col("w"))), F.lit(0)).alias(f"w{k}") for k, _ in base])
    logit = [(F.col(f"w{k}") / 1e9 + v) / float(model.temperature) for k, v in base]
    top = F.greatest(*logit)
    norm = sum((F.exp(x - top) for x in logit[1:]), F.exp(logit[0] - top))
    named = F.coalesce(*[F.when(x == top, F.lit(f)) for x, f in zip(logit, model.families, strict=True)])
    told = wide.select("paragraph", named.alias("family"), (F.lit(1.0) / norm).alias("probability")).where((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST))
    overlap = hits.join(templates, "gram").groupBy("paragraph", "family", "template").agg((F.count("*") / F.first("size")).alias("overlap"))
    overlap = overlap.groupBy("paragraph", "family").agg(F.max("overlap").alias("overlap"))
    return told.join(overlap, ["paragraph", "family"]).where(F.col("overlap") >= OVERLAP)


def pairs_of(text: str) -> set[str]:
    return {g for g in grams(text) if " " in g}


def license_scan(df: DataFrame, model: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, family, probability, overlap, n_paragraphs) for each row of ``df``."""
    model = model or train(df, text_col)
    cues = F.split(F.lit(" ".join(model.cues)), " ")
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    # a text's families depend on the text alone, so a digest of it is the key
    docs = docs.withColumn("key", F.sha2("text", 256))
    some = docs.where(F.arrays_overlap(word_array(F.col("text")), cues))
    units = some.select("key", F.explode(paragraphs(F.col("text"))).alias("unit")).where(F.arrays_overlap(word_array(F.col("unit")), cues))
    units = units.where(F.arrays_overlap(gram_array(word_array(F.col("unit"))), F.split(F.lit("\n".join(model.pairs)), "\n")))
    units = materialise(keyed(units).distinct(), "units")
    found = materialise(scored_keys(units.select("paragraph", "unit").dropDuplicates(["paragraph"]), model), "licences")
    best = units.select("key", "paragraph").join(found, "paragraph").groupBy("key").agg(F.max(F.struct("overlap", "probability", "family")).alias("best"), F.count("*").alias("n"))
    best = materialise(best.select(F.col("key").alias("_key"), "best", "n"), "licences")
    joined = docs.select("doc_id", "key").join(best, F.col("key") == F.col("_key"), "left")
    return joined.select("doc_id", F.col("best.family").alias("family"), F.round(F.coalesce("best.probability", F.lit(0.0)), 6).alias("probability"), F.round(F.coalesce("best.overlap", F.lit(0.0)), 6).alias("overlap"), F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"))
