"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates. Built-in functions only.

A paragraph ends at a blank line; its lines are read on, so that a notice may be wrapped. It is judged in windows of at
most 2 * STRIDE words that overlap by half: a template is whole in one of them, however long the paragraph. The word
n-grams of a window are the features of a sparse logistic regression over licence families and one unknown class. The
regression is trained here, on variations of templates and on a bounded sample of windows of the corpus, which stand for
the unknown; how sure it must be is calibrated on rows kept aside. A predicted family is confirmed by the share of one of
its templates that the window holds. A window may hold more than one licence: a family that is no less sure than the
threshold when only it and the unknown are asked counts too, if the window holds nearly all of one of its templates.

Texts without any of a few words of the templates, and windows with too few words of templates, are passed over with one
look: what holds enough of a template to confirm it has both, whatever else the corpus holds (see anchors, least_words).
"""

from __future__ import annotations

import functools
import itertools
import random
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans

UNKNOWN = "unknown"
#: Wordings by family: fixed texts of licence notices.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc_by_nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc_by_sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc_by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "public_domain": (
        "This work is dedicated to the public domain under CC0 1.0.",
        "The author waives all rights to the work worldwide under copyright law by dedicating it to the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "reserved": (
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ),
}
#: Everyday sentences with words of licences that grant nothing; they teach the unknown class what a licence is not.
NOT_LICENCES = (
    "He lost his driving license last year and cannot work.",
    "The city granted a license to sell food in the public square.",
    "She asked for permission to leave the room.",
    "The warranty of the washing machine expired in May.",
    "General Apache warriors crossed the desert.",
    "She studied at MIT and later taught in Berkeley.",
    "The software is slow and the documentation is poor.",
    "Terms and conditions may apply to this offer.",
    "The public library is free and open to any person.",
    "The license plate of the car could not be read.",
)

_TOKEN = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
#: Share of a template that confirms a family, and the share that a family beside the most likely one needs.
LEAST_SHARE, BESIDE_SHARE = 0.6, 0.9
#: Words from one window to the next; no template is longer.
STRIDE = 48
_BLANK = r"\n(?:[\x20\t\r]*\n)+"
_CHUNK = rf"(?:[^a-z0-9]*+(?:{_TOKEN})){{1,{STRIDE}}}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def ngrams(words: Column, most: int = 3) -> Column:
    """The distinct n-grams of 1 to most words, words joined by spaces."""
    n = F.size(words)
    out = [words]
    for k in range(2, most + 1):
        places = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        out.append(_runs(words, places, k))
    return F.array_distinct(F.concat(*out))


def windows(paragraph: Column) -> Column:
    """A paragraph in lower case in windows: each STRIDE words of it with the next STRIDE; one window if there are fewer."""
    chunks = F.regexp_extract_all(F.lower(paragraph), F.lit(_CHUNK), F.lit(0))

    def pairs(c: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0)))
        return F.transform(places, lambda i: F.concat_ws(" ", F.get(c, i), F.get(c, i + 1)))

    return spans.once(chunks, lambda c: F.when(F.size(c) > 0, pairs(c)).otherwise(F.array().cast("array<string>")))


def _runs(words: Column, places: Column, k: int) -> Column:
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, k), " "))


def _words(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


@dataclass
class Classifier:
    features: CountVectorizerModel
    regression: LogisticRegressionModel
    families: list[str]
    threshold: float


def variations(per_template: int, seed: int) -> list[tuple[str, str]]:
    """family and words of each template and of versions of it with words dropped, cut off, added or renumbered."""
    rng = random.Random(seed)
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = _words(text)
            out.append((family, text))
            for _ in range(per_template):
                w = [x for x in words if rng.random() > 0.08]
                if len(w) > 12 and rng.random() < 0.4:
                    w = w[: rng.randint(len(w) * 2 // 3, len(w))]
                noise = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(0, 12))]
                out.append((family, " ".join(w + noise if rng.random() < 0.5 else noise + w)))
    return out + [(UNKNOWN, t) for t in NOT_LICENCES]


def _sample(docs: DataFrame, texts: int, most: int, seed: int) -> list[str]:
    """Windows of the distinct texts of least hash, at most so many texts and windows. Only hashes are sorted."""
    hashed = docs.filter("text is not null and text <> ''").select("text", F.xxhash64("text", F.lit(seed)).alias("h"))
    least = hashed.select("h").distinct().orderBy("h").limit(texts).agg(F.max("h")).first()[0]
    if least is None:
        return []
    picked = hashed.filter(F.col("h") <= least).groupBy("h").agg(F.first("text").alias("text"))
    first = F.slice(F.flatten(F.transform(F.split("text", _BLANK), windows)), 1, 10)
    return [r.w for r in picked.select("h", F.posexplode(first).alias("i", "w")).orderBy("h", "i").limit(most).collect()]


def fit(docs: DataFrame, most_windows: int = 3000, per_template: int = 25, seed: int = 5) -> Classifier:
    """Train on the templates' variations and on most_windows windows of docs at most (a documented bound).

    The windows are the first ten of the texts of least hash. Those that hold a large share of a template are left out,
    as they are no examples of the unknown. One row in four is kept aside; the threshold is the least probability at
    which at most one in a thousand of the unknown rows kept aside would be taken for a licence, and 0.5 at least. docs
    needs text; nulls, empty and repeated texts, and an empty table, only leave fewer examples of the unknown.
    """
    spark = docs.sparkSession
    found = _sample(docs, max(most_windows // 10, 1), most_windows, seed)
    templates = [set(_grams(_words(t))) for texts in TEMPLATES.values() for t in texts]
    plain = [x for x in found if not any(len(t & set(_grams(_words(x)))) > 0.4 * len(t) for t in templates)]
    rows = variations(per_template, seed) + [(UNKNOWN, x) for x in plain]
    families = sorted({f for f, _ in rows})
    vocabulary = sorted({g for texts in TEMPLATES.values() for t in texts for g in _grams(_words(t))})
    data = spark.createDataFrame([(float(families.index(f)), t, i) for i, (f, t) in enumerate(rows)], "label double, line string, no int")
    features = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    features.setBinary(True)
    made = features.transform(data.withColumn("grams", ngrams(tokens(F.col("line"))))).select("label", "features", "no").coalesce(2)
    apart = F.pmod(F.xxhash64("no", F.lit(seed)), F.lit(4)) == 0
    model = LogisticRegression(regParam=0.002, maxIter=40, family="multinomial").fit(made.filter(~apart))
    unknown = families.index(UNKNOWN)
    aside = model.transform(made.filter(apart & (F.col("label") == unknown))).select(vector_to_array("probability").alias("p"))
    sure = sorted((max(p) if p.index(max(p)) != unknown else 0.0 for (p,) in aside.collect()), reverse=True)  # a quarter of the bounded rows
    threshold = max(0.5, (sure[len(sure) // 1000] + 1) / 2 if sure and sure[len(sure) // 1000] > 0.5 else 0.5)
    return Classifier(features, model, families, threshold)


def _grams(words: list[str], most: int = 3) -> list[str]:
    return [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def _templates(spark: SparkSession) -> DataFrame:
    """family and wordings: the n-grams of each of its templates."""
    rows = [(family, [sorted(set(_grams(_words(t)))) for t in texts]) for family, texts in TEMPLATES.items()]
    return spark.createDataFrame(rows, "family string, wordings array<array<string>>").coalesce(1)


@functools.cache
def anchors() -> tuple[str, ...]:
    """Words of which every window that confirms a template has one: those of each template that are in fewest families,
    and of these the longest, until less than LEAST_SHARE of its n-grams are without one. They follow from the templates
    alone, whatever a corpus is like."""
    families = Counter(w for texts in TEMPLATES.values() for w in {w for t in texts for w in _words(t)})
    out: set[str] = set()
    for text in (t for texts in TEMPLATES.values() for t in texts):
        grams = {tuple(g.split(" ")) for g in _grams(_words(text))}
        words = sorted((w for w in set(_words(text)) if w.isalpha() and len(w) > 1), key=lambda w: (w not in out, families[w], -len(w), w))
        own: set[str] = set()
        while sum(own.isdisjoint(g) for g in grams) >= LEAST_SHARE * len(grams):
            own.add(words.pop(0))
        out |= own
    return tuple(sorted(out))


@functools.cache
def least_words() -> int:
    """How many words of a template a window that confirms any has at least: of templates of up to 10 words all choices of
    missing words are tried; of longer ones a missing word takes a third of its n-grams away at least."""

    def of(text: str) -> int:
        grams = {tuple(g.split(" ")) for g in _grams(_words(text))}
        words, most = sorted(set(_words(text))), (1 - LEAST_SHARE) * len(grams)
        for missing in range(len(words), -1, -1):
            if len(words) <= 10:
                taken = min(sum(not set(gone).isdisjoint(g) for g in grams) for gone in itertools.combinations(words, missing))
            else:
                taken = sum(sorted(sum(w in g for g in grams) for w in words)[:missing]) / 3
            if taken <= most:
                return len(words) - missing
        return len(words)

    return min(of(t) for texts in TEMPLATES.values() for t in texts)


def _of_templates(words: Column) -> Column:
    """How many distinct words of templates are among a window's."""
    every = sorted({w for texts in TEMPLATES.values() for t in texts for w in _words(t)})
    return F.size(F.array_intersect(words, F.array(*map(F.lit, every))))


def word_pattern(words: list[str]) -> str:
    """An expression for any of the words, with each shared beginning written once, so that few tries part them."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def of(node: dict) -> str:
        parts = [c + of(below) for c, below in sorted(node.items()) if c]
        inner = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})" if parts else ""
        return f"{inner}?" if parts and "" in node and inner.startswith("(?:") else f"(?:{inner})?" if parts and "" in node else inner

    return of(tree)


def _anchored(text: Column) -> Column:
    """Whether a text has an anchor among its words."""
    return F.lower(text).rlike(rf"(?<![a-z]){word_pattern(list(anchors()))}(?![a-z])")


def scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """One row per paragraph and family that is taken for its licence: doc_id, paragraph_no, family, probability, share,
    confirmed.

    docs needs doc_id and text; other columns are ignored, whatever their names. paragraph_no counts from 0. probability
    is the greatest over the paragraph's windows, and so is share, that of the nearest template of the family that a
    window holds; confirmed says whether it reaches LEAST_SHARE. Judged are the windows that have one of anchors() and
    least_words() words of templates, which all have that could confirm one. Null and empty texts have no paragraphs. Repeated rows
    and paragraphs are each reported. Long texts are read whole, at a cost in proportion to their length. An empty table
    gives no rows.
    """
    model = model or fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(_anchored(F.col("text")))
    rows = rows.withColumn("row_no", F.monotonically_increasing_id())
    parts = rows.select("row_no", "doc_id", F.posexplode(F.split("text", _BLANK)).alias("paragraph_no", "paragraph"))
    parts = parts.select("row_no", "doc_id", F.col("paragraph_no").cast("long").alias("paragraph_no"), F.explode(windows(F.col("paragraph"))).alias("window")).filter(_anchored(F.col("window")))
    parts = parts.withColumn("words", tokens(F.col("window"))).filter(_of_templates(F.col("words")) >= least_words())
    made = model.features.transform(parts.withColumn("grams", ngrams(F.col("words"))))
    judged = model.regression.transform(made).select("row_no", "doc_id", "paragraph_no", "grams", vector_to_array("probability").alias("p"))
    unknown = F.get("p", F.lit(model.families.index(UNKNOWN)))
    names = [(i, f) for i, f in enumerate(model.families) if f != UNKNOWN]
    asked = F.array(*(F.struct(F.lit(f).alias("family"), F.get("p", F.lit(i)).alias("probability"), (F.get("p", F.lit(i)) / (F.get("p", F.lit(i)) + unknown)).alias("alone")) for i, f in names))
    sure = judged.withColumn("x", F.explode(F.filter(asked, lambda x: x["alone"] >= model.threshold))).select("row_no", "doc_id", "paragraph_no", "grams", "x.*")
    compared = sure.join(F.broadcast(_templates(docs.sparkSession)), "family")  # a row per family
    share = F.array_max(F.transform("wordings", lambda t: F.size(F.array_intersect(F.col("grams"), t)) / F.size(t)))
    taken = compared.withColumn("share", share).filter((F.col("probability") >= model.threshold) | (F.col("share") >= BESIDE_SHARE))
    out = taken.groupBy("row_no", "doc_id", "paragraph_no", "family").agg(F.max("probability").alias("probability"), F.max("share").alias("share"))
    return out.select("doc_id", "paragraph_no", "family", F.round("probability", 6).alias("probability"), F.round("share", 6).alias("share"), (F.col("share") >= LEAST_SHARE).alias("confirmed"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
