"""License scans: a trained paragraph classifier in DataFrame operations.

Training (numpy, on the driver, from the texts below; no input is needed)
gives sparse multinomial logistic weights over word n-grams, calibrated by a
temperature, with a class for everything that is no license. Every paragraph
is judged. A paragraph is a line, with the lines that follow it where it looks
hard-wrapped. Each word of a paragraph counts what the n-grams that hang on
it could add at most (evidence(), derived from the weights); where the sum
proves that the paragraph is no license, its n-grams are not made.

Scanning uses SQL functions alone: the paragraphs left, their n-grams that have
weights, a join with the weight table (its size is fixed by the training texts),
a softmax, and the overlap with the predicted family's templates.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

UNKNOWN = "unknown"
#: Least calibrated probability, and least share of common word pairs with a template.
LEAST_PROBABILITY, LEAST_OVERLAP = 0.6, 0.6
#: Least calibrated probability of being any license that gives a row.
LEAST_LICENSE = 0.5
NGRAMS = (1, 2, 3)
#: A line that goes on in the next one: of the usual width, not ended by a mark.
WRAPPED = r"(?m)^([^\n]{40,100}[^\n.!?:;])\r?\n(?=[^\s])"

#: Usual notices of well-known licenses, and their names.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.',
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.',
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Released under the Apache 2.0 license.",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU GPL version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "Distributed under the GPL v2.",
        "Released under the GNU General Public License, version 2 or later.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 3.",
        "Distributed under the GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "Released under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.',
        "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages however caused and on any theory of liability.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": [
        "Released under CC0 1.0.",
        "This work is dedicated to the public domain under the CC0 1.0 Universal license.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "proprietary": [
        "Alle Rechte vorbehalten.",
        "Tous droits réservés.",
        "Todos los derechos reservados.",
        "All rights reserved.",
        "Copyright Example Corporation. All rights reserved.",
        "This software is proprietary and confidential. Unauthorized copying is prohibited. All rights reserved.",
    ],
}
#: Sentences with the words of notices that are no license.
OTHERS = [
    "She renewed her driving license last week.",
    "The bar lost its liquor licence after the fire.",
    "He is a licensed electrician in the city.",
    "They bought a license to fish in the lake.",
    "The license plate of the car was hidden.",
    "Licensing fees went up again this year.",
    "The company licensed the song for a film.",
    "The gnu is a large antelope of the plains.",
    "An apache helicopter landed near the village.",
    "The Apache people lived in the southwest.",
    "Mozilla makes a web browser called Firefox.",
    "The committee redistributed the funds among the schools.",
    "Redistribution of wealth was the theme of the debate.",
    "Seats in the house were redistributed after the census.",
    "Human rights are for all and rights must be protected.",
    "He was reserved and all rights went to his brother.",
    "The drug has a proprietary name.",
    "A proprietary blend of spices made the sauce.",
    "The doctor lost his license to practice medicine.",
    "A poetic licence let him change the ending.",
    "Permission is hereby requested to leave the room.",
    "She works in the public sector under a new license scheme.",
    "Version 2.0 of the game needs no license key.",
    "The software is sold without a manual.",
    "All rights of way are shown on the map of the county.",
    "The terms of the contract were published in the public record.",
    "Copies of the report are distributed free of charge to any person who asks.",
    "The author was granted permission to use the name of the holder in the film.",
    "The binary form of the number has eight digits.",
    "The claim for damages was liable to fail in court.",
    "There is no warranty on the car, express or implied, said the dealer.",
    "General conditions of sale apply to the public.",
    "Die Rechte der Frau wurden 1919 in der Verfassung verankert.",
    "Les droits de l'homme sont universels.",
    "Los derechos humanos son para todos.",
    "Notice of the meeting must be included in the following list.",
    "The mit student published a paper on the version of the source code.",
]
#: English words that are in most texts. An n-gram of these alone is no feature.
COMMON = frozenset("a all an and any are as at be been but by can do for from had has have he her his i if in into is it its may me my no not of on or other out she so such than that the their them there they this to up was we were what which who will with you your".split())
PREFIXES = ["", "", "", "// ", "# ", "* ", "Note: ", "Copyright (c) 2020 Jane Roe. ", "The text is here. "]
SUFFIXES = ["", "", "", " See the file for details.", " Please read it.", " (c) 2021"]


def words_of(text: str) -> list[str]:
    """Words of a paragraph, as the SQL side cuts them."""
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def ngrams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in NGRAMS for i in range(len(words) - n + 1) if not COMMON.issuperset(words[i : i + n])}


def _examples(seed: int = 5, per_text: int = 14) -> list[tuple[set[str], str]]:
    """Noisy copies of the templates and of other sentences, with random words around and dropped."""
    rng = np.random.default_rng(seed)
    noise = lambda n: " ".join("".join(rng.choice(list("abcdefghiklmnoprstuvwz"), rng.integers(1, 9))) for _ in range(n))
    out = []

    def add(text: str, label: str) -> None:
        words = text.split()
        if len(words) > 12 and rng.random() < 0.4:  # a part of a long notice
            n = rng.integers(8, len(words))
            at = rng.integers(0, len(words) - n + 1)
            words = words[at : at + n]
        if len(words) > 8:
            words = [w for w in words if rng.random() > 0.04]
        text = " ".join(words)
        if rng.random() < 0.3:
            text = f"{noise(rng.integers(1, 12))} {text}" if rng.random() < 0.5 else f"{text} {noise(rng.integers(1, 25))}"
        text = str(rng.choice(PREFIXES)) + text + str(rng.choice(SUFFIXES))
        out.append((ngrams_of(words_of(text)), label))

    for label, texts in TEMPLATES.items():
        for text in texts:
            for _ in range(per_text):
                add(text, label)
    for text in OTHERS:
        for _ in range(per_text * 2):
            add(text, UNKNOWN)
    # words of notices alone or in pairs say little
    words = sorted({w for texts in TEMPLATES.values() for t in texts for w in words_of(t)})
    for k in range(len(words) * 2):
        own = " ".join([words[k % len(words)], *rng.choice(words, rng.integers(0, 2))])
        add(f"{noise(rng.integers(0, 12))} {own} {noise(rng.integers(0, 12))}", UNKNOWN)
    return out


@functools.cache
def fitted() -> tuple[list[str], np.ndarray, dict[str, np.ndarray], float]:
    """(classes, biases, n-gram -> weights, temperature)."""
    train, held = _examples(5), _examples(6, 6)
    classes = sorted(TEMPLATES) + [UNKNOWN]
    counts: dict[str, int] = {}
    for grams, _ in train:
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
    vocabulary = {g: k for k, g in enumerate(sorted(g for g, n in counts.items() if n >= 5))}
    matrix = lambda rows: np.array([[g in own for g in vocabulary] for own, _ in rows], np.float64)
    x, y = matrix(train), np.array([classes.index(c) for _, c in train])
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)  # the last row of weights holds the biases
    target = np.eye(len(classes))[y]
    balance = (len(y) / len(classes) / target.sum(axis=0))[y] ** 0.5
    balance /= balance.sum()

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    v = np.ones(x.shape[1])
    for _ in range(20):  # the largest curvature bounds the step
        v = x.T @ (balance * (x @ v))
        v /= np.linalg.norm(v)
    rate, l1 = 2 / np.linalg.norm(x.T @ (balance * (x @ v))), 0.0003
    w = ahead = np.zeros((x.shape[1], len(classes)))
    for step in range(1, 301):  # accelerated proximal gradient: a step, then shrinking towards zero
        new = ahead - rate * (x.T @ (balance[:, None] * (soft(x @ ahead) - target)))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * l1, 0)
        ahead, w = new + (step - 1) / (step + 2) * (new - w), new
    w, b = w[:-1], w[-1] - w[-1].mean()
    hx, hy = matrix(held), np.array([classes.index(c) for _, c in held])
    z = hx @ w + b
    loss = lambda t: -np.log(soft(z / t)[np.arange(len(hy)), hy] + 1e-12).mean()
    temperature = min((0.3 * 1.15**k for k in range(20)), key=loss)
    kept = np.abs(w).max(axis=1) > 0
    return classes, b, {g: w[k] for g, k in vocabulary.items() if kept[k]}, float(temperature)


#: Bounds of the classes of evidence: words of a class count as its upper end.
CLASSES = (1.0, 0.93, 0.8, 0.65, 0.5, 0.35, 0.2, 0.1)


@functools.cache
def evidence() -> tuple[tuple[float, tuple[str, ...]], ...]:
    """(worth, words): a text whose distinct words are worth less than 1 in all gives no row.

    Every n-gram hangs on one of its words, and a word is worth the most that
    its n-grams, all together, move any family from its odds against `unknown` in
    an empty text towards its share of LEAST_LICENSE, of the way there.
    """
    classes, bias, weights, temperature = fitted()
    unknown = classes.index(UNKNOWN)
    share = LEAST_LICENSE / (1 - LEAST_LICENSE) / (len(classes) - 1)
    way = np.maximum(bias[unknown] - bias + temperature * np.log(share) - 1e-6, 1e-9)
    way[unknown] = np.inf
    moved: dict[str, np.ndarray] = {}
    for g, w in sorted(weights.items()):
        word = max(sorted(set(g.split()) - COMMON), key=len)
        moved[word] = moved.get(word, 0.0) + np.maximum(w - w[unknown], 0)
    worth = {word: float((m / way).max()) for word, m in moved.items()}
    edges = [np.inf, *CLASSES, 0.0]
    out = [(high, tuple(word for word, v in worth.items() if low < v <= high)) for high, low in zip(edges, edges[1:])]
    return tuple((min(high, 1.0), own) for high, own in out if own)


def may_be_license(words: list[str]) -> bool:
    return sum(worth * len(set(own).intersection(words)) for worth, own in evidence()) >= 1


def _pairs(words: list[str]) -> list[str]:
    return sorted({" ".join(p) for p in zip(words, words[1:])}) or words


def paragraphs_of(text: str | None) -> list[str]:
    """Paragraphs of a text, as the SQL side cuts them."""
    return re.sub(WRAPPED, r"\1 ", text or "").split("\n")


def _paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, row, paragraph, words of all paragraphs that may be a license. row tells
    repeated documents apart."""
    cut = lambda line: F.split(F.lower(line), "[^a-z0-9]+")
    listed = [w for _, own in evidence() for w in own]
    lines = F.split(F.regexp_replace("text", WRAPPED, "$1 "), "\n")
    # step by step inside one array that is then unfolded: the optimizer copies no step into the next ones
    found = F.transform(lines, lambda line, k: F.struct(k.alias("paragraph"), line.alias("line"), F.array_distinct(F.filter(cut(line), lambda w: w.isin(listed))).alias("found")))
    within = lambda own, words: F.size(F.filter(own, lambda w: w.isin(list(words))))
    worth = lambda own: functools.reduce(lambda a, b: a + b, [within(own, words) * value for value, words in evidence()])
    kept = F.filter(F.filter(found, lambda x: F.size(x["found"]) > 0), lambda x: worth(x["found"]) >= 1)
    worded = F.transform(kept, lambda x: F.struct(x["paragraph"].alias("paragraph"), F.filter(cut(x["line"]), lambda w: w != "").alias("words")))
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.monotonically_increasing_id().alias("row"), F.inline(worded))


def _runs(words: Column, n: int) -> Column:
    """The n-word runs of an array of words, space-joined; none if it is shorter."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def license_paragraphs(docs: DataFrame) -> DataFrame:
    """Of docs (doc_id, text), every paragraph that is likely a license -> doc_id, paragraph
    (from 0), family, probability, overlap, confirmed.

    A paragraph gives a row if the calibrated probability that it is of any
    family is at least LEAST_LICENSE. family is the most probable one (the first
    in the alphabet of equal ones) if its own probability is at least
    LEAST_PROBABILITY, else `unknown`; overlap is the largest share of word pairs
    that the paragraph and one of the family's templates have in common, of the
    smaller of the two (0 for unknown); confirmed if it is at least LEAST_OVERLAP.
    Null and empty texts give no row; very long texts are cut into lines by the task that
    reads them, and only lines that may be a license go on; repeated documents and null ids give their
    own rows; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    classes, bias, weights, temperature = fitted()
    unknown = classes.index(UNKNOWN)
    weight_table = _table(spark, [{"gram": g, "w": w.tolist()} for g, w in weights.items()], "gram string, w array<double>")
    templates = _table(spark, [{"family": label, "template": _pairs(words_of(t))} for label, texts in TEMPLATES.items() for t in texts], "family string, template array<string>")
    rows = _paragraphs(pick(docs, "doc_id", "text"))
    words = F.col("words")
    grams = F.array_intersect(F.concat(*[_runs(words, n) for n in NGRAMS]), F.from_json(F.lit(json.dumps(sorted(weights))), "array<string>"))
    pairs = F.when(F.size(words) > 1, F.array_distinct(_runs(words, 2))).otherwise(words)
    known = F.from_json(F.lit(json.dumps(sorted({p for texts in TEMPLATES.values() for t in texts for p in _pairs(words_of(t))}))), "array<string>")
    rows = rows.select("doc_id", "row", "paragraph", grams.alias("grams"), pairs.alias("pairs"))
    rows = rows.select("doc_id", "row", "paragraph", "grams", F.size("pairs").alias("n"), F.array_intersect("pairs", known).alias("pairs"))
    hits = rows.select("doc_id", "row", "paragraph", "n", "pairs", F.explode("grams").alias("gram")).join(F.broadcast(weight_table), "gram")
    sums = [F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(classes))]
    summed = hits.groupBy("row", "paragraph").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("pairs").alias("pairs"), *sums)
    logits = F.array(*[(F.round(F.col(f"s{k}") + float(bias[k]), 9) / temperature) for k in range(len(classes))])
    scored = summed.select("doc_id", "row", "paragraph", "n", "pairs", logits.alias("z"))
    top = F.array_max("z")
    scored = scored.withColumn("best", F.array_position("z", top) - 1).withColumn("total", F.aggregate("z", F.lit(0.0), lambda acc, z: acc + F.exp(z - top)))
    scored = scored.where(1 - F.exp(F.col("z")[unknown] - top) / F.col("total") >= LEAST_LICENSE)
    named = F.array(*map(F.lit, classes))[F.col("best").cast("int")]
    scored = scored.withColumn("probability", 1 / F.col("total")).withColumn("family", F.when(F.col("probability") >= LEAST_PROBABILITY, named).otherwise(UNKNOWN))
    compared = scored.join(F.broadcast(templates), "family", "left")
    shared = F.size(F.array_intersect("pairs", "template")) / F.greatest(F.least("n", F.size("template")), F.lit(1))
    result = compared.groupBy("row", "paragraph").agg(
        F.first("doc_id").alias("doc_id"), F.first("family").alias("family"), F.round(F.first("probability"), 6).alias("probability"), F.coalesce(F.max(F.when(F.col("template").isNotNull(), shared)), F.lit(0.0)).alias("overlap")
    )
    return result.select("doc_id", "paragraph", "family", "probability", "overlap", ((F.col("family") != UNKNOWN) & (F.col("overlap") >= LEAST_OVERLAP)).alias("confirmed"))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows as a relation of one literal, without Python on the executors."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))
