"""Operator 9, licence scans by a trained paragraph classifier.

Every line of every text is a paragraph. Features are hashed 1- and 2-grams of its words (lower-cased runs of
letters and digits), present or not, divided by the root of their number; a softmax regression over them,
trained here, tells the licence families, `unknown` (licences of no family) and `none` apart. It learns a family from notices
that combine PHRASES with its NAMES, and from parts of its TEXTS, with words left out, doubled and surrounded by words of
ordinary paragraphs; `unknown` from the same phrases with OTHER names, and GENERIC sentences; `none` from lines of a
sample of the documents. The bound on what is fitted is SAMPLE_DOCUMENTS documents (those of the least hashes of doc_id), of which
SAMPLE_LINES lines of at most LINE_CHARS characters are taken; lines that resemble a notice are left out.

The unknown class is calibrated: the least probability of a family, and the least confirmation by a template, are set where
notices worded as none of those learned from, and notices with names of other licences that weren't learned from either, are told
apart best. The confirmation is the share of the word pairs of one of the family's notices or texts that the
paragraph has, or the share of the paragraph's own word pairs that those hold together. A paragraph
that isn't `none` but lacks either is `unknown`, if it is worded as a notice (UNKNOWN), or further from `none` than nearly all (ORDINARY) ordinary lines that weren't learned from.

Defined results: a null text has no paragraphs, an empty one has one; rows are independent, so repeated rows,
null ids and clashing names change nothing; an empty table gives an empty result (the model then knows no ordinary lines); of
families of equal probability the first by name is taken; a text of any length is one row, of which a task's memory holds
about 40 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SIGNS, U64, find, grams, slices, utf8

#: Names in use for each family.
NAMES = {
    "agpl-3.0": ["the GNU Affero General Public License, version 3", "the GNU AGPL v3", "the GNU AGPL v3 or later", "the AGPL-3.0 license", "GNU AGPL 3.0", "the Affero GPL version 3"],
    "apache-2.0": ["the Apache License, Version 2.0", "the Apache 2.0 license", "the Apache License 2.0", "the Apache license v2", "Apache-2.0", "the Apache Software License 2.0"],
    "bsd": ["the BSD license", "the BSD 3-Clause License", "the BSD 2-Clause License", "the three-clause BSD license", "the simplified BSD license", "the new BSD license", "a BSD-style license", "BSD-3-Clause"],
    "cc-by": ["CC BY 4.0", "CC-BY", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution license", "CC BY 3.0", "Creative Commons Attribution 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC", "a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons Attribution NonCommercial license", "CC BY-NC 3.0", "Creative Commons BY-NC"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA", "a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution ShareAlike license", "CC BY-SA 3.0", "Creative Commons BY-SA"],
    "cc0": ["CC0 1.0 Universal", "CC0", "the CC0 1.0 public domain dedication", "Creative Commons Zero", "the Creative Commons CC0 license"],
    "gpl-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2", "GPLv2", "the GPL version 2", "GPL-2.0-only", "the GNU GPL version 2 or later"],
    "gpl-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3", "GPLv3", "the GPL version 3", "GPL-3.0-or-later", "the GNU GPL version 3 or later"],
    "lgpl": ["the GNU Lesser General Public License", "the GNU LGPL, version 2.1 or later", "the LGPL", "LGPLv3", "the GNU Lesser GPL version 3", "LGPL-2.1-or-later"],
    "mit": ["the MIT License", "the MIT license", "the Expat License", "an MIT-style license", "MIT", "the MIT/X11 license"],
    "mpl-2.0": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0", "MPL 2.0", "the MPL version 2", "MPL-2.0"],
}
#: Names of licences of no family; the second half only calibrates.
OTHER = ["the Eclipse Public License 2.0", "the Artistic License", "the zlib License", "the Boost Software License", "the European Union Public Licence", "a commercial license", "the Open Font License", "the terms of our customer agreement", "the Common Development and Distribution License", "the Python Software Foundation License", "the ISC License", "a proprietary licence", "the Open Database License", "the Ruby license", "the WTFPL", "the terms of the sales contract"]
#: How notices are worded; {} stands for a name. Every fourth only calibrates.
PHRASES = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under {}.", "This program is licensed under {}.", "This project is released under {}.", "This library is distributed under the terms of {}.", "Available under the terms of {}.", "You can use this code under {}; see LICENSE.", "License: {}", "SPDX-License-Identifier: {}", "Published under {} by its authors.", "Subject to the terms of {}.", "This file is part of a program covered by {}.", "All content is made available under {} unless stated otherwise.", "Unless noted, the source code is licensed under {}."]
#: Sentences of the licences themselves, and of notices that name none.
TEXTS = {
    "agpl-3.0": [
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version.",
    ],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "No part of this publication may be reproduced without prior written permission of the publisher.", "No part of this book may be reproduced, stored in a retrieval system or transmitted in any form or by any means without the prior permission of the copyright owner.", "All other rights are reserved by the publisher and unauthorised copying is prohibited."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "cc-by": ["You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit and provide a link to the license."],
    "cc-by-nc": ["You are free to share and adapt the material under the following terms: you must give appropriate credit, and you may not use the material for commercial purposes."],
    "cc-by-sa": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original and give appropriate credit."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law."],
    "gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."],
    "gpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "See the GNU Lesser General Public License for more details."],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
#: Licence sentences of no family.
GENERIC = ["Use of this software is governed by the terms of your licence agreement.", "This material is licensed under special terms.", "The licensee may copy this work under the conditions of the contract.", "Distributed under a custom license.", "Copyright and license terms apply.", "See the licence file for the terms of use.", "Licensed to the customer for internal use.", "You may not redistribute this document under any other license."]
FAMILIES = sorted({*NAMES, *TEXTS})
FEATURES = 1 << 15
UNKNOWN = 0.75  # of the word pairs of a notice without its name, or of a generic sentence
SAMPLE_DOCUMENTS = 400
SAMPLE_LINES = 2000
LINE_CHARS = 1000
PARTS = 12  # of each text
ORDINARY = 0.999  # of the lines not learned from are nearer to none than what is reported as unknown
ROUNDS = 100
#: Words without which a line resembles no template.
SIGNAL = {"license", "licence", "licensed", "copyright", "rights", "permission", "software", "redistribution", "redistributions", "reproduced", "material", "work", "gnu", "mit", "cc0", "cc", "bsd", "apache", "mozilla", "publisher", "program"}


def paragraphs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines of some texts, and how many each text has."""
    data, offsets = utf8(texts)
    line = np.flatnonzero(data == 0x0A) + 1
    some = ~np.asarray(texts.is_null())
    begins = np.sort(np.concatenate([offsets[:-1][some], line]), kind="stable")
    # a line that ends a text begins where the next text does: both are kept
    bounds = np.append(begins, len(data))
    number = np.searchsorted(line, offsets[1:], side="right") - np.searchsorted(line, offsets[:-1], side="right") + some
    return pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))), number


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paragraph, feature) of each different 1- and 2-gram, in order, and how many each paragraph has."""
    words = find(texts, SIGNS, lower=True)
    one, row = words.hashes(), words.row
    two, same = grams(one, 2), row[:-1] == row[1:]
    hashes, rows = np.concatenate([one, two[same]]), np.concatenate([row, row[:-1][same]])
    key = np.sort(rows * FEATURES + (hashes >> U64(40)).astype(np.int64) % FEATURES)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key // FEATURES, key % FEATURES, np.bincount(key // FEATURES, minlength=len(words.counts))


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray):
        self.names, self.weights, self.bias, self.least, self.confirm, self.mass = names, weights, bias, 0.5, 0.5, 0.5

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        row, feature, n = features(texts)
        logits = np.tile(self.bias, (len(n), 1))
        some = np.flatnonzero(n)
        if len(some):
            sums = np.add.reduceat(self.weights[feature], np.searchsorted(row, some), axis=0)
            logits[some] += sums / np.sqrt(n[some])[:, None]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], rounds: int = ROUNDS, penalty: float = 1e-4) -> Model:
    """Softmax regression by accelerated gradient steps with a scale for each weight (Adam)."""
    names = sorted(set(labels))
    y = np.eye(len(names))[[names.index(x) for x in labels]]
    row, feature, n = features(pa.array(texts, pa.string()))
    value = (1 / np.sqrt(n)[row]).astype(np.float32)
    weights, bias = np.zeros((FEATURES, len(names))), np.zeros(len(names))
    used, at = np.unique(feature, return_inverse=True)
    some, by = np.flatnonzero(n), np.argsort(at, kind="stable")
    row_begin, at_begin = np.searchsorted(row, some), np.searchsorted(at[by], np.arange(len(used)))
    w, state = np.zeros((len(used) + 1, len(names)), np.float32), [0.0, 0.0]
    for k in range(1, rounds + 1):
        logits = np.tile(w[-1], (len(y), 1))
        logits[some] += np.add.reduceat(w[at] * value[:, None], row_begin, axis=0)
        p = np.exp(logits - logits.max(1, keepdims=True))
        p = ((p / p.sum(1, keepdims=True) - y) / len(y)).astype(np.float32)
        slope = np.vstack([np.add.reduceat((p[row] * value[:, None])[by], at_begin, axis=0), p.sum(0)])
        slope += penalty * w
        state = [0.9 * state[0] + 0.1 * slope, 0.999 * state[1] + 0.001 * slope**2]
        w = (w - 0.2 * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    weights[used], bias = w[:-1], w[-1]
    return Model(names, weights.astype(np.float32), bias)


def _varied(text: str, noise: list[str], rng: np.random.Generator) -> str:
    """The text with words left out, doubled, and surrounded by others; `license` is spelled either way."""
    words = [w for w in text.split() for _ in range(int(rng.choice([0, 1, 2], p=[0.06, 0.92, 0.02])))] or text.split()
    side = [noise[i] for i in rng.integers(0, len(noise), rng.integers(0, 6))] if noise else []
    cut = int(rng.integers(0, len(side) + 1))
    out = " ".join([*side[:cut], *words, *side[cut:]])
    return out.replace("icense ", "icence ").replace("icense.", "icence.") if rng.random() < 0.4 else out


def _notices(learned: bool) -> Iterator[tuple[str, str]]:
    """(text, family) of notices to learn from, or of those that only calibrate."""
    for k, phrase in enumerate(PHRASES):
        if (k % 4 < 3) == learned:
            for family, names in NAMES.items():
                yield from ((phrase.format(n), family) for n in names)
            half = len(OTHER) // 2
            yield from ((phrase.format(n), "unknown") for n in (OTHER[:half] if learned else OTHER[half:]))


def _pairs(text: str) -> set[tuple[str, str]]:
    """Pairs of neighbouring words, spelled alike."""
    words = [w.replace("licence", "license") for w in find(pa.array([text]), SIGNS, lower=True).strings().to_pylist()]
    return set(zip(words[:-1], words[1:], strict=True)) or set(zip(words, words, strict=True))


class Templates:
    def __init__(self) -> None:
        texts = {f: [_pairs(x) for x in [*NAMES.get(f, []), *TEXTS.get(f, [])]] for f in FAMILIES}
        texts["unknown"] = [p for p in map(_pairs, [*GENERIC, *OTHER, *(x.split("{}")[0] for x in PHRASES)]) if len(p) > 1 or all(a != b for a, b in p)]
        self.texts, self.all = texts, {f: set().union(*ps, *(_pairs(p.format(n)) for p in PHRASES for n in NAMES.get(f, []))) for f, ps in texts.items() if f != "unknown"}

    def similarity(self, text: str, family: str) -> float:
        """How far a family's templates confirm a paragraph."""
        own = _pairs(text)
        if not own or family not in self.texts:
            return 0.0
        if family == "unknown":
            return max(len(p & own) / len(p) for p in self.texts[family])
        return max(len(own & self.all[family]) / len(own), *(len(p & own) / len(p) for p in self.texts[family]))


TEMPLATES = Templates()


def _sample(documents: DataFrame) -> list[str]:
    """At most SAMPLE_LINES lines of at most SAMPLE_DOCUMENTS documents, in order of their hashes."""
    least = documents.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(SAMPLE_DOCUMENTS).agg(F.max("h")).first()[0]
    if least is None:
        return []
    some = documents.where(F.xxhash64("doc_id") <= least).select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line")).where(F.length("line") <= LINE_CHARS).distinct()
    return [r.line for r in some.orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES).collect()]


def fit(documents: DataFrame, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    lines = _sample(documents)
    marked = find(pa.array(lines, pa.string()), SIGNS, lower=True).strings().to_pylist() if lines else []
    counts = find(pa.array(lines, pa.string()), SIGNS).counts.tolist() if lines else []
    plain, at = [], 0
    for line, n in zip(lines, counts, strict=True):
        words = set(marked[at : at + n])
        at += n
        if not words & SIGNAL or max(TEMPLATES.similarity(line, f) for f in FAMILIES) < 0.4:
            plain.append(line)
    plain, others = plain[: len(plain) // 2], plain[len(plain) // 2 :]
    noise = [w for x in plain for w in x.split()[:50]]
    texts, labels = [*plain, "", " "], ["none"] * (len(plain) + 2)

    def learn(text: str, family: str, n: int) -> None:
        texts.append(text)
        texts.extend(_varied(text, noise, rng) for _ in range(n))
        labels.extend([family] * (n + 1))

    for text, family in _notices(True):
        learn(text, family, 1)
    for text in GENERIC[::2]:
        learn(text, "unknown", PARTS)
    for family, whole in TEXTS.items():
        for text in whole:
            learn(text, family, PARTS)
            words = text.split()
            for _ in range(PARTS if len(words) > 12 else 0):  # a line may hold part of a sentence
                k = int(rng.integers(0, len(words) - 8))
                learn(" ".join(words[k : k + int(rng.integers(8, 30))]), family, 0)
    model = train(texts, labels)

    aside = [*_notices(False), *((x, "unknown") for x in GENERIC[1::2])]
    aside = [(v, f) for x, f in aside for v in (x, _varied(x, noise, rng))]
    p = model.probabilities(pa.array([x for x, _ in aside]))
    names = [n if n != "none" else "" for n in model.names]
    best = np.where(np.array(names) == "", -1.0, p).argmax(1)
    score, like = p[np.arange(len(p)), best], np.array([TEMPLATES.similarity(x, model.names[k]) for (x, _), k in zip(aside, best.tolist(), strict=True)])
    right = np.array([model.names[k] == f for (_, f), k in zip(aside, best.tolist(), strict=True)])
    known = np.array([f != "unknown" for _, f in aside])
    taken = np.array([model.names[k] != "unknown" for k in best.tolist()])
    # known ones are to be found as what they are, others are to be turned down
    steps = [(round(float(a), 2), round(float(b), 2)) for a in np.arange(0.1, 0.96, 0.05) for b in np.arange(0.3, 0.96, 0.05)]
    value = {s: round(float((right & (score >= s[0]) & (like >= s[1]))[known].mean() + (~(taken & (score >= s[0]) & (like >= s[1])))[~known].mean()), 6) for s in steps}
    model.least, model.confirm = max(steps, key=lambda s: (value[s], s))
    if others:
        mass = 1 - model.probabilities(pa.array(others))[:, model.names.index("none")]
        model.mass = max(model.mass, float(np.quantile(mass, ORDINARY)))
    return model


FOUND = "array<struct<paragraph: int, family: string, score: double, similarity: double>>"
_FOUND = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("score", pa.float64()), ("similarity", pa.float64())]))


def _scan(model: Model, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    lines, number = paragraphs(texts)
    p = model.probabilities(lines)
    none = model.names.index("none")
    first = np.cumsum(number) - number
    out: list[list[dict]] = [[] for _ in number]
    some = np.flatnonzero(p.argmax(1) != none)
    text = np.searchsorted(np.cumsum(number), some, side="right")
    for k, d in zip(some.tolist(), text.tolist(), strict=True):
        best = max((i for i in range(len(model.names)) if i != none), key=lambda i: p[k, i])
        family, score = model.names[best], float(p[k, best])
        like = TEMPLATES.similarity(lines[k].as_py(), family)
        sure = score >= model.least and like >= model.confirm
        if sure and family != "unknown" or 1 - p[k, none] > model.mass or TEMPLATES.similarity(lines[k].as_py(), "unknown") >= UNKNOWN:
            out[d].append({"paragraph": k - int(first[d]), "family": family if sure else "unknown", "score": score, "similarity": like})
    return number, out


def scan(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, n_paragraphs, found (FOUND: the paragraphs that aren't `none`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, found = [np.zeros(0, np.int64)], []
            for a, b in slices(batch.column(1)):
                n, f = _scan(model, batch.column(1).slice(a, b - a))
                numbers.append(n)
                found += f
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(numbers).astype(np.int64)), pa.array(found, _FOUND)], names=["doc_id", "n_paragraphs", "found"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id bigint, n_paragraphs bigint, found {FOUND}")


def licences(documents: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licence, licences (families of its paragraphs, in order, comma-joined)."""
    found = scan(documents, fit(documents))
    return found.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licence"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",").alias("licences"))
