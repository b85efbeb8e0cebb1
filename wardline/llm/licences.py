"""Licence scan: a trained paragraph classifier, with template comparison.

A paragraph is a line of a text, or a run of lines that all hold template words, comment marks taken off: a
notice may be wrapped.  Its features are the word uni- and bigrams it shares with the licence
templates below (all other words have no weight).  A multinomial logistic regression over these sparse
features gives a probability for each licence family and for ``unknown``; it is trained on excerpts of the
templates, alone and amid ordinary words, against all paragraphs of at most ``FIT_DOCS`` documents of the corpus
(the one bounded sample here) and a few that speak of licences without being one; paragraphs that share word trigrams
with a template are left out, others stay, licence words or not.  The unknown class is calibrated on held-out examples:
the probabilities are sharpened or flattened by the temperature that explains them best, and a family needs
the smallest threshold that lets no more than one in a thousand held-out unknown paragraphs through.  A
predicted family counts only if a template of it agrees: enough of the paragraph's licence words, or of the
template's, are shared word trigrams.

Every line of every text is judged, and no row moves: a map without any shuffle.

Defined cases: null and empty texts have no paragraph and the licence ``none``; several families in one
text: the one with the highest probability (ties: the first in the alphabet) is ``licence`` and all stand in
``families``; repeated rows are judged each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrowed

#: Documents whose paragraphs serve as examples of the unknown class, at most.
FIT_DOCS = 600
#: Template trigrams that keep a paragraph out of the unknown class.
SHARED = 2
#: Longest line whose verdict a worker remembers, and how many of them.
MEMO_CHARS, MEMO_LINES = 400, 20_000
#: Share of unknown held-out paragraphs that a threshold may let through.
LET_THROUGH = 0.001
#: Shared trigrams that confirm: of the paragraph's licence words, or of the template's.
CONFIRM = 0.5
ROUNDS, RATE, DECAY = 300, 2.0, 1e-4

# Public licence notices and sentences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "This software is distributed under the 3-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL version 2.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Released under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-ND 4.0.",
        "Licensed under CC BY 4.0. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This work has been dedicated to the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved.",
        "This document is confidential and proprietary and may not be copied or disclosed without written permission.",
    ),
}

#: Paragraphs that speak of licences, rights and copying, and grant nothing.
HARD = (
    "He lost his driver's licence and had to walk.", "A fishing license is needed to fish in the lake, free of charge for children.",
    "Parliament debated copyright law and the rights of authors.", "The copyright notice on the first page had faded.",
    "She was granted a licence to sell wine, subject to conditions.", "The public domain is where old books end up.",
    "Human rights were reserved for a few.", "The software is provided by the school to all students.", "The Apache helicopter landed under the bridge.",
    "MIT released a study this week.", "Permission was granted to the heirs of the estate.", "We walked on the commons, a creative group of friends.",
    "Redistribution of land was the main demand of the party.", "The terms of the agreement were published at the general assembly.",
    "The gnu is a large antelope that lives in the public parks.", "The licence plate was stolen without permission.",
)

_WORD = re.compile(r"[^\W_]+")
_LEADER = re.compile(r"^\s*(?:(?:[#;*%!>|]|//|--|/\*+|<!--|\bREM\b|\bdnl\b)\s*)+")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(words: list[str], *sizes: int) -> set[str]:
    return {" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


class Model:
    """Weights over the template n-grams; families in order, ``unknown`` first."""

    def __init__(self, unknown: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        common: dict[str, int] = {}
        plain = [words_of(p) for p in unknown]
        for w in plain:
            for g in grams(w, 1, 2):
                common[g] = common.get(g, 0) + 1
        # an n-gram that one in fifty ordinary paragraphs hold says nothing; nor do numbers by themselves
        often = max(2, len(plain) // 50)
        kept = {g for ts in TEMPLATES.values() for t in ts for g in grams(words_of(t), 1, 2)}
        kept = sorted(g for g in kept if common.get(g, 0) < often and not g.isdigit() and len(g) > 1)
        self.features = {g: i for i, g in enumerate(kept)}
        self.anchors = frozenset(w for g in kept for w in g.split())
        self.families = ["unknown", *sorted(TEMPLATES)]
        self.weights = np.zeros((len(kept) + 1, len(self.families)))
        self.temperature, self.threshold = 1.0, 0.5
        self.trigrams = {f: [grams(words_of(t), 3) or grams(words_of(t), 1) for t in ts] for f, ts in TEMPLATES.items()}
        texts, labels = self._examples(plain, rng)
        order = rng.permutation(len(texts))
        half = len(order) * 4 // 5
        self._fit([texts[i] for i in order[:half]], labels[order[:half]])
        self._calibrate([texts[i] for i in order[half:]], labels[order[half:]])

    def _examples(self, plain: list[list[str]], rng) -> tuple[list[list[str]], np.ndarray]:
        texts: list[list[str]] = list(plain)
        labels = [0] * len(plain)
        ordinary = [w for p in plain[:400] for w in p[:40]] or ["text"]
        for f, ts in TEMPLATES.items():
            for t in ts:
                words = words_of(t)
                for k in range(24):
                    keep = words
                    if k >= 4 and len(words) > 8:  # a stretch of it
                        n = int(rng.integers(8, len(words) + 1))
                        a = int(rng.integers(0, len(words) - n + 1))
                        keep = words[a : a + n]
                    if k % 3 == 1:  # amid ordinary words
                        around = [ordinary[i] for i in rng.integers(0, len(ordinary), int(rng.integers(5, 120)))]
                        at = int(rng.integers(0, len(around) + 1))
                        keep = around[:at] + keep + around[at:]
                    texts.append(keep)
                    labels.append(self.families.index(f))
        # single template words amid ordinary ones are not a licence
        lone = sorted(w for w in self.anchors if w in self.features)
        for _ in range(1500):
            some = [ordinary[i] for i in rng.integers(0, len(ordinary), 30)]
            some[int(rng.integers(0, 30))] = lone[int(rng.integers(0, len(lone)))] if lone else "text"
            texts.append(some)
            labels.append(0)
        return texts, np.array(labels)

    def _matrix(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        row, col = [], []
        for i, w in enumerate(texts):
            found = [self.features[g] for g in grams(w, 1, 2) if g in self.features]
            row += [i] * (len(found) + 1)
            col += [*found, len(self.features)]  # the bias
        return np.array(row), np.array(col)

    def _logits(self, row, col, n) -> np.ndarray:
        out = np.zeros((n, len(self.families)))
        np.add.at(out, row, self.weights[col])
        return out

    def _fit(self, texts, labels) -> None:
        row, col = self._matrix(texts)
        n = len(texts)
        goal = np.eye(len(self.families))[labels]
        share = 1.0 / np.maximum(np.bincount(labels, minlength=len(self.families)), 1)
        share = np.sqrt(share)[labels]  # rare families count more, unknown stays the largest
        share = (share / share.sum())[:, None]
        for _ in range(ROUNDS):
            p = _softmax(self._logits(row, col, n))
            slope = np.zeros_like(self.weights)
            np.add.at(slope, col, ((p - goal) * share)[row])
            self.weights -= RATE * (slope + DECAY * self.weights)

    def _calibrate(self, texts, labels) -> None:
        row, col = self._matrix(texts)
        logits = self._logits(row, col, len(texts))
        options = np.geomspace(0.1, 4.0, 30)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in options]
        self.temperature = float(options[int(np.argmin(loss))])
        p = _softmax(logits / self.temperature)
        other = np.sort(p[labels == 0, 1:].max(axis=1)) if (labels == 0).any() else np.zeros(1)
        self.threshold = float(min(0.9, max(0.5, other[int(np.ceil((1 - LET_THROUGH) * len(other))) - 1] + 1e-6)))

    def judge(self, paragraph: str) -> tuple[str, float, bool]:
        """(family or unknown, probability of that, confirmed by a template)."""
        words = words_of(paragraph)
        row, col = self._matrix([words])
        p = _softmax(self._logits(row, col, 1) / self.temperature)[0]
        best = int(np.argmax(p[1:])) + 1
        if p[best] < self.threshold or p[0] >= p[best]:
            return "unknown", float(p[0]), False
        return self.families[best], float(p[best]), self._confirmed(self.families[best], words)

    def _confirmed(self, family: str, words: list[str]) -> bool:
        mine = grams(words, 3)
        known = {g for ts in TEMPLATES for t in self.trigrams[ts] for g in t}
        own = len(mine & known)
        return any(
            (shared := len(mine & t)) and (shared >= CONFIRM * len(t) or (shared >= 3 and shared >= CONFIRM * own))
            for t in self.trigrams[family]
        )


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


_TRIGRAMS = {g for ts in TEMPLATES.values() for t in ts for g in grams(words_of(t), 3)}


def train(docs: DataFrame) -> Model:
    """Unknown examples: paragraphs of at most FIT_DOCS documents that are no part of a template."""
    n = docs.count()
    share = min(1.0, FIT_DOCS / max(n, 1))
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    got = some.where(F.col("text").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS).select("text")
    lines = [p for r in got.toLocalIterator() for p in r["text"].split("\n") if p.strip() and len(grams(words_of(p), 3) & _TRIGRAMS) < SHARED]
    return Model([*lines, *HARD * 4])


def paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, found): every paragraph with a licence family, as (paragraph, family, probability, confirmed, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the templates
    schema = "doc_id bigint, found array<struct<paragraph:int,family:string,probability:double,confirmed:boolean,text:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        memo: dict[str, tuple[str, float, bool]] = {}

        def verdict(line: str) -> tuple[str, float, bool]:
            if len(line) > MEMO_CHARS:
                return m.judge(line)
            if len(memo) > MEMO_LINES:
                memo.clear()
            if line not in memo:
                memo[line] = m.judge(line)
            return memo[line]

        for pdf in batches:
            out = []
            for text in pdf["text"]:
                found: list[tuple] = []
                # a text, then a line, without any template word has no features: unknown by the bias alone
                if isinstance(text, str) and not m.anchors.isdisjoint(words_of(text)):
                    together: list[tuple[int, str]] = []  # lines next to each other that hold features

                    def wrapped() -> None:
                        if len(together) > 1:
                            whole = " ".join(_LEADER.sub("", x) for _, x in together)
                            family, p, sure = verdict(whole)
                            if sure and not any(f == family and s and k >= together[0][0] for k, f, _, s, _ in found):
                                found.append((together[0][0], family, p, sure, whole))
                        together.clear()

                    for k, line in enumerate(text.split("\n")):
                        words = words_of(line)
                        if m.anchors.isdisjoint(words):
                            wrapped()
                            continue
                        if m.features.keys().isdisjoint(grams(words, 1, 2)):
                            wrapped()
                        else:
                            together.append((k, line))
                        family, p, sure = verdict(line)
                        if family != "unknown":
                            found.append((k, family, p, sure, line))
                    wrapped()
                out.append(found)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "found": out})

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def licence_scan(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, licence, probability, families, n_paragraphs (confirmed), n_unconfirmed for every row."""
    docs = narrowed(documents, doc_id="bigint", text="string")
    found = paragraphs(docs, train(docs))
    sure = F.filter("found", lambda x: x["confirmed"])
    best = F.get(F.array_sort(F.transform(sure, lambda x: F.struct((-x["probability"]).alias("p"), x["family"].alias("family")))), F.lit(0))
    return found.select(
        "doc_id",
        F.coalesce(best["family"], F.lit("none")).alias("licence"),
        F.coalesce(-best["p"], F.lit(0.0)).alias("probability"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.size(sure).cast("bigint").alias("n_paragraphs"),
        (F.size("found") - F.size(sure)).cast("bigint").alias("n_unconfirmed"),
    )
