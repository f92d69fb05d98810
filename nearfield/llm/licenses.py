"""Licence scans: a trained paragraph classifier with an unknown class, confirmed by comparison with templates."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

#: Bound of the background paragraphs that training takes from the corpus (only training; scanning reads all).
BACKGROUND = 400
UNKNOWN = "unknown"

#: Notices by which texts name their licence, and opening or typical paragraphs of the licences.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "LGPL-2.1": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Licensed under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "Unlicense": [
        "Released into the public domain under the Unlicense.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}

FOUND = T.StructType([T.StructField("n_licenses", T.LongType()), T.StructField("families", T.StringType()), T.StructField("spans", T.StringType())])

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def features(words: list[bytes]) -> set:
    """Word 1-grams and 2-grams, each once."""
    return {*words, *zip(words, words[1:])}


def trigrams(words: list[bytes]) -> set:
    return set(zip(words, words[1:], words[2:])) or {tuple(words)}


class Model(NamedTuple):
    classes: list[str]
    singles: dict
    doubles: dict
    weights: np.ndarray
    bias: np.ndarray
    gain: np.ndarray
    temperature: float
    least: float
    templates: dict[str, list[set]]
    owners: dict[tuple, list[str]]
    words: dict[str, set]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def examples(background: list[str], seed: int, copies: int) -> list[tuple[list[bytes], str]]:
    """Templates with words lost, changed and put between background words, and background paragraphs as unknown."""
    rng = random.Random(seed)
    pool = [w for t in background for w in words_of(t)] or [b"word"]
    made = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            whole = words_of(text)
            made.append((whole, family))
            for _ in range(copies):
                w = [x if rng.random() > 0.04 else rng.choice(pool) for x in whole if len(whole) < 8 or rng.random() > 0.04]
                before, after = (rng.choices(pool, k=rng.choice((0, 0, 2, 5))) for _ in range(2))
                made.append((before + w + after, family))
    for text in background:
        w = words_of(text)
        for cut in (w, w[: 5 + len(w) // 4]):
            if cut:
                made.append((cut, UNKNOWN))
    # Words of licences out of their place aren't licences.
    loose = [w for texts in TEMPLATES.values() for t in texts for w in words_of(t)]
    for _ in range(20 * copies):
        made.append((rng.choices(loose, k=rng.randint(1, 6)) + rng.choices(pool, k=rng.randint(3, 20)), UNKNOWN))
    return made


def train(background: list[str], seed: int = 7, copies: int = 12, rounds: int = 300) -> Model:
    """Sparse multinomial logistic regression; temperature and threshold are fitted on held-out examples."""
    known = {f: [trigrams(words_of(t)) for t in texts] for f, texts in TEMPLATES.items()}
    background = [t for t in background if not any(len(g & trigrams(words_of(t))) >= 0.5 * len(g) for gs in known.values() for g in gs)]
    fit, held = examples(background, seed, copies), examples(background, seed + 1, 3)
    names = {}
    for words, family in fit:
        if family != UNKNOWN:
            for x in features(words):
                names.setdefault(x, len(names))
    classes = [UNKNOWN, *TEMPLATES]

    def matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(names)), np.float32)
        for i, (words, _) in enumerate(rows):
            x[i, [names[f] for f in features(words) if f in names]] = 1
        return x, np.array([classes.index(f) for _, f in rows])

    x, y = matrix(fit)
    target = np.eye(len(classes), dtype=np.float32)[y]
    weights, bias = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    balance = (len(y) / len(classes) / np.bincount(y, minlength=len(classes)).clip(1))[y, None].astype(np.float32)
    step = 4.0 / len(y)
    for _ in range(rounds):
        error = (softmax(x @ weights + bias) - target) * balance
        weights -= step * (x.T @ error) + 1e-4 * weights
        bias -= step * error.sum(axis=0)
    hx, hy = matrix(held)
    logits = hx @ weights + bias
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(hy)), hy] + 1e-9).mean())
    p = softmax(logits / temperature)
    right = (p.argmax(1) == hy) & (hy > 0)
    least = float(min(0.9, max(0.3, np.quantile(p[right].max(1), 0.01) if right.any() else 0.5)))
    singles = {f: i for f, i in names.items() if isinstance(f, bytes)}
    doubles = {f: i for f, i in names.items() if not isinstance(f, bytes)}
    gain = np.maximum(0, (weights[:, 1:] - weights[:, :1]).max(axis=1))
    owners: dict[tuple, list[str]] = {}
    for family, texts in known.items():
        for t in sorted(set().union(*texts)):
            owners.setdefault(t, []).append(family)
    vocabulary = {f: {w for t in texts for w in words_of(t)} for f, texts in TEMPLATES.items()}
    return Model(classes, singles, doubles, weights, bias, gain, temperature, least, known, owners, vocabulary)


def classify(model: Model, words: list[bytes]) -> tuple[str, float]:
    """Family (or unknown) and its calibrated probability."""
    at = [model.singles[w] for w in set(words) & model.singles.keys()]
    if at:
        at += [model.doubles[w] for w in set(zip(words, words[1:])) & model.doubles.keys()]
    # No family can reach the unknown class: the features' best gains don't make up for the bias.
    if float(model.gain[at].sum()) + float((model.bias[1:] - model.bias[0]).max()) < 0:
        return UNKNOWN, 1.0
    p = softmax((model.weights[at].sum(axis=0) + model.bias) / model.temperature)
    best = int(p.argmax())
    if best and p[best] >= model.least:
        return model.classes[best], float(p[best])
    return UNKNOWN, float(p[0])


def confirmed(model: Model, family: str, words: list[bytes], share: float = 0.6) -> bool:
    """Whether a template of the family has its trigrams in the paragraph, or the paragraph its own in a template."""
    own = trigrams(words)
    return any(len(own & t) >= share * len(t) or (len(own) >= 8 and len(own & t) >= share * len(own)) for t in model.templates[family])


def line_family(model: Model, words: list[bytes], before: str) -> str:
    """Family of a line by itself; else that whose templates have most of its trigrams, a third of them at least.

    So the lines of a wrapped paragraph, few of which say enough alone, get its family. A line of one or two words
    goes on with the family of the line ``before`` if that has the words.
    """
    family = classify(model, words)[0]
    if family != UNKNOWN:
        return family
    if len(words) < 3:
        return before if before != UNKNOWN and all(w in model.words[before] for w in words) else UNKNOWN
    shared = Counter(f for t in set(zip(words, words[1:], words[2:])) for f in model.owners.get(t, ()))
    if not shared:
        return UNKNOWN
    best = max(shared.values())
    if 3 * best < len(words) - 2:
        return UNKNOWN
    if shared[before] == best:
        return before
    return min(f for f, n in shared.items() if n == best)


def scan(model: Model, text: str) -> tuple:
    """Licences of a text. A paragraph is a run of neighbouring lines, marks of comments aside, that belong to one family.

    A paragraph counts if the classifier gives it that family, or one of its lines, and a template confirms it. If not as a whole, lines
    that the classifier knows are tried by themselves.
    """
    runs: list[tuple[str, list[tuple[int, int, list[bytes]]]]] = []
    at, before = 0, UNKNOWN
    for line in text.split("\n"):
        family = line_family(model, words, before) if (words := words_of(line)) else UNKNOWN
        if family != UNKNOWN:
            if family != before:
                runs.append((family, []))
            runs[-1][1].append((at, at + len(line), words))
        before = family
        at += len(line) + 1
    found: list[tuple[str, int, int]] = []
    for family, lines in runs:
        words = [w for _, _, ws in lines for w in ws]
        known = classify(model, words)[0]
        known = family if known == UNKNOWN and any(classify(model, ws)[0] == family for _, _, ws in lines) else known
        if known != UNKNOWN and confirmed(model, known, words):
            found.append((known, lines[0][0], lines[-1][1]))
        elif len(lines) > 1:
            found += [(family, a, b) for a, b, ws in lines if classify(model, ws)[0] == family and confirmed(model, family, ws)]
    return len(found), ",".join(sorted({f for f, _, _ in found})), ",".join(f"{f}:{a}:{b}" for f, a, b in found)


def license_scan(docs: DataFrame, background: int = BACKGROUND, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_licenses, families, spans`` of each document; spans are ``family:start:end`` in code points.

    Without a ``model`` one is trained on the templates and on ``background`` paragraphs of the corpus, picked by
    digest. A null or empty text has no licence; repeated rows get equal results; texts are scanned whole; an empty
    table gives no rows (and a model without background); columns other than the two play no part.
    """
    need = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        # Those of least digest. A threshold on the digest leaves a few times as many to sort, however many rows there are.
        share = min(1.0, (4 * background + 100) / max(1, need.count()))
        line, h = F.element_at(F.split("text", "\n"), 1), F.xxhash64("text")
        few = need.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))).select(h.alias("h"), line.alias("line")).distinct()
        drawn = few.orderBy("h", "line").limit(background)
        model = train([r.line or "" for r in drawn.collect()])

    def start() -> Callable[[str], tuple]:
        return lambda text: scan(model, text)

    return map_texts(need, start, FOUND)
