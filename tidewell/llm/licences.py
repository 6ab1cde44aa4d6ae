"""License scans: a trained paragraph classifier whose predictions are confirmed by templates.

A paragraph is a line, or a window of neighbouring lines that none but lines without letters and digits part (so a licence may be
wrapped, and comment marks do not count). Windows are tried from every line on that is not confirmed alone, over such lines only, until they have as many words as
the longest template. Of confirmed windows that overlap, the one with the largest part of its template stays, then the one of fewer lines, then the first; it is one paragraph, at its first line, or with a line of its family that it directly follows or precedes (the rest of a licence of which a line further off is confirmed alone counts again). Its features are its distinct words and pairs of neighbouring words (lower case, split at all but letters and
digits) that the templates have, but for lone stop words; the classes are licence families and one for everything else. The
classifier is multinomial logistic regression, fitted on the driver on variants of the templates and of other prose below (VARIANTS of each,
a fixed set, nothing from the corpus); its probabilities are calibrated by a temperature and the limit of the unknown class by
the variants held out. A prediction stands if its probability reaches the limit and the paragraph holds at least CONFIRMED
of the word pairs of one of the family's templates. Only paragraphs that hold a pair of gate() are scored: of each template these are
so many pairs that without any of them too few are left to confirm it, so that no paragraph which could be confirmed is left out.

Scoring is array functions inside a row: features come from a hash table in the plan, weights are integers, so nothing is shuffled.

n_paragraphs counts lines, whether windows join them or not. Null and empty texts have no paragraphs; repeated rows are scanned alike; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE, table

TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "This project is licensed under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any " "person obtaining a copy of this software and " "associated documentation files, to deal in the Software without " "restriction, including without limitation the rights to " "use, copy, modify, merge, " "publish, distribute, sublicense, " "and/or sell copies of the Software",
        "The above copyright notice and this permission " "notice shall be included in all copies " "or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "This project is released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License v3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GPL version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL": ["Licensed under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": [
        "Released under the BSD License.", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["Licensed under the Mozilla Public License 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Proprietary": ["All rights reserved. Proprietary and confidential.", "Unauthorized copying of this file, via any medium is strictly prohibited.", "Copyright. All rights reserved."],
}
OTHER = [
    "He lost his driving license after the accident and had to apply for a new one.", "The city council issued a fishing license to every resident.", "Poetic license allows a writer to bend the rules of grammar.", "The bar was closed because its liquor license had expired.",
    "She studied at MIT and later worked on public policy for the general public.", "The Apache helicopter landed near the version of the bridge built in 2004.", "The creative commons of the village were used for grazing cows.", "Copyright law protects authors of books and music in most countries.",
    "The warranty covers parts and labor for two years from the date of purchase.", "You need permission from the owner to enter the building.", "The lawyer explained which license terms apply when software is sold to the government.", "Public license debates were common in the general assembly.",
    "The redistribution of wealth was a topic of the election.", "Open source software has changed the industry and many companies use it.", "A licensed electrician must inspect the work before the wall is closed.", "The new version of the program was released under great pressure.",
    "The weather was mild and the children played in the garden until evening.", "Sales grew by three percent in the second quarter, the company said.", "Mix the flour with the eggs and add milk until the dough is smooth.", "The train leaves at nine and arrives in the capital before noon.",
    "The GNU is a large antelope of the plains.", "BSD stands for several things, among them a degree.", "The Mozilla office moved to a new street.", "Attribution of the painting to the master is disputed.", "Use of the software requires training.", "The license plate of the car was found in the river.",
]
KEY = "licen[sc]e[sd]?|licensing|copyright|warrant(?:y|ies)|permission|redistribut(?:e|ion)|spdx|mit|apache|gnu|a?l?gpl|bsd|mozilla|mpl|creative|cc|cc0|isc|proprietary|copying|domain"
SEPARATOR = r"[^\p{L}\p{N}]"
STOP = set("the of and to in is it that for on by as was are with be from this or an at a any all you may not no if can which".split())
VARIANTS, HELD_OUT, SEED = 40, 4, 5
CONFIRMED, MOST_UNKNOWN = 0.6, 0.005
BUCKETS, SCALE = 4096, 1_000_000


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _features(words: list[str]) -> set[str]:
    return {w for w in words if w not in STOP} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _variants(text: str, n: int, noise: list[str], rng: random.Random) -> list[list[str]]:
    """Its words as they are, with some lost or changed, and among other prose."""
    out = [_words(text)]
    while len(out) < n:
        words = [w if rng.random() > 0.04 else rng.choice(noise) for w in _words(text) if rng.random() > 0.05]
        before, after = ([rng.choice(noise) for _ in range(rng.choice((0, 0, 3, 12, 40)))] for _ in "ab")
        out.append(before + words + after)
    return out


@lru_cache(maxsize=1)
def model() -> dict:
    """Families, features with their weights in millionths, the intercepts, the limit and the templates' pairs."""
    rng = random.Random(SEED)
    families = sorted(TEMPLATES)
    noise = [w for text in OTHER for w in _words(text) if not re.fullmatch(KEY, w)]
    rows, held = [], []
    for k, texts in enumerate([*(TEMPLATES[f] for f in families), OTHER]):
        for text in texts:
            for n, words in enumerate(_variants(text, VARIANTS if k < len(families) else 2 * VARIANTS, noise, rng)):
                (held if n % HELD_OUT == HELD_OUT - 1 else rows).append((words, k))
    names = sorted(set().union(*(_features(_words(t)) for texts in TEMPLATES.values() for t in texts)))
    place = {f: i for i, f in enumerate(names)}

    def matrix(of: list) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(of), len(names)))
        for r, (words, _) in enumerate(of):
            x[r, [place[f] for f in _features(words) if f in place]] = 1
        return x, np.array([k for _, k in of])

    x, y = matrix(rows)
    classes = len(families) + 1
    want = np.eye(classes)[y]
    share = want / want.sum(0)[y][:, None] / classes  # each class weighs the same
    w, b = np.zeros((len(names), classes)), np.zeros(classes)
    mean_w, mean_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(400):
        p = _softmax(x @ w + b)
        grad = (p - want) * share.sum(1)[:, None]
        mean_w, mean_b = 0.9 * mean_w + x.T @ grad + 1e-5 * w, 0.9 * mean_b + grad.sum(0)
        w, b = w - 4.0 * mean_w, b - 4.0 * mean_b
    x, y = matrix(held)
    scores = x @ w + b
    heat = min((t / 10 for t in range(5, 60)), key=lambda t: -np.log(_softmax(scores / t)[np.arange(len(y)), y] + 1e-12).mean())
    w, b = w / heat, b / heat
    p = _softmax(x @ w + b)
    unknown = p[y == classes - 1, :-1].max(1)
    limit = max(0.5, float(np.quantile(unknown, 1 - MOST_UNKNOWN)))
    pairs = [sorted({place[f"{c} {d}"] for c, d in zip(ws, ws[1:], strict=False)}) for f in families for t in TEMPLATES[f] for ws in [_words(t)]]
    longest = max(len(_words(t)) for f in families for t in TEMPLATES[f])
    owners = [k for k, f in enumerate(families) for _ in TEMPLATES[f]]
    accuracy = float((p.argmax(1) == y).mean())
    return {"families": families, "names": names, "weights": np.rint(w.T * SCALE).astype(int).tolist(), "intercepts": np.rint(b * SCALE).astype(int).tolist(), "limit": limit, "pairs": pairs, "owners": owners, "longest": longest, "accuracy": accuracy}


@lru_cache(maxsize=1)
def gate() -> str:
    """A regular expression that lower-case texts without a match hold too few pairs of every template: of each it has all but so many that the rest does not confirm."""
    m = model()
    chosen: set[str] = set()
    for ids in sorted(m["pairs"], key=len):
        pairs = sorted((m["names"][i] for i in ids), key=lambda p: (p not in chosen, sum(w in STOP for w in p.split(" ")), p.split(" ")[0] in STOP, p))
        need = next(n for n in range(len(pairs) + 1) if n >= CONFIRMED * len(pairs))
        chosen |= set(pairs[: len(pairs) - need + 1])
    by_letter: dict[str, dict[str, list[str]]] = {}
    for first, then in sorted(p.split(" ") for p in chosen):
        by_letter.setdefault(first[0], {}).setdefault(first[1:], []).append(then)
    branch = lambda firsts: "|".join(f"{rest}{SEPARATOR}++(?:{'|'.join(then)})" for rest, then in firsts.items())
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{letter}(?:{branch(firsts)})" for letter, firsts in by_letter.items()) + r")(?![\p{L}\p{N}])"


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _hash(words: list[str]) -> int:
    n = 42
    for w in words:
        n = xxhash.xxh64_intdigest(w.encode(), seed=n)
    return n - (1 << 64) if n >> 63 else n


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _family(line: Column, m: dict) -> Column:
    """The confirmed family of a paragraph, as f, and the largest part of one of its templates that the paragraph holds, as part; else null."""
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for i, name in enumerate(m["names"]):
        h = _hash(name.split(" "))
        buckets[h % BUCKETS].append({"h": h, "i": i})
    held = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    grid = held(buckets, "array<array<struct<h:bigint,i:int>>>")
    weights, intercepts = held(m["weights"], "array<array<bigint>>"), held(m["intercepts"], "array<bigint>")
    templates = held([{"p": p, "k": k} for p, k in zip(m["pairs"], m["owners"], strict=True)], "array<struct<p:array<int>,k:int>>")
    split = F.filter(F.split(F.lower(line), f"{SEPARATOR}+"), lambda x: x != "")

    def hashes(ws: Column) -> Column:
        n = F.size(ws)
        two = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1)))).otherwise(F.array().cast("array<bigint>"))
        return F.concat(F.transform(ws, lambda x: F.xxhash64(x)), two)

    def look_up(h: Column) -> Column:
        return F.transform(F.filter(F.get(grid, F.pmod(h, F.lit(BUCKETS)).cast("int")), lambda e: e["h"] == h), lambda e: e["i"])

    found = F.array_distinct(F.flatten(F.transform(_let(split, hashes), look_up)))
    classes = len(m["families"]) + 1

    def decide(ids: Column) -> Column:
        score = lambda k: (F.aggregate(ids, F.get(intercepts, k), lambda s, i: s + F.get(F.get(weights, k), i)) / SCALE)
        return _let(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), score), lambda scores: _let(F.array_max(scores), lambda most: chosen(ids, scores, most)))

    def chosen(ids: Column, scores: Column, most: Column) -> Column:
        share = 1 / F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - most))
        k = F.array_position(scores, most).cast("int") - 1
        part = F.array_max(F.transform(F.filter(templates, lambda t: t["k"] == k), lambda t: F.when(F.size(F.array_intersect(t["p"], ids)) >= CONFIRMED * F.size(t["p"]), F.size(F.array_intersect(t["p"], ids)) / F.size(t["p"]))))
        return F.when((k < classes - 1) & (share >= m["limit"]), _let(part, lambda x: F.when(x.isNotNull(), F.struct(F.get(held(m["families"], "array<string>"), k).alias("f"), x.alias("part")))))

    return _let(found, decide)


def _ends(lines: Column, alone: Column, i: Column, longest: int) -> Column:
    """The last lines of the windows of two lines or more from line i on."""
    start = F.struct(F.lit(False).alias("over"), F.lit(0).alias("words"), F.array().cast("array<int>").alias("ends"))

    def step(acc: Column, k: Column) -> Column:
        n = F.regexp_count(F.get(lines, k), F.lit(r"[\p{L}\p{N}]+"))
        over = acc["over"] | (acc["words"] >= longest) | F.get(alone, k).isNotNull() | (n == 0)
        return F.when(over, F.struct(F.lit(True).alias("over"), acc["words"].alias("words"), acc["ends"].alias("ends"))).otherwise(
            F.struct(F.lit(False).alias("over"), (acc["words"] + n).alias("words"), F.when(k > i, F.concat(acc["ends"], F.array(k))).otherwise(acc["ends"]).alias("ends"))
        )

    last = F.least(i + longest - 1, F.size(lines) - 1)  # every line has a word
    return F.aggregate(F.sequence(i, last), start, step)["ends"]


def _joined(lines: Column, alone: Column, m: dict) -> Column:
    """The confirmed windows of two lines or more that stay, as line and family; alone: what each line is by itself."""
    near = F.transform(lines, lambda x, i: F.concat_ws(" ", x, F.get(lines, i + 1)).rlike(gate()))

    def windows(marks: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(alone, i).isNull() & F.exists(F.slice(marks, i + 1, F.lit(m["longest"])), lambda x: x))
        return F.flatten(F.transform(starts, lambda i: F.transform(_ends(lines, alone, i, m["longest"]), lambda j: F.struct(i.alias("i"), j.alias("j"), F.array_join(F.slice(lines, i + 1, j - i + 1), " ").alias("t")))))

    likely = F.filter(_let(near, windows), lambda w: w["t"].rlike(gate()))
    scored = F.filter(F.transform(likely, lambda w: F.struct(w["i"].alias("i"), w["j"].alias("j"), _family(w["t"], m).alias("x"))), lambda w: w["x"].isNotNull())
    ranked = F.sort_array(F.transform(scored, lambda w: F.struct((-w["x"]["part"]).alias("far"), (w["j"] - w["i"]).alias("more"), w["i"].alias("i"), w["j"].alias("j"), w["x"]["f"].alias("family"))))
    none = F.array().cast("array<struct<i:int,j:int,family:string>>")
    step = lambda acc, w: F.when(F.exists(acc, lambda c: (c["i"] <= w["j"]) & (w["i"] <= c["j"])), acc).otherwise(F.concat(acc, F.array(F.struct(w["i"].alias("i"), w["j"].alias("j"), w["family"].alias("family")))))
    beside = lambda w: F.coalesce(F.when(w["i"] > 0, F.get(alone, w["i"] - 1)) == w["family"], F.lit(False)) | F.coalesce(F.get(alone, w["j"] + 1) == w["family"], F.lit(False))
    return F.transform(F.filter(F.aggregate(ranked, none, step), lambda w: ~beside(w)), lambda w: F.struct(w["i"].cast("long").alias("line"), w["family"].alias("family")))


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_paragraphs (lines with a word), n_licences (paragraphs of a confirmed family), families (distinct, by name, joined by ", "; empty if
    none) and found (line number and family of each) of every row."""
    m = model()
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.split(text, "\n").alias("lines"), F.lower(text).alias("text"))
    none = F.array().cast("array<string>")
    rows = rows.select("id", F.size(F.filter("lines", lambda x: x.rlike(rf"[^{SPACE}]"))).cast("long").alias("n_paragraphs"), F.when(F.col("text").rlike(gate()), F.split("text", "\n")).otherwise(none).alias("lines"))
    rows = rows.select("id", "n_paragraphs", "lines", F.transform("lines", lambda x: F.when(x.rlike(gate()), _family(x, m)["f"])).alias("alone"))
    lone = F.filter(F.transform("alone", lambda f, n: F.struct(n.cast("long").alias("line"), f.alias("family"))), lambda x: x["family"].isNotNull())
    joined = F.when(F.size("lines") > 1, _joined(F.col("lines"), F.col("alone"), m)).otherwise(F.array().cast("array<struct<line:bigint,family:string>>"))
    rows = rows.select("id", "n_paragraphs", F.sort_array(F.concat(lone, joined)).alias("found"))
    families = F.array_join(F.sort_array(F.array_distinct(F.transform("found", lambda x: x["family"]))), ", ")
    return rows.select(F.col("id").alias(id_column), "n_paragraphs", F.size("found").cast("long").alias("n_licences"), families.alias("families"), "found")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).drop("found")
