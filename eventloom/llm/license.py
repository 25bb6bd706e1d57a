"""Licence scan: a trained paragraph classifier with an unknown class, confirmed by templates.

A paragraph is a line. Its words that the training vocabulary knows, and their neighbouring pairs,
are the sparse features of a multinomial logistic regression over licence families and "unknown".
The regression is fitted on the driver from variations of the templates below and from unrelated
sentences, its temperature and its threshold on variations held out. Scoring is column expressions
over the whole text: the weights are a constant map. A family counts only if one of its templates
shares enough of its words with the paragraph, among them every word that names a licence, and if no
word stands there that names a licence of the same kin (a GNU licence that says "Lesser" is not the
GPL); a template of fewer than four known words must stand in the paragraph word for word. So a
licence that has no template is unknown, however much of a known one's wording it uses. A statement that is wrapped over several lines is looked for in windows that begin
at a known word and have as many words as a template, across line breaks and marks; they are
classified and confirmed like a paragraph, but only words in the template's order count.
Windows that touch a line of the same family are left out, of overlapping ones the best counts.

Edge cases: null and empty texts have no paragraph and no licence; a paragraph with fewer than two
known words is unknown; ties go to the family first by name; repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and opening statements of public licences, by family.
TEMPLATES = {
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "bsd": (
        "Distributed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Available under the Creative Commons CC BY-SA 4.0 licence.",
        "To the extent possible under law, the author has waived all copyright with a CC0 public domain dedication.",
    ),
    "epl": (
        "This program is made available under the terms of the Eclipse Public License, version 2.0.",
        "Eclipse Public License",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "ISC License",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "MIT License",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "Copyright Example Corporation. All rights reserved.",
        "All rights reserved.",
        "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
}
# Words that name a licence. A template that has some is confirmed only where all of them stand.
NAMES = frozenset("affero agpl apache boost bsd bsl cc cc0 commons eclipse epl gnu gpl isc lesser lgpl mit mozilla mpl unencumbered unlicense".split())
# Sentences that share words with licences but grant none of the above.
UNRELATED = (
    "The driver lost a license after the second offence and sold the car.",
    "A public hearing on the general terms of the contract takes place in version two of the schedule.",
    "The apache helicopter was released from the public hangar under the terms of the contract.",
    "Students at MIT released a study on the free use of public software.",
    "Creative people use common words; the work of an author is under review.",
    "The foundation published a free copy of the source in binary and other forms.",
    "Permission to land was granted to any person with a copy of the file.",
    "The new version is subject to conditions and may be used with or without notice.",
    "All rights of way are reserved for the library van on the following days.",
    "The library bought software and documentation files for the reading room.",
    "Modification of the code is not part of this work, the program office said.",
    "Mozilla and GNU are names that appear in the history of free software.",
    "Copyright law is a subject that few people like to discuss.",
    "The weather was fine and the people were in the street.",
    "International attribution of the painting is confidential, the corporation said.",
    "The eclipse was visible to the public without a fee.",
    "A boost in software sales is the purpose of the program, for lesser firms at least.",
    "Licensed under the Artistic License, version 2.0.",
    "Distributed under the Python Software Foundation License, version 2.",
    "This work is licensed under the Open Software License, version 3.0.",
    "SPDX-License-Identifier: Artistic-2.0",
)
STOP = frozenset("a an and any are as at be been by can for from has have in is it its may not of on or our that the this to via was with you your".split())
UNKNOWN = "unknown"
SHORT = 4  # templates with fewer known words are confirmed as phrases


def _tokens(text: str, vocabulary: frozenset[str] | set[str]) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w in vocabulary]


def _spaced(text: str) -> str:
    """All words, each between single spaces."""
    return " ".join(["", *(w for w in re.split(r"[^a-z0-9]+", text.lower()) if w), ""])


def _grams(tokens: list[str]) -> set[str]:
    return {*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False))}


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the first is unknown
    vocabulary: tuple[str, ...]
    weights: dict[str, list[float]]
    bias: list[float]
    threshold: float
    templates: dict[str, list[dict]]  # known words, of these the names, and the names that bar the template
    phrases: dict[str, list[str]]  # the short templates
    spans: list[dict]  # all templates: number of words, known words in order, all of them again for phrases, names and bars

    def probabilities(self, tokens: list[str]) -> np.ndarray:
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in _grams(tokens) if g in self.weights), np.zeros(len(self.bias)))
        e = np.exp(z - z.max())
        return e / e.sum()


def _variations(rng: random.Random, n: int) -> list[tuple[str, str]]:
    """Texts by family: words dropped, cut short, wrapped in other sentences."""
    out = []
    for family, texts in {**TEMPLATES, UNKNOWN: UNRELATED}.items():
        for text in texts:
            words = text.split()
            for k in range(n):
                kept = [w for w in words if rng.random() > 0.08 * (k % 3) or NAMES & set(re.split(r"[^a-z0-9]+", w.lower()))] or words
                if family == UNKNOWN and k % 2:
                    kept = rng.sample(words, max(2, len(words) // 2))
                if k % 4 == 3:
                    kept = rng.choice(UNRELATED).split()[: rng.randint(1, 5)] + kept
                out.append((" ".join(kept), family))
    rng.shuffle(out)
    return out


def _names(words: list[str], family: str) -> tuple[list[str], list[str]]:
    """(names in a template, names of other families whose templates have all of these and more)."""
    own = NAMES & set(words)
    others = [NAMES & set(re.split(r"[^a-z0-9]+", t.lower())) for f, ts in TEMPLATES.items() if f != family for t in ts]
    return sorted(own), sorted(set().union(*(o - own for o in others if own and own < o)))


@lru_cache(maxsize=4)
def train(seed: int = 11, per_text: int = 24, l2: float = 2e-3, rounds: int = 200) -> Model:
    """The classifier, from per_text variations of every template; a quarter of them calibrate it."""
    rng = random.Random(seed)
    vocabulary = frozenset(w for texts in TEMPLATES.values() for t in texts for w in re.split(r"[^a-z0-9]+", t.lower()) if w and w not in STOP)
    families = (UNKNOWN, *sorted(TEMPLATES))
    data = [(_grams(_tokens(t, vocabulary)), families.index(f)) for t, f in _variations(rng, per_text)]
    held, data = data[::4], [d for i, d in enumerate(data) if i % 4]
    grams = {g: i for i, g in enumerate(sorted(set().union(*(g for g, _ in data))))}

    def matrix(rows):
        x = np.zeros((len(rows), len(grams) + 1))
        x[:, -1] = 1
        for i, (g, _) in enumerate(rows):
            x[i, [grams[a] for a in g if a in grams]] = 1
        return x

    x, y = matrix(data), np.eye(len(families))[[f for _, f in data]]
    w = back = np.zeros((x.shape[1], len(families)))
    step = 2 * len(x) / np.linalg.norm(x, 2) ** 2
    soft = lambda z: (e := np.exp(z - z.max(1, keepdims=True))) / e.sum(1, keepdims=True)
    for t in range(rounds):
        look = w + t / (t + 3) * (w - back)
        back, w = w, look - step * (x.T @ (soft(x @ look) - y) / len(x) + l2 * look)
    z, truth = matrix(held) @ w, np.array([f for _, f in held])
    loss = lambda c: -np.log(soft(c * z)[np.arange(len(truth)), truth] + 1e-12).mean()
    scale = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss)
    p = soft(scale * z)
    known, other = p[truth > 0, 1:].max(1), p[truth == 0, 1:].max(1)
    cuts = np.linspace(0.2, 0.95, 76)
    threshold = float(max(cuts, key=lambda c: ((known >= c).mean() + (other < c).mean(), -abs(c - 0.5))))
    w = np.round(w * scale, 6)
    words = {f: [sorted(set(_tokens(t, vocabulary))) for t in texts] for f, texts in TEMPLATES.items()}
    return Model(
        families,
        tuple(sorted(vocabulary)),
        {g: w[i].tolist() for g, i in grams.items()},
        w[-1].tolist(),
        threshold,
        {f: [dict(zip(("words", "names", "bars"), (t, *_names(t, f)), strict=True)) for t in known if len(t) >= SHORT] for f, known in words.items()},
        {f: [_spaced(t) for t, k in zip(TEMPLATES[f], known, strict=True) if len(k) < SHORT] for f, known in words.items()},
        [
            {
                "family": f,
                "n": len(_spaced(t).split()),
                "words": list(dict.fromkeys(_tokens(t, vocabulary))),
                "phrase": _tokens(t, vocabulary) if len(k) < SHORT else None,
                **dict(zip(("names", "bars"), _names(k, f), strict=True)),
            }
            for f, known in words.items()
            for t, k in zip(TEMPLATES[f], known, strict=True)
        ],
    )


def classify(model: Model, line: str, confirm: float = 0.6) -> tuple[str, float] | None:
    """The plain version of one paragraph's result: (family or unknown, probability); None if it has too few known words."""
    tokens = _tokens(line, set(model.vocabulary))
    if len(tokens) < 2:
        return None
    p = model.probabilities(tokens)
    k = int(p.argmax())
    if k and p[k] >= model.threshold:
        family = model.families[k]
        own = set(tokens)
        named = (t for t in model.templates[family] if own >= set(t["names"]) and not own & set(t["bars"]))
        if any(len(own & set(t["words"])) >= confirm * len(t["words"]) for t in named) or any(s in _spaced(line) for s in model.phrases[family]):
            return family, float(p[k])
    return UNKNOWN, float(p[0] if not k else p[k])


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, although f asks for it inside other lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _some(array: str, start: Column, n: Column) -> Column:
    """Up to n entries of an array from a place within it, in n steps; slice() copies the whole array first."""
    return F.transform(F.sequence(start, F.least(start + n, F.size(array)) - 1), lambda i: F.get(array, i))


def licence_paragraphs(docs: DataFrame, model: Model, confirm: float = 0.6) -> DataFrame:
    """docs with n_paragraphs and found array<struct<paragraph, family, probability>>, families confirmed only."""
    weights = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")
    bias = F.array(*[F.lit(float(b)) for b in model.bias])
    families = F.array(*[F.lit(f) for f in model.families])
    templates = F.from_json(F.lit(json.dumps(model.templates)), "map<string,array<struct<words:array<string>,names:array<string>,bars:array<string>>>>")
    phrases = F.from_json(F.lit(json.dumps(model.phrases)), "map<string,array<string>>")
    own = docs.withColumn("_l", F.split(F.coalesce("text", F.lit("")), "\n"))
    known = lambda line: F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w.isin(*model.vocabulary))
    spaced = lambda line: F.concat(F.lit(" "), F.array_join(F.array_remove(F.split(F.lower(line), "[^a-z0-9]+"), ""), " "), F.lit(" "))
    # _p, _s, _j, _g have an entry for each line; those of lines with fewer than two known words are null.
    own = own.withColumn("_p", F.transform("_l", known))
    def grams(t):
        return F.array_distinct(F.concat(t, F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda k: F.concat_ws(" ", F.element_at(t, k), F.element_at(t, k + 1)))))

    def scores(t):
        return F.aggregate(F.filter(F.transform(grams(t), lambda g: weights[g]), lambda a: a.isNotNull()), bias, lambda acc, a: F.zip_with(acc, a, lambda x, y: x + y))

    own = own.withColumn("_s", F.transform("_p", lambda t: F.when(F.size(t) >= 2, scores(t))))
    total = lambda z: F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max(z)))
    first = lambda z: F.element_at(families, F.array_position(z, F.array_max(z)).cast("int"))
    own = own.withColumn("_j", F.transform("_s", lambda z: F.when(z.isNotNull(), F.struct(first(z).alias("family"), (1 / total(z)).alias("probability")))))
    named = lambda t, own_words: (F.size(F.array_except(t["names"], own_words)) == 0) & ~F.arrays_overlap(t["bars"], own_words)

    def confirmed(x, i):
        t = F.get("_p", i)
        fits = F.exists(templates[x["family"]], lambda y: (F.size(F.array_intersect(t, y["words"])) >= confirm * F.size(y["words"])) & named(y, t))
        stands = F.exists(F.coalesce(phrases[x["family"]], F.array().cast("array<string>")), lambda s: F.contains(spaced(F.get("_l", i)), s))
        sure = (x["family"] != UNKNOWN) & (x["probability"] >= model.threshold)
        return F.when(x.isNotNull() & sure & (F.coalesce(fits, F.lit(False)) | stands), x["family"])

    own = own.withColumn("_g", F.transform("_j", confirmed))
    paragraphs = lambda c: F.filter(F.transform(c, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    own = own.withColumn("_f", F.transform(paragraphs("_g"), lambda i: F.struct(i.alias("paragraph"), F.get("_j", i)["family"].alias("family"), F.get("_j", i)["probability"].alias("probability"))))

    # Wrapped statements. _k: the known words of all lines, each with its line, that line's family, and its
    # place among all words. Words before a line: what stands before its line end in the text's words and line ends.
    words = lambda line: F.array_remove(F.split(F.lower(line), "[^a-z0-9]+"), "")
    placed = lambda line: F.filter(F.transform(words(line), lambda w, j: F.struct(j.alias("j"), w.alias("w"))), lambda y: y["w"].isin(*model.vocabulary))
    several = F.size(F.filter("_p", lambda t: F.size(t) > 0)) > 1
    tokens = F.array_remove(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" \n ")), "[^a-z0-9\n]+"), "")
    ends = F.filter(F.transform(tokens, lambda w, j: F.when(w == "\n", j)), lambda j: j.isNotNull())
    own = own.withColumn("_n", F.when(several, ends))
    before = lambda n, i: F.when(i == 0, 0).otherwise(F.get(n, i - 1) - i + 1)
    lines = F.filter(F.transform("_p", lambda t, i: F.when(F.size(t) > 0, i)), lambda i: i.isNotNull())
    word = lambda n, i, y: F.struct(i.alias("i"), (before(n, i) + y["j"]).alias("at"), y["w"].alias("w"), F.get("_g", i).alias("g"))
    known_words = _let(F.col("_n"), lambda n: F.flatten(F.transform(lines, lambda i: F.transform(placed(F.get("_l", i)), lambda y: word(n, i, y)))))
    own = own.withColumn("_k", F.when(several, known_words))
    spans = F.from_json(F.lit(json.dumps(model.spans)), "array<struct<family:string,n:int,words:array<string>,phrase:array<string>,names:array<string>,bars:array<string>>>")

    def in_order(own_words, of):
        """How many of the words follow one another as in the template."""
        step = lambda acc, p: F.when(p > acc["last"], F.struct(p.alias("last"), (acc["n"] + 1).alias("n"))).otherwise(acc)
        return F.aggregate(F.transform(own_words, lambda w: F.array_position(of, w).cast("int")), F.struct(F.lit(0).alias("last"), F.lit(0).alias("n")), step)["n"]

    def window(s, k, t):
        inside = F.filter(_some("_k", k, t["n"]), lambda y: y["at"] < s["at"] + t["n"])
        t_own = F.transform(inside, lambda y: y["w"])
        return F.struct(
            t["family"].alias("family"), s["at"].alias("start"), t["n"].alias("n"), s["i"].alias("first"), F.element_at(inside, -1)["i"].alias("last"), t_own.alias("t"),
            F.array_distinct(F.transform(inside, lambda y: y["i"])).alias("lines"), F.exists(inside, lambda y: y["g"].eqNullSafe(t["family"])).alias("found"),
            (in_order(t_own, t["words"]) / F.size(t["words"])).alias("share"), (F.coalesce(t_own == t["phrase"], F.lit(True)) & named(t, t_own)).alias("whole"),
        )

    def windows(t):
        at = F.filter(F.transform("_k", lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: F.array_contains(t["words"], x["s"]["w"]) & ~x["s"]["g"].eqNullSafe(t["family"]))
        return F.filter(F.transform(at, lambda x: window(x["s"], x["k"], t)), lambda x: (x["first"] < x["last"]) & (x["share"] >= confirm) & x["whole"] & ~x["found"])

    own = own.withColumn("_v", F.when(several, F.flatten(F.transform(spans, windows))))
    own = own.withColumn("_v", F.transform("_v", lambda x: x.withField("z", scores(x["t"]))))
    own = own.withColumn("_v", F.transform("_v", lambda x: x.withField("probability", 1 / total(x["z"]))))
    own = own.withColumn("_v", F.array_sort(F.filter("_v", lambda x: (first(x["z"]) == x["family"]) & (x["probability"] >= model.threshold))))
    # By family and start, the windows that meet another lie so many places from it at most.
    reach = max(len([x for x in model.spans if x["family"] == f]) * max(x["n"] for x in model.spans if x["family"] == f) for f in model.families[1:])
    meets = lambda x, o: (o["family"] == x["family"]) & (o["start"] < x["start"] + x["n"]) & (x["start"] < o["start"] + o["n"])
    rank = lambda x: F.struct(x["share"], x["probability"], -x["start"], x["n"])
    about = lambda k: _some("_v", F.greatest(F.lit(0), k - reach), F.lit(2 * reach + 1))
    best = F.filter("_v", lambda x, k: ~F.exists(about(k), lambda o: meets(x, o) & (rank(o) > rank(x))))
    wrapped = F.coalesce(F.array_distinct(F.transform(best, lambda x: F.struct(x["first"].alias("paragraph"), x["family"], x["probability"]))), F.array().cast("array<struct<paragraph:int,family:string,probability:double>>"))
    own = own.withColumn("found", F.array_sort(F.concat("_f", wrapped)))
    covered = F.coalesce(F.flatten(F.transform("_v", lambda v: v["lines"])), F.array().cast("array<int>"))
    unknown = F.size(F.array_except(paragraphs("_j"), F.concat(paragraphs("_g"), covered))).cast("long")
    n = F.size(F.filter("_l", lambda x: x.rlike(r"\S"))).cast("long")
    return own.withColumns({"n_paragraphs": n, "n_unknown": unknown}).drop("_l", "_p", "_s", "_j", "_g", "_f", "_n", "_k", "_v")


def licence_rows(docs: DataFrame) -> DataFrame:
    """Per document: paragraphs with text, families found, the first one's paragraph, the highest probability, and unconfirmed paragraphs."""
    got = licence_paragraphs(docs.select("doc_id", "text"), train())
    return got.select(
        "doc_id",
        "n_paragraphs",
        F.array_join(F.sort_array(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",").alias("licences"),
        F.get("found", F.lit(0))["paragraph"].cast("long").alias("first_paragraph"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["probability"])), F.lit(0.0)).alias("score"),
        "n_unknown",
    )
