"""Learned operators: held-out accuracy, agreement with their plain versions, edge cases; and the pipeline."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import catalog, langid, license, toxicity

from . import helpers as H

EN = "the of and to in that with from this for was are by thing ring reading".split()
FR = "le la les des une est que qui dans pour avec mentre éaux ción être".split()
BAD = ["idiot", "moronic", "scumbag", "loathsome"]


def sentence(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "er"]) for _ in range(n))


# ---- language ID (4)


def language_docs(spark, n=150):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = ["en", "fr"][i % 2]
        rows.append((i, sentence(rng, EN if lang == "en" else FR, 40), lang, "s", 1))
    rows += [(1000, sentence(rng, EN, 60) + " " + sentence(rng, FR, 60), None, "s", 1), (1001, None, "en", "s", 1), (1002, "12 34 !!", "en", "s", 1), (1003, "", None, None, None), (None, sentence(rng, FR, 30), "fr", "s", 1), (3, sentence(rng, FR, 30), "fr", "s", 1)]
    return spark.createDataFrame(rows, H.SCHEMA)


def test_language(spark):
    docs = language_docs(spark).withColumns({"label": F.lit("zz"), "bucket": F.lit(1), "languages": F.lit("x")})
    rows = langid.language_rows(docs).collect()
    assert len(rows) == docs.count()
    truth = {i: ["en", "fr"][i % 2] for i in range(150)}
    held = [r for r in rows if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert len(held) > 20 and all(r.lang_pred == truth[r.doc_id] for r in held)
    by = {r.doc_id: r for r in rows}
    assert set(by[1000].languages) == {"en", "fr"} and 0.3 < by[1000].score < 0.7
    assert [(by[i].lang_pred, by[i].score) for i in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == "fr" and all(0 <= r.score <= 1 for r in rows)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "the text", None, None, 1)], H.SCHEMA)
    assert [r.lang_pred for r in langid.language_rows(docs).collect()] == ["und"]
    assert langid.language_rows(H.empty(spark)).count() == 0


def test_held_out_fold_teaches_nothing(spark):
    docs = language_docs(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    changed = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    again = langid.fit(changed.where(~langid.held_out()))
    assert model.languages == again.languages and np.array_equal(model.likelihood, again.likelihood)


def test_em_recovers_proportions():
    rng = np.random.default_rng(0)
    p = np.zeros((4000, 2), np.float32)
    first = rng.random(4000) < 0.25
    p[:, 0], p[:, 1] = np.where(first, 0.02, 0.002), np.where(first, 0.002, 0.02)
    share, _ = langid._em(p, np.ones(4000, np.int64), np.array([4000]), rounds=200, tolerance=1e-6)
    # A trigram of one language is as likely as 1 : 10 in the other: (0.25 - 1/11) / (9/11).
    assert share[0, 0] == pytest.approx((0.25 - 1 / 11) / (9 / 11), abs=0.03)


def test_language_against_plain_python(monkeypatch):
    """Trigrams, mixture and set of each text by loops over single characters; long texts piece by piece."""
    rng = random.Random(3)
    texts = [sentence(rng, EN, 30), "", sentence(rng, FR, 25), "x", sentence(rng, EN, 20) + "! " + sentence(rng, FR, 60), "É a", sentence(rng, FR, 90)]
    languages = ("en", "fr", "xx")
    counts = np.full((langid.BUCKETS, 3), 0.5)
    for k, words in enumerate((EN, FR, ["zyx", "wvu"])):
        grams, n, _ = langid.trigrams([sentence(rng, words, 300)])
        counts[grams, k] += n
    model = langid.Model(languages, (counts / counts.sum(0)).astype(np.float32))

    def bucket(a, b, c):
        h = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) & 0xFFFFFFFF
        h ^= h >> 13
        return (h * 0x27D4EB2F & 0xFFFFFFFF) >> 17

    def mixture(p):
        share = [1 / len(p[0])] * len(p[0])
        for _ in range(24):
            new = [0.0] * len(share)
            for row in p:
                z = sum(a * b for a, b in zip(row, share, strict=True))
                new = [x + a * b / z / len(p) for x, a, b in zip(new, row, share, strict=True)]
            moved = max(abs(a - b) for a, b in zip(new, share, strict=True))
            share = new
            if moved < 2e-3:
                break
        return share, sum(np.log(sum(a * b for a, b in zip(row, share, strict=True))) for row in p)

    def plain(text):
        low = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        p = [model.likelihood[bucket(*low[i - 1 : i + 2])].astype(float).tolist() for i in range(1, len(low) - 1) if low[i] != " "]
        if not p:
            return "und", 0.0
        share, _ = mixture(p)
        rank = sorted(range(3), key=lambda j: -share[j])
        cost = 2 * np.log(len(p) + 1)
        best = (sum(np.log(row[rank[0]]) for row in p) - cost, languages[rank[0]], share[rank[0]])
        for k in (2, 3):
            part, ll = mixture([[row[j] for j in rank[:k]] for row in p])
            if ll - k * cost > best[0]:
                best = (ll - k * cost, languages[rank[int(np.argmax(part))]], max(part))
        return best[1:]

    for block in (400_000, 50):
        monkeypatch.setattr(langid, "BLOCK_CHARS", block)
        for text, got in zip(texts, langid.infer(model, texts), strict=True):
            want = plain(text)
            assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=2e-3), text


def test_language_learns_a_bounded_number_of_labels(spark):
    docs = language_docs(spark).unionByName(spark.range(300).select((F.col("id") + 5000).alias("doc_id"), F.lit("junk zq").alias("text"), F.concat(F.lit("l"), "id").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")))
    assert langid.fit(docs, most_languages=2).languages == ("en", "fr")


# ---- toxicity (3)


def toxic_docs(spark, n=420):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        words = sentence(rng, EN, 40).split()
        if toxic:
            for w in rng.sample(BAD, 3):
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, toxic))
    docs += [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "idiot scumbag moronic", "en", "s", 3), (9002, "idiot scumbag moronic", "en", "s", 3), (None, "the ring", "en", "s", 1)]
    labels += [(9000, None, None), (None, 1, 1), (0, 1, None), (5, 1, labels[5][2])]
    return spark.createDataFrame(docs, H.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_docs(spark)
    rows = toxicity.toxicity_rows(docs.withColumns({"toxic": F.lit(0), "label": F.lit("y")}), labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null and doc_id is not null").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.97
    by = {r.doc_id: r for r in rows}
    assert by[9000].score == by[9001].score < 0.5 and by[9002].predicted == 1


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = toxic_docs(spark)
    flipped = labels.withColumn("toxic", F.when(langid.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(str, toxicity.toxicity_rows(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels(spark):
    docs, labels = toxic_docs(spark)
    assert all(r.score == 0 for r in toxicity.toxicity_rows(docs, labels.limit(0)).collect())
    assert toxicity.toxicity_rows(H.empty(spark), labels).count() == 0


def weak_votes(n=6000, seed=4):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    fire = lambda a, b: (rng.random(n) < np.where(y == 1, a, b)).astype(float)
    votes = np.column_stack([fire(0.8, 0.05), fire(0.6, 0.1), fire(0.7, 0.02)])
    return rng, y, np.column_stack([votes, votes[:, 0]])


def test_label_model_finds_accuracies_and_correlations():
    rng, y, votes = weak_votes()
    given = np.where(rng.random(6000) < 0.1, y, -1)
    asked = np.ones(votes.shape, bool)
    first = toxicity.first_rates(votes, given, asked)
    post, rates, corr, prior, share = toxicity.label_model(votes, np.ones(6000), asked, first, 0.5)
    assert rates[1] == pytest.approx([0.1, 0.6], abs=0.08) and corr[0, 3] > 0.9 and abs(corr[0, 1]) < 0.2
    assert np.mean((post > 0.5) == y) > 0.93 and prior == pytest.approx(0.3, abs=0.05) and share[0] < 0.6 < share[1]
    # Counted patterns give what single rows give.
    patterns, back, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    by_pattern = toxicity.label_model(patterns, n.astype(float), np.ones(patterns.shape, bool), first, 0.5)
    assert by_pattern[0][back.ravel()] == pytest.approx(post, abs=1e-6) and by_pattern[1] == pytest.approx(rates, abs=1e-6)


def test_label_model_against_plain_loops():
    _, _, votes = weak_votes(60, 5)
    n = np.arange(60) % 3 + 1.0
    asked = np.random.default_rng(6).random(votes.shape) < 0.8
    rates = np.array([[0.2, 0.7]] * 4)
    got = toxicity.label_model(votes, n, asked, rates, 0.4, rounds=3)

    def expect(r, prior, share):
        out = []
        for i in range(60):
            z = np.log(prior / (1 - prior))
            for k in range(4):
                if asked[i, k]:
                    on, off = r[k][1] / r[k][0], (1 - r[k][1]) / (1 - r[k][0])
                    z += share[k] * np.log(on if votes[i, k] else off)
            out.append(1 / (1 + np.exp(-z)))
        return out

    r, share = rates.tolist(), [1.0] * 4
    post = expect(r, 0.4, share)
    for _ in range(3):
        r = [[(sum(n[i] * w(post[i]) * votes[i, k] for i in range(60) if asked[i, k]) + 0.1) / (sum(n[i] * w(post[i]) for i in range(60) if asked[i, k]) + 0.2) for w in (lambda p: 1 - p, lambda p: p)] for k in range(4)]
        prior = sum(a * b for a, b in zip(n, post, strict=True)) / n.sum()
        left = [[votes[i, k] - r[k][0] * (1 - post[i]) - r[k][1] * post[i] for k in range(4)] for i in range(60)]
        cov = lambda a, b: sum(n[i] * left[i][a] * left[i][b] for i in range(60) if asked[i, a] and asked[i, b]) / sum(n[i] for i in range(60) if asked[i, a] and asked[i, b])  # noqa: E731, B023
        share = [1 / max(1, sum(min(1, max(0, cov(a, b) / np.sqrt(cov(a, a) * cov(b, b)))) for b in range(4))) for a in range(4)]
        post = expect(r, prior, share)
    assert got[0] == pytest.approx(post, abs=1e-6) and got[1] == pytest.approx(np.array(r), abs=1e-6)


def test_toxicity_against_a_plain_scorer(spark):
    docs, labels = toxic_docs(spark)
    model, _ = toxicity.fit(docs, labels)
    names, w, v = list(model.voters.index), model.weights, model.voters

    def plain(text):
        words, z, hits = [x.lower() for x in toxicity.WORD.findall(text or "")], model.weights[-1], 0
        for i, s in enumerate(names):
            n = sum(x + "." == s or (len(x) > len(s) and x.startswith(s)) for x in words)
            if n:
                z, hits = z + w[i] * (1 + np.log(n)), hits + n
        for k, p in enumerate(toxicity.PATTERNS):
            z += w[len(names) + k] * bool(p.search(text or ""))
        return 1 / (1 + np.exp(-(z + w[len(names) + len(toxicity.PATTERNS)] * 10 * hits / max(1, len(words)))))

    rows = toxicity.toxicity_rows(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.score == pytest.approx(plain(texts[r.doc_id]), abs=1e-9) for r in rows)
    # A voter is made from its own part only, and not asked about it.
    asked = v.asked(np.arange(v.folds))
    for k in range(v.folds):
        assert not asked[k, k * toxicity.KINDS : (k + 1) * toxicity.KINDS].any() and asked[k].sum() == v.size - toxicity.KINDS


def test_draw_is_bounded_in_rows_and_characters(spark):
    docs, labels = toxic_docs(spark)
    many = docs.unionByName(docs.where("doc_id = 7").withColumn("text", F.explode(F.array(*[F.lit(str(i)) for i in range(500)]))))
    rows, share = toxicity.draw(many, labels, 100, 1_000_000)
    assert 60 < len(rows) <= 100 and 0 < share < 1
    rows, _ = toxicity.draw(many, labels, 1000, 30_000)
    assert 0 < sum(len(t) for _, t, _, _ in rows) <= 30_000 and max(len(t) for _, t, _, _ in rows) <= 300
    assert toxicity.draw(docs, labels.where("toxic = 1"), 100, 1000) == ([], 0.0)


# ---- quality (6)


def test_quality_without_common_words(spark, sf):
    from eventloom.llm import quality

    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("etaoinshrd"), rng.integers(4, 9)))
    text = lambda n, share: " ".join(rng.choice(quality.COMMON_WORDS[:6]) if rng.random() < share else word() for _ in range(n))
    clean = [text(int(n), 0.15) for n in rng.integers(60, 400, 200)]
    junk = [text(n, 0) for n in (60, 120, 400)] + [" | ".join(text(n, 0).split()) for n in (60, 120, 400)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean + junk)] + [(900, junk[1] + " x", "rare", "s", 1), (901, junk[1] + " y", None, "s", 1)]
    feats = quality.features(spark.createDataFrame(rows, H.SCHEMA))
    kept = {r.doc_id: r.kept for r in quality.judged(feats, quality.references(feats).where("lang = 'en'")).collect()}
    assert all(kept[i] for i in range(len(clean)))
    assert not any(kept[len(clean) + i] for i in range(len(junk)))
    assert kept[900] and kept[901]
    got = quality.quality_rows(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 60")
    assert got.where("quality = 0 and kept").count() == 0


# ---- licences (7)


def test_licences(spark):
    model = license.train()
    lines = [t for ts in license.TEMPLATES.values() for t in ts] + list(license.UNRELATED) + ["", "licensed", "MIT license", "Licensed under CC BY-NC 4.0. Licensed under the Apache License", "Ünï the of", H.prose(30)]
    texts = lines + ["\n".join(lines), None, "x\n\nReleased under the MIT License.\ny"]
    got = {r.doc_id: r for r in license.licence_rows(H.documents(spark, texts).withColumn("found", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        each = [c for line in (t or "").split("\n") if (c := license.classify(model, line))]
        assert got[i].licences == ",".join(sorted({f for f, _ in each} - {license.UNKNOWN})), t
        assert got[i].n_unknown == sum(f == license.UNKNOWN for f, _ in each)
    for family, ts in license.TEMPLATES.items():
        assert all(license.classify(model, t)[0] == family for t in ts)
    assert not any((license.classify(model, t) or (license.UNKNOWN,))[0] != license.UNKNOWN for t in license.UNRELATED)
    assert (got[len(texts) - 1].licences, got[len(texts) - 1].first_paragraph, got[len(texts) - 1].n_paragraphs) == ("mit", 2, 3)
    assert license.licence_rows(H.empty(spark)).count() == 0


def test_licences_in_the_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id for r in catalog.op7_licences(spark, sf).where("licences <> ''").collect()}
    want = {r.doc_id for r in docs.where("text like '%CC BY-NC 4.0%' or text like '%MIT License%' or text like '%Apache License%' or text like '%GNU General Public%' or text like '%All rights reserved.%'").collect()}
    assert got == want


def test_bare_statement_of_rights(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id for r in catalog.op7_licences(spark, sf).where("licences like '%proprietary%'").collect()}
    assert got == {r.doc_id for r in docs.where("text like '%All rights reserved.%'").collect()}
    lines = ["All rights reserved.", "(c) 2020 X. ALL RIGHTS RESERVED", "All rights of way are reserved.", "He reserved all rights.", "Overall rights reserved"]
    rows = {r.doc_id: r.licences for r in license.licence_rows(H.documents(spark, lines)).collect()}
    assert [rows[i] for i in range(len(lines))] == ["proprietary", "proprietary", "", "", ""]


def test_wrapped_licences(spark):
    import textwrap

    lead = "We walked along one quiet river until evening came, then slept. "
    want, texts = [], []
    for family, ts in license.TEMPLATES.items():
        for t in ts:
            for width in (40, 60, 70, 80):
                for mark in ("", "# ", " * "):
                    body = lead[: -len(t) % 31].rsplit(" ", 1)[0] + " " + lead if len(t) < width else ""
                    texts.append("\n".join(["first"] + [mark + x for x in textwrap.wrap(body + t, width, break_on_hyphens=True)] + ["last"]))
                    want.append(family)
    apart = ["All rights\nof way are reserved.", "mit\nmit under\nmit mit", "All rights\nreserved.", "\n".join(license.UNRELATED)]
    rows = {r.doc_id: r for r in license.licence_rows(H.documents(spark, texts + apart)).collect()}
    for i, (family, text) in enumerate(zip(want, texts, strict=True)):
        assert (rows[i].licences, rows[i].first_paragraph is not None) == (family, True), text
    assert [rows[len(texts) + i].licences for i in range(4)] == ["", "", "proprietary", ""]
    assert (rows[len(texts) + 2].first_paragraph, rows[len(texts) + 2].n_unknown) == (0, 0)


UNSEEN = (
    ("epl", "Licensed under the Eclipse Public License, version 2.0"),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE Version 3"),
    ("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("mpl", "Mozilla Public License Version 2.0"),
    ("boost", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("mit", "This project is open source and available under the MIT License."),
    ("apache", "You may obtain a copy of the software under the Apache License 2.0"),
    ("gpl", "distributed under the terms of the GNU General Public License v3"),
    ("gpl", "GNU GENERAL PUBLIC LICENSE"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that"),
    ("cc", "This text is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc", "Content is available under CC BY-SA 4.0"),
    ("bsd", "This code is released under the BSD 2-Clause License"),
    ("unlicense", "This software is free and unencumbered and released into the public domain"),
    ("proprietary", "Copyright (c) 2020 Some Company, Inc. All rights reserved."),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by"),
)
MISSED = (
    "Use of this source code is governed by a BSD-style license",
    "Apache Software License, version 2",
    "License: MIT",
    "This software is covered by the GNU GPL, version 2 or later",
)  # known misses: no template shares enough words
NO_TEMPLATE = (
    "Licensed under the zlib License.",
    "Microsoft Public License (Ms-PL)",
    "European Union Public Licence, version 1.2",
    "SIL Open Font License, Version 1.1",
    "Common Development and Distribution License, Version 1.0",
    "Academic Free License version 3.0",
    "Distributed under the PostgreSQL License.",
    "Licensed under the Universal Permissive License, Version 1.0",
    "This work is licensed under the Free Art License",
    "PHP License, version 3.01",
    "GNU Free Documentation License, Version 1.3",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: OFL-1.1",
)


def test_licences_in_other_words_and_of_other_families(spark):
    texts = [t for _, t in UNSEEN] + [t.replace("License", "License\n#", 1) for t in NO_TEMPLATE] + list(MISSED + NO_TEMPLATE)
    assert not {t for ts in license.TEMPLATES.values() for t in ts} & set(texts)
    rows = {r.doc_id: r.licences for r in license.licence_rows(H.documents(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == [f for f, _ in UNSEEN] + [""] * (len(texts) - len(UNSEEN))


# ---- pipeline


def test_pipeline_against_plain_python(spark, sf):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    from eventloom.llm import quality, secrets

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {r.doc_id for r in quality.quality_rows(spark.read.parquet(f"{sf}/documents.parquet")).where("kept").collect()}
    docs = {k: t for k, t in docs.items() if k in kept}
    docs = {k: t for k, t in docs.items() if H.jaccard_groups(docs)[k][1] == k} if len(docs) < 5 else {k: docs[k] for k, (_, c) in H.jaccard_groups(docs).items() if c == k}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {k: t for k, t in docs.items() if not H.contamination(t, items)[1]}
    scanner, library = secrets.Scanner(secrets.RULES), Tokenizer.from_file(catalog.tokenizer_path())

    def redacted(text):
        out, end = [], 0
        for a, _, b in scanner.scan([text])[0]:
            if a >= end:
                out += [text[end:a], "[secret]"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    want = {k: library.encode(redacted(t), add_special_tokens=False).ids for k, t in docs.items()}
    rows = P.run(spark, sf).collect()
    assert {r.doc_id: r.ids for r in rows} == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert len(P.STAGES) == 5


def test_near_duplicate_stage_by_id_and_text(spark, sf):
    import corpus_pipeline as P

    a, b, c = H.prose(60, 1), H.prose(60, 2), H.prose(60, 3)
    rows = [(7, a, "en", "s", 1), (7, b, "en", "s", 1), (9, b + " tail", "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "r", 1), (3, c, "fr", "x", 2), (3, c, "en", "x", 2)]
    rows += [(None, H.prose(60, 4), "en", "s", 1)] * 2 + [(8, None, None, None, None), (8, "", None, None, None)]
    out = P.near_duplicate_stage(spark, spark.createDataFrame(rows, H.SCHEMA), sf).collect()
    got = sorted((str(r.doc_id), str(r.text), str(r.lang)) for r in out)
    assert got == sorted([("7", a, "en"), ("7", b, "en"), ("3", c, "en"), ("None", H.prose(60, 4), "en"), ("8", "None", "None"), ("8", "", "None")])


def test_pipeline_stages_on_edge_rows(spark, sf):
    import corpus_pipeline as P

    docs = H.documents(spark, H.edge_texts() + [H.edge_texts()[5]], clash=True)
    docs = docs.unionByName(docs.where("doc_id in (5, 8)")).unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    for start in (docs, docs.limit(0)):
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, start, sf)
            if i < len(P.STAGES) - 1:
                assert out.columns == list(P.COLUMNS)
            out.collect()


def test_every_query_is_registered(spark):
    names = set(catalog.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert set(catalog.oracle_sql()) <= names


def plain_licences(model, text, confirm=0.6):
    """{(line, family)} and the number of unknown lines: lines one by one, then every window against every other."""
    lines, vocabulary = text.split("\n"), set(model.vocabulary)
    each = {i: c for i, line in enumerate(lines) if (c := license.classify(model, line))}
    known = {i: f for i, (f, _) in each.items() if f != license.UNKNOWN}
    words = [(i, w) for i, line in enumerate(lines) for w in re.split("[^a-z0-9]+", line.lower()) if w]
    spots = [(i, at, w) for at, (i, w) in enumerate(words) if w in vocabulary]
    found = []
    if len({i for i, _, _ in spots}) > 1:
        for t in model.spans:
            for first, at, w in spots:
                inside = [s for s in spots if at <= s[1] < at + t["n"]]
                own = [s[2] for s in inside]
                last, share = 0, 0
                for x in own:
                    place = t["words"].index(x) + 1 if x in t["words"] else 0
                    if place > last:
                        last, share = place, share + 1
                share /= len(t["words"])
                whole = (t["phrase"] is None or own == t["phrase"]) and set(t["names"]) <= set(own) and not set(t["bars"]) & set(own)
                if w not in t["words"] or inside[-1][0] == first or share < confirm or not whole or any(known.get(i) == t["family"] for i in range(first, inside[-1][0] + 1)):
                    continue
                p = model.probabilities(own)
                if model.families[int(p.argmax())] == t["family"] and p.max() >= model.threshold:
                    found.append((t["family"], at, t["n"], share, round(float(p.max()), 9), first, inside[-1][0]))
    rank = lambda v: (v[3], v[4], -v[1], v[2])
    best = [v for v in found if not any(o[0] == v[0] and o[1] < v[1] + v[2] and v[1] < o[1] + o[2] and rank(o) > rank(v) for o in found)]
    covered = {i for v in found for i in range(v[5], v[6] + 1)}
    return set(known.items()) | {(v[5], v[0]) for v in best}, sum(i not in covered and f == license.UNKNOWN for i, (f, _) in each.items())


def test_licences_wrapped_against_every_window(spark):
    model, rng = license.train(), random.Random(2)
    statements = [t for ts in license.TEMPLATES.values() for t in ts]
    texts = []
    for _ in range(40):
        words = [w for _ in range(rng.randint(1, 5)) for w in (rng.choice(statements) + " " + " ".join(rng.choice(license.UNRELATED).split()[: rng.randint(0, 6)])).split()]
        texts.append("".join(w + rng.choice([" ", " ", " ", " ", "\n", "\n\n"]) for w in words))
    texts += ["Released under the MIT\nLicense.\n" * 30, "MIT License\n" * 20, "\n\nMIT\n\n\nLicense"]
    got = {r.doc_id: ({(f.paragraph, f.family) for f in r.found}, r.n_unknown) for r in license.licence_paragraphs(H.documents(spark, texts).drop("found"), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_licences(model, t), t


def test_licences_in_a_text_of_many_lines(spark):
    began = time.time()
    row = license.licence_rows(H.documents(spark, ["Released under the MIT\nLicense.\n" * 4_000])).first()
    assert (row.licences, row.n_paragraphs, row.n_unknown) == ("mit", 8_000, 0)
    assert time.time() - began < 90  # a quadratic plan takes many minutes
