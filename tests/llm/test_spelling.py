"""Spelling variants against plain Python over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import spelling

from . import helpers as H


def is_near(a, b):
    """Whether one code point inserted, deleted or replaced makes a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(docs):
    c = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(H.LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            k = h % len(w)
            c[w[:k] + w[k + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def plain_variants(docs):
    words = plain_words(docs)
    form, near_n = {}, {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) <= 1 and x != w and is_near(w, x)]
        near_n[w] = len(near)
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], near_n[w], words.get(form[w]))
    return out


def rows(docs):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def frame(spark, docs):
    return H.documents(spark, ["x"]).drop("doc_id", "text").limit(1).crossJoin(spark.createDataFrame(docs, "doc_id long, text string")).withColumnsRenamed({"key": "id", "n": "place", "token": "word"})


def planted():
    rng = random.Random(11)
    base = ["hello", "hellos", "helloss", "jello", "hallo", "yellow", "aaaaa", "aaaaaa", "aaaaaaa", "aabaa", "été÷été", "été×été", "Étété", "tests", "tesst", "testt", "teest", "abcde", "bacde", "abcd" * 30, "abcd" * 29 + "abc"]
    docs = [(i, " ".join(rng.choice(base) + rng.choice(["", "", "s", "A"]) for _ in range(200))) for i in range(30)]
    docs += [(40, "Chain " * 4 + "chainx " * 30 + "chainxy " * 70 + "chbinxy " * 150 + "cha1n chain漢chain"), (41, None), (None, "hello nullid " * 5), (42, ""), (42, "twice " * 2), (42, "twice " * 2)]
    return docs + [(43, "z" * 30_000 + " " + "z" * 30_001 + " ") for _ in range(3)]


def test_spelling_variants(spark, monkeypatch):
    docs = planted()
    want = plain_variants(docs)
    assert want["chain"][:2] == ("chainx", "chbinxy") and want["hello"][3] >= 3
    assert rows(frame(spark, docs)) == want
    monkeypatch.setattr(spelling, "deletion_keys", lambda texts, f=spelling.deletion_keys: (*f(texts)[:2], f(texts)[2] % np.uint64(5)))  # hashes that collide all the time
    small = docs[:4]
    assert rows(frame(spark, small)) == plain_variants(small)


def test_spelling_variants_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows(docs)
    assert got == plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert rows(docs.limit(0)) == {}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé漢\U0001f600", max_size=9), max_size=6))
def test_deletion_keys(texts):
    of, place, key = spelling.deletion_keys(texts)
    left = [texts[i] if p < 0 else texts[i][:p] + texts[i][p + 1 :] for i, p in zip(of, place)]
    assert len(left) == sum(len(t) + 1 for t in texts)
    assert len(set(left)) == len(set(zip(left, key.tolist()))) == len(set(key.tolist()))


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_shared_keys_over_batches(size):
    key = [1, 1, 2, 3, 3, 3, 4, 5, 5, 6, 7, 7]
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(range(i, min(len(key), i + size)))], ["key", "id"]) for i in range(0, len(key), size)]
    got = [x for b in spelling._shared(iter(batches)) for x in b.column(1).to_pylist()]
    assert got == [i for i, k in enumerate(key) if key.count(k) > 1]
