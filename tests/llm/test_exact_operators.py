"""Operators with exact definitions against plain Python, edge cases included."""

import random
import math
import re

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventloom.llm import bpe, decontam, jaccard, quality, secrets, substring, urlfilter

from . import helpers as H

PATH = public_tokenizers.path("byte_bpe_50k.json")


def real_texts(spark, sf, most=120):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(most).collect()]


# ---- substring dedup (2)


@pytest.mark.parametrize("many", [400, 1])
def test_substring_dedup(spark, sf, many, monkeypatch):
    monkeypatch.setattr(substring, "MANY", many)
    texts = H.edge_texts() + real_texts(spark, sf)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_digests(H.documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == H.kept_words(texts, 35)


def test_substring_dedup_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_ROWS", -1)
    texts = H.edge_texts()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_digests(H.documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == H.kept_words(texts, 35)


def test_substring_repeated_rows_and_null_ids(spark):
    text = H.prose(60, 9)
    rows = [(1, text), (1, text), (None, text), (2, H.prose(60, 8))]
    got = sorted((str(r.doc_id), r.n_removed) for r in substring.substring_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 60), ("1", 60), ("2", 0), ("None", 60)]
    assert substring.substring_digests(H.empty(spark)).count() == 0


# ---- n-gram Jaccard join (10)


@pytest.mark.parametrize(("block", "broadcast"), [(128, 1_000_000), (3, -1)])
def test_jaccard_join(spark, sf, block, broadcast, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    base = H.prose(150, 20).split()
    near = []
    for _ in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        near.append(" ".join(w))
    texts = H.edge_texts() + near + real_texts(spark, sf, 60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(H.documents(spark, texts)).collect()}
    assert got == H.jaccard_groups(dict(enumerate(texts)))


def test_jaccard_hot_tokens(spark, monkeypatch):
    """With every shared token hot, prefixes change but links don't."""
    texts = [H.prose(60, 30) + " " + H.prose(4, 40 + i) for i in range(12)] + [H.prose(60, 31)] * 3
    monkeypatch.setattr(jaccard, "HOT_SHARE", 1 << 40)
    real_max = max
    monkeypatch.setattr(jaccard, "max", lambda *a: 1 if a and a[0] == 2000 else real_max(*a), raising=False)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(H.documents(spark, texts)).collect()}
    assert got == H.jaccard_groups(dict(enumerate(texts)))


def test_jaccard_empty_and_null_ids(spark):
    assert jaccard.near_duplicates(H.empty(spark)).count() == 0
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (7, "q r s t"), (3, None)]
    got = sorted(map(str, (tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, [(None, 2, 7), (7, 2, 7), (7, 2, 7), (7, 2, 7), (3, 0, 3)]))


@pytest.mark.parametrize("bits", [0, 2])
def test_jaccard_classes_with_equal_first_halves(spark, sf, bits, monkeypatch):
    """Digests that agree in all or most of their first 64 bits: classes are told apart by the rest."""
    digest = jaccard._digest

    def weak(tokens):
        d = digest(tokens)
        return bytes([d[0] & bits]) + bytes(7) + d[8:]

    monkeypatch.setattr(jaccard, "_digest", weak)
    texts = [t or "" for t in H.edge_texts() + real_texts(spark, sf, 30)]
    classes = [jaccard._halves(s) for s in jaccard.shingle_sets(pa.array(texts), 3)]
    rows = [(i, *c) for i, c in enumerate(classes)]
    named, moved = jaccard._apart(spark.createDataFrame(rows, "rep long, key long, other long"))
    assert len(moved) >= len({c for c in classes if c[0] is not None}) - 3
    keys = {r.rep: r.key for r in named.collect()}
    for i, a in enumerate(classes):
        for j, b in enumerate(classes):
            assert (a == b) == (keys[i] == keys[j])
    assert all(moved.get(c, c[0]) == keys[i] for i, c in enumerate(classes))


def test_jaccard_links_by_texts_without_an_id(spark):
    a = H.prose(60, 1)
    rows = [(None, a), (None, a.upper()), (5, a + " tail"), (None, H.prose(60, 2)), (None, None)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.component_id) for r in got if r.n_shingles in (58, 59)) == ["5", "5", "5", "None"]


# ---- decontamination (5)


def items_of(spark, sf):
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    return rows + [(900, None), (901, ""), (902, "lone"), (903, rows[0][1]), (904, "..."), (None, "w7919 w15838")]


@pytest.mark.parametrize(("literal", "bloom", "broadcast", "a_row"), [(20_000, 0, 300_000, 64), (-1, 1_000_000, 300_000, 2), (-1, -1, -1, 1)])
def test_decontamination(spark, sf, literal, bloom, broadcast, a_row, monkeypatch):
    for name, value in (("LITERAL_WORDS", literal), ("BLOOM_WORDS", bloom), ("BROADCAST_ROWS", broadcast), ("WINDOWS_A_ROW", a_row)):
        monkeypatch.setattr(decontam, name, value)
    items = [i for i in items_of(spark, sf) if i[0] is not None]
    texts = H.edge_texts() + real_texts(spark, sf, 60) + ["Lone LONE; lone", "x " + items[3][1].upper() + " y"]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontam.contamination_digests(H.documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [H.contamination(t, dict(items)) for t in texts]


def test_decontamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    got = decontam.contamination_digests(docs, none).collect()
    assert len(got) == 4 and not any(r.contaminated for r in got)
    assert decontam.contamination_digests(H.empty(spark), none).count() == 0
    one = spark.createDataFrame([(5, "A b")], "item_id long, text string")
    assert sum(r.contaminated for r in decontam.contamination_digests(docs, one).collect()) == 3


def test_decontamination_of_a_long_text_and_a_hot_word(spark, monkeypatch):
    monkeypatch.setattr(decontam, "LITERAL_WORDS", -1)
    monkeypatch.setattr(decontam, "BLOOM_WORDS", -1)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", -1)
    # Every window's rarest word is "hot", which stands at every tenth place of the long text and in 100 windows.
    long = " ".join("hot" if i % 10 == 0 else f"w{i % 97}" for i in range(20_000))
    often = " ".join(f"w{i % 97}" for i in range(100_000))
    items = [(i, " ".join(["hot" if j == i % 10 else f"w{(i * 13 + j * 7) % 97}" for j in range(10)])) for i in range(100)] + [(5000, " ".join(long.split()[777:790]))]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontam.contamination_digests(H.documents(spark, [long, often]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got[0] == H.contamination(long, dict(items)) and got[0][1] > 0
    assert got[1][:3] == (100_000, 0, 0)


# ---- quality rules (6)


def test_quality_base(spark, sf):
    texts = H.edge_texts() + real_texts(spark, sf) + ["a b c d e " * 3, "a a a a a a a a a a a a", "# x\n# x\n\n\n"]
    got = {r.doc_id: r for r in quality.quality_rows(H.documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        base = H.quality_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert not (r.base_failed and r.kept)
    assert quality.quality_rows(H.empty(spark)).count() == 0


def test_quality_distance(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1, 1],), ([2, 0],), ([0, 5],), ([0, 0],)], "c array<long>")
    even = F.array(F.lit(0.5), F.lit(0.5))
    got = [r[0] for r in df.select(quality.js_distance(quality.shares(F.col("c")), even)).collect()]
    assert got[0] == pytest.approx(0) and got[1] == pytest.approx(got[2]) and 0.5 < got[1] < 0.6 and got[3] is None


@pytest.mark.parametrize(("tile", "broadcast"), [(1_000, 10_000), (2, -1)])
def test_quality_verdict_against_plain_python(spark, sf, tile, broadcast, monkeypatch):
    monkeypatch.setattr(quality, "TILE", tile)
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", broadcast)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rare = [(10_000, H.prose(60, 5), "ja"), (10_001, "el gato y la casa " * 3 + H.prose(60, 6), "ja"), (10_002, H.prose(70, 7), "zz"), (10_003, H.prose(70, 8), None)]
    docs = docs.unionByName(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    feats = {r.doc_id: r for r in quality.features(docs).collect()}
    got = {r.doc_id: r for r in quality.quality_rows(docs).collect()}
    sums = {}
    for r in feats.values():
        if r.lang is not None:
            for c in ("classes", "common"):
                sums[r.lang, c] = [x + y for x, y in zip(sums.get((r.lang, c), [0] * len(r[c])), r[c], strict=True)]
    langs = {k for k, _ in sums}

    def distance(a, b):
        p, q = ([x / sum(v) for x in v] for v in (a, b))
        half = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
        return math.sqrt(max(0.0, sum(half(x, y) + half(y, x) for x, y in zip(p, q, strict=True)) / 2))

    for i, r in feats.items():
        if r.n_words < 40:
            assert got[i].class_distance is None and got[i].kept == (not got[i].base_failed)
            continue
        own = r.lang is not None and sum(sums[r.lang, "common"]) - sum(r.common) >= 40
        mine, nearest = {}, {}
        for c in ("classes", "common"):
            left = [x - y for x, y in zip(sums[r.lang, c], r[c], strict=True)] if own else []
            mine[c] = distance(r[c], left) if own else None
            rest = [distance(r[c], sums[k, c]) for k in langs - {r.lang} if sum(sums[k, c])]
            nearest[c] = min([*rest, *([mine[c]] if own else [])], default=None)

        def near(d, own=own, n=r.n_words):
            return d["classes"] <= 0.3 and d["common"] <= 0.45 and not (own and d["common"] > 0.1 + 1.22 / math.sqrt(n))

        if own and near(mine):
            nearest = mine
        assert (got[i].class_distance, got[i].word_distance) == (pytest.approx(nearest["classes"], abs=2e-6), pytest.approx(nearest["common"], abs=2e-6))
        assert got[i].kept == (near(nearest) and not got[i].base_failed)
    # Two documents of a rare language are judged by each other, the only one of another language by all others.
    assert got[10_000].class_distance > 0 and got[10_002].class_distance > 0


# ---- URL filter (1)


def test_url_filter(spark, sf):
    urls = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "http://COM/", "https://www.Example.com/en/x?y#z", "http://example.com/en", "ftp://a.net/fr/1", "http://net/es/", "http://xnet/es/", "http://m.casino-win.example.org/q", "x://h?a://b/", "http://casino-win.example.net/de/"]
    got = {r.page_id: r for r in urlfilter.url_rows(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, url in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(H.LOWER), m[2]) if m else ("", "")
        fits = [(len(r), v, r) for v, r in urlfilter.RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
        bad = any(host == s or host.endswith("." + s) for s in urlfilter.BLOCKED_SITES)
        rule, verdict = (max(fits)[2], max(fits)[1]) if fits else (None, "block" if bad else "allow")
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), url


def test_url_filter_of_very_long_hosts(spark):
    long = ".".join(f"l{i}" for i in range(8000))
    urls = [f"http://{long}.casino-win.example.org/", f"http://{long}.net/fr/x", f"http://casino-win.example.org.{long}/", "http://" + "." * 5000 + "/"]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.url_rows(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {0: (None, "block"), 1: ("net/fr/", "block"), 2: (None, "allow"), 3: (None, "allow")}


def test_cascade_is_exact_and_has_levels(spark):
    from pyspark.sql import functions as F

    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("cast(substr(key, 2) as int) % 7 = 0")
    cascade = urlfilter.build(universe, listed, first_rate=0.3)
    assert len(cascade.levels) >= 2
    got = {r.key for r in universe.where(cascade.contains(F.col("key"))).collect()}
    assert got == {r.key for r in listed.collect()}


def test_url_filter_beyond_the_bound(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = sorted(map(str, urlfilter.url_rows(pages).collect()))
    monkeypatch.setattr(urlfilter, "MAX_BITS", 1)
    assert sorted(map(str, urlfilter.url_rows(pages).collect())) == want
    assert urlfilter.url_rows(pages.limit(0)).count() == 0


# ---- secrets (8)


def plain_spans(text):
    return sorted((m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, text or "") if r.keep(m))


def either(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYS = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
# The base rules, written out apart from the library's: kind, pattern, group that must be so long.
BASE = (
    ("assign", "(" + KEYS + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE) for m in re.finditer(p, text or "") if len(m.group(g)) >= least)


ALPHABET = ["password", "TOKEN", "api_key", "apikey", "secret", "=", ": ", '"', "'", " ", "abcdef12", "AKIA", "ABCDEFGH1234567890", "deadbeef" * 3, "0" * 23, "f", "ſecret", "passwd=", "é", "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "http://u:p@h", "K"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join), max_size=6))
def test_trigram_index_loses_no_match(texts):
    got = secrets.Scanner(secrets.RULES).scan(texts) if texts else []
    assert got == [plain_spans(t) for t in texts]
    assert [[s for s in spans if s[1] < len(BASE)] for spans in got] == [base_spans(t) for t in texts]


def test_secret_rows(spark, sf):
    texts = H.edge_texts() + real_texts(spark, sf) + ["é password: token: abcdefgh", "token=secret=abcdefg", "a" * 24 + "\n" + "AKIA" + "A" * 16]
    got = {r.doc_id: r for r in secrets.secret_digests(H.documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = plain_spans(t)
        line = lambda most: ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in spans if k < most)  # noqa: B023, E731
        assert (got[i].spans, got[i].base_sha256) == (line(99), H.sha(line(3)))
        assert got[i].base_sha256 == H.sha(",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in base_spans(t)))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
    red = {r.doc_id: r.text for r in secrets.redact(H.documents(spark, texts)).collect()}
    assert not any(plain_spans(t) for t in red.values())
    assert secrets.secret_digests(H.empty(spark)).count() == 0


def test_queries_without_trigrams_scan_all():
    assert secrets.trigram_query(r"[0-9a-f]{24,}") is True
    assert secrets.query_trigrams(secrets.trigram_query(r"AKIA[A-Z0-9]+")) == {b"aki", b"kia"}
    assert secrets.trigram_query(r"abc|d") is True


# ---- BPE (9)

PIECES = ["a", "B", " ", "  ", "\n", "'s", "'re", "'", "'l", "l", "\x1c", "\x85", "\u2003", "\u3000", "é", "ß", "中", "9", "½", "!", "$", "<|endoftext|>", "<|endof", "|>", "<", "\t", "😀", "e\u0301", "ing", "the", "_", "\u00a0", "\x00", "\ufffd"]


@pytest.fixture(scope="module")
def bpe_pair():
    return bpe.MergeTable.load(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=14).map("".join)))
def test_bpe_equals_the_library(bpe_pair, text):
    table, library = bpe_pair
    ids = bpe.encode(table, text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert bpe.decode(table, ids) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), st.integers(1, 5))
def test_bpe_chunks_do_not_matter(bpe_pair, text, step):
    table, library = bpe_pair
    encoder = bpe.Encoder(table)
    ids = [t for i in range(0, len(text), step) for part in encoder.feed(text[i : i + step]) for t in part]
    ids += [t for part in encoder.finish() for t in part]
    assert ids == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("tail", ["", ".", " q", "'s", "=" * 5000 + "123"])
def test_bpe_long_pieces_use_the_window(bpe_pair, tail, monkeypatch):
    table, library = bpe_pair
    monkeypatch.setattr(bpe, "CHUNK", 500)
    monkeypatch.setattr(bpe, "LONG_PIECE", 600)
    rng = random.Random(3)
    text = "x y" + "".join(rng.choice(["a", "b", "the", "ing", "er", "é", "zz", "th"]) for _ in range(6000)) + tail
    assert 0 < table.lookahead < 5000
    assert bpe.encode(table, text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_rows(spark, sf, bpe_pair):
    _, library = bpe_pair
    texts = H.edge_texts() + real_texts(spark, sf, 40)
    docs = H.documents(spark, texts)
    got = {r.doc_id: r for r in bpe.token_digests(docs, PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), H.sha(",".join(map(str, ids))))
        assert got[i].decoded_sha256 == H.sha(library.decode(ids, skip_special_tokens=False))
    back = {r.id: r.text for r in bpe.decode_ids(bpe.encode_texts(docs, PATH), PATH).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    assert bpe.token_digests(H.empty(spark), PATH).count() == 0
