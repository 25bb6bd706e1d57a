"""Operators against hand-computed cases: text, filters, slate, clusters, agreement, drift, mobility, alerts."""

import math
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.operators import clusters, domain, labelers, ranking, sinks, slate, stats
from eventloom.sources import feeds


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x"))).first()[0]


# ---- text


def test_norm_and_keys(spark):
    assert one(spark, "  “Ｈello—World”  STRASSE ß ", T.norm) == '"hello-world" strasse ss'
    assert one(spark, " A\tB’s  ", T.norm_ascii) == "a b's"
    assert one(spark, "Timothée  DUPONT", T.name_key) == one(spark, "Dupont Timothee", T.name_key) == "dupont timothee"
    assert one(spark, None, T.norm) is None


def test_visible_text(spark):
    html = "<p>a <b>b</b><script>no()</script><style>x{}</style> c&amp;d</p><template>t</template>"
    assert one(spark, html, T.html_to_text) == "a b c&d"
    assert one(spark, "plain < text", T.readable_text) == "plain < text"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('{"datePublished" : "2024-02-03T10:00"}<h1>x</h1>Jan 1, 2020', "2024-02-03"),
        ('<meta property="article:published_time" content="2023-01-02">', "2023-01-02"),
        ('<time class="a" datetime="2022-12-31">', "2022-12-31"),
        ("<h1>Title</h1> by A on September 5, 2021 more", "2021-09-05"),
        ("<h1>Title</h1>" + "x" * 500 + "Sept. 5, 2021", None),
        ("nothing", None),
        (None, None),
    ],
)
def test_page_published(spark, html, want):
    assert one(spark, html, T.page_published) == want


def test_tokens_and_counts(spark):
    assert sorted(one(spark, "(v3.6) a release, release!", T.story_tokens)) == ["release", "v3.6"]
    assert one(spark, "up 3.5% to $1,000 in 2024", T.specificity) == 5.0
    rows = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]
    assert one(spark, "an open\n source model", lambda c: c.rlike(T.term_pattern("open source")))
    assert not one(spark, "openly sourced", lambda c: c.rlike(T.term_pattern("open")))
    assert one(spark, "C++ code", lambda c: c.rlike(T.term_pattern("c++")))


def test_dates(spark):
    assert one(spark, "Tue, 05 Mar 2024 10:00:00 +0000", T.parse_rfc822).startswith("2024-03-05T10:00:00")
    assert one(spark, "soon", T.parse_rfc822) == "soon"
    got = [one(spark, x, T.parse_iso_any) for x in ("2024-03-05T10:00:00Z", "2024-03-05T12:00:00+02:00", "2024-03-05", "x")]
    assert got == [datetime(2024, 3, 5, 10), datetime(2024, 3, 5, 10), datetime(2024, 3, 5), None]
    as_of = F.lit(datetime(2024, 3, 31))
    rows = spark.createDataFrame([(datetime(2024, 3, 1),), (datetime(2024, 4, 5),), (None,)], "p timestamp")
    assert [r[0] for r in rows.select(T.recency(F.col("p"), as_of)).collect()] == pytest.approx([math.exp(-1), 1.0, 0.5])


# ---- sources


def test_feeds(spark):
    rss = '<?xml version="1.0"?><rss><channel><title>c</title><item><title>A</title><link>l1</link><pubDate>d</pubDate></item><item><title>B</title></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="l2"/><updated>u</updated><summary>s</summary></entry></feed>'
    docs = spark.createDataFrame([(1, rss), (2, atom), (3, None), (4, "junk")], "id int, xml string")
    got = [tuple(r) for r in feeds.parse_feed(docs, "xml").orderBy("id", "pos").collect()]
    assert got == [(1, 0, "A", "l1", "d", None), (1, 1, "B", None, None, None), (2, 0, "E", "l2", "u", "s")]
    many = "<rss><channel>" + "<item><title>t</title></item>" * 30 + "</channel></rss>"
    assert feeds.parse_feed(spark.createDataFrame([(many,)], "xml string"), "xml").count() == 25


def test_front_matter_and_posts(spark):
    r = feeds.front_matter(spark.createDataFrame([("---\nurl: http://a:1\nlab: X\n---\nbody\n---\nmore",), ("no header",)], "raw string"), "raw").collect()
    assert (r[0].meta, r[0].body, r[1].meta, r[1].body) == ({"url": "http://a:1", "lab": "X"}, "body\n---\nmore", {}, "no header")
    assert [one(spark, x, feeds.truthy) for x in ("True", " false", None)] == [True, False, False]
    assert one(spark, "t\nauthors: A B; C ;\nx", feeds.authors_line) == ["A B", "C"]
    assert one(spark, "none", feeds.authors_line) is None


def test_sitemap_index(spark):
    xml = "<sitemapindex><sitemap><loc>https://a/s1</loc></sitemap></sitemapindex>"
    assert feeds.child_sitemaps(spark.createDataFrame([(xml,)], "x string"), "x").collect()[0].loc == "https://a/s1"


# ---- sinks


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sinks.insert_new(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(sinks.replace_by_key(old, new, ["k"])) == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(sinks.update_column(old, new.withColumnRenamed("v", "n"), ["k"], "v", "n")) == [(1, "a"), (2, "x")]
    again = sinks.insert_new(sinks.insert_new(old, new, ["k"]), new, ["k"])
    assert rows(again) == rows(sinks.insert_new(old, new, ["k"]))


# ---- slate


def accept(rows, policy):
    state = slate.Acceptance(policy)
    full = [{"reason": None, "cluster_id": None, "rare": [], "published": datetime(2026, 7, 28), "lab": "L", **r} for r in rows]
    return [state.take(r) for r in full], state


def test_slate_rules():
    policy = slate.SlatePolicy(max_per_lab=2)
    took, state = accept([{"lab": "A"}] * 4 + [{"lab": "B"}], policy)
    assert took == [True, True, False, False, True] and state.dropped["lab_cap"] == 2
    took, state = accept([{"rare": ["3.6"]}, {"rare": ["3.6", "q"]}, {"rare": []}], slate.SlatePolicy(max_per_lab=0))
    assert took == [True, False, True] and state.dropped["same_story"] == 1
    took, _ = accept([{"rare": ["q"], "lab": slate.UNATTRIBUTED}] * 2, slate.SlatePolicy(max_per_lab=0))
    assert took == [True, True]
    # A row that a later rule drops does not claim its cluster.
    took, _ = accept([{"lab": "A", "cluster_id": 1}, {"lab": "A", "cluster_id": 2}, {"lab": "A", "cluster_id": 3}, {"lab": "B", "cluster_id": 3}], policy)
    assert took == [True, True, False, True]


def test_slate_query(spark):
    rows = [(i, float(100 - i), f"lab{i % 3}", None, datetime(2026, 7, 20), [], None if i % 4 else "undated") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, score double, lab string, cluster_id long, published timestamp, rare array<string>, reason string")
    chosen, dropped = slate.topk_slate(df, slate.SlatePolicy(k=4, max_per_lab=2))
    assert [r["id"] for r in chosen] == [1, 2, 3, 5] and dropped == {"undated": 2}


def test_row_reasons(spark):
    df = spark.createDataFrame([(False, "one two", datetime(2026, 7, 23)), (True, "one", datetime(2026, 7, 23)), (False, "w " * 10, None), (False, "w " * 10, datetime(2026, 7, 19)), (False, None, datetime(2026, 7, 27))], "synth boolean, quote string, published timestamp")
    no = F.lit(False)
    row = {"not_entailed": no, "synth": F.col("synth"), "quote": F.col("quote"), "no_mechanism": no, "no_holding": no, "published": F.col("published")}
    got = [r[0] for r in df.select(slate.row_reason(slate.SlatePolicy(window_days=7), F.lit(datetime(2026, 7, 28)), row)).collect()]
    assert got == ["thin_quote", None, "undated", "outside_window", "thin_quote"]


def test_reader_rank(spark):
    rows = [(1, datetime(2024, 5, 24), None, 9.0), (2, datetime(2026, 7, 20), 7, 5.0), (3, datetime(2026, 7, 21), 7, 4.0), (4, datetime(2026, 7, 1), None, 1.0), (5, None, None, 8.0)]
    df = spark.createDataFrame(rows, "id long, published timestamp, cluster_id long, score double")
    got = {r.id: r.reader_rank for r in slate.reader_rank(df, F.lit(datetime(2026, 6, 1))).collect()}
    assert [got[i] for i in (2, 4, 3, 1, 5)] == [1, 2, 3, 4, 5]


# ---- clusters


def test_clusters(spark):
    rows = [(1, "release", "lab a ships model x now".split()), (2, "release", "lab a ships model x today".split()), (3, "benchmark", "lab a ships model x now".split()), (4, "release", [])]
    got = {r.id: r.cluster_id for r in clusters.cluster_claims(spark.createDataFrame(rows, "id long, event_type string, tokens array<string>")).collect()}
    assert got[1] == got[2] and len({got[1], got[3], got[4]}) == 3


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.root for r in clusters.min_label(edges, spark.range(61)).collect()} == {0}


# ---- statistics


@pytest.mark.parametrize(("x", "y", "want"), [("aabb", "aabb", 1.0), ("aabb", "bbaa", -1.0), ("aaaa", "aaaa", math.nan)])
def test_kappa(spark, x, y, want):
    got = stats.kappa(spark.createDataFrame(list(zip(x, y, strict=True)), "x string, y string"), "x", "y").first().kappa
    assert got == want or math.isnan(got) and math.isnan(want)


def test_kappa_skewed_and_empty(spark):
    got = stats.kappa(spark.createDataFrame(list(zip("aaaaaaab", "aaaaaabb", strict=True)), "x string, y string"), "x", "y").first()
    assert got.kappa < 0.7 and got.n == 8
    assert stats.kappa(spark.createDataFrame([], "x string, y string"), "x", "y").first().n == 0


def test_psi(spark):
    rows = [("a", False)] * 80 + [("b", False)] * 20 + [("a", True)] * 50 + [("b", True)] * 50
    got = stats.psi(spark.createDataFrame(rows, "c string, cur boolean"), "c", F.col("cur")).first().psi
    assert got == pytest.approx(-0.3 * math.log(0.5 / 0.8) + 0.3 * math.log(0.5 / 0.2))
    new = spark.createDataFrame([("a", False)] * 10 + [("a", True)] * 5 + [("b", True)] * 5, "c string, cur boolean")
    assert stats.psi(new, "c", F.col("cur")).first().psi > 0.25


@pytest.mark.parametrize(("a", "b", "want"), [(range(50), range(50), 0.0), (range(50), range(100, 150), 1.0), ([1, 1, 2], [1, 1, 2], 0.0), ([], [1, 2], 0.0)])
def test_ks(spark, a, b, want):
    rows = [(float(v), False) for v in a] + [(float(v), True) for v in b]
    got = stats.ks(spark.createDataFrame(rows, "v double, cur boolean"), "v", F.col("cur")).first()
    assert got.statistic == pytest.approx(want) and (a or math.isinf(got.critical))


def test_dawid_skene(spark):
    import random

    rng, rows = random.Random(0), []
    for i in range(200):
        truth = "a" if i % 2 else "b"
        for name, acc in (("x", 0.95), ("y", 0.9), ("z", 0.6)):
            if rng.random() < 0.9:
                rows.append((i, name, truth if rng.random() < acc else ("b" if truth == "a" else "a")))
    post, acc = labelers.dawid_skene(spark.createDataFrame(rows, "item long, labeler string, vote string"))
    assert acc["x"] > acc["y"] > acc["z"] and acc["x"] > 0.85
    assert sum((r.posterior > 0.5) == bool(r.item % 2) for r in post.collect()) > 180


# ---- domain


def test_moves(spark):
    d = datetime
    rows = [(1, "A", d(2026, 1, 1)), (1, "B", d(2026, 2, 1)), (2, "A", d(2026, 1, 1)), (2, "A", d(2026, 3, 1)), (2, "B", d(2026, 2, 1)), (3, "A", d(2025, 1, 1)), (3, "B", d(2026, 1, 1)), (4, "A", d(2026, 1, 1)), (4, "A", d(2026, 2, 1)), (5, "A", None), (5, None, d(2026, 1, 1))]
    seen = spark.createDataFrame(rows, "person long, lab string, observed timestamp")
    found = domain.moves(seen, 90)
    assert [(r.person, r.src, r.dst) for r in found.collect()] == [(1, "A", "B")]
    assert domain.moves(seen, 90, found.select("person", "src", "dst")).count() == 0


def test_alerts_fire_once(spark):
    hits = spark.createDataFrame([(1, "p", "r"), (1, "p", "r"), (2, "p", "r")], "event_id int, persona string, rule string")
    keys = ["event_id", "persona", "rule"]
    fired = hits.where("event_id = 2")
    first = domain.unfired(hits, fired, keys)
    assert [r.event_id for r in first.collect()] == [1]
    assert domain.unfired(hits, fired.unionByName(first), keys).count() == 0


def test_channels_and_prf(spark):
    lex = {"compute": ["gpu", "data center"], "talent": ["hire"]}
    got = [one(spark, x, lambda c: domain.channel(c, lex)) for x in ("a GPU and a data  center hire", "gpu hire", "hire", "none")]
    assert got == ["compute", "compute", "talent", None]
    assert one(spark, "new gpu", lambda c: domain.exposure(c, {"T2": ["gpu"], "T1": ["new"], "T0": []})) == ["T1", "T2"]
    r = domain.prf(spark.createDataFrame([("a", "a"), ("b", "a"), (None, "a"), ("a", None), (None, None)], "p string, t string"), "p", "t").first()
    assert (r.tp, r.fp, r.fn, r.f1) == (1, 2, 2, pytest.approx(1 / 3))


def test_cost_raises_without_price(spark):
    df = spark.createDataFrame([("m", 1_000_000.0, 100_000.0)], "m string, i double, o double")
    cost = lambda name: df.select(domain.cost_usd(F.lit(name), F.col("i"), F.col("o"), {"m": (3.0, 15.0)})).first()[0]
    assert cost("m") == pytest.approx(4.5)
    with pytest.raises(Exception, match="no price"):
        cost("other")


def test_stage2(spark):
    docs = spark.createDataFrame([(1, "The <b>Model</b> ships today. It is fast. " + "x" * 2000), (2, "text"), (3, "text"), (4, "text")], "document_id long, raw string")
    reply = '```json\n{"events": [{"claim": "c1", "quote": "it is FAST.", "event_type": "release"}, {"claim": "c2", "quote": "It is  fast.", "event_type": "other"}, {"claim": "c3", "quote": "absent", "event_type": "other"}, {"claim": "c4", "quote": "ships today", "event_type": "other"}, {"claim": "c5", "quote": "xxx", "event_type": "other"}]}\n```'
    replies = spark.createDataFrame([(1, reply), (2, "no json"), (3, '{"events": []}'), (4, '{"events": [{"claim": "a", "quote": ""}]}')], "document_id long, reply_json string")
    got = [(r.document_id, r.claim, r.status) for r in domain.stage2(docs, replies).orderBy("document_id", "ord").collect()]
    assert got == [(1, "c1", "ok"), (1, "c2", "duplicate_quote"), (1, "c3", "quote_not_found"), (1, "c4", "ok"), (1, "c5", "over_cap"), (2, None, "parse_failed"), (3, None, "empty"), (4, "a", "quote_not_found")]


def test_places_are_exact_on_large_tables(spark):
    from eventloom.operators import documents, order

    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = 1_000_000
        rows = spark.range(n).select(
            "id", (F.xxhash64("id") % 1000 / 7.0).alias("score"), F.when(F.col("id") % 3 == 0, F.col("id") % 50_000).alias("cluster_id"), F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id % 300 as int))").alias("published"), F.repeat(F.lit("x"), 100).alias("wide")
        )
        ranked = slate.reader_rank(rows, F.expr("timestamp'2024-03-01'"))
        got = ranked.agg(F.count("*").alias("n"), F.countDistinct("reader_rank").alias("d"), F.min("reader_rank").alias("lo"), F.max("reader_rank").alias("hi"), F.countDistinct("id").alias("ids")).first()
        assert tuple(got) == (n, n, 1, n, n)
        schema = "id long, source_id long, source_type string, url string, raw_content string, content_hash string, published_at string, retrieved_at string"
        stored = spark.createDataFrame([(7, 1, "blog", "u", "old", "h", None, "2024")], schema)
        fetched = spark.range(400_000).select(F.lit(1).cast("long").alias("source_id"), F.lit("blog").alias("source_type"), F.concat(F.lit("u"), "id").alias("url"), F.concat(F.repeat(F.lit("x"), 100), F.col("id").cast("string")).alias("raw_content"), F.lit(None).cast("string").alias("published_at"), F.concat(F.lit("2024-"), F.col("id") % 99).alias("retrieved_at"))
        new = documents.store(stored, fetched).agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
        assert tuple(new) == (400_000, 400_000, 8, 400_007)
        few = spark.createDataFrame([(v,) for v in ("b", "a", "d", "c")], "v string")
        assert sorted(tuple(r) for r in order.numbered(few, "at", "v").collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
        assert order.numbered(few.limit(0), "at", "v").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_hidden_elements_and_references(spark):
    page = "<!DOCTYPE html><p title='a > b'>One<b>two</b> &amp;&nbsp;3 &lt; 4</p><template>x<template>y</template>z</template><noscript>n</noscript><!-- c --><script>if (a < b) {}</script><STYLE>p{}</STYLE> end<script>never closed"
    assert one(spark, page, T.html_to_text) == "One two & 3 < 4 end"
    assert one(spark, None, T.html_to_text) is None


def test_slate_ledger_counts_barred_rows_down_to_the_last_accepted(spark):
    rows = [(i, float(10 - i), "l", None, None, [], "undated" if i in (1, 4, 8) else None) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, score double, lab string, cluster_id long, published timestamp, rare array<string>, reason string")
    chosen, dropped = slate.topk_slate(df, slate.SlatePolicy(k=4, max_per_lab=0))
    assert [r["id"] for r in chosen] == [0, 2, 3, 5] and dropped == {"undated": 2}
    chosen, dropped = slate.topk_slate(df, slate.SlatePolicy(k=40, max_per_lab=0))
    assert len(chosen) == 7 and dropped == {"undated": 3}


def test_stage2_reads_texts_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "<p>Says  <b>ADA</b></p>"), (2, None)], "document_id long, raw string")
    replies = spark.createDataFrame([(1, '{"events": [{"quote": "says ada"}, {"quote": null}, {"quote": "b"}]}'), (2, '{"events": [{"quote": "x"}]}')], "document_id long, reply_json string")
    out = domain.stage2(docs, replies)
    assert [(r.document_id, r.ord, r.status) for r in out.orderBy("document_id", "ord").collect()] == [(1, 0, "ok"), (1, 1, "quote_not_found"), (1, 2, "quote_not_found"), (2, 0, "quote_not_found")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1  # as many Python workers a task


def test_jaccard_cells_pair_classes_not_rows(spark):
    from itertools import combinations

    rng = random.Random(8)
    rows = [(rng.choice(["x", "y", None]), rng.choice([*range(30), None]), rng.choice([None, [], ["a"], ["a", "b"], ["b", "a", "a"], ["c", "b"], ["a", "b", "c"], [""]])) for _ in range(160)]
    jaccard = lambda a, b: None if a is None or b is None else round(len({*a} & {*b}) / len({*a} | {*b}), 1) if a and b else 0.0
    want = Counter(jaccard(p[2], q[2]) for p, q in combinations(rows, 2) if p[0] is not None and p[0] == q[0] and None not in (p[1], q[1]) and p[1] != q[1])
    frame = spark.createDataFrame(rows, "k string, id long, t array<string>")
    assert {r.cell: r.n for r in clusters.jaccard_cells(frame, ["k"], "id", "t").collect()} == want
    many = spark.range(300_000).selectExpr("'x' AS k", "id", "array(concat('w', id % 4)) AS t")  # 45 billion pairs, ten of classes
    assert {r.cell: r.n for r in clusters.jaccard_cells(many, ["k"], "id", "t").collect()} == {1.0: 4 * (75_000 * 74_999 // 2), 0.0: 6 * 75_000**2}


def test_stage2_broadcasts_no_texts(spark):
    docs = spark.range(3000).select(F.col("id").alias("document_id"), F.repeat(F.lit("and more. "), 140).alias("raw"))  # Spark expects 20 bytes of each text
    replies = docs.select("document_id", F.when(F.col("document_id") % 2 == 0, '{"events": [{"quote": "And more."}]}').alias("reply_json"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")  # the texts have 4.2 MB
    try:
        got = domain.stage2(docs, replies).groupBy("status").count().collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert {r["status"]: r["count"] for r in got} == {"ok": 1500, "parse_failed": 1500}
