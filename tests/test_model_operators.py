"""Register, delivery and configuration against small hand-made tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from eventloom.operators import delivery, register
from eventloom.schemas import TABLES, Model
from eventloom.sources import config

NOW = datetime(2026, 7, 28)


def model(spark, **rows):
    made = {}
    for name, values in rows.items():
        fields = dict(c.split(" ", 1) for c in TABLES[name].split(", "))
        made[name] = spark.createDataFrame([tuple(v.get(c) for c in fields) for v in values], TABLES[name])
    return Model(spark, made)


def test_author_links_abstain_and_are_idempotent(spark):
    m = model(
        spark,
        raw_documents=[{"id": 1, "raw_content": "t\nauthors: Émile Zola; Ada Byron; Max Two\nx"}],
        people=[{"id": 1, "canonical_name": "Zola Emile"}, {"id": 2, "canonical_name": "Max Two"}, {"id": 3, "canonical_name": "Two Max"}],
        evidence=[{"id": 5, "document_id": 1}],
        insights=[{"id": 9, "evidence_id": 5}],
    )
    links = register.author_links(m)
    assert [tuple(r) for r in links.collect()] == [(9, 1, 5, "author")]
    m._tables["event_entities"] = links.select(F.lit(1).cast("long").alias("id"), "event_id", F.lit("person").alias("entity_kind"), "person_id")
    assert register.author_links(m).count() == 0


def test_candidates(spark):
    rows = [{"id": i, "name": f"n{i}", "paper_count": p, "seed_lab_ids": labs, "status": s} for i, (p, labs, s) in enumerate([(5, [1], "pending"), (4, [1, 2], "pending"), (3, [2], "pending"), (9, [1], "rejected"), (1, None, "pending")])]
    c = model(spark, person_candidates=rows).person_candidates
    assert {r.id for r in register.slate_per_lab(c, 1).collect()} == {0, 1}
    assert {r.id for r in register.slate_per_lab(c, 1, veto=[0], force=[4]).collect()} == {1, 4}
    pages = spark.createDataFrame([(1, 7, 2), (1, 8, 1)], "id long, lab_id long, page_id long")
    got = {r.id: (r.lab_id, r.basis) for r in register.affiliation_for(c, pages).collect()}
    assert got == {0: (1, "inferred"), 1: (8, "verbatim"), 2: (2, "inferred"), 3: (1, "inferred")}


def test_names_on_pages(spark):
    names = spark.createDataFrame([("Ada Lovelace",), ("O'Brien, Pat",), ("No One",)], "name string")
    pages = spark.createDataFrame([(2, "ADA  LOVELACE is here; o'brien, pat"), (1, "ada is lovelace"), (3, "Ada Lovelace")], "page_id long, text string")
    assert {r.name: r.page_id for r in register.names_on_pages(names, pages).collect()} == {"Ada Lovelace": 2, "O'Brien, Pat": 2}


def test_observations_are_daily_and_idempotent(spark):
    new = spark.createDataFrame([(1, 1, "2026-01-01T05"), (1, 1, "2026-01-01T03"), (1, 1, "2026-01-02"), (1, 2, "2026-01-01")], "person_id long, lab_id long, observed_at string")
    have = new.where("lab_id = 2")
    first = register.observed(new, have)
    assert sorted(tuple(r) for r in first.collect()) == [(1, 1, "2026-01-01T03"), (1, 1, "2026-01-02")]
    assert register.observed(new, have.unionByName(first)).count() == 0


def test_coauthors_and_move_events(spark):
    papers = spark.createDataFrame([("e1", datetime(2026, 1, 1), ["Ada L", "New Person", "new person"]), ("e2", datetime(2020, 1, 1), ["Ada L", "Old"]), ("e3", datetime(2026, 1, 1), ["X", "Y"])], "entry_id string, published timestamp, authors array<string>")
    tracked = spark.createDataFrame([("ada l", 4)], "k string, person_id long")
    got = [tuple(r) for r in register.coauthors(papers, tracked, F.lit(NOW)).collect()]
    assert got == [("New Person", 1, ["e1"], [4])]
    moves = spark.createDataFrame([(1, "A", "B", datetime(2026, 1, 1), datetime(2026, 2, 1))], "person long, src string, dst string, left timestamp, joined timestamp")
    rows = register.move_events(moves).collect()
    assert {(r.lab, r.role) for r in rows} == {("A", "mover_from"), ("B", "mover_to")} and len({r.event_id for r in rows}) == 1


def test_alert_candidates(spark):
    docs = [{"id": 1, "published_at": "2026-07-20"}, {"id": 2, "published_at": "2026-01-01"}]
    m = model(
        spark,
        raw_documents=docs,
        evidence=[{"id": 1, "document_id": 1}, {"id": 2, "document_id": 2}],
        insights=[{"id": 1, "evidence_id": 1}, {"id": 2, "evidence_id": 2}],
        event_positions=[{"id": 1, "event_id": 1, "ticker": "B", "direction": "threat", "channel": "c"}, {"id": 2, "event_id": 1, "ticker": "A", "direction": "tailwind", "channel": "c"}, {"id": 3, "event_id": 2, "ticker": "A", "direction": "threat", "channel": "c"}, {"id": 4, "event_id": 1, "ticker": "C", "direction": "unclear", "channel": "c"}],
        hypotheses=[{"id": 1, "insight_id": 1, "persona": "p", "direction": "threat", "confidence": "high"}, {"id": 2, "insight_id": 1, "persona": "q", "direction": "monitor", "confidence": "high"}, {"id": 3, "insight_id": 1, "persona": "q", "direction": "threat", "confidence": "low"}],
    )
    got = sorted((r.event_id, r.persona, r.rule, r.reason) for r in delivery.alert_candidates(m, F.lit(NOW)).collect())
    assert got == [(1, "investment", "signed_edge", "A tailwind; B threat"), (1, "p", "signed_reading", "threat high")]


def test_queues_and_reports(spark):
    labels = [{"id": 1, "event_a": 1, "event_b": 2, "winner": "a", "labeler": "llm:m1/investment/r1"}, {"id": 2, "event_a": 1, "event_b": 2, "winner": "b", "labeler": "llm:m2/investment/r1"}, {"id": 3, "event_a": 3, "event_b": 4, "winner": "a", "labeler": "human:z/investment/r1"}, {"id": 4, "event_a": 1, "event_b": 2, "winner": "tie", "labeler": "lf:x"}]
    m = model(spark, pairwise_labels=labels, slate_reviews=[{"id": 1, "event_id": 1, "persona": "p", "reviewer": "r", "verdict": "cut", "reviewed_at": "1"}, {"id": 2, "event_id": 1, "persona": "p", "reviewer": "r", "verdict": "keep", "reviewed_at": "2"}], insights=[{"id": 1}, {"id": 2}], claim_checks=[{"id": 1, "insight_id": 1, "model": "m"}], hypotheses=[{"id": 1, "insight_id": 1, "persona": "p"}], hypothesis_checks=[{"id": 1, "hypothesis_id": 1, "score": 0.5}], evidence=[{"id": 1, "verbatim_content": "said so"}])
    assert [tuple(r) for r in delivery.disagreements(m.pairwise_labels).collect()] == [(1, 2, "llm:m1/investment/r1", "llm:m2/investment/r1")]
    assert {(r.item, r.labeler) for r in delivery.family_overlap_votes(m.pairwise_labels).collect()} == {("1-2", "m1"), ("1-2", "m2")}
    assert [tuple(r) for r in delivery.slate_precision(m).collect()] == [("p", 1, 1, 1.0)]
    assert [r.id for r in delivery.unchecked(m, "m").collect()] == [2]
    assert [tuple(r) for r in delivery.faithfulness(m).collect()] == [("p", 1, 0.5, 1)]
    queue = delivery.persona_queue(m, "p", spark.createDataFrame([(1,), (2,)], "event_id long"), spark.createDataFrame([(2,), (3,)], "event_id long"))
    assert sorted(tuple(r) for r in queue.collect()) == [(2, 0), (3, 1)]
    digests = spark.createDataFrame([("d", 'x\n> "said so"\n> made up\n')], "name string, markdown string")
    assert [tuple(r) for r in delivery.digest_parity(digests, m).collect()] == [("d", "made up")]


def test_rank_comparisons(spark):
    a = spark.createDataFrame([(i, i) for i in range(1, 11)], "event long, rank int")
    b = spark.createDataFrame([(i, 11 - i) for i in range(1, 11)], "event long, rank int")
    assert delivery.kendall_tau(a, a).first().tau == 1.0 and delivery.kendall_tau(a, b).first().tau == -1.0
    assert {r.k: r.overlap for r in delivery.overlap_at(a, b, (5, 10)).collect()} == {5: 0, 10: 10}


POLICY = {"version": 3, "owner": None, "channels": {"c": ["gpu"]}, "event_type_prior": {"release": 3}, "slate_k": 15, "hand_weights": {"recency": 1}}


def test_policy(spark):
    p = config.parse_policy({**POLICY, "positions": {"as_of": "2026-01-02", "holdings": [{"ticker": "t", "name": "n", "thesis": "x", "exposure_terms": ["GPU"], "weight_pct": 3}]}})
    assert p.positions_as_of == date(2026, 1, 2) and p.positions[0].weight_pct == 3.0 and not p.is_owned
    assert (p.max_per_lab, p.story_rare_df) == (0, 0.0)
    owned = [config.parse_policy({**POLICY, "owner": o}).is_owned for o in ("Ada", "UNASSIGNED (placeholder)", "")]
    assert owned == [True, False, False]
    assert p.terms(spark).count() == 1 and p.exposure_terms(spark).first() == ("T", "gpu")


@pytest.mark.parametrize("change", [{"odd": 1}, {"channels": {}}, {"channels": {"c": []}}, {"story_rare_df": 2}, {"slate_k": -1}, {"event_type_prior": {"nope": 1}}, {"positions": {"as_of": "2026-01-02", "holdings": [{"ticker": "T", "name": "n", "thesis": "x", "exposure_terms": []}]}}, {"positions": {"holdings": [{"ticker": "T", "name": "n", "thesis": "x", "exposure_terms": ["a"]}]}}, {"positions": [1]}])
def test_bad_policies_raise(change):
    with pytest.raises(config.ConfigError):
        config.parse_policy({**POLICY, **change})


def test_missing_keys_and_rubrics():
    with pytest.raises(config.ConfigError):
        config.parse_policy({k: v for k, v in POLICY.items() if k != "owner"})
    r = config.parse_rubric({"name": "investment", "version": 2, "audience": "a", "question": "q", "rules": ["r"]})
    assert r.labeler("llm", "m") == "llm:m/investment/r2"
    with pytest.raises(config.ConfigError):
        config.parse_rubric({"name": "x"})
    with pytest.raises(config.ConfigError):
        config.load_yaml("- a list")


# ---- intake and digests


def intake(spark, docs, **more):
    sources = [{"id": 1, "purpose": "content", "url": "https://g/x/releases.atom"}, {"id": 2, "purpose": "content", "lab_id": 1, "url": "b"}, {"id": 3, "purpose": "register"}]
    return model(spark, sources=sources, raw_documents=docs, **more)


def test_stage1(spark):
    from eventloom.operators import documents as D

    long = "x" * 450
    rows = [
        ("blog", 2, "short"), ("blog", 2, long), ("blog", 1, long), ("blog", 1, long + " ACME "), ("github", 1, "acme " + "x" * 60), ("social", 2, "@h\nurl\nAnd so it goes on and on and on and on and on and on and on"),
        ("social", 2, "@h\nurl\nThis is a new model that we release today to everybody out there"), ("social", 2, "@h\nurl\n@you yes yes yes yes yes yes yes yes yes yes yes yes yes yes"), ("arxiv", 2, "t\nauthors: Nobody Here\n" + long), ("arxiv", 2, "t\nauthors: Lovelace Ada\n" + long),
        ("arxiv", 2, "t\nauthors: The Team\n" + long), ("arxiv", 2, long), ("blog", 2, long + " Webinar: please register"), ("blog", 2, long + " we're hiring"), ("blog", 3, "short"),
    ]
    m = intake(spark, [{"id": i, "source_type": t, "source_id": s, "raw_content": c} for i, (t, s, c) in enumerate(rows)], people=[{"id": 1, "canonical_name": "Ada Lovelace"}], rejections=[{"id": 1, "document_id": 0, "stage": "stage1"}])
    got = {r.document_id: r.reason for r in D.stage1(m, ["Acme"], ["The Team"]).collect()}
    assert got == {1: None, 2: "no_tracked_entity", 3: None, 4: None, 5: "social_thread_continuation", 6: None, 7: "social_reply_fragment", 8: "not_lab_authored", 9: None, 10: None, 11: None, 12: "kill_list:event_promo", 13: "kill_list:job_post"}


def test_near_duplicate_titles(spark):
    from eventloom.operators import documents as D

    docs = [{"id": i, "source_type": "blog", "source_id": 2, "url": u, "raw_content": c, "content_hash": c, "published_at": p} for i, (u, c, p) in enumerate([("a", "Same  Title\n1", "2026-01-02"), ("b", "same title\n2", "2026-01-01"), ("c", "same title\n3", None), ("d", "other", None), ("d", "<html>same title", None), ("e", None, None)])]
    m = intake(spark, docs)
    found = D.near_duplicates(m)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1), (2, 1)]
    assert D.near_dup_titles(m).first().extra == 2 and D.url_versions(m).first().urls == 1
    m._tables["rejections"] = found.select(F.lit(1).cast("long").alias("id"), "document_id", F.lit("stage1").alias("stage"))
    assert D.near_duplicates(m).count() == 0


def test_store_is_idempotent_and_pages_compare_by_text(spark):
    from eventloom.operators import documents as D

    m = intake(spark, [{"id": 7, "url": "p", "raw_content": "<p>a b</p>", "content_hash": "x"}])
    fetched = spark.createDataFrame([("blog", 2, f"u{i}", c, None, "2026-01-01") for i, c in enumerate(["one", "two", "one", None])], "source_type string, source_id long, url string, raw_content string, published_at string, retrieved_at string")
    new = D.store(m.raw_documents, fetched)
    assert sorted((r.id, r.url) for r in new.collect()) == [(8, "u0"), (9, "u1")]
    assert D.store(m.raw_documents.unionByName(new), fetched).count() == 0
    pages = spark.createDataFrame([("p", "<div>a  b</div>"), ("q", "<p>a b</p>")], "url string, raw_content string")
    assert [r.url for r in D.changed_pages(m, pages).collect()] == ["q"]
    assert sorted(r.id for r in D.eligible(intake(spark, [{"id": 1, "source_id": 2, "url": "a"}, {"id": 2, "source_id": 3, "url": "b"}])).collect()) == [1]


def test_digest_text():
    from eventloom.operators import digest

    items = [{"id": 1, "claim": "c", "quote": "q", "lab": "L", "published_at": None, "url": "u"}]
    text = digest.to_markdown([("h1", "T"), *digest.item_blocks(items, {1: "note"}), ("rule", None)])
    assert text == "# T\n\n### 1. c\n\n*L, undated*\n\n> q\n\nnote\n\n[source](u)\n\n---\n"
    assert digest.newest(["2026-07-28-30d-a.md", "2026-07-28-100d-a.md", "2026-07-01-300d-a.md", "2026-08-01-7d-b.md"], "-a") == "2026-07-28-100d-a.md"
    assert digest.newest([]) is None


def test_mechanism_first(spark):
    from eventloom.operators import digest

    rows = spark.createDataFrame([(1, 1, False, None), (2, 2, True, False), (3, 3, None, True)], "id int, pos int, s boolean, m boolean")
    assert [r.id for r in digest.mechanism_first(rows, F.col("s"), F.col("m"), "pos").collect()] == [2, 3, 1]


# ---- posts and the writes that remove


def test_posts(spark, tmp_path):
    from eventloom.sources import social

    (tmp_path / "p.json").write_text('{"source": "x", "n": 2, "posts": [{"id": "1", "handle": "a", "url": "https://h/a/status/1", "created_at": "2026", "text": "t"},\n {"id": "2", "handle": "a", "url": "u", "created_at": "2027", "text": "t"}, {"id": "3", "handle": "b", "url": "u", "created_at": "2020", "text": "t"}]}')
    posts = social.read_posts(spark, str(tmp_path))
    assert [r.id for r in social.within_limits(posts, 1, 9).collect()] == ["2", "3"]
    assert [r.id for r in social.within_limits(posts, 5, 2).collect()] == ["2", "3"]
    assert sorted(tuple(r[0]) for r in posts.select(social.post_key(F.col("url"))).collect() if r[0].id) == [("a", "1")]
    with pytest.raises(ValueError, match="budget"):
        social.worst_case_usd(100, 20, 1000, 0.01, 8.0)
    assert social.worst_case_usd(1, 20, 1000, 0.01, 8.0) == pytest.approx(0.2)


def test_retract_and_prune(spark):
    from eventloom.operators import sinks

    m = model(
        spark,
        people=[{"id": 1}, {"id": 2}, {"id": 3}],
        identities=[{"id": 1, "person_id": 1, "evidence_id": 1}, {"id": 2, "person_id": 2, "evidence_id": 2}, {"id": 3, "person_id": 2, "evidence_id": 3}],
        affiliations=[{"id": 1, "person_id": 1, "evidence_id": 4}],
        evidence=[{"id": i} for i in (1, 2, 3, 4)],
        insights=[{"id": 1, "evidence_id": 2}],
    )
    names = ("people", "identities", "affiliations", "event_entities", "evidence", "insights")
    tables = {n: getattr(m, n) for n in names}
    ids = lambda d, n: sorted(r.id for r in d[n].collect())
    out = sinks.retract(tables, spark.createDataFrame([(1,), (3,)], "id long"))
    assert (ids(out, "people"), ids(out, "identities"), ids(out, "affiliations"), ids(out, "evidence")) == ([2, 3], [2], [], [2, 4])
    out = sinks.prune_people(tables, spark.createDataFrame([(2,)], "id long"))
    assert (ids(out, "people"), ids(out, "identities"), ids(out, "evidence")) == ([1, 3], [1], [1, 2, 4])
    rows = spark.createDataFrame([(1, 5, None, "model_asserted", 9), (2, 5, 6, None, 9), (3, None, None, None, 9)], "id long, attributed_person_id long, attributed_lab_id long, basis string, evidence_id long")
    assert sorted((r.event_id, r.entity_kind) for r in sinks.event_entities(rows).collect()) == [(1, "person"), (2, "lab"), (2, "person")]
    got = []
    sinks.notifier(got.append)(rows.limit(1), 0)
    assert got[0]["id"] == 1
