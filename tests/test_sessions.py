"""Verbatim search, seeding, repair, review and versions, edge cases included."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom import plans
from eventloom.functions import text as T
from eventloom.operators import register, repair, review, seeding, verbatim
from eventloom.operators.versions import Conflict, Versions
from eventloom.schemas import Model


@pytest.mark.parametrize("chars", [4_000_000, 12])
def test_verbatim_pairs(spark, chars, monkeypatch):
    monkeypatch.setattr(verbatim, "NEEDLE_CHARS", chars)
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "ab", "ＡＢ", "ﬁ", "fi", "ß", "SS", "’", "'", "b a", "x", "漢"])
    texts = ["".join(word() + rng.choice(["", " ", "\n "]) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "  "]
    needles = ["".join(word() + rng.choice(["", " "]) for _ in range(rng.randint(1, 3))) for _ in range(40)] + [None, "", "fi", "ＦＩ", "fi"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("needle", F.lit(1))
    quotes = spark.createDataFrame(list(enumerate(needles)), "item_id long, text string").withColumn("n", F.lit("x"))
    want = sorted((i, j) for i, t in enumerate(texts) for j, n in enumerate(needles) if t is not None and n is not None and T.norm_text(n) in T.norm_text(t))
    assert sorted(tuple(r) for r in verbatim.verbatim_pairs(docs, quotes).collect()) == want
    assert verbatim.verbatim_pairs(docs.limit(0), quotes).count() == verbatim.verbatim_pairs(docs, quotes.limit(0)).count() == 0


def test_verbatim_pairs_within_a_scope(spark):
    docs = spark.createDataFrame([(1, "ab c", "x"), (2, "ab c", "y"), (3, "ab", None)], "doc_id long, text string, s string")
    quotes = spark.createDataFrame([(1, "AB", "x"), (2, "ab", "y"), (2, "ab", "x"), (3, "ab", None), (4, "", "y"), (5, "c", "z")], "item_id long, text string, s string")
    assert sorted(tuple(r) for r in verbatim.verbatim_pairs(docs, quotes, "s").collect()) == [(1, 1), (1, 2), (2, 2), (2, 4), (3, 3)]


def test_names_on_pages_in_compatibility_forms(spark):
    names = spark.createDataFrame([("Ada Lovelace",), ("Fi Straße",), (" ",), (None,)], "name string")
    pages = spark.createDataFrame([(3, "ＡＤＡ  LOVELACE"), (2, "so says ada\nlovelace."), (5, "ﬁ STRASSE")], "page_id long, text string")
    assert {r.name: r.page_id for r in register.names_on_pages(names, pages).collect()} == {"Ada Lovelace": 2, "Fi Straße": 5}


def test_seeding(spark):
    seeds = [(1, "L", "Ada Lovelace", "founder", "lead"), (2, "L", "Bob Stone", "engineer", None), (3, "M", "Ada Lovelace", None, None), (4, "N", "No Page", "x", None), (5, "L", "Not There", None, None), (6, "N", "Own Page", "chief", "t"), (7, "L", "Known Person", None, None)]
    lab = [("L", 0, 10, "l0", "nothing"), ("L", 1, 11, "l1", "ＡＤＡ Lovelace, Founder; Known Person"), ("L", 2, 12, "l2", "ada lovelace; bob stone"), ("M", 0, 20, "m0", "Ada Lovelace"), ("L", 3, 13, "l3", None)]
    own = [("Own Page", 0, 30, "o0", "Own  page, CHIEF"), ("Not There", 0, 31, "o1", "else"), ("Ada Lovelace", 0, 32, "o2", "Ada Lovelace")]
    people = spark.createDataFrame([("Known Person",)], "canonical_name string")
    rows = seeding.seed_decisions(spark.createDataFrame(seeds, seeding.SEED), spark.createDataFrame(lab, seeding.PAGE), spark.createDataFrame(own, seeding.PAGE), people)
    got = {r.ord: (r.status, r.document_id, r.role) for r in rows.collect()}
    assert got == {
        1: ("added", 11, "founder"),
        2: ("added", 12, None),
        3: ("registered", 20, None),
        4: ("seed_page_unfetchable", None, None),
        5: ("seed_name_not_on_page", 10, None),
        6: ("added", 30, "chief"),
        7: ("registered", 11, None),
    }
    writes = seeding.seed_writes(rows, spark.createDataFrame([(1, "L"), (2, "N")], "id long, name string"), "2024-01-01")
    assert sorted(r.canonical_name for r in writes["people"].collect()) == ["Ada Lovelace", "Bob Stone", "Own Page"]
    assert sorted((r.handle, r.platform) for r in writes["identities"].collect())[0] == ("Ada Lovelace @ l1", "lab_page")
    assert sorted((r.lab_id, r.role) for r in writes["affiliations"].where("role is not null").collect()) == [(1, "founder"), (2, "chief")]
    assert {(r.document_id, r.reason, r.detail) for r in writes["rejections"].collect()} == {
        (None, "seed_page_unfetchable", "N: no fetchable page for 'No Page'"),
        (10, "seed_name_not_on_page", "'Not There' not verbatim on any of: l0, l1, l2, l3, o1"),
    }
    ids = {r.id: r.verbatim_content for r in writes["evidence"].collect()}
    assert sorted(ids[r.evidence_id] for r in writes["affiliations"].collect()) == ["Ada Lovelace", "Bob Stone", "Own Page"]


def test_repair_replies(spark):
    cases = {
        '{"claim": " a b\\n"}': ("rewritten", "a b"),
        'text ```{"claim": "c", "reason": 5}``` text': ("rewritten", "c"),
        '{"claim": null}': ("unrepairable", None),
        '{"claim": ""}': ("unparsed", None),
        '{"claim": 4}': ("unparsed", None),
        '{"claim": ["x"]}': ("unparsed", None),
        "{}": ("unparsed", None),
        "{broken": ("unparsed", None),
        "": ("unparsed", None),
        '{"claim": "x"} {"claim": "y"}': ("rewritten", "x"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "reply string").withColumn("r", repair.rewrite(F.col("reply")))
    assert {r.reply: tuple(r.r) for r in df.collect()} == cases
    checks = {
        '{"verdict": "entailed ", "reason": "r"}': ("entailed", "r"),
        '{"verdict": "maybe"}': ("partial", repair.UNCHECKED),
        'x "verdict" : "not_entailed", "reason": "cut of': ("not_entailed", "cut of"),
        '{"verdict": 3}': ("partial", repair.UNCHECKED),
        '{"verdict": "partial"}': ("partial", ""),
        "no": ("partial", repair.UNCHECKED),
        '{"verdict": "entailed", "reason": "%s"}' % ("z" * 400): ("entailed", "z" * 300),
    }
    df = spark.createDataFrame([(k,) for k in checks], "reply string").withColumn("r", repair.verdict(F.col("reply")))
    assert {r.reply: tuple(r.r) for r in df.collect()} == checks


def _claims(spark):
    return Model(
        spark,
        {
            "insights": spark.createDataFrame([(i, 100 + i, f"claim {i}") for i in range(4)], "id long, evidence_id long, claim string"),
            "evidence": spark.createDataFrame([(100 + i,) for i in range(3)], "id long"),
            "claim_checks": spark.createDataFrame([(i, i, m, "partial", None, None) for i in range(4) for m in ("judge", "other")], "id long, insight_id long, model string, verdict string, reason string, created_at string"),
            "rejections": spark.createDataFrame([], "id long, document_id long, stage string, reason string, detail string, created_at string"),
        },
    )


def test_repair_is_one_commit(spark, tmp_path, monkeypatch):
    m = _claims(spark)
    replies = spark.createDataFrame([(0, '{"claim": "new 0"}'), (1, '{"claim": null}'), (3, '{"claim": "its evidence is gone"}')], "insight_id long, reply string")
    checks = spark.createDataFrame([(0, '{"verdict": "entailed"}')], "insight_id long, reply string")
    rows = repair.decisions(m, replies, checks, "judge")
    assert {r.id: (r.status, r.verdict) for r in rows.collect()} == {0: ("rewritten", "entailed"), 1: ("unrepairable", None), 2: ("unparsed", None)}
    stored = Versions(spark, f"file://{tmp_path}/v")
    assert stored.state()["version"] == 0
    names = ("insights", "claim_checks", "rejections")
    stored.commit({n: getattr(m, n) for n in names}, "base")
    changes = repair.repaired(m, rows, "judge", "2024-01-01")

    # A run that dies after its first table, and one that dies while it writes the manifest, leave the old state.
    with pytest.raises(ZeroDivisionError):
        stored.commit({"insights": changes["insights"], "claim_checks": _dies()}, "repair")
    assert stored.state()["version"] == 1 and {r.claim for r in stored.read("insights").collect()} == {f"claim {i}" for i in range(4)}
    (tmp_path / "v/_manifests/000000000002.json").write_text('{"version": 2, "tok')
    assert stored.state()["version"] == 1

    base = stored.state()
    assert stored.commit(changes, "repair", base) == 2
    for _ in range(2):  # a replay adds nothing, whatever state it starts from
        assert stored.commit(changes, "repair") == 2
    with pytest.raises(Conflict):
        stored.commit({"insights": m.insights}, "late", base)
    assert stored.state()["version"] == 2 and set(stored.state()["tables"]) == set(names)
    assert {r.id: r.claim for r in stored.read("insights").collect()} == {0: "new 0", 1: "claim 1", 2: "claim 2", 3: "claim 3"}
    assert [(r.detail, r.reason) for r in stored.read("rejections").collect()] == [("event 0: claim 0", "claim_rewritten")]
    got = {(r.insight_id, r.model): r.verdict for r in stored.read("claim_checks").collect()}
    assert len(got) == 8 and got[0, "judge"] == "entailed" and got[0, "other"] == "partial"
    assert stored.commit({"rejections": m.rejections}, "clear") == 3 and stored.read("rejections").count() == 0 and stored.read("insights").count() == 4


class _dies:
    @property
    def write(self):
        raise ZeroDivisionError


def plain_review(candidates, decisions, labs):
    """Outcomes, statuses and lists by going through the decisions one after another."""
    was = {c: [name, status] for c, name, status in candidates}
    lists, out = {"approve": [], "reject": []}, {}
    for seq, c, decision in sorted(decisions):
        if c not in was:
            out[seq] = "not_found"
            continue
        name, status = was[c]
        fine = name == name.strip() and len(name.split()) >= 2 and all(any(x.isalpha() for x in w) for w in name.split()) and name.lower() not in labs
        if decision == "approved" and not fine:
            out[seq] = "refused"
            continue
        section = "approve" if decision == "approved" else "reject"
        if name not in lists[section]:
            lists[section].append(name)
        if decision == "rejected":
            out[seq], was[c][1] = "rejected", "rejected"
        elif status == "pending":
            out[seq], was[c][1] = "promoted", "approved"
        else:
            out[seq] = "already_approved"
    return out, {c: s for c, (_, s) in was.items()}, lists


def test_review_is_a_fold_of_decisions(spark):
    rng = random.Random(8)
    names = ["Ann Bee", "Solo", " Ann Bee", "Big Lab", "A 1", "Zoë Ünï", "Ann Bee", "José  Luis"]
    candidates = [(i, rng.choice(names) if i % 3 else f"Per son{chr(97 + i % 26)}", rng.choice(["pending", "pending", "approved", "rejected"])) for i in range(60)]
    decisions = [(s, rng.randint(0, 65), rng.choice(["approved", "approved", "rejected"])) for s in range(150)]
    cand = spark.createDataFrame([(i, n, s, [1, 2] if i % 2 else [1], 900 + i) for i, n, s in candidates], "id long, name string, status string, seed_person_ids array<long>, evidence_id long").withColumn("reviewed_at", F.lit(None).cast("string"))
    labs = spark.createDataFrame([("Big Lab",), ("Other",)], "name string")
    rows = review.decided(cand, spark.createDataFrame(decisions, "seq long, id long, decision string"), labs)
    outcome, status, lists = plain_review(candidates, decisions, {"big lab", "other"})
    assert {r.seq: r.outcome for r in rows.collect()} == outcome
    assert {r.id: r.status for r in review.statuses(cand, rows, "now").collect()} == status
    stored = spark.createDataFrame([("approve", "Zoë Ünï", 1)], "section string, name string, ord long")
    got = review.overrides(stored, rows).orderBy("section", "ord").collect()
    for section in lists:
        want = (["Zoë Ünï"] if section == "approve" else []) + [n for n in lists[section] if (section, n) != ("approve", "Zoë Ünï")]
        assert [r.name for r in got if r.section == section] == want
    assert review.decided(cand.limit(0), spark.createDataFrame(decisions, "seq long, id long, decision string"), labs).where("outcome <> 'not_found'").count() == 0


def test_promotion_on_the_best_basis(spark):
    schema = "id long, name string, status string, seed_person_ids array<long>, evidence_id long"
    cand = spark.createDataFrame([(1, "On Pages", "pending", [7], 91), (2, "One Lab", "pending", [7, 8], 92), (3, "Two Labs", "pending", [7, 9], 93), (4, "No Seeds", "pending", None, 94), (5, "On Pages", "pending", [7], 95)], schema).withColumn("reviewed_at", F.lit(None).cast("string"))
    links = spark.createDataFrame([(1, 7, 50, None, "page_verbatim", None, None), (2, 8, 50, None, "page_verbatim", None, None), (3, 8, 51, None, "coauthor_inference", None, None), (4, 9, 51, None, "page_verbatim", None, None)], "id long, person_id long, lab_id long, role string, basis string, observed_at string, evidence_id long")
    m = Model(spark, {"person_candidates": cand, "affiliations": links})
    rows = review.decided(cand, spark.createDataFrame([(i, i, "approved") for i in range(1, 6)], "seq long, id long, decision string"), spark.createDataFrame([], "name string"))
    pages = spark.createDataFrame([(30, 50, "ON  PAGES"), (29, 50, "on pages too"), (31, 51, "on pages"), (28, None, "on pages")], "document_id long, lab_id long, text string")
    out = review.reviewed(m, rows, pages, "2024-01-01")
    people = {r.id: r.canonical_name for r in out["people"].collect()}
    got = sorted((people[r.person_id], r.lab_id or 0, r.basis or "", r.evidence_id in (91, 92, 93, 94)) for r in out["affiliations"].collect() if r.person_id in people)
    assert got == [("No Seeds", 0, "", True), ("On Pages", 50, "page_verbatim", False), ("On Pages", 50, "page_verbatim", False), ("On Pages", 51, "page_verbatim", False), ("On Pages", 51, "page_verbatim", False), ("One Lab", 50, "coauthor_inference", True), ("Two Labs", 0, "", True)]
    assert sorted(r.document_id for r in out["evidence"].collect()) == [29, 31]
    assert sorted(r.handle for r in out["identities"].collect()) == ["No Seeds", "On Pages", "One Lab", "Two Labs"]
    assert {r.status for r in out["person_candidates"].collect()} == {"approved"}


def test_longest_common_block(spark):
    import difflib

    from eventloom.operators import quotes

    rng = random.Random(12)
    for _ in range(300):
        quote, text = ("".join(rng.choice("ab é") for _ in range(rng.randint(0, n))) for n in (14, 40))
        assert quotes.longest_common(quote, text) == difflib.SequenceMatcher(None, quote, text, autojunk=False).find_longest_match(0, len(quote), 0, len(text)).size
    assert quotes.longest_common("x" * 3000 + "y", "x" * 200_000) == 3000
    rows = [(1, "The model runs twice", "<p>The MODEL runs</p> twicf"), (2, "model twice runs the", "the model runs twice"), (3, "entirely made", "the model"), (4, " ", "x"), (5, None, "x"), (6, "x", None), (7, "a b", "a c")]
    got = {r.id: r.reason_class for r in quotes.quote_classes(spark.createDataFrame(rows, "id long, quote string, raw string")).collect()}
    assert got == {1: "near_miss", 2: "paraphrase", 3: "fabrication", 7: "fabrication"}


def test_ranks_of_unseen_scores(spark):
    from eventloom.operators.probe import ScoreIndex

    rng = random.Random(2)
    scores = [rng.choice([None, 1.0, 2.5, rng.random() * 10]) for _ in range(500)]
    probes = [(i, x) for i, x in enumerate([-1.0, 0.5, 1.0, 2.5, 2.6, 9.9, 100.0, None])]
    known = sorted(x for x in scores if x is not None)
    frame = spark.createDataFrame([(x,) for x in scores], "score double")
    asked = spark.createDataFrame(probes, "probe long, score double")
    got = {r.probe: (r.rank, r.of) for r in ScoreIndex(frame).ranks(asked).collect()}
    assert got == {i: (1 + sum(x > at for x in known), len(known)) for i, at in probes if at is not None}
    assert {(r.rank, r.of) for r in ScoreIndex(frame.limit(0)).ranks(asked).collect()} == {(1, 0)}


def test_sampled_pairs(spark):
    from eventloom.operators import ranking

    rows = [(i, "big" if i < 900 else f"lab{i % 4}", ["x", "y", "z"][i % 3]) for i in range(1000)]
    events = spark.createDataFrame(rows, "id long, lab string, kind string")
    lab, kind = {i: a for i, a, _ in rows}, {i: k for i, _, k in rows}
    got = [tuple(r) for r in ranking.sample_pairs(events, 200, 7).collect()]
    assert got and sorted(got) == sorted(tuple(r) for r in ranking.sample_pairs(events.repartition(9), 200, 7).collect())
    assert len({g[:2] for g in got}) == len(got) == 200 and all(a < b for a, b, _ in got)
    by = {s: [(a, b) for a, b, x in got if x == s] for s in ("lab", "kind", "any")}
    assert [len(by[s]) for s in by] == [100, 60, 40]
    assert all(lab[a] != lab[b] for a, b in by["lab"]) and all(kind[a] != kind[b] for a, b in by["kind"])
    small = sum(lab[x] != "big" for pair in by["lab"] for x in pair)
    assert small > 130  # labs are drawn evenly, so four in five are small ones
    assert ranking.sample_pairs(events.limit(1), 10, 7).count() == 0
    assert {tuple(r) for r in ranking.sample_pairs(events.where("id < 3"), 100, 7).select("event_a", "event_b").collect()} == {(0, 1), (0, 2), (1, 2)}


def test_a_post_of_very_many_lines(spark):
    from eventloom.operators import documents

    body = "@h\nurl\n" + "\n" * 1_200_000 + "It runs."
    assert [r[0] for r in spark.createDataFrame([(body,), ("@h\nurl",), ("@h",), ("",)], "b string").select(documents.fragment_reason(F.col("b"))).collect()] == ["social_thread_continuation", "social_empty", "social_empty", "social_empty"]


def test_seeding_pairs_no_seeds_with_pages(spark):
    """Each of 3,000 seeds of one name stands on each of 3,000 pages of its lab; the least page is found for the name, once."""
    n = 3000
    seeds = spark.range(n).selectExpr("id AS ord", "'L' AS lab", "'Ada Lovelace' AS name", "'of' AS role", "CAST(NULL AS STRING) AS tier")
    lab = spark.range(n).selectExpr("'L' AS owner", "9000 - id AS ord", "id AS document_id", "concat('u', id) AS url", "'ada lovelace of here' AS text")
    hits = verbatim._hits(lab.selectExpr("document_id AS doc_id", "text", "owner AS scope", "ord").coalesce(1).orderBy("ord"), spark.createDataFrame([(7, "ada", "L"), (8, "ada", "M")], "needle long, n string, scope string"))
    assert [tuple(r) for r in hits.coalesce(1).collect()][:1] == [(n - 1, 9000 - n + 1, 7)] and hits.count() < n
    rows = seeding.seed_decisions(seeds, lab, lab.where("false"), spark.createDataFrame([], "canonical_name string"))
    got = rows.groupBy("status", "document_id", "role").count().collect()
    assert sorted((r.status, r.document_id, r.role, r["count"]) for r in got) == [("added", n - 1, "of", 1), ("registered", n - 1, None, n - 1)]


def test_shards_are_read_for_their_scope(spark, monkeypatch):
    monkeypatch.setattr(verbatim, "NEEDLE_CHARS", 12)
    docs = spark.createDataFrame([(s, i, i, f"w{i % 5} x{s}") for s in "abcd" for i in range(9)] + [(None, 1, 1, "w1"), ("a", 0, 50, None), ("b", 0, 51, "?")], "scope string, ord long, doc_id long, text string")
    names = spark.createDataFrame([(s, f"W{i}") for s in "abcde" for i in range(7)] + [("a", " "), ("c", " "), (None, "w1"), ("a", None)], "scope string, text string")
    got = {(r.scope, r.text): r.doc_id for r in verbatim.first_in_scope(docs, names).collect()}
    assert got == {(s, f"W{i}"): i for s in "abcd" for i in range(5)} | {("a", " "): 0, ("c", " "): 0}
    needles = spark.createDataFrame([(i, f"n{i}", s) for i, s in enumerate("abcdefgh")], "needle long, n string, scope string")
    shards = list(verbatim._shards(needles))
    assert len(shards) > 1 and sum(docs.where(here).count() for here, _ in shards) < len(shards) * docs.count()  # no text is read for every shard


def test_rejected_quotes_of_odd_texts(spark, tmp_path):
    odd = ["Chß " * 100, "abc " * 100, "x" * 400, "ab Chß longer " + "- " * 200, "<b>bold</b> &amp;lt; text &nbsp; here " * 20, "a <script>all of this is hidden</script> " * 20, "word" + " " * 400 + "other words " * 30, "éàïü× ÷ÿ " * 60, "ß" * 300, "1234 " * 100]
    texts = [(3 * i + k, t) for i, t in enumerate(odd) for k in range(3)] + [(900, "short"), (901, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in plans.QUERIES["rejected_quotes"](spark, str(tmp_path)).collect()}
    assert got == set(c.sql(plans.SQL["rejected_quotes"]).fetchall())
    assert {(1, "fabrication"), (7, "paraphrase"), (10, "paraphrase"), (12, "near_miss")} <= got


def test_ranks_merge_values_and_probes(spark, tmp_path):
    """300,000 probes in the one range of 300,000 scores: pairs of both would be 90 billion."""
    from eventloom.operators.probe import ScoreIndex

    n = 300_000
    stored = spark.range(n).selectExpr("CAST(id AS DOUBLE) AS score")
    got = ScoreIndex(stored).ranks(spark.range(n).selectExpr("id AS probe", "id + 0.5 AS score"))
    assert got.where(F.col("rank") != n - F.col("probe")).count() == 0 and got.count() == n
    twice = ScoreIndex(stored.limit(3)).ranks(spark.createDataFrame([(1, 1.0), (1, 1.0), (2, float("nan"))], "probe long, score double"))
    assert sorted((r.probe, r.rank) for r in twice.collect()) == [(1, 2), (1, 2), (2, 1)]
    spark.createDataFrame([(1, 60.0), (2, None), (2, None)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1.0,), (2.0,), (None,)], "value double").write.parquet(str(tmp_path / "events.parquet"))
    rows = plans.QUERIES["rank_probe"](spark, str(tmp_path)).collect()
    assert sorted((r.probe, r["rank"], r["of"]) for r in rows) == [(1, 2, 2), (2, 1, 2), (2, 1, 2)]
