"""Every registered plan against its SQL, the suites' planted violations, streams, and the layers."""

import ast
from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom import plans
from eventloom.operators import integrity
from eventloom.schemas import TABLES, Model
from eventloom.streaming import ingest

ROOT = Path(__file__).resolve().parents[1]
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return None if x is None else str(x)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in NAMES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_plan_equals_sql(spark, sf, con, name):
    df = plans.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(plans.SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    got = sorted(str([plain(v) for v in r]) for r in df.select(*cols).collect())
    assert got == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_plan_without_sql_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() >= 0


def test_whole_pages_and_posts(spark, tmp_path):
    own = '<p>x</p><script>{"datePublished": "2020-01-02T03:00"}</script>'
    spark.createDataFrame([(3, own), (7, "<p>" + "y" * 50_000 + "</p>" + own), (11, "<p>x</p>"), (15, None), (4, None)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.published for r in plans.QUERIES["page_published"](spark, str(tmp_path)).collect()}
    assert got == {3: "2020-01-02", 7: "2020-01-02", 11: None, 15: None, 4: "2024-03-05"}
    posts = [(1, "head" + "\n" * 10_002 + "body"), (2, "head\n@x"), (3, "head"), (4, "")]
    spark.createDataFrame([(i, 1, t) for i, t in posts], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.reason for r in plans.QUERIES["filter_social_fragment"](spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: "reply", 3: "empty", 4: "empty"}


def model(spark, **rows):
    made = {}
    for name, values in rows.items():
        fields = dict(c.split(" ", 1) for c in TABLES[name].split(", "))
        made[name] = spark.createDataFrame([tuple(v.get(c) for c in fields) for v in values], TABLES[name])
    return Model(spark, made)


def test_integrity_green_and_planted(spark):
    raw = "<html><h1>T</h1> March 5, 2024 Ada Lovelace joins Lab.</html>"
    import hashlib

    doc = {"id": 1, "source_id": 1, "url": "u", "raw_content": raw, "content_hash": hashlib.sha256(raw.encode()).hexdigest(), "published_at": "2024-03-06"}
    base = {
        "sources": [{"id": 1, "name": "s", "channel": "official", "purpose": "content"}],
        "fetch_log": [{"id": 1, "source_id": 1, "status": "ok"}],
        "raw_documents": [doc],
        "evidence": [{"id": 1, "document_id": 1, "verbatim_content": "ada lovelace JOINS", "verification": "exact"}],
        "people": [{"id": 1, "canonical_name": "Ada Lovelace"}],
        "identities": [{"id": 1, "person_id": 1, "confidence_tier": "verbatim", "resolution_method": "exact", "evidence_id": 1}],
        "insights": [{"id": 1, "evidence_id": 1, "event_type": "release", "cluster_id": 1}],
        "event_entities": [{"id": 1, "event_id": 1, "basis": "source_inferred", "evidence_id": 1}],
        "event_scores": [{"id": 1, "event_id": 1, "model": "m", "policy_version": 3}],
        "insight_features": [{"event_id": 1, "feature": "f"}],
    }
    run = lambda **changed: {r.check for r in integrity.suite(model(spark, **{**base, **changed}), 3, ["release"], F.lit(datetime(2024, 4, 1))).collect()}
    assert run() == set()
    assert run(raw_documents=[{**doc, "content_hash": "x", "published_at": "2024-01-01"}]) == {"C1", "C18"}
    assert run(evidence=[{**base["evidence"][0], "verbatim_content": "absent", "verification": "fuzzy"}]) == {"C2", "C11", "C19"}
    assert run(identities=[]) == {"C3"}
    assert run(identities=[{**base["identities"][0], "confidence_tier": "corroborated", "evidence_id": None}]) == {"C4"}
    assert run(fetch_log=[]) == {"C7"}
    assert run(people=[{"id": 1, "canonical_name": "Ada"}]) == {"C9"}
    assert run(sources=[{**base["sources"][0], "channel": "third_party"}]) == {"C12"}
    assert run(insights=[base["insights"][0], {**base["insights"][0], "id": 2, "event_type": "odd"}]) == {"C14", "C17"}
    assert run(insight_features=[]) == {"C15"}
    assert run(event_scores=base["event_scores"] + [{"id": 2, "event_id": 9, "model": "n", "policy_version": 2}], insight_features=[{"event_id": 1}, {"event_id": 9}]) == {"C16", "C17"}
    labs = [{"id": i, "person_id": 1, "lab_id": i, "observed_at": "2024-03-20", "evidence_id": 1} for i in range(3)]
    assert run(affiliations=labs) == {"C20"}
    assert run(affiliations=[{**labs[0], "observed_at": None}]) == {"C5"}
    assert run(person_candidates=[{"id": 1, "name": "x", "seed_lab_ids": [1, 2, 3], "evidence_id": 1}]) == {"C20"}


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = ingest.read_documents(spark, str(tmp_path / "in"), events.schema, 1)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    counts = run(ingest.tumbling_counts(stream, "ts", "event_type", delay="60 days"), "tumbling", "complete")
    want = events.groupBy(F.to_timestamp(F.to_date("ts")).alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(str, counts.collect())) == sorted(map(str, want.collect()))
    alerts = run(ingest.once_only_alerts(stream.select(F.col("user_id").alias("event_id"), F.lit("p").alias("persona"), F.col("event_type").alias("rule"))), "alerts", "append")
    assert alerts.count() == events.select("user_id", "event_type").distinct().count()
    docs = run(ingest.dedup_by_content(stream, "event_type"), "docs", "append")
    assert docs.count() == events.select("event_type").distinct().count()


def test_replayed_batches_add_nothing(spark, tmp_path):
    write = ingest.append_new(str(tmp_path / "t"), ["k"])
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for i in (0, 0, 1):
        write(batch, i)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_nothing_outside_imports_the_llm_package():
    for path in (ROOT / "eventloom").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_fragments_end_a_word_as_their_sql_does(spark, tmp_path):
    posts = [(i, 0, "head\n" + t) for i, t in enumerate(["Leè enment", "Le è", "La", "The_x", "It2", "And-so", "Deß", "Then", "De, x", "Leé\nx"])]
    spark.createDataFrame(posts, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.reason) for r in plans.QUERIES["filter_social_fragment"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == {(r[0], r[2]) for r in c.sql(plans.SQL["filter_social_fragment"]).fetchall()}
    assert (0, "continuation") in got
