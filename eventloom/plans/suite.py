"""The metrics and integrity suites over the evidence model, derived from the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import integrity, metrics
from eventloom.schemas import EVENT_TYPES, TABLES, Model

from .registry import QUERIES, SQL, Tables, query

# Stand-ins, each of a whole table as (source table, {column: expression}); the expressions mean the same in Spark SQL and DuckDB.
_KIND = "CASE " + " ".join(f"WHEN event_id % 8 = {i} THEN '{e}'" for i, e in enumerate(EVENT_TYPES)) + " END"
_SOURCE_TYPE = "CASE s_suppkey % 4 WHEN 0 THEN 'blog' WHEN 1 THEN 'newsroom' WHEN 2 THEN 'arxiv' ELSE 'github' END"
STANDINS = {
    "sources": ("supplier", {"id": "s_suppkey", "source_type": _SOURCE_TYPE, "lab_id": "s_nationkey % 8", "name": "s_name", "url": "s_name", "channel": "CASE WHEN s_suppkey % 3 = 0 THEN 'official' ELSE 'third_party' END", "purpose": "CASE WHEN s_suppkey % 5 = 0 THEN 'register' ELSE 'content' END"}),
    "raw_documents": ("orders", {"id": "o_orderkey", "source_id": "o_orderkey % 10", "source_type": _SOURCE_TYPE.replace("s_suppkey", "(o_orderkey % 10)"), "url": "concat('u', CAST(o_orderkey % 1900 AS VARCHAR(20)))", "raw_content": "concat(o_orderpriority, ' ', repeat('word ', CAST(o_orderkey % 70 AS INTEGER)), 'k')", "published_at": "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) END", "retrieved_at": "concat(substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), 1, 8), '28')"}),
    "evidence": ("events", {"id": "event_id", "document_id": "event_id - event_id % 3", "verbatim_content": "concat(repeat('word ', CAST(event_id % 70 AS INTEGER)), 'k')", "verification": "CASE event_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' ELSE 'structural' END"}),
    "labs": ("nation", {"id": "n_nationkey", "name": "n_name"}),
    "people": ("customer", {"id": "c_custkey", "canonical_name": "replace(c_name, '#', ' ')", "discovered_via": "CASE c_custkey % 3 WHEN 0 THEN 'seed' WHEN 1 THEN 'coauthor_expansion' ELSE 'auto_approved' END"}),
    "identities": ("customer", {"id": "c_custkey", "person_id": "c_custkey", "platform": "CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'github' END", "handle": "c_name", "confidence_tier": "CASE WHEN c_custkey % 5 = 0 THEN 'corroborated' ELSE 'verbatim' END", "resolution_method": "CASE WHEN c_custkey % 4 = 0 THEN 'manual' ELSE 'exact' END", "evidence_id": "CASE WHEN c_custkey % 17 <> 0 THEN c_custkey END"}),
    "affiliations": ("customer", {"id": "c_custkey", "person_id": "c_custkey - c_custkey % 3", "lab_id": "c_nationkey % 8", "observed_at": "CASE WHEN c_custkey % 13 <> 0 THEN '2024-01-05' END", "evidence_id": "c_custkey + 1000"}),
    "insights": ("events", {"id": "event_id", "evidence_id": "event_id - event_id % 2", "attributed_person_id": "CASE WHEN event_id % 4 = 0 THEN user_id END", "attributed_lab_id": "CASE WHEN event_id % 3 <> 0 THEN user_id % 8 END", "event_type": _KIND, "claim": "concat('claim ', event_type, ' of ', repeat('x ', CAST(user_id % 9 AS INTEGER)), 'end')", "cluster_id": "CASE WHEN event_id % 7 <> 0 THEN event_id - event_id % 5 END", "score": "CASE WHEN event_id % 9 <> 0 THEN value + event_id / 1000000.0 END"}),
    "event_entities": ("events", {"id": "event_id", "event_id": "event_id", "entity_kind": "CASE WHEN event_id % 6 = 0 THEN 'person' ELSE 'lab' END", "role": "CASE WHEN event_id % 10 = 0 THEN 'subject' ELSE 'author' END", "basis": "CASE WHEN event_id % 8 = 0 THEN 'source_inferred' ELSE 'model_asserted' END", "evidence_id": "event_id"}),
    "rejections": ("orders", {"id": "o_orderkey", "document_id": "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey - o_orderkey % 3 END", "stage": "CASE o_orderkey % 4 WHEN 0 THEN 'verification' WHEN 1 THEN 'stage2' ELSE 'stage1' END", "reason": "CASE o_orderkey % 7 WHEN 0 THEN 'quote_unverified' WHEN 1 THEN 'quote_not_found' WHEN 2 THEN 'near_duplicate' WHEN 3 THEN 'low_substance' WHEN 4 THEN 'no_verified_insight' ELSE 'too_short' END"}),
    "fetch_log": ("events", {"id": "event_id", "source_id": "event_id % 9", "attempted_at": "CAST(CAST(ts AS DATE) AS VARCHAR(20))", "status": "CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 13 = 0 THEN 'empty' ELSE 'ok' END"}),
    "llm_calls": ("orders", {"id": "o_orderkey", "task": "CASE WHEN o_orderstatus = 'F' THEN 'extract' ELSE 'judge' END", "model": "o_orderpriority", "input_tokens": "o_custkey", "output_tokens": "o_orderkey % 100", "cost_usd": "o_totalprice", "reasoning_tokens": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 END"}),
    "pairwise_labels": ("events", {"id": "event_id", "event_a": "event_id", "event_b": "event_id + 1", "winner": "CASE event_id % 5 WHEN 0 THEN 'tie' WHEN 1 THEN 'a' WHEN 2 THEN 'a' ELSE 'b' END", "labeler": "concat(CASE WHEN event_id % 4 = 0 THEN 'human:' ELSE 'llm:' END, event_type, '/investment/r1')", "reason": "CASE WHEN event_id % 6 = 0 THEN 'x CONF=low' WHEN event_id % 7 <> 0 THEN 'clear' END"}),
    "insight_features": ("events", {"event_id": "event_id", "feature": "event_type", "value": "value"}),
    "event_scores": ("events", {"id": "event_id", "event_id": "event_id - event_id % 4", "model": "event_type", "score": "value", "policy_version": "CASE WHEN event_id = 2 THEN 1 ELSE 3 END"}),
}


def model(t: Tables) -> Model:
    """The evidence model of a directory of stand-in tables."""
    made = {}
    for name, (source, columns) in STANDINS.items():
        types = dict(c.split(" ", 1) for c in TABLES[name].split(", "))
        typed = {c: f"CAST({e} AS {types[c]})" for c, e in columns.items()}
        rows = getattr(t, source).selectExpr(*[f"{typed[c]} AS {c}" if c in typed else f"CAST(NULL AS {k}) AS {c}" for c, k in types.items()])
        made[name] = rows.withColumn("content_hash", F.when(F.col("id") % 100 != 7, F.sha2("raw_content", 256)).otherwise("stale")) if name == "raw_documents" else rows
    return Model(t.spark, made)


_CTES = ", ".join(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})" for name, (source, columns) in STANDINS.items())
_PCT = "CAST(round(100.0 * ({0}) / nullif({1}, 0), 1) AS DOUBLE)"
_DOCS = "(SELECT i.id AS iid, e.document_id AS did, i.event_type AS et FROM insights i JOIN evidence e ON e.id = i.evidence_id)"
_CONTENT = "source_id IN (SELECT id FROM sources WHERE purpose = 'content')"
_LATEST = "(SELECT d.* FROM raw_documents d QUALIFY row_number() OVER (PARTITION BY url ORDER BY id DESC) = 1)"
_WORDS = "(SELECT length(verbatim_content) - length(replace(verbatim_content, ' ', '')) + 1 AS w FROM evidence SEMI JOIN (SELECT evidence_id AS id FROM insights) USING (id))"
_LAG = "(SELECT date_diff('day', CAST(published_at AS DATE), CAST(retrieved_at AS DATE)) AS lag FROM raw_documents WHERE CAST(retrieved_at AS DATE) >= CAST(published_at AS DATE))"
_METRIC_SQL = {
    "g1_basis_by_lab": f"SELECT coalesce(l.name, '(unattributed)') AS lab, count(*) AS insights, count(*) FILTER (basis = 'model_asserted') AS model_asserted, count(*) FILTER (basis = 'source_inferred') AS source_inferred, {_PCT.format('count(*) FILTER (basis = $$source_inferred$$)', 'count(*)')} AS pct_inferred FROM insights i LEFT JOIN labs l ON l.id = attributed_lab_id LEFT JOIN (FROM event_entities WHERE entity_kind = 'lab') e ON e.event_id = i.id GROUP BY ALL".replace("$$", "'"),
    "g2_verification_rejections": "SELECT stage, reason, count(*) AS n FROM rejections WHERE stage = 'verification' OR starts_with(reason, 'quote') OR contains(reason, 'duplicate') GROUP BY ALL",
    "g3_evidence_populations": "SELECT count(*) FILTER (c) AS insight_evidence, count(*) FILTER (NOT c) AS register_evidence, count(*) AS total_evidence, (SELECT count(*) FROM insights) AS insights FROM (SELECT id IN (SELECT evidence_id FROM insights) AS c FROM evidence)",
    "g4_cap_binding": f"SELECT source_type, k AS insights_in_doc, count(*) AS docs, round(avg(length(raw_content))) AS avg_chars, min(length(raw_content)) AS min_chars FROM (SELECT did, count(*) AS k FROM {_DOCS} GROUP BY did) JOIN raw_documents ON id = did GROUP BY ALL",
    "g5_split_signature": f"WITH s AS (SELECT did FROM {_DOCS} GROUP BY did, et HAVING count(*) > 1) SELECT (SELECT count(DISTINCT did) FROM {_DOCS}) AS docs_with_insights, (SELECT count(*) FROM s) AS same_type_groups, (SELECT count(DISTINCT did) FROM s) AS docs_affected",
    "g5b_clusters": "SELECT count(*) AS insights, count(*) - count(cluster_id) AS cluster_id_null, count(DISTINCT cluster_id) AS distinct_clusters, round(count(*) / CAST(nullif(count(DISTINCT cluster_id), 0) AS DOUBLE), 2) AS insights_per_cluster FROM insights",
    "m1a_funnel": f"SELECT (SELECT count(*) FROM raw_documents WHERE {_CONTENT}) AS content_docs, (SELECT count(DISTINCT document_id) FILTER (stage = 'stage1') FROM rejections) AS stage1_rejected, (SELECT count(DISTINCT document_id) FILTER (stage = 'stage2') FROM rejections) AS stage2_rejected, (SELECT count(DISTINCT did) FROM {_DOCS}) AS docs_with_insight, (SELECT count(*) FROM insights) AS insights",
    "m1b_rejection_reasons": "SELECT stage, reason, count(*) AS n FROM rejections GROUP BY ALL",
    "m1c_yield_by_type": f"WITH d AS (SELECT source_type, count(*) AS docs FROM raw_documents WHERE {_CONTENT} GROUP BY ALL), k AS (SELECT source_type, count(*) AS k FROM raw_documents JOIN {_DOCS} ON did = id WHERE {_CONTENT} GROUP BY ALL) SELECT source_type, docs, coalesce(k, 0) AS insights, round(coalesce(k, 0) / CAST(docs AS DOUBLE), 2) AS insights_per_doc FROM d LEFT JOIN k USING (source_type)",
    "m1d_yield_per_survivor": f"WITH d AS (SELECT source_type, count(*) AS docs FROM {_LATEST} x WHERE {_CONTENT} AND NOT EXISTS (SELECT 1 FROM rejections r WHERE r.stage = 'stage1' AND r.document_id = x.id) GROUP BY ALL), k AS (SELECT source_type, count(*) AS k FROM raw_documents JOIN {_DOCS} ON did = id GROUP BY ALL) SELECT source_type, docs AS surviving_docs, coalesce(k, 0) AS insights, round(coalesce(k, 0) / CAST(docs AS DOUBLE), 2) AS per_surviving_doc FROM d LEFT JOIN k USING (source_type)",
    "m2a_verification_rate": f"WITH k AS (SELECT count(*) AS a FROM evidence WHERE id IN (SELECT evidence_id FROM insights)), r AS (SELECT count(*) FILTER (reason = 'quote_unverified') AS b, count(*) FILTER (reason IN ('no_verified_insight', 'quote_not_found')) AS c FROM rejections) SELECT a AS kept_insights, b AS per_insight_failed, c AS whole_doc_failed, {_PCT.format('a', 'a + b')} AS pct_verified FROM k, r",
    "m2b_methods": "SELECT CASE WHEN id IN (SELECT evidence_id FROM insights) THEN 'insight (extraction)' ELSE 'register (entity)' END AS population, verification, count(*) AS n FROM evidence GROUP BY ALL",
    "m3a_insights_per_document": f"SELECT k AS n_insights, count(*) AS documents FROM (SELECT count(*) AS k FROM {_DOCS} GROUP BY did) GROUP BY k",
    "m3b_quote_length": f"SELECT bucket, count(*) AS n, CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS DOUBLE) AS pct FROM (SELECT CASE WHEN w < 10 THEN '1. under 10 (under-spec)' WHEN w < 50 THEN (w // 10 + 1) || '. ' || (w // 10 * 10) || '-' || (w // 10 * 10 + 9) WHEN w <= 60 THEN '6. 50-60' ELSE '7. 61+ (over-spec)' END AS bucket FROM {_WORDS}) GROUP BY bucket",
    "m3b2_quotes_in_spec": f"SELECT count(*) AS insight_quotes, count(*) FILTER (w >= 10 AND w <= 60) AS in_spec, {_PCT.format('count(*) FILTER (w >= 10 AND w <= 60)', 'count(*)')} AS pct_in_spec FROM {_WORDS}",
    "m3c_claim_length": "SELECT min(w) AS min_w, round(avg(w), 1) AS avg_w, max(w) AS max_w FROM (SELECT length(claim) - length(replace(claim, ' ', '')) + 1 AS w FROM insights)",
    "m3d_months": f"SELECT left(published_at, 7) AS month, count(*) AS docs FROM {_LATEST} WHERE {_CONTENT} AND published_at IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12",
    "m3e_event_types": "SELECT event_type, count(*) AS n, CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS DOUBLE) AS pct FROM insights GROUP BY event_type",
    "m4b_register_balance": "WITH a AS (SELECT a.lab_id, a.person_id, discovered_via AS via FROM affiliations a JOIN people p ON p.id = a.person_id) SELECT l.name AS lab, (SELECT count(*) FROM a WHERE lab_id = l.id AND via = 'seed') AS seeds, (SELECT count(DISTINCT person_id) FROM a WHERE lab_id = l.id AND via <> 'seed') AS layer_below, (SELECT count(*) FROM insights WHERE attributed_lab_id = l.id) AS insights FROM labs l",
    "m4c_attribution": "SELECT count(*) AS insights, count(attributed_person_id) AS with_person, count(attributed_lab_id) AS with_lab, count(*) FILTER (coalesce(attributed_person_id, attributed_lab_id) IS NULL) AS unattributed, (SELECT count(*) FROM people) AS people_in_register FROM insights",
    "m4d_identities": "SELECT platform, confidence_tier, resolution_method, count(*) AS n FROM identities GROUP BY ALL",
    "m4e_event_entities": "SELECT entity_kind, role, basis, count(*) AS n FROM event_entities GROUP BY ALL",
    "m5a_cost_by_task": "SELECT task, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS tok_in, CAST(sum(output_tokens) AS BIGINT) AS tok_out, round(sum(cost_usd), 4) AS usd, round(avg(cost_usd), 5) AS usd_per_call FROM llm_calls GROUP BY ALL",
    "m5a2_reasoning_tokens": f"SELECT model, count(*) AS calls, CAST(sum(output_tokens) AS BIGINT) AS tok_out, CAST(coalesce(sum(reasoning_tokens), 0) AS BIGINT) AS tok_reasoning, {_PCT.format('coalesce(sum(reasoning_tokens), 0)', 'sum(output_tokens)')} AS pct_thinking, round(sum(cost_usd), 4) AS usd FROM llm_calls GROUP BY model",
    "m5a3_judges": f"SELECT string_split(labeler[5:], '/')[1] AS judge_model, count(*) AS judged, count(*) FILTER (reason NOT ILIKE '%conf=low%') AS usable, {_PCT.format('count(*) FILTER (reason ILIKE $$%conf=low%$$)', 'count(*)')} AS pct_low_conf FROM pairwise_labels WHERE labeler LIKE 'llm:%' GROUP BY 1".replace("$$", "'"),
    "m5b_cost_per_insight": "WITH c AS (SELECT sum(cost_usd) AS c, sum(cost_usd) FILTER (task = 'extract') AS x FROM llm_calls), n AS (SELECT count(*) AS n FROM insights) SELECT round(c, 4) AS total_usd, n AS insights, round(c / n, 5) AS usd_per_insight, (SELECT count(*) FROM rejections WHERE reason = 'low_substance') AS killed_by_gate, round(100 * x / c, 1) AS pct_in_extract FROM c, n",
    "m6a_fetch_status": "SELECT status, count(*) AS n FROM fetch_log GROUP BY status",
    "m6b_failed_fetches": "SELECT name, source_type, status, count(*) AS n, max(attempted_at) AS last_try FROM fetch_log f JOIN sources s ON s.id = f.source_id WHERE status <> 'ok' GROUP BY ALL",
    "m7_labs_by_type": "SELECT coalesce(name, '(none)') AS lab, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in EVENT_TYPES) + ", count(*) AS total FROM insights LEFT JOIN labs l ON l.id = attributed_lab_id GROUP BY 1",
    "s1_models": "SELECT model, count(DISTINCT event_id) AS events, round(min(score), 3) AS min_s, round(max(score), 3) AS max_s FROM event_scores GROUP BY model",
    "s2_top_events": "SELECT round(score, 3) AS score, coalesce(name, '(none)') AS lab, event_type, claim[:66] AS claim FROM (FROM insights WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 10) i LEFT JOIN labs l ON l.id = attributed_lab_id",
    "s3_top_share": "SELECT coalesce(name, '(none)') AS lab, count(*) AS in_top30 FROM (FROM insights WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 30) i LEFT JOIN labs l ON l.id = attributed_lab_id GROUP BY 1",
    "s4_winners": "SELECT winner, count(*) AS n FROM pairwise_labels GROUP BY winner",
    "f1_freshness": f"WITH g AS (SELECT 'all' AS cohort, lag FROM {_LAG} UNION ALL SELECT 'steady', lag FROM {_LAG} WHERE lag <= 14) SELECT cohort, count(*) AS docs, round(avg(lag), 1) AS mean_lag, CAST(list_sort(list(lag))[count(*) // 2 + 1] AS DOUBLE) AS median_lag FROM g GROUP BY cohort",
}

for _name, _metric in metrics.ALL.items():
    QUERIES[f"metric_{_name}"] = lambda spark, sf_dir, f=_metric: f(model(Tables(spark, sf_dir)))
    SQL[f"metric_{_name}"] = f"WITH {_CTES} " + (", " + _METRIC_SQL[_name][5:] if _METRIC_SQL[_name].startswith("WITH ") else _METRIC_SQL[_name])



@query(f"""WITH {_CTES}, v AS (
  SELECT e.id, coalesce(contains(lower(d.raw_content), e.verbatim_content), false) AS ok FROM evidence e LEFT JOIN raw_documents d ON d.id = e.document_id),
  bad AS (SELECT id FROM v WHERE NOT ok),
  used AS (SELECT evidence_id AS id FROM insights UNION SELECT evidence_id FROM identities UNION SELECT evidence_id FROM affiliations UNION SELECT evidence_id FROM event_entities),
  c AS (
  SELECT 'C1' AS "check", id FROM raw_documents WHERE id % 100 = 7
  UNION ALL SELECT 'C2', id FROM bad
  UNION ALL SELECT 'C3', id FROM people WHERE id NOT IN (SELECT person_id FROM identities)
  UNION ALL SELECT 'C4', id FROM identities WHERE evidence_id IS NULL OR resolution_method = 'manual' OR confidence_tier = 'corroborated'
  UNION ALL SELECT 'C5', id FROM affiliations WHERE observed_at IS NULL OR evidence_id IN (FROM bad)
  UNION ALL SELECT 'C6', id FROM insights WHERE evidence_id NOT IN (SELECT id FROM evidence)
  UNION ALL SELECT 'C7', id FROM sources WHERE id NOT IN (SELECT source_id FROM fetch_log)
  UNION ALL SELECT 'C9', id FROM people
  UNION ALL SELECT 'C10', id FROM evidence WHERE id NOT IN (SELECT id FROM used WHERE id IS NOT NULL)
  UNION ALL SELECT 'C11', id FROM event_entities WHERE evidence_id IN (FROM bad)
  UNION ALL SELECT 'C12', x.id FROM event_entities x JOIN evidence e ON e.id = x.evidence_id JOIN raw_documents d ON d.id = e.document_id JOIN sources s ON s.id = d.source_id WHERE basis = 'source_inferred' AND channel <> 'official'
  UNION ALL SELECT 'C14', cluster_id FROM insights WHERE cluster_id IS NOT NULL GROUP BY cluster_id HAVING count(DISTINCT event_type) > 1
  UNION ALL SELECT 'C14', 1 FROM (SELECT count(cluster_id) AS a, count(*) AS b FROM insights) WHERE 0 < a AND a < b
  UNION ALL SELECT DISTINCT 'C15', event_id FROM event_scores WHERE event_id NOT IN (SELECT event_id FROM insight_features)
  UNION ALL SELECT 'C16', 1 FROM (SELECT model FROM event_scores GROUP BY model HAVING count(DISTINCT event_id) <> (SELECT count(DISTINCT event_id) FROM event_scores))
  UNION ALL SELECT DISTINCT 'C17', policy_version FROM event_scores WHERE policy_version <> 3
  UNION ALL SELECT DISTINCT 'C17', 0 FROM insights WHERE event_type = 'other'
  UNION ALL SELECT 'C19', i.id FROM insights i JOIN evidence e ON e.id = i.evidence_id WHERE verification <> 'exact'
  UNION ALL SELECT 'C20', person_id FROM affiliations WHERE observed_at IS NOT NULL GROUP BY person_id HAVING count(DISTINCT lab_id) > 2)
  SELECT "check", count(*) AS violations FROM c GROUP BY 1""")
def checks_suite(t):
    found = integrity.suite(model(t), 3, list(EVENT_TYPES[:-1]), F.expr("timestamp'2024-02-01'"))
    return found.groupBy("check").agg(F.count("*").alias("violations"))
