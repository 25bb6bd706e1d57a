"""Schemas of the evidence model's tables, as Spark DDL; additive evolution is by unionByName."""

TABLES = {
    "sources": "id BIGINT, source_type STRING, lab_id BIGINT, name STRING, url STRING, channel STRING, purpose STRING, active BOOLEAN",
    "raw_documents": "id BIGINT, source_type STRING, source_id BIGINT, url STRING, content_hash STRING, raw_content STRING, published_at STRING, retrieved_at STRING",
    "evidence": "id BIGINT, document_id BIGINT, locator STRING, verbatim_content STRING, verification STRING, verification_score DOUBLE",
    "labs": "id BIGINT, name STRING, is_public_company BOOLEAN, parent_ticker STRING",
    "people": "id BIGINT, canonical_name STRING, seniority_tier STRING, discovered_via STRING, first_seen_at STRING",
    "identities": "id BIGINT, person_id BIGINT, platform STRING, handle STRING, confidence_tier STRING, resolution_method STRING, evidence_id BIGINT",
    "affiliations": "id BIGINT, person_id BIGINT, lab_id BIGINT, role STRING, basis STRING, observed_at STRING, evidence_id BIGINT",
    "person_candidates": "id BIGINT, name STRING, discovered_via STRING, paper_count INT, entry_ids ARRAY<STRING>, seed_person_ids ARRAY<BIGINT>, seed_lab_ids ARRAY<BIGINT>, lab_hint STRING, evidence_id BIGINT, status STRING, reviewed_at STRING, created_at STRING",
    "insights": "id BIGINT, evidence_id BIGINT, attributed_person_id BIGINT, attributed_lab_id BIGINT, event_type STRING, claim STRING, cluster_id BIGINT, score DOUBLE, score_components STRING, created_at STRING",
    "event_entities": "id BIGINT, event_id BIGINT, entity_kind STRING, person_id BIGINT, lab_id BIGINT, role STRING, basis STRING, evidence_id BIGINT",
    "hypotheses": "id BIGINT, insight_id BIGINT, persona STRING, hypothesis STRING, tickers STRING, direction STRING, confidence STRING, time_horizon STRING, reasoning STRING",
    "rejections": "id BIGINT, document_id BIGINT, stage STRING, reason STRING, detail STRING, created_at STRING",
    "fetch_log": "id BIGINT, source_id BIGINT, attempted_at STRING, status STRING, items_found INT, detail STRING",
    "llm_calls": "id BIGINT, task STRING, model STRING, input_tokens BIGINT, output_tokens BIGINT, cost_usd DOUBLE, created_at STRING, reasoning_tokens BIGINT, cache_write_tokens BIGINT, cache_read_tokens BIGINT",
    "insight_features": "event_id BIGINT, feature STRING, value DOUBLE, computed_at STRING",
    "pairwise_labels": "id BIGINT, event_a BIGINT, event_b BIGINT, winner STRING, labeler STRING, thesis_channel STRING, reason STRING, labeled_at STRING",
    "event_scores": "id BIGINT, event_id BIGINT, model STRING, score DOUBLE, rank INT, components STRING, policy_version INT, created_at STRING",
    "event_positions": "id BIGINT, event_id BIGINT, ticker STRING, direction STRING, channel STRING, rationale STRING, evidence_id BIGINT, policy_version INT, created_at STRING",
    "alerts": "id BIGINT, event_id BIGINT, persona STRING, rule STRING, reason STRING, fired_at STRING, delivered_via STRING",
    "claim_checks": "id BIGINT, insight_id BIGINT, model STRING, verdict STRING, reason STRING, created_at STRING",
    "hypothesis_checks": "id BIGINT, hypothesis_id BIGINT, model STRING, supported INT, total INT, score DOUBLE, detail STRING, created_at STRING",
    "slate_reviews": "id BIGINT, event_id BIGINT, persona STRING, reviewer STRING, verdict STRING, reviewed_at STRING",
    "contributor_scores": "id BIGINT, person_id BIGINT, rubric STRING, score DOUBLE, n_events INT, components STRING, created_at STRING",
    "contributor_reviews": "id BIGINT, person_id BIGINT, rubric STRING, reviewer STRING, verdict STRING, reviewed_at STRING",
}

EVENT_TYPES = ("release", "research", "benchmark", "infrastructure", "commercial", "open_source", "personnel", "other")


class Model:
    """The model's tables by attribute; a missing one is empty, with its schema."""

    def __init__(self, spark, tables=None):
        self._spark, self._tables = spark, dict(tables or {})

    @classmethod
    def at(cls, spark, path):
        """Tables as Parquet folders under a path."""
        return cls(spark, {name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in TABLES.items()})

    def __getattr__(self, name):
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self._spark.createDataFrame([], TABLES[name])
        return self._tables[name]
