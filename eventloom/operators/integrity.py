"""The integrity suite: each check returns its violating rows as (check, subject, detail); none is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import materialise

from eventloom.functions import text as T

# The confidence tiers that each way of resolving an identity may give.
TIERS = {"exact": ("verbatim", "name_match_only"), "coauthor_overlap": ("corroborated",), "manual": ("manual_approved",), "self_link": ("verbatim",)}
MOST_DATE_DRIFT = 14
MOST_LABS = 2


def _bad(rows: DataFrame, check: str, subject: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def reverified(m) -> DataFrame:
    """(id, ok) of all evidence: its quote stands in the stored bytes or, unless structural, in the visible text.

    Documents are normalised once each, not once for each quote.
    """
    used = m.evidence.select(F.col("document_id").alias("id")).distinct()
    docs = m.raw_documents.join(used, "id", "left_semi").select(F.col("id").alias("document_id"), T.norm(F.col("raw_content")).alias("raw"), T.norm(T.html_to_text(F.col("raw_content"))).alias("seen"))
    quote = T.norm(F.col("verbatim_content"))
    rows = m.evidence.select("id", "document_id", "verification", quote.alias("q")).join(docs, "document_id", "left")
    ok = F.contains("raw", F.col("q")) | ((F.col("verification") != "structural") & F.contains("seen", F.col("q")))
    return rows.select("id", F.coalesce(ok, F.lit(False)).alias("ok"))


def _fails(m, rows: DataFrame, check: str, ok: DataFrame) -> DataFrame:
    broken = ok.where(~F.col("ok")).select(F.col("id").alias("evidence_id"))
    return _bad(rows.join(broken, "evidence_id", "left_semi"), check, F.col("id"), F.col("evidence_id"))


def checks(m, policy_version: int, event_types: list[str], as_of: Column) -> dict[str, DataFrame]:
    """Violations by check; C13 is a balance table, see metrics.m4b_register_balance."""
    key = lambda df, c, name="id": df.select(F.col(c).alias(name)).where(F.col(name).isNotNull())
    ok = materialise(reverified(m), "reverified")
    out: dict[str, DataFrame] = {}
    out["C1"] = _bad(m.raw_documents.where(F.sha2("raw_content", 256) != F.col("content_hash")), "C1", F.col("id"), F.lit("hash mismatch"))
    out["C2"] = _bad(ok.where(~F.col("ok")), "C2", F.col("id"), F.lit("no longer matches its document"))
    out["C3"] = _bad(m.people.join(key(m.identities, "person_id"), "id", "left_anti"), "C3", F.col("id"), F.col("canonical_name"))
    allowed = F.lit(False)
    for method, tiers in TIERS.items():
        allowed = allowed | ((F.col("resolution_method") == method) & F.col("confidence_tier").isin(*tiers))
    hygiene = F.when(F.col("evidence_id").isNull(), "no evidence").when(~F.coalesce(allowed, F.lit(False)), F.concat_ws(" by ", "confidence_tier", "resolution_method"))
    out["C4"] = _bad(m.identities.where(hygiene.isNotNull()), "C4", F.col("id"), hygiene)
    undated = _bad(m.affiliations.where(F.coalesce("observed_at", F.lit("")) == ""), "C5", F.col("id"), F.lit("no observed_at"))
    out["C5"] = undated.unionByName(_fails(m, m.affiliations.where(F.coalesce("observed_at", F.lit("")) != ""), "C5", ok))
    out["C6"] = _bad(m.insights.join(key(m.evidence, "id", "evidence_id"), "evidence_id", "left_anti"), "C6", F.col("id"), F.col("evidence_id"))
    out["C7"] = _bad(m.sources.join(key(m.fetch_log, "source_id"), "id", "left_anti"), "C7", F.col("id"), F.col("name"))
    out["C8"] = _fails(m, m.person_candidates, "C8", ok)
    tokens = F.split("canonical_name", r"\s+")
    clean = (F.size(tokens) >= 2) & (F.trim("canonical_name") == F.col("canonical_name")) & F.forall(tokens, lambda w: w.rlike(r"\p{L}"))
    named = m.people.join(m.labs.select(F.lower("name").alias("_n")), F.lower("canonical_name") == F.col("_n"), "left")
    out["C9"] = _bad(named.where(~F.coalesce(clean, F.lit(False)) | F.col("_n").isNotNull()), "C9", F.col("id"), F.col("canonical_name"))
    users = reduce(DataFrame.unionByName, [key(x, "evidence_id") for x in (m.insights, m.identities, m.affiliations, m.person_candidates, m.event_entities, m.event_positions)])
    out["C10"] = _bad(m.evidence.join(users, "id", "left_anti"), "C10", F.col("id"), F.lit("referenced by nothing"))
    out["C11"] = _fails(m, m.event_entities, "C11", ok)
    by = m.evidence.select(F.col("id").alias("evidence_id"), "document_id").join(m.raw_documents.select(F.col("id").alias("document_id"), "source_id"), "document_id")
    by = by.join(m.sources.select(F.col("id").alias("source_id"), "channel"), "source_id").where(~F.col("channel").eqNullSafe("official")).select("evidence_id", "channel")
    out["C12"] = _bad(m.event_entities.where("basis = 'source_inferred'").join(by, "evidence_id"), "C12", F.col("id"), F.col("channel"))
    filled = m.insights.agg(F.count("cluster_id").alias("c"), F.count("*").alias("t")).where("0 < c and c < t")
    mixed = m.insights.where("cluster_id is not null").groupBy("cluster_id").agg(F.countDistinct("event_type").alias("k")).where("k > 1")
    out["C14"] = _bad(filled, "C14", F.lit("all"), F.concat_ws("/", "c", "t")).unionByName(_bad(mixed, "C14", F.col("cluster_id"), F.col("k")))
    out["C15"] = _bad(m.event_scores.select("event_id").distinct().join(key(m.insight_features, "event_id", "event_id"), "event_id", "left_anti"), "C15", F.col("event_id"), F.lit("no features"))
    per = m.event_scores.groupBy("model").agg(F.countDistinct("event_id").alias("k"))
    every = m.event_scores.agg(F.countDistinct("event_id").alias("u"))
    out["C16"] = _bad(per.crossJoin(every).where("k <> u"), "C16", F.col("model"), F.concat_ws("/", "k", "u"))
    other = m.event_scores.select("policy_version").distinct().where(~F.col("policy_version").eqNullSafe(policy_version))
    unranked = m.insights.select("event_type").distinct().where(F.col("event_type").isNotNull() & ~F.col("event_type").isin(*event_types))
    out["C17"] = _bad(other, "C17", F.col("policy_version"), F.lit("another policy")).unionByName(_bad(unranked, "C17", F.col("event_type"), F.lit("unranked type")))
    own = F.to_date(T.page_published(F.col("raw_content")))
    stored = F.try_to_date(F.substring("published_at", 1, 10), "yyyy-MM-dd")
    out["C18"] = _bad(m.raw_documents.where(F.col("raw_content").contains("<h")).where(F.abs(F.datediff(stored, own)) > MOST_DATE_DRIFT), "C18", F.col("id"), F.col("published_at"))
    loose = m.evidence.where("verification <> 'exact'").select(F.col("id").alias("evidence_id"), "verification")
    out["C19"] = _bad(m.insights.join(loose, "evidence_id"), "C19", F.col("id"), F.col("verification"))
    merged = m.person_candidates.where(F.size(F.array_distinct(F.coalesce("seed_lab_ids", F.array().cast("array<bigint>")))) > MOST_LABS)
    since = F.unix_micros(as_of) - 90 * 86_400_000_000
    recent = m.affiliations.where(F.col("lab_id").isNotNull() & (F.unix_micros(F.try_to_timestamp(F.col("observed_at"))) >= since))
    moved = recent.groupBy("person_id").agg(F.countDistinct("lab_id").alias("k")).where(F.col("k") > MOST_LABS)
    out["C20"] = _bad(merged, "C20", F.col("name"), F.lit("candidate of several labs")).unionByName(_bad(moved, "C20", F.col("person_id"), F.col("k")))
    return out


def suite(m, policy_version: int, event_types: list[str], as_of: Column) -> DataFrame:
    """All violations in one table; the release gate is that it is empty."""
    return reduce(DataFrame.unionByName, checks(m, policy_version, event_types, as_of).values())
