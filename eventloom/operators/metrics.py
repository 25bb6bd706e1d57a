"""The standing metrics over the evidence model: one function, one table each.

Every function takes the model (attributes are tables) and returns an unordered DataFrame; a
caller that prints sorts. Subqueries of counts become one-row aggregates that are cross-joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.schemas import EVENT_TYPES


def _pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits).cast("double")


def _row(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def _n(df: DataFrame, name: str, of: Column | None = None) -> DataFrame:
    return df.agg((F.count("*") if of is None else of).alias(name))


def _lab(m, rows: DataFrame, missing: str) -> DataFrame:
    labs = m.labs.select(F.col("id").alias("attributed_lab_id"), F.col("name").alias("_lab"))
    return rows.join(labs, "attributed_lab_id", "left").withColumn("lab", F.coalesce("_lab", F.lit(missing)))


def _cited(m) -> DataFrame:
    return m.insights.select(F.col("evidence_id").alias("id")).where("id is not null").distinct()


def _with_document(m) -> DataFrame:
    ev = m.evidence.select(F.col("id").alias("evidence_id"), "document_id")
    return m.insights.select(F.col("id").alias("insight_id"), "evidence_id", "event_type").join(ev, "evidence_id")


def _spaces(c: str) -> Column:
    return F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit(""))) + 1


def latest_documents(m) -> DataFrame:
    newest = m.raw_documents.groupBy("url").agg(F.max("id").alias("id"))
    return m.raw_documents.join(newest.select("id"), "id", "left_semi")


def _content(m, docs: DataFrame) -> DataFrame:
    good = m.sources.where("purpose = 'content'").select(F.col("id").alias("source_id"))
    return docs.join(good, "source_id", "left_semi")


def g1_basis_by_lab(m):
    entities = m.event_entities.where("entity_kind = 'lab'").select(F.col("event_id").alias("id"), "basis")
    rows = _lab(m, m.insights.select("id", "attributed_lab_id").join(entities, "id", "left"), "(unattributed)")
    c = lambda b: F.count_if(F.col("basis") == b)
    return rows.groupBy("lab").agg(F.count("*").alias("insights"), c("model_asserted").alias("model_asserted"), c("source_inferred").alias("source_inferred"), _pct(c("source_inferred"), F.count("*")).alias("pct_inferred"))


def g2_verification_rejections(m):
    hit = (F.col("stage") == "verification") | F.col("reason").ilike("quote%") | F.col("reason").ilike("%duplicate%")
    return m.rejections.where(hit).groupBy("stage", "reason").agg(F.count("*").alias("n"))


def g3_evidence_populations(m):
    cited = _cited(m)
    return _row(
        _n(m.evidence.join(cited, "id", "left_semi"), "insight_evidence"),
        _n(m.evidence.join(cited, "id", "left_anti"), "register_evidence"),
        _n(m.evidence, "total_evidence"),
        _n(m.insights, "insights"),
    )


def g4_cap_binding(m):
    per = _with_document(m).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("insights_in_doc"))
    sized = m.raw_documents.select("id", "source_type", F.length("raw_content").alias("k")).join(per, "id")
    return sized.groupBy("source_type", "insights_in_doc").agg(F.count("*").alias("docs"), F.round(F.avg("k")).alias("avg_chars"), F.min("k").cast("long").alias("min_chars"))


def g5_split_signature(m):
    rows = _with_document(m)
    same = rows.groupBy("document_id", "event_type").agg(F.count("*").alias("k")).where("k > 1")
    return _row(_n(rows, "docs_with_insights", F.countDistinct("document_id")), _n(same, "same_type_groups"), _n(same, "docs_affected", F.countDistinct("document_id")))


def g5b_clusters(m):
    k = F.countDistinct("cluster_id")
    return m.insights.agg(F.count("*").alias("insights"), F.count_if(F.col("cluster_id").isNull()).alias("cluster_id_null"), k.alias("distinct_clusters"), F.round(F.count("*") / F.nullif(k, F.lit(0)), 2).alias("insights_per_cluster"))


def m1a_funnel(m):
    out = lambda stage: m.rejections.where(F.col("stage") == stage).agg(F.countDistinct("document_id").alias(f"{stage}_rejected"))
    return _row(_n(_content(m, m.raw_documents), "content_docs"), out("stage1"), out("stage2"), _n(_with_document(m), "docs_with_insight", F.countDistinct("document_id")), _n(m.insights, "insights"))


def m1b_rejection_reasons(m):
    return m.rejections.groupBy("stage", "reason").agg(F.count("*").alias("n"))


def m1c_yield_by_type(m):
    docs = _content(m, m.raw_documents).groupBy("source_type").agg(F.count("*").alias("docs"))
    made = _content(m, m.raw_documents).select(F.col("id").alias("document_id"), "source_type").join(_with_document(m), "document_id").groupBy("source_type").agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    return docs.join(made, "source_type", "left").select("source_type", "docs", k.alias("insights"), F.round(k / F.nullif(F.col("docs"), F.lit(0)), 2).alias("insights_per_doc"))


def m1d_yield_per_survivor(m):
    gone = m.rejections.where("stage = 'stage1' and document_id is not null").select(F.col("document_id").alias("id"))
    docs = _content(m, latest_documents(m)).join(gone, "id", "left_anti").groupBy("source_type").agg(F.count("*").alias("surviving_docs"))
    made = m.raw_documents.select(F.col("id").alias("document_id"), "source_type").join(_with_document(m), "document_id").groupBy("source_type").agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    return docs.join(made, "source_type", "left").select("source_type", "surviving_docs", k.alias("insights"), F.round(k / F.nullif(F.col("surviving_docs"), F.lit(0)), 2).alias("per_surviving_doc"))


def m2a_verification_rate(m):
    counts = m.rejections.agg(F.count_if(F.col("reason") == "quote_unverified").alias("per_insight_failed"), F.count_if(F.col("reason").isin("no_verified_insight", "quote_not_found")).alias("whole_doc_failed"))
    out = _row(_n(m.evidence.join(_cited(m), "id", "left_semi"), "kept_insights"), counts)
    return out.withColumn("pct_verified", _pct(F.col("kept_insights"), F.col("kept_insights") + F.col("per_insight_failed")))


def m2b_methods(m):
    marked = m.evidence.join(_cited(m).withColumn("_c", F.lit(True)), "id", "left")
    return marked.groupBy(F.when(F.col("_c"), "insight (extraction)").otherwise("register (entity)").alias("population"), "verification").agg(F.count("*").alias("n"))


def m3a_insights_per_document(m):
    return _with_document(m).groupBy("document_id").agg(F.count("*").alias("n_insights")).groupBy("n_insights").agg(F.count("*").alias("documents"))


def _quote_words(m):
    return m.evidence.join(_cited(m), "id", "left_semi").select(_spaces("verbatim_content").alias("w"))


def m3b_quote_length(m):
    rows, w = _quote_words(m), F.col("w")
    bucket = F.when(w < 10, "1. under 10 (under-spec)")
    for i in range(2, 6):
        bucket = bucket.when(w < 10 * i, f"{i}. {10 * i - 10}-{10 * i - 1}")
    bucket = bucket.when(w <= 60, "6. 50-60").otherwise("7. 61+ (over-spec)")
    return _row(rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")), _n(rows, "_all")).select("bucket", "n", _pct(F.col("n"), F.col("_all")).alias("pct"))


def m3b2_quotes_in_spec(m):
    good = F.count_if(F.col("w").between(10, 60))
    return _quote_words(m).agg(F.count("*").alias("insight_quotes"), good.alias("in_spec"), _pct(good, F.count("*")).alias("pct_in_spec"))


def m3c_claim_length(m):
    return m.insights.select(_spaces("claim").alias("w")).agg(F.min("w").cast("long").alias("min_w"), F.round(F.avg("w"), 1).alias("avg_w"), F.max("w").cast("long").alias("max_w"))


def m3d_months(m):
    docs = _content(m, latest_documents(m)).where("published_at is not null")
    return docs.groupBy(F.substring("published_at", 1, 7).alias("month")).agg(F.count("*").alias("docs")).orderBy(F.desc("month")).limit(12)


def m3e_event_types(m):
    return _row(m.insights.groupBy("event_type").agg(F.count("*").alias("n")), _n(m.insights, "_all")).select("event_type", "n", _pct(F.col("n"), F.col("_all")).alias("pct"))


def m4b_register_balance(m):
    via = m.people.select(F.col("id").alias("person_id"), "discovered_via")
    aff = m.affiliations.join(via, "person_id")
    seeds = aff.where("discovered_via = 'seed'").groupBy("lab_id").agg(F.count("*").alias("s"))
    below = aff.where("discovered_via in ('coauthor_expansion', 'auto_approved')").groupBy("lab_id").agg(F.countDistinct("person_id").alias("b"))
    made = m.insights.groupBy(F.col("attributed_lab_id").alias("lab_id")).agg(F.count("*").alias("i"))
    out = m.labs.select(F.col("id").alias("lab_id"), F.col("name").alias("lab"))
    for part in (seeds, below, made):
        out = out.join(part, "lab_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("lab", zero("s").alias("seeds"), zero("b").alias("layer_below"), zero("i").alias("insights"))


def m4c_attribution(m):
    p, k = F.col("attributed_person_id").isNotNull(), F.col("attributed_lab_id").isNotNull()
    counts = m.insights.agg(F.count("*").alias("insights"), F.count_if(p).alias("with_person"), F.count_if(k).alias("with_lab"), F.count_if(~p & ~k).alias("unattributed"))
    return _row(counts, _n(m.people, "people_in_register"))


def m4d_identities(m):
    return m.identities.groupBy("platform", "confidence_tier", "resolution_method").agg(F.count("*").alias("n"))


def m4e_event_entities(m):
    return m.event_entities.groupBy("entity_kind", "role", "basis").agg(F.count("*").alias("n"))


def m5a_cost_by_task(m):
    usd = F.sum("cost_usd")
    return m.llm_calls.groupBy("task", "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("tok_in"), F.sum("output_tokens").alias("tok_out"), F.round(usd, 4).alias("usd"), F.round(usd / F.count("*"), 5).alias("usd_per_call"))


def m5a2_reasoning_tokens(m):
    thought = F.sum(F.coalesce("reasoning_tokens", F.lit(0)))
    return m.llm_calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("output_tokens").alias("tok_out"), thought.alias("tok_reasoning"), _pct(thought, F.sum("output_tokens")).alias("pct_thinking"), F.round(F.sum("cost_usd"), 4).alias("usd"))


def m5a3_judges(m):
    low = F.col("reason").ilike("%conf=low%")  # null for a null reason, which neither count takes
    judged = m.pairwise_labels.where(F.col("labeler").startswith("llm:"))
    return judged.groupBy(F.split_part(F.substr("labeler", F.lit(5)), F.lit("/"), F.lit(1)).alias("judge_model")).agg(F.count("*").alias("judged"), F.count_if(~low).alias("usable"), _pct(F.count_if(low), F.count("*")).alias("pct_low_conf"))


def m5b_cost_per_insight(m):
    cost = m.llm_calls.agg(F.sum("cost_usd").alias("_c"), F.sum(F.when(F.col("task") == "extract", F.col("cost_usd"))).alias("_x"))
    out = _row(cost, _n(m.insights, "insights"), _n(m.rejections.where("reason = 'low_substance'"), "killed_by_gate"))
    return out.select(F.round("_c", 4).alias("total_usd"), "insights", F.round(F.col("_c") / F.nullif(F.col("insights"), F.lit(0)), 5).alias("usd_per_insight"), "killed_by_gate", F.round(100.0 * F.col("_x") / F.nullif(F.col("_c"), F.lit(0.0)), 1).cast("double").alias("pct_in_extract"))


def m6a_fetch_status(m):
    return m.fetch_log.groupBy("status").agg(F.count("*").alias("n"))


def m6b_failed_fetches(m):
    named = m.sources.select(F.col("id").alias("source_id"), "name", "source_type")
    return m.fetch_log.where("status <> 'ok'").join(named, "source_id").groupBy("name", "source_type", "status").agg(F.count("*").alias("n"), F.max("attempted_at").alias("last_try"))


def m7_labs_by_type(m):
    cells = [F.count_if(F.col("event_type") == e).alias(e) for e in EVENT_TYPES]
    return _lab(m, m.insights, "(none)").groupBy("lab").agg(*cells, F.count("*").alias("total"))


def s1_models(m):
    return m.event_scores.groupBy("model").agg(F.countDistinct("event_id").alias("events"), F.round(F.min("score"), 3).alias("min_s"), F.round(F.max("score"), 3).alias("max_s"))


def s2_top_events(m):
    top = m.insights.where("score is not null").orderBy(F.desc("score"), "id").limit(10)
    return _lab(m, top, "(none)").select(F.round("score", 3).alias("score"), "lab", "event_type", F.substring("claim", 1, 66).alias("claim"))


def s3_top_share(m):
    top = m.insights.where("score is not null").orderBy(F.desc("score"), "id").limit(30)
    return _lab(m, top, "(none)").groupBy("lab").agg(F.count("*").alias("in_top30"))


def s4_winners(m):
    return m.pairwise_labels.groupBy("winner").agg(F.count("*").alias("n"))


def f1_freshness(m):
    """Lag from publication to retrieval in days: count, mean and upper median, of all and within 14 days."""
    us = lambda c: F.unix_micros(F.try_to_timestamp(F.col(c)))
    lag = m.raw_documents.select(((us("retrieved_at") - us("published_at")) / 86_400_000_000).alias("lag")).where("lag >= 0")
    both = F.when(F.col("lag") <= 14, F.array(F.lit("all"), F.lit("steady"))).otherwise(F.array(F.lit("all")))
    counts = lag.select(F.explode(both).alias("cohort"), "lag").groupBy("cohort", "lag").agg(F.count("*").alias("k"))
    n = counts.groupBy("cohort").agg(F.sum("k").alias("docs"), F.round(F.sum(F.col("lag") * F.col("k")) / F.sum("k"), 1).alias("mean_lag"))
    run = counts.withColumn("r", F.sum("k").over(W.partitionBy("cohort").orderBy("lag"))).join(n, "cohort")
    at = F.floor(F.col("docs") / 2)
    return run.where((F.col("r") > at) & (F.col("r") - F.col("k") <= at)).select("cohort", "docs", "mean_lag", F.round("lag", 1).alias("median_lag"))


ALL = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__[:2] in ("g1", "g2", "g3", "g4", "g5", "m1", "m2", "m3", "m4", "m5", "m6", "m7", "s1", "s2", "s3", "s4", "f1")}
