"""Claim repair: claims that their quote supports in part are rewritten and checked again, in one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdicts, and what stands for a check that has none.
VERDICTS = ("entailed", "partial", "not_entailed")
UNCHECKED = "re-verify unparsed; kept partial"


def _object(reply: Column) -> Column:
    """The outermost braces of a reply as a variant; null if that is no JSON. Of two objects in a row the first counts."""
    return F.try_parse_json(F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit("")))


def _text(v: Column, field: str) -> Column:
    """A field if it is a string."""
    part = F.try_variant_get(v, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rewrite(reply: Column) -> Column:
    """struct<status, claim>: `rewritten` with a claim, `unrepairable` if the reply's claim is null, else `unparsed`."""
    v = _object(reply)
    claim = _bare(_text(v, "claim"))
    given = F.try_variant_get(v, "$.claim", "variant")
    status = F.when(claim != "", "rewritten").when(F.is_variant_null(given), "unrepairable").otherwise("unparsed")
    return F.struct(status.alias("status"), F.when(claim != "", claim).alias("claim"))


def verdict(reply: Column) -> Column:
    """struct<verdict, reason> of a check's reply, its JSON or else its wording; `partial` if it has none."""
    v = _object(reply)
    own = _bare(_text(v, "verdict"))
    loose = F.nullif(F.regexp_extract(reply, r'"verdict"\s*:\s*"(entailed|partial|not_entailed)"', 1), F.lit(""))
    why = F.substring(F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit("")), 1, 300)
    loose_why = F.substring(F.regexp_extract(reply, r'"reason"\s*:\s*"([^"]*)', 1), 1, 300)
    fine = F.coalesce(own.isin(*VERDICTS), F.lit(False))
    return F.struct(
        F.when(fine, own).otherwise(F.coalesce(loose, F.lit("partial"))).alias("verdict"),
        F.when(fine, why).when(loose.isNotNull(), loose_why).otherwise(F.lit(UNCHECKED)).alias("reason"),
    )


def decisions(m, rewrites: DataFrame, checks: DataFrame, model: str) -> DataFrame:
    """(id, claim, status, new_claim, verdict, reason) of each insight that model's verdict calls partial.

    rewrites and checks: (insight_id, reply), one row an insight at most; without a reply it is unparsed.
    """
    queue = m.claim_checks.where((F.col("model") == model) & (F.col("verdict") == "partial")).select(F.col("insight_id").alias("id")).distinct()
    quoted = m.insights.select("id", "claim", "evidence_id").join(queue, "id").join(m.evidence.select(F.col("id").alias("evidence_id")), "evidence_id")
    one = lambda rows, name: rows.select(F.col("insight_id").alias("id"), F.col("reply").alias(name))
    rows = quoted.join(one(rewrites, "_r"), "id", "left").join(one(checks, "_c"), "id", "left")
    rows = rows.withColumns({"_w": rewrite(F.coalesce("_r", F.lit(""))), "_v": verdict(F.coalesce("_c", F.lit("")))})
    changed = F.col("_w.status") == "rewritten"
    return rows.select("id", "claim", F.col("_w.status").alias("status"), F.col("_w.claim").alias("new_claim"), F.when(changed, F.col("_v.verdict")).alias("verdict"), F.when(changed, F.col("_v.reason")).alias("reason"))


def repaired(m, decided: DataFrame, model: str, as_of: str) -> dict[str, DataFrame]:
    """insights, claim_checks and rejections after the decisions: the old claim is logged, claim and verdict replaced."""
    new = decided.where("status = 'rewritten'")
    insights = m.insights.join(new.select("id", "new_claim"), "id", "left").withColumn("claim", F.coalesce("new_claim", "claim")).select(*m.insights.columns)
    mine = new.select(F.col("id").alias("insight_id"), F.lit(model).alias("model"))
    checks = new.select(F.xxhash64("id", F.lit(model), "new_claim").alias("id"), F.col("id").alias("insight_id"), F.lit(model).alias("model"), "verdict", "reason", F.lit(as_of).alias("created_at"))
    said = F.concat(F.lit("event "), F.col("id").cast("string"), F.lit(": "), F.substring("claim", 1, 300))
    log = new.select(F.xxhash64("id", "claim", F.lit(as_of)).alias("id"), F.lit(None).cast("long").alias("document_id"), F.lit("verification").alias("stage"), F.lit("claim_rewritten").alias("reason"), said.alias("detail"), F.lit(as_of).alias("created_at"))
    return {
        "insights": insights,
        "claim_checks": m.claim_checks.join(mine, ["insight_id", "model"], "left_anti").select(*m.claim_checks.columns).unionByName(checks),
        "rejections": m.rejections.unionByName(log),
    }
