"""Drift of documents and events: the days before the newest document against all that came before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats

DAYS = 14


def dated(m, days: int = DAYS) -> DataFrame:
    """Documents with a date, and current: whether that is in the window that ends with the newest of them."""
    docs = m.raw_documents.where("published_at is not null")
    newest = F.try_to_date(F.substring(F.max("published_at"), 1, 10))
    cut = docs.agg(F.date_format(F.date_sub(newest, days), "yyyy-MM-dd").alias("_cut"))  # one row
    return docs.crossJoin(F.broadcast(cut)).withColumn("current", F.col("published_at") >= F.col("_cut")).drop("_cut")


def _mix(rows: DataFrame, category: str, metric: str) -> DataFrame:
    sizes = rows.where(F.col(category).isNotNull()).agg(F.count_if(~F.col("current")).alias("n_ref"), F.count_if("current").alias("n_cur"))
    out = stats.psi(rows, category, F.col("current")).withColumnRenamed("psi", "value").crossJoin(sizes)
    return out.select(F.lit(metric).alias("metric"), F.lit("PSI").alias("kind"), "value", F.lit(stats.PSI_MAJOR).alias("threshold"), stats.psi_verdict(F.col("value")).alias("verdict"), "n_ref", "n_cur")


def _spread(rows: DataFrame, value: str, metric: str) -> DataFrame:
    out = stats.ks(rows, value, F.col("current"))
    verdict = F.when(F.col("statistic") >= F.col("critical"), "MAJOR").otherwise("stable")
    return out.select(F.lit(metric).alias("metric"), F.lit("KS").alias("kind"), F.col("statistic").alias("value"), F.col("critical").alias("threshold"), verdict.alias("verdict"), F.col("n").alias("n_ref"), F.col("m").alias("n_cur"))


def drift_rows(m, days: int = DAYS) -> DataFrame:
    """(metric, kind, value, threshold, verdict, n_ref, n_cur), no row where either side is empty.

    Documents count by source type and length if their source is one of content, events by their
    type and score with the date of their document; null categories and values count on neither side.
    """
    docs = dated(m, days)
    content = docs.join(m.sources.where("purpose = 'content'").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    of = m.evidence.select(F.col("id").alias("evidence_id"), "document_id")
    events = m.insights.select("evidence_id", "event_type", "score").join(of, "evidence_id").join(docs.select(F.col("id").alias("document_id"), "current"), "document_id")
    parts = [
        _mix(content, "source_type", "doc source_type mix"),
        _mix(events, "event_type", "insight event_type mix"),
        _spread(content.withColumn("chars", F.length("raw_content")), "chars", "doc length"),
        _spread(events, "score", "insight score"),
    ]
    return reduce(DataFrame.unionByName, parts).where("n_ref > 0 and n_cur > 0")


def drift_report(rows: DataFrame) -> DataFrame:
    """One row (metrics, major, moderate, worst): how many metrics moved, and those that moved most, by name."""
    return rows.agg(
        F.count("*").alias("metrics"),
        F.count_if(F.col("verdict") == "MAJOR").alias("major"),
        F.count_if(F.col("verdict") == "moderate").alias("moderate"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("verdict") == "MAJOR", F.col("metric")))), ", ").alias("worst"),
    )
