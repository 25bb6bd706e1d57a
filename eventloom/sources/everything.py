"""All configured sources in one plan: what each shows and adds is counted as it is read, and one that fails does not fail the others."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.sinks import first_by_key
from eventloom.session import materialise

ITEM = "url string, raw_content string, published_at string"


def ingest_all(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new documents, log) of sources, name to a function that gives rows of `ITEM`, against stored (content_hash).

    New documents (source, url, raw_content, published_at, content_hash) are those whose content is not stored; of equal
    ones that of the first source, then of the least url, stays. log: (source, status, seen, new, detail), status
    being ok, empty or error. A source whose function or schema fails is logged and left out. The others are read
    once, by one job; a counter beside each branch of the plan says what it showed.
    """
    parts, seen, failed = [], {}, {}
    for place, (name, load) in enumerate(sources.items()):
        try:
            rows = load().select("url", "raw_content", F.col("published_at").cast("string").alias("published_at")).where("raw_content is not null")
        except (PySparkException, OSError, ValueError) as e:
            failed[name] = str(e)[:200]
            continue
        seen[name] = Observation(f"source {place}")
        parts.append(rows.select(F.lit(place).alias("_s"), F.lit(name).alias("source"), "*").observe(seen[name], F.count(F.lit(1)).alias("n")))
    empty = spark.createDataFrame([], f"_s int, source string, {ITEM}")
    rows = reduce(DataFrame.unionByName, parts, empty).withColumn("content_hash", F.sha2("raw_content", 256)).withColumn("_o", F.struct("_s", "url"))
    first = first_by_key(rows, ["content_hash"], "_o")
    new = materialise(first.join(stored.select("content_hash").distinct(), "content_hash", "left_anti").select("source", "url", "raw_content", "published_at", "content_hash"), "documents")
    added = {r.source: r["count"] for r in new.groupBy("source").count().collect()}
    log = [(name, "error", 0, 0, failed[name]) if name in failed else (name, "ok" if (n := seen[name].get["n"]) else "empty", n, added.get(name, 0), None) for name in sources]
    return new, spark.createDataFrame(log, "source string, status string, seen long, new long, detail string")
