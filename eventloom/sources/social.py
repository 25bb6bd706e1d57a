"""Posts of tracked accounts from fetched pages, under per-account, per-run and money limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POST = "id STRING, handle STRING, url STRING, created_at STRING, text STRING"


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of JSON files {posts: [...]} under a path."""
    return spark.read.schema(f"source STRING, n INT, posts ARRAY<STRUCT<{POST.replace(' STRING', ': STRING')}>>").option("multiLine", True).json(path).select(F.explode("posts").alias("p")).select("p.*")


def within_limits(posts: DataFrame, per_account: int, per_run: int) -> DataFrame:
    """The newest posts of each account, the accounts taken in turns up to the run's limit."""
    turn = F.row_number().over(W.partitionBy("handle").orderBy(F.desc("created_at"), F.desc("id")))
    return posts.withColumn("_turn", turn).where(F.col("_turn") <= per_account).orderBy("_turn", "handle").limit(per_run).drop("_turn")


def worst_case_usd(accounts: int, per_account: int, per_run: int, usd_per_post: float, budget_usd: float) -> float:
    """The most a run can cost; raises if that is over the budget."""
    usd = min(accounts * per_account, per_run) * usd_per_post
    if usd > budget_usd:
        raise ValueError(f"a run may cost {usd:.2f}, over the budget of {budget_usd:.2f}")
    return usd


def post_document(handle: Column, url: Column, text: Column) -> Column:
    """A post as a stored document: two header lines, then the text."""
    return F.concat(F.lit("@"), handle, F.lit("\n"), url, F.lit("\n"), text)


def post_key(url: Column) -> Column:
    """struct<handle, id> of a post's url; nulls where it is none."""
    pattern = r"^https?://[^/]+/([^/]+)/status/(\d+)"
    part = lambda i: F.nullif(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.struct(part(1).alias("handle"), part(2).alias("id"))
