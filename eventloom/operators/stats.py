"""Drift, agreement and rank statistics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import ranged

FLOOR = 1e-4  # share of a category that one side lacks
PSI_MODERATE, PSI_MAJOR = 0.10, 0.25
KS_COEFFICIENT = 1.358


def psi(rows: DataFrame, category: str, current: Column) -> DataFrame:
    """One row (psi): population stability of the category between current rows and the others."""
    counts = rows.where(F.col(category).isNotNull()).groupBy(category).agg(F.count_if(~current).alias("_r"), F.count_if(current).alias("_c"))
    totals = counts.agg(F.greatest(F.sum("_r"), F.lit(1)).alias("rn"), F.greatest(F.sum("_c"), F.lit(1)).alias("cn"))
    p, q = F.greatest(F.col("_r") / F.col("rn"), F.lit(FLOOR)), F.greatest(F.col("_c") / F.col("cn"), F.lit(FLOOR))
    return counts.crossJoin(F.broadcast(totals)).agg(F.coalesce(F.sum((q - p) * F.log(q / p)), F.lit(0.0)).alias("psi"))


def psi_verdict(value: Column) -> Column:
    return F.when(value >= PSI_MAJOR, "MAJOR").when(value >= PSI_MODERATE, "moderate").otherwise("stable")


def ks(rows: DataFrame, value: str, current: Column) -> DataFrame:
    """One row (n, m, statistic, critical): two-sample Kolmogorov-Smirnov.

    Values are counted first, ties as one; the running sums go partition by partition of value
    ranges, so no task holds all values. An empty side gives (0, infinity).
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(~current).alias("r"), F.count_if(current).alias("c"))
    laid = ranged(counts, "v")
    parts = laid.groupBy("_p").agg(F.sum("r").alias("pr"), F.sum("c").alias("pc"))
    w = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    before = parts.select("_p", F.coalesce(F.sum("pr").over(w), F.lit(0)).alias("br"), F.coalesce(F.sum("pc").over(w), F.lit(0)).alias("bc"))
    totals = parts.agg(F.sum("pr").alias("n"), F.sum("pc").alias("m"))
    own = W.partitionBy("_p").orderBy("v")
    run = laid.join(before, "_p").select((F.sum("r").over(own) + F.col("br")).alias("fr"), (F.sum("c").over(own) + F.col("bc")).alias("fc"))
    gap = F.max(F.abs(F.col("fr") / F.nullif(F.col("n"), F.lit(0)) - F.col("fc") / F.nullif(F.col("m"), F.lit(0))))
    out = run.crossJoin(F.broadcast(totals)).groupBy("n", "m").agg(gap.alias("g"))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    both = (F.col("n") > 0) & (F.col("m") > 0)
    return out.select("n", "m", F.when(both, F.col("g")).otherwise(0.0).alias("statistic"), F.when(both, KS_COEFFICIENT * F.sqrt((n + m) / F.nullif(n * m, F.lit(0.0)))).otherwise(F.lit(float("inf"))).alias("critical"))


def kappa(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, observed, expected, kappa) of two labellers' categories; NaN if chance explains all."""
    n = pairs.count()
    both = pairs.groupBy(x, y).agg(F.count("*").alias("k"))
    px = both.groupBy(F.col(x).alias("c")).agg(F.sum("k").alias("a"))
    py = both.groupBy(F.col(y).alias("c")).agg(F.sum("k").alias("b"))
    expected = px.join(py, "c").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("e"))
    observed = both.agg(F.coalesce(F.sum(F.when(F.col(x) == F.col(y), F.col("k"))), F.lit(0)).alias("o"))
    out = observed.crossJoin(expected).select(F.lit(n).cast("long").alias("n"), (F.col("o") / n).alias("observed") if n else F.lit(None).cast("double").alias("observed"), (F.col("e") / (n * n)).alias("expected") if n else F.lit(None).cast("double").alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") == 1, F.lit(float("nan"))).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def kappa_reading(value: Column) -> Column:
    return F.when(F.isnan(value), "undefined").when(value < 0.2, "slight").when(value < 0.4, "fair").when(value < 0.6, "moderate").when(value < 0.8, "substantial").otherwise("almost perfect")


def net_wins(pairs: DataFrame) -> DataFrame:
    """(event, net) of pairs (event_a, event_b, winner): wins less losses; a tie keeps both at 0."""
    sides = F.array(
        F.struct(F.col("event_a").alias("event"), F.when(F.col("winner") == "a", 1).when(F.col("winner") == "b", -1).otherwise(0).alias("d")),
        F.struct(F.col("event_b").alias("event"), F.when(F.col("winner") == "b", 1).when(F.col("winner") == "a", -1).otherwise(0).alias("d")),
    )
    return pairs.select(F.explode(sides).alias("s")).groupBy(F.col("s.event").alias("event")).agg(F.sum("s.d").cast("long").alias("net"))


def pairwise_accuracy(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """One row (n, accuracy) over decided pairs; equal scores count as a vote for b."""
    decided = pairs.where("winner <> 'tie'")
    a, b = scores.select(F.col("event").alias("event_a"), F.col("score").alias("sa")), scores.select(F.col("event").alias("event_b"), F.col("score").alias("sb"))
    right = F.when(F.col("sa") > F.col("sb"), "a").otherwise("b") == F.col("winner")
    return decided.join(a, "event_a").join(b, "event_b").agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def precision_at_k(scores: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """One row (precision): positive net among the k best-scored labelled events."""
    top = scores.join(gold, "event").orderBy(F.desc("score"), "event").limit(k)
    return top.agg(F.avg((F.col("net") > 0).cast("double")).alias("precision"))


def ndcg_at_k(scores: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """One row (ndcg) with gain max(0, net); null without any gain."""
    gain = F.greatest(F.lit(0), "net")

    def dcg(rows: DataFrame, order: list) -> DataFrame:
        at = F.row_number().over(W.orderBy(*order))  # over k rows
        return rows.orderBy(*order).limit(k).withColumn("i", at).agg(F.sum(gain / F.log2(F.col("i") + 1)).alias("v"))

    got = dcg(scores.join(gold, "event"), [F.desc("score"), F.asc("event")])
    best = dcg(gold, [F.desc("net"), F.asc("event")])
    return got.crossJoin(best.withColumnRenamed("v", "w")).select(F.when(F.col("w") > 0, F.col("v") / F.col("w")).alias("ndcg"))


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z-scores by the population's deviation; a constant column becomes 0."""
    stats = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return rows.crossJoin(F.broadcast(stats)).withColumns(z).select(*rows.columns)
