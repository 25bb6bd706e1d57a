"""Labeller reliability without gold labels: binary Dawid-Skene by expectation-maximisation.

Votes stay a long table (item, labeler, vote in a/b). A round is one join of votes with the
accuracies, which are few, and two aggregations; the driver sees one number per labeller.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import materialise

LEAST, MOST, START = 0.01, 0.99, 0.7


def dawid_skene(votes: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> tuple[DataFrame, dict[str, float]]:
    """((item, posterior that a holds), accuracy by labeller).

    The posterior starts from the majority, clipped to 0.05 and 0.95. Convergence is judged on the
    accuracies, which determine the posterior.
    """
    votes = materialise(votes.where("vote in ('a', 'b')").select("item", "labeler", (F.col("vote") == "a").alias("a")), "votes")
    margin = votes.groupBy("item").agg(F.sum(F.when(F.col("a"), 1).otherwise(-1)).alias("m"))
    post = margin.select("item", F.when(F.col("m") > 0, 0.95).otherwise(0.05).alias("p"))
    acc: dict[str, float] = {}
    for _ in range(rounds):
        agree = F.when(F.col("a"), F.col("p")).otherwise(1 - F.col("p"))
        got = votes.join(post, "item").groupBy("labeler").agg(F.avg(agree).alias("v")).collect()  # a row a labeller
        new = {r.labeler: min(MOST, max(LEAST, r.v)) for r in got}
        done = bool(acc) and max(abs(new[k] - acc[k]) for k in new) < tolerance
        acc = new
        if not acc:
            break
        odds = F.create_map(*[F.lit(x) for k, v in acc.items() for x in (k, math.log(v / (1 - v)))])
        z = votes.groupBy("item").agg(F.sum(F.when(F.col("a"), odds[F.col("labeler")]).otherwise(-odds[F.col("labeler")])).alias("z"))
        post = z.select("item", (1 / (1 + F.exp(-F.col("z")))).alias("p"))
        if done:
            break
    return post.withColumnRenamed("p", "posterior"), acc
