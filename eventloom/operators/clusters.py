"""Clusters of near-duplicate claims: prefix-filtered candidates, exact Jaccard, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import jaccard
from eventloom.session import materialise

from .order import numbered


def similar_pairs(claims: DataFrame, threshold: float, block: str, id_col: str, tokens: str) -> DataFrame:
    """(a, b, jaccard) of pairs within a block at or above the threshold.

    Only the rarest n - ceil(t n) + 1 tokens of each claim are joined on, and only claims whose
    sizes allow the threshold: two sets that reach it share one of them. Rarity is counted over all claims.
    """
    own = claims.select(F.col(block).alias("k"), F.col(id_col).alias("id"), F.array_distinct(tokens).alias("t")).where(F.size("t") > 0)
    df = own.select("k", F.explode("t").alias("w")).groupBy("k", "w").agg(F.count("*").alias("df"))
    ranked = own.select("k", "id", F.explode("t").alias("w")).join(df, ["k", "w"]).groupBy("k", "id").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("r"))
    length = F.size("r") - F.ceil(threshold * F.size("r") - 1e-9) + 1
    prefix = ranked.select("k", "id", F.size("r").alias("n"), F.explode(F.slice("r", F.lit(1), length.cast("int"))).alias("x")).select("k", "id", "n", F.col("x.w").alias("w"))
    a, b = (prefix.withColumnsRenamed({"id": x, "n": f"n{x}"}) for x in "ab")
    sizes = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    pairs = a.join(b, ["k", "w"]).where((F.col("a") < F.col("b")) & sizes).select("a", "b").distinct()
    left, right = own.select(F.col("id").alias("a"), F.col("t").alias("ta")), own.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("jaccard")).where(F.col("jaccard") >= threshold)


def min_label(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): every node with the smallest id of its component.

    Labels jump to their own label's label after each round of taking the least neighbour, so the
    rounds grow with the logarithm of the diameter; they go on until no label changes. Each round's
    table is cut off in the shared folder.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "pairs")
    labels = materialise(nodes.select("id", F.col("id").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("root", F.coalesce("m", "root")).alias("root"), F.col("root").alias("was"))
        low = materialise(low, "labels")
        jump = low.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = materialise(low.join(jump, "root").select("id", F.least("root", "up").alias("root"), "was"), "labels")
        if not new.where("root <> was").limit(1).count():
            return new.select("id", "root")
        labels = new.select("id", "root")


def cluster_claims(claims: DataFrame, threshold: float = 0.4, block: str = "event_type", id_col: str = "id", tokens: str = "tokens") -> DataFrame:
    """(id, cluster_id): clusters within a block, numbered by their smallest member.

    Claims of equal token sets are one while pairs are sought, so that copies make no pairs.
    """
    own = claims.select(F.col(id_col).alias("id"), F.col(block).alias("block"), F.array_sort(F.array_distinct(tokens)).alias("tokens"))
    some = own.where(F.size("tokens") > 0)
    sets = materialise(some.groupBy("block", "tokens").agg(F.min("id").alias("id")), "sets")
    copies = some.join(sets.withColumnRenamed("id", "b"), ["block", "tokens"]).where("id <> b").select(F.col("id").alias("a"), "b")
    pairs = materialise(similar_pairs(sets, threshold, "block", "id", "tokens").select("a", "b").unionByName(copies), "similar")
    roots = min_label(pairs, own.select("id"))
    order = numbered(roots.select("root").distinct(), "cluster_id", "root").select("root", F.col("cluster_id").cast("long"))
    return roots.join(order, "root").select("id", "cluster_id")


def jaccard_cells(rows: DataFrame, keys: list[str], key: str, tokens: str) -> DataFrame:
    """(cell, n): pairs of rows of equal keys and different key, by the overlap of their token sets to one decimal.

    Rows of one token set are one class, and classes are paired, not rows: copies cost nothing, and what is left is the square
    of the different sets under equal keys. A null array of tokens has no overlap, a null cell. Nulls in keys or key pair with nothing.
    """
    own = rows.dropna(subset=[*keys, key]).select(*keys, key, F.coalesce(F.array_sort(F.array_distinct(tokens)), F.array().cast("array<string>")).alias("t"), F.col(tokens).isNull().alias("none"))

    def cells(part: DataFrame, by: list[str], sign: int) -> DataFrame:
        sets = part.groupBy(*by, "none", "t").agg(F.count("*").alias("n"))
        a, b = (sets.withColumnsRenamed({"t": f"t{x}", "n": f"n{x}", "none": f"none{x}"}) for x in "ab")
        ahead = F.struct("nonea", "ta") <= F.struct("noneb", "tb")
        same = (F.col("nonea") == F.col("noneb")) & (F.col("ta") == F.col("tb"))
        pairs = F.when(same, F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
        cell = F.when(~F.col("nonea") & ~F.col("noneb"), F.bround(jaccard(F.col("ta"), F.col("tb")), 1))
        return a.join(b, by).where(ahead).groupBy(cell.alias("cell")).agg(F.sum(pairs * sign).alias("n"))

    twice = own.groupBy(*keys, key).count().where("count > 1").select(*keys, key)  # rows of one key, which are no pairs
    both = cells(own, keys, 1).unionByName(cells(own.join(twice, [*keys, key], "left_semi"), [*keys, key], -1))
    return both.groupBy("cell").agg(F.sum("n").alias("n")).where("n > 0")
