"""Places of rows in one order over a whole table, exact at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.session import materialise


def ranged(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with _p, the number of the range of the order that a row lies in.

    The ranges are a table in the shared folder: whoever reads it twice reads the same ranges, which
    two runs of one plan need not give.
    """
    return materialise(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows with their place in the order, from 1 on. The order should leave no ties."""
    laid = ranged(rows, *order)
    before = F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))  # one row a range
    sizes = laid.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(before, F.lit(0)).alias("_b"))
    at = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return laid.withColumn("_n", at).join(sizes, "_p").withColumn(name, F.col("_n") + F.col("_b")).drop("_p", "_n", "_b")
