"""Deterministic samples, ordered limits and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import natural_key
from sheaf.operators.lagged import placed
from sheaf.operators.policy import top_k
from sheaf.session import cut


def numbered(df: DataFrame, order: list[Column], out: str = "rn", rows_per_part: int = 1_000_000) -> DataFrame:
    """Row numbers from 1 over the whole table, without sorting it in one task.

    Rows are range-partitioned by the order, written once with the number of their part, and
    counted and numbered from there (bounds of ranges are sampled, so two readings of the plan would
    part the rows in two ways); each part's start is the sum of the parts before it (one row a
    part). The number of parts follows the number of rows. Rows of equal order are numbered in no
    set order and share a part: end ``order`` with a key. An empty table gives no row.
    """
    parts = max(1, -(-df.count() // rows_per_part))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    tally = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ranged = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    start = tally.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return ranged.join(F.broadcast(start), "_part").withColumn(out, F.col("_in") + F.col("_start")).drop("_part", "_in", "_start")


def every_nth(df: DataFrame, key: str, order: str, pieces: int = 10, width: int = 1 << 16) -> DataFrame:
    """Every ``max(1, n div pieces)``-th row of each key, counted from the first; ``order`` is a number, shards of it are ``width`` wide."""
    d = placed(df, [key], order, F.floor(F.col(order) / width))
    return d.where(F.col("_i") % F.greatest(F.lit(1), F.floor(F.col("_n") / pieces)) == 0).drop("_n", "_i")


def stratified(df: DataFrame, group: str, stratum: str, order: str, k: int = 3, pieces: int = 10) -> DataFrame:
    """First ``k`` rows of every stratum of a group, and every ``max(1, n div pieces)``-th row of the group; each row once."""
    head = top_k(df, [group, stratum], [F.col(order)], k)
    return head.unionByName(every_nth(df, group, order, pieces)).distinct()


def natural_order(df: DataFrame, col: str, *ties: str) -> DataFrame:
    """Sorted as people sort: 7.3.1 before 7.3.10 before A."""
    return df.orderBy(natural_key(F.col(col)), *ties)


def natural_places(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, col, place): different values of each key with their place in natural order from 1; values that sort alike share it.

    All keys are numbered in one sort over the whole table (``numbered``), so a key with a third of
    all rows is sorted by many tasks. Null keys and values are left out.
    """
    d = df.where(F.col(key).isNotNull() & F.col(col).isNotNull()).select(key, col).distinct().withColumn("_nat", natural_key(F.col(col)))
    n = numbered(d.select(key, "_nat").distinct(), [F.col(key), F.col("_nat")])
    first = n.groupBy(key).agg(F.min("rn").alias("_first"))
    return d.join(n, [key, "_nat"]).join(first, key).select(key, col, (F.col("rn") - F.col("_first") + 1).cast("int").alias("place"))


def batches(df: DataFrame, group: str, order: str, size: int, width: int = 1 << 16) -> DataFrame:
    """Adds ``batch`` numbers from 0, ``size`` rows each, within a group; ``order`` is a number."""
    return placed(df, [group], order, F.floor(F.col(order) / width)).withColumn("batch", F.floor(F.col("_i") / size).cast("int")).drop("_i", "_n")


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, first): distinct values by where they were first seen."""
    return df.groupBy(value).agg(F.min(order).alias("first"))
