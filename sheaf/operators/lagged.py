"""The row before, and the place of a row, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous(df: DataFrame, keys: list[str], order: str, payload: list[str], shard: Column, suffix: str = "_before") -> DataFrame:
    """Adds each ``payload`` column of the row before, by ``order`` within ``keys``.

    ``shard`` is a whole number that never falls as ``order`` rises. Rows look back within their
    (keys, shard); the first of each shard takes the last row of the nearest earlier shard, found
    among one row a shard. Null ``order`` sorts first. Rows of equal ``order`` must be merged before.
    """
    d = df.withColumn("_shard", shard.cast("long"))
    w = Window.partitionBy(*keys, "_shard").orderBy(order)
    pack = F.struct(*payload)
    local = d.withColumn("_before", F.lag(pack).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    tails = d.groupBy(*keys, "_shard").agg(F.max_by(pack, F.col(order)).alias("_tail"))
    along = Window.partitionBy(*keys).orderBy("_shard")
    heads = tails.select(*keys, "_shard", F.lag("_tail").over(along).alias("_carry")).where(F.col("_carry").isNotNull())
    out = local.join(heads, [*keys, "_shard"], "left")
    before = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_before"))
    return out.select(*df.columns, *[before[c].alias(c + suffix) for c in payload])


def placed(df: DataFrame, keys: list[str], order: str, shard: Column, place: str = "_i", total: str = "_n") -> DataFrame:
    """Adds each row's ``place`` from 0, by ``order`` within ``keys``, and the ``total`` of rows of its keys.

    ``shard`` is a whole number that never falls as ``order`` rises. Rows are counted within their
    (keys, shard), and each shard goes on from those before it, counted along one row a shard. Null
    keys are a key of their own; equal ``order`` is placed in no set order.
    """
    d = df.withColumn("_shard", shard.cast("long"))
    sizes = d.groupBy(*keys, "_shard").agg(F.count(F.lit(1)).alias("_c"))
    along = Window.partitionBy(*keys).orderBy("_shard")
    heads = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_shard").alias("_of"), (F.sum("_c").over(along) - F.col("_c")).alias("_start"), F.sum("_c").over(Window.partitionBy(*keys)).alias(total)
    )
    local = d.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_shard").orderBy(order)) - 1)
    same = F.col("_shard").eqNullSafe(F.col("_of"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(heads, same).withColumn(place, F.col("_at") + F.col("_start")).select(*df.columns, place, total)
