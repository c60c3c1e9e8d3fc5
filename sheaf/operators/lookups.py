"""As-of lookups, exploding with a fallback, and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, point: str, forward: bool, width: int = 1024) -> DataFrame:
    """Union of both sides, sorted by place within (keys, shard); the nearest point is carried to each left row.

    No inequality join: the work is one shuffle and one sort, however many pairs match. Shards are
    ``width`` places wide, so a key with a third of all rows is shared out; where a shard has no point
    on the near side, that of the nearest shard with one is taken, found along one row a shard. A null
    place finds nothing. Places are numbers.
    """
    pack = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), pack.alias("_row"), F.lit(None).cast(right.schema[point].dataType).alias("_pt"))
    r = right.select(*keys, F.col(point).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(point).alias("_pt")).where(F.col("_at").isNotNull()).distinct()
    u = l.unionByName(r).withColumn("_shard", F.floor(F.col("_at") / F.lit(width)).cast("long"))
    ends = u.groupBy(*keys, "_shard").agg((F.min("_pt") if forward else F.max("_pt")).alias("_pt"))
    along = Window.partitionBy(*keys).orderBy(F.col("_shard").desc() if forward else F.col("_shard"))
    carried = ends.select(
        *keys, F.lit(None).cast(u.schema["_at"].dataType).alias("_at"), F.lit(2).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"),
        F.last("_pt", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_pt"), "_shard",
    ).where(F.col("_shard").isNotNull() & F.col("_pt").isNotNull())
    # At one place: backward takes the point there, strict forward does not. What is carried comes first.
    order = [F.col("_at").desc_nulls_first(), F.col("_side")] if forward else [F.col("_at").asc_nulls_first(), F.col("_side").desc()]
    w = Window.partitionBy(*keys, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return u.unionByName(carried).withColumn("found", F.when(F.col("_at").isNotNull(), F.last("_pt", ignorenulls=True).over(w))).where("_side = 0")


def next_after(left: DataFrame, right: DataFrame, keys: list[str], at: str, point: str) -> DataFrame:
    """Each left row with ``found``: the smallest point of its keys that is greater than ``at``, or null."""
    return _asof(left, right, keys, at, point, True).select("_row.*", "found")


def last_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, point: str, fallback_first: bool = True) -> DataFrame:
    """Each left row with ``found``: the greatest point at or before ``at``; else the first point of its keys, or null."""
    d = _asof(left, right, keys, at, point, False)
    if fallback_first:
        first = right.where(F.col(point).isNotNull()).groupBy(*keys).agg(F.min(point).alias("_first"))
        d = d.join(first, keys, "left").withColumn("found", F.when(F.col("_at").isNotNull(), F.coalesce("found", "_first")))
    return d.select("_row.*", "found")


def explode_or(df: DataFrame, col: str, fallback: Column, out: str) -> DataFrame:
    """One row per element; one row with the fallback where the array is null or empty."""
    return df.withColumn(out, F.explode(F.when(F.size(F.coalesce(F.col(col), F.array().cast(df.schema[col].dataType))) > 0, F.col(col)).otherwise(F.array(fallback))))


def flatten_tree(nodes: DataFrame, node: str, parent: str, most_levels: int = 100) -> DataFrame:
    """(node, level, path) of every node reachable from a root (null parent); level is the true depth from 1.

    ``path`` holds the whole ids from the root on, parted by slashes. A recursive query; cycles, and
    trees of more than ``most_levels`` levels, end it with an error.
    """
    edges = nodes.select(F.col(node).alias("id"), F.col(parent).alias("parent"))
    return nodes.sparkSession.sql(
        """WITH RECURSIVE walk(id, level, path) MAX RECURSION LEVEL {most} AS (
      SELECT id, 1, CAST(id AS STRING) FROM {edges} WHERE parent IS NULL
      UNION ALL SELECT t.id, level + 1, concat(path, '/', CAST(t.id AS STRING)) FROM {edges} t JOIN walk ON t.parent = walk.id
    ) SELECT id, level, path FROM walk""".replace("{most}", str(int(most_levels))),
        edges=edges,
    ).withColumnRenamed("id", node)


def nearest_right(words: DataFrame, keys: list[str], x: str, line: str) -> DataFrame:
    """Each positioned word with ``next_x``, the start of the next word to its right in the same line."""
    return words.withColumn("next_x", F.lead(x).over(Window.partitionBy(*keys, line).orderBy(x)))


def line_boxes(words: DataFrame, keys: list[str], x0: str, y0: str, x1: str, y1: str, word: str) -> DataFrame:
    """Bounding box and text of the words of each line, from left to right."""
    return words.groupBy(*keys).agg(
        F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(x0, word))), lambda s: s[word]), " ").alias("text"),
    )
