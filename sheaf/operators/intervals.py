"""Overlapping and gapped intervals: continuous periods and holes per entity (problem 4).

Two levels keep huge entities apart. Intervals are clipped to the shards of the axis in which they
begin and end; what lies between is not spelled out but carried along the shards as a depth, so an
interval is two rows, however long. Coverage is merged within (entity, shard), then what touches the
edge of a shard is stitched to the next shard that changes anything. An entity with a third of all
rows is thus worked on by many tasks, and what meets along an entity is one row a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators.lagged import previous
from sheaf.session import written


def clip(cover: DataFrame, target: DataFrame | None, keys: list[str], width: int) -> DataFrame:
    """(keys, shard, at, c, t, aimed): where the depth of ``cover`` and ``target`` changes, and by how much.

    The sums by place combine on the map side, so a shard never holds more than ``width`` rows,
    however many intervals begin or end in it.
    """

    def ends(df: DataFrame, c: int, t: int) -> DataFrame:
        d = df.where(F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("lo") <= F.col("hi")))
        change = lambda at, by: F.struct(at.cast("long").alias("at"), F.lit(c * by).alias("c"), F.lit(t * by).alias("t"))
        return d.select(*keys, F.inline(F.array(change(F.col("lo"), 1), change(F.col("hi").cast("long") + 1, -1))), F.lit(t).alias("aimed"))

    e = ends(cover, 1, 0)
    if target is not None:
        e = e.unionByName(ends(target, 0, 1))
    shard = F.floor(F.col("at") / F.lit(width)).cast("long").alias("shard")
    return e.groupBy(*keys, shard, "at").agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.max("aimed").alias("aimed"))


def merge_local(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shard, span_kind, on, at): the places of a shard at which a period or a gap begins (``on``) or has ended.

    The depth at a shard's begin is that of all shards before it, summed up along one row a shard.
    An entity with no target at all has gaps wherever nothing is covered (the ones outside its first
    and last place have no end or no begin, and vanish when runs are made).
    """
    sums = changes.groupBy(*keys, "shard").agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.max("aimed").alias("aimed"))
    along = Window.partitionBy(*keys).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *keys, "shard", F.lit(None).cast("long").alias("at"), F.coalesce(F.sum("c").over(along), F.lit(0)).alias("c"), F.coalesce(F.sum("t").over(along), F.lit(0)).alias("t"),
        F.max("aimed").over(Window.partitionBy(*keys)).alias("aimed"),
    )
    within = Window.partitionBy(*keys, "shard").orderBy(F.col("at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    d = changes.unionByName(carried).select(
        *keys, "shard", "at", F.sum("c").over(within).alias("depth"), F.sum("t").over(within).alias("wanted"), "c", "t", (F.first("aimed").over(within) > 0).alias("aimed"),
    ).where(F.col("at").isNotNull())
    depth, wanted = F.col("depth"), F.col("wanted")
    period, was_period = depth > 0, depth - F.col("c") > 0
    gap = (depth == 0) & (~F.col("aimed") | (wanted > 0))
    was_gap = (depth - F.col("c") == 0) & (~F.col("aimed") | (wanted - F.col("t") > 0))
    turn = lambda kind, now, was: F.when(now != was, F.struct(F.lit(kind).alias("span_kind"), now.alias("on")))
    return d.select(*keys, "shard", "at", F.inline(F.array_compact(F.array(turn("period", period, was_period), turn("gap", gap, was_gap)))))


def stitch(turns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, span_kind, lo, hi): every run from where it begins to where it ends, in its own shard or in the next with a turn."""
    heads = turns.groupBy(*keys, "span_kind", "shard").agg(F.min("at").alias("at"))
    following = heads.select(*keys, "span_kind", "shard", F.lead("at").over(Window.partitionBy(*keys, "span_kind").orderBy("shard")).alias("at"), F.lit(False).alias("on")).where(F.col("at").isNotNull())
    w = Window.partitionBy(*keys, "shard", "span_kind").orderBy("at")
    d = turns.select(*keys, "shard", "span_kind", "on", "at").unionByName(following).withColumn("_next", F.lead("at").over(w))
    return d.where(F.col("on") & F.col("_next").isNotNull()).select(*keys, "span_kind", F.col("at").alias("lo"), (F.col("_next") - 1).alias("hi"))


def periods(df: DataFrame, keys: list[str], width: int = 256) -> DataFrame:
    """(keys, lo, hi): longest runs of consecutive integers named by any interval [lo, hi] of the entity.

    Null or backward bounds name nothing; repeated, nested and overlapping intervals count once;
    an empty table gives no row. Null keys are an entity.
    """
    return stitch(merge_local(clip(df, None, keys, width), keys).where("span_kind = 'period'"), keys).drop("span_kind")


def periods_and_gaps(cover: DataFrame, target: DataFrame, keys: list[str], width: int = 256) -> DataFrame:
    """(keys, span_kind, lo, hi): every ``period`` of ``cover`` and every ``gap`` in ``target``.

    An entity without a target interval is held against the range from its first to its last
    covered place; one without any cover has its whole target as gaps. Null keys are an entity, too.
    """
    # Changes by place are few integers; they are written once, as the two levels read them several times.
    return stitch(merge_local(written(clip(cover, target, keys, width)), keys), keys)


def tolerant_runs(df: DataFrame, keys: list[str], place: str, gap: int, least: int, last: str | None = None) -> DataFrame:
    """(keys, lo, hi): runs of the places found, joined over at most ``gap`` missing ones, spanning ``least`` or more.

    With ``last`` a row names all places from ``place`` to it. Every find is stretched by ``gap``, so
    that runs that may join meet, and periods are cut back by as much.
    """
    found = df.select(*keys, F.col(place).cast("long").alias("lo"), (F.col(last or place).cast("long") + gap).alias("hi"))
    return periods(found, keys).select(*keys, "lo", (F.col("hi") - gap).alias("hi")).where(F.col("hi") - F.col("lo") >= least)


def merge_upwards(runs: DataFrame, keys: list[str], gap: int, narrow: int, width: int = 1 << 16) -> DataFrame:
    """(keys, lo, hi): the last run of an entity with the runs before it, as long as each is close and short.

    Going up, a run joins if at most ``gap`` places part it from the next and it spans less than
    ``narrow``; the first that does not ends the merge. Keys are not null, runs of one entity disjoint.
    """
    d = runs.select(*keys, "lo", "hi", (-F.col("lo")).alias("_down"))
    d = previous(d, keys, "_down", ["lo"], F.floor(F.col("_down") / width))
    nxt = F.col("lo_before")
    stops = nxt.isNotNull() & ((nxt - F.col("hi") > gap) | (F.col("hi") - F.col("lo") >= narrow))
    end = d.groupBy(*keys).agg(F.max(F.when(stops, F.col("lo"))).alias("_stop"))
    return d.join(end, keys).where(F.col("_stop").isNull() | (F.col("lo") > F.col("_stop"))).groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
