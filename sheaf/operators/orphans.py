"""References to records that do not exist: keyed pending-orphan state (problem 2).

The state of a key is its parent index (when its parents were written and deleted) and its
references, each waiting (``missing``, ``late``, ``deleted``) or settled. A batch of events changes it
step by step: new references probe the index, a parent that arrives re-probes the references waiting
for it, a deletion re-probes the settled references it may reopen. Nothing else is looked at again.

A probe asks what was written and what was still there at the time of the reference. It is two-level:
within (key, time shard) by running sums, across the shards of a key by sums of one row each, so a
key with a third of all rows is worked on by as many tasks as it has shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WRITE, _DELETE, _REFERENCE = 0, 1, 2
_INDEX = ["key", "at", "kind", "parent"]
#: References without a time are dealt out over so many shards of their own.
_TIMELESS = 64


def references(df: DataFrame, table: str, row_id: str, key: Column, at: str, *more: str) -> DataFrame:
    """Events of one referring table, with columns ``more`` beside them; null keys refer to nothing."""
    return (
        df.select(
            key.alias("key"), F.col(at).alias("at"), F.lit(_REFERENCE).alias("kind"), F.lit(None).cast("long").alias("parent"), F.lit(table).alias("tbl"), F.col(row_id).cast("long").alias("row_id"), *more
        )
        .where(F.col("key").isNotNull() & F.col("row_id").isNotNull())
    )


def parents(df: DataFrame, key: Column, written: str, deleted: str) -> DataFrame:
    """Write and delete events of the parent table, each with the identity of its parent.

    Parents of one key with equal times are one parent, so repeated rows count once; parents that
    share only the time they were deleted are two. One deleted before it was written never existed:
    it counts as written, and is gone at once.
    """
    p = df.select(key.alias("key"), F.col(written).alias("_w"), F.greatest(written, deleted).alias("_g"), F.col(deleted).alias("_d"))
    p = p.where(F.col("key").isNotNull() & F.col("_w").isNotNull()).withColumn("parent", F.xxhash64("key", "_w", "_d"))
    both = F.array(
        F.struct(F.col("_w").alias("at"), F.lit(_WRITE).alias("kind")),
        F.struct(F.when(F.col("_d").isNotNull(), F.col("_g")).alias("at"), F.lit(_DELETE).alias("kind")),
    )
    return p.select("key", "parent", F.inline(both)).where(F.col("at").isNotNull()).select(
        *_INDEX, F.lit(None).cast("string").alias("tbl"), F.lit(None).cast("long").alias("row_id")
    )


def _whole(events: DataFrame) -> DataFrame:
    """Events with all their columns; those without an identity of the parent are told apart by key, time and kind."""
    d = events if "parent" in events.columns else events.withColumn("parent", F.lit(None).cast("long"))
    return d.select(*_INDEX, "tbl", "row_id")


def fold(events: DataFrame, shard_days: int = 30) -> DataFrame:
    """(key, tbl, row_id, at, state) of every reference, as of its own time; equal events count once.

    ``state``: null if the parent exists then; ``missing`` if the key names no parent at all;
    ``late`` if every write comes after the reference; ``deleted`` if it was written by then but
    does not exist then. A write counts at its own time, a delete too (the parent is gone then). A
    reference without a time is ``missing`` or, if the key has a parent, not an orphan.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    timeless = F.lit(-1 << 40) - F.pmod(F.xxhash64("tbl", "row_id"), F.lit(_TIMELESS))
    shard = F.coalesce(F.floor(micros / F.lit(86_400_000_000 * shard_days)), timeless).cast("long")
    is_ref = (F.col("kind") == _REFERENCE).cast("int")
    written = (F.col("kind") == _WRITE).cast("long")
    step = F.when(F.col("kind") == _WRITE, 1).when(F.col("kind") == _DELETE, -1).otherwise(0).cast("long")
    # One shuffle serves the merging of equal events, the running sums and the sums of the shards.
    e = _whole(events).withColumn("shard", shard).repartition("key", "shard").dropDuplicates()
    within = Window.partitionBy("key", "shard").orderBy("at", is_ref).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = e.select("key", "shard", "at", "kind", "tbl", "row_id", F.sum(written).over(within).alias("w"), F.sum(step).over(within).alias("open"))
    sums = e.groupBy("key", "shard").agg(F.sum(written).alias("sw"), F.sum(step).alias("so"))
    along = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        "key", "shard",
        F.coalesce(F.sum("sw").over(along), F.lit(0)).alias("w0"),
        F.coalesce(F.sum("so").over(along), F.lit(0)).alias("o0"),
        F.sum("sw").over(Window.partitionBy("key")).alias("all_w"),
    )
    w, there = F.col("w") + F.col("w0"), F.col("open") + F.col("o0")
    state = (
        F.when(F.col("all_w") == 0, "missing")
        .when(F.col("at").isNull(), F.lit(None))
        .when(w == 0, "late")
        .when(there <= 0, "deleted")
    )
    return (
        local.where(F.col("kind") == _REFERENCE)
        .join(carried, ["key", "shard"])
        .select("key", "tbl", "row_id", "at", state.alias("state"))
    )


@dataclass
class OrphanState:
    """Keyed state between batches: the parent index, and every reference with its state.

    Both frames are meant to be written by the caller between batches. A reference delivered in two
    batches is kept twice, in the same state; readers merge it.
    """

    index: DataFrame
    states: DataFrame

    @classmethod
    def empty(cls, batch: DataFrame, shard_days: int = 30) -> OrphanState:
        """The state after a first batch."""
        batch = _whole(batch)
        return cls(batch.where(F.col("kind") < _REFERENCE).select(*_INDEX), fold(batch, shard_days))

    def advance(self, batch: DataFrame, shard_days: int = 30, few: int = 100_000) -> OrphanState:
        """The state after one more batch, in any order of events.

        Probed are: references of the batch; waiting ones of a key that the batch writes to; settled
        ones of a key from the first time on at which the batch deletes a parent. A batch of at most
        ``few`` keys (they are counted) has them broadcast, so that neither index nor references are
        shuffled; a larger one is joined by the key (``few=0`` for batches known to be large). ``batch``
        is read several times.
        """
        batch = _whole(batch)
        fresh = batch.where(F.col("kind") < _REFERENCE).select(*_INDEX)
        index = self.index.unionByName(fresh)
        keys = batch.select("key").distinct()
        small = few > 0 and keys.limit(few + 1).count() <= few
        touched = fresh.groupBy(F.col("key").alias("_k")).agg(
            F.max(F.col("kind") == _WRITE).alias("_writes"), F.min(F.when(F.col("kind") == _DELETE, F.col("at"))).alias("_gone_from")
        )
        known = self.states.join(F.broadcast(touched) if small else touched, F.col("key") == F.col("_k"), "left")
        due = F.when(F.col("state").isNotNull(), F.col("_writes")).otherwise(F.col("at") >= F.col("_gone_from"))
        known = known.withColumn("_due", F.coalesce(due, F.lit(False)))
        again = known.where("_due").select("key", "at", F.lit(_REFERENCE).alias("kind"), F.lit(None).cast("long").alias("parent"), "tbl", "row_id")
        probed = index.join(F.broadcast(keys), "key", "left_semi") if small else index
        probed = probed.select(*_INDEX, F.lit(None).cast("string").alias("tbl"), F.lit(None).cast("long").alias("row_id"))
        new = fold(probed.unionByName(again).unionByName(batch.where(F.col("kind") == _REFERENCE)), shard_days)
        kept = known.where(~F.col("_due")).select(*self.states.columns)
        return OrphanState(index, kept.unionByName(new))

    def open_orphans(self) -> DataFrame:
        """References that wait now, each once."""
        return self.states.where(F.col("state").isNotNull()).distinct()

    def snapshot(self) -> DataFrame:
        """References and orphans by table and month of the reference."""
        return orphan_counts(self.states.distinct())


def orphan_counts(states: DataFrame) -> DataFrame:
    """References and orphans per table and month of the reference."""
    n = lambda s: F.sum((F.col("state") == s).cast("long"))
    return (
        states.groupBy("tbl", F.date_format("at", "yyyy-MM").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("n_references"),
            *[F.coalesce(n(s), F.lit(0)).alias(f"n_{s}") for s in ("missing", "late", "deleted")],
        )
    )
