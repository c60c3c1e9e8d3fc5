"""Streams: orphan state kept up to date batch by batch, latest keyed state, windowed message counts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sheaf.functions.text import message_template
from sheaf.operators.orphans import OrphanState

EVENTS = "key string, at timestamp, kind int, parent bigint, tbl string, row_id bigint"
_INDEX = "key string, at timestamp, kind int, parent bigint"
_STATES = "key string, tbl string, row_id bigint, at timestamp, state string"
_COUNTS = "tbl string, month string, state string, n bigint"


class OrphanStore:
    """Orphan state in a shared folder, in buckets by a hash of the key; a batch rewrites only the buckets it touches.

    Every step writes its buckets below ``v=<step>`` and then one small file that names the step each
    bucket was last written in: with it the step counts, without it nothing has happened, so a step
    that is lost with its executor is simply repeated. Data that neither the last nor the last but
    one step names are removed. ``buckets`` must stay the same over the life of a store.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _steps(self) -> list[int]:
        at = self._path(f"{self.root}/steps")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _named(self, step: int) -> dict[int, int]:
        """Bucket to the step it was last written in."""
        text = self.spark.read.text(f"{self.root}/steps/{step:012d}.json", wholetext=True).head()[0]
        return {int(b): v for b, v in json.loads(text).items()}

    def _finish(self, step: int, named: dict[int, int]) -> None:
        final = self._path(f"{self.root}/steps/{step:012d}.json")
        temp = self._path(f"{self.root}/steps/.{step:012d}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(named).encode()))
        out.close()
        self._fs.delete(final, False)
        self._fs.rename(temp, final)

    def _read(self, kind: str, named: dict[int, int], schema: str, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{kind}/v={v}/b={b}" for b, v in named.items() if buckets is None or b in buckets]
        # A bucket without rows of this kind has no folder.
        paths = [p for p in paths if self._fs.exists(self._path(p))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str, step: int) -> None:
        bucketed = df.withColumn("b", self._bucket(F.col("key"))) if "b" not in df.columns else df
        bucketed.hint("rebalance", F.col("b")).write.partitionBy("b").mode("overwrite").parquet(f"{self.root}/{kind}/v={step}")

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def advance(self, batch: DataFrame, batch_id: int) -> None:
        """Takes in one batch of events; the same batch again gives the same step again."""
        step = batch_id + 1
        before = [v for v in self._steps() if v < step]
        named = self._named(before[-1]) if before else {}
        parent = F.col("parent") if "parent" in batch.columns else F.lit(None)
        batch = batch.select(
            "key", F.col("at").cast("timestamp").alias("at"), F.col("kind").cast("int").alias("kind"), parent.cast("long").alias("parent"), "tbl", F.col("row_id").cast("long").alias("row_id")
        ).where(F.col("key").isNotNull()).persist()
        touched = [r.b for r in batch.select(self._bucket(F.col("key")).alias("b")).distinct().collect()]  # at most one row a bucket
        old = OrphanState(self._read("index", named, _INDEX, touched), self._read("states", named, _STATES, touched))
        new = old.advance(batch)
        self._write(new.index, "index", step)
        self._write(new.states, "states", step)
        states = self.spark.read.schema(_STATES + ", b int").parquet(f"{self.root}/states/v={step}").distinct()
        self._write(states.groupBy("b", "tbl", F.date_format("at", "yyyy-MM").alias("month"), "state").agg(F.count(F.lit(1)).alias("n")), "counts", step)
        self._finish(step, named | {b: step for b in touched})
        batch.unpersist()
        if len(before) > 1:
            self._drop(before[-2], set(named.items()) | {(b, step) for b in touched})

    def _drop(self, last: int, alive: set[tuple[int, int]]) -> None:
        """Removes what the last but two step named and no later one does, and its file."""
        for b, v in set(self._named(last).items()) - alive:
            for kind in ("index", "states", "counts"):
                self._fs.delete(self._path(f"{self.root}/{kind}/v={v}/b={b}"), True)
        self._fs.delete(self._path(f"{self.root}/steps/{last:012d}.json"), False)

    def states(self) -> DataFrame:
        """Every reference with its state after the last finished step."""
        steps = self._steps()
        return self._read("states", self._named(steps[-1]) if steps else {}, _STATES).distinct()

    def snapshot(self) -> DataFrame:
        """References and orphans by table and month, added up from the counts of the buckets."""
        steps = self._steps()
        n = self._read("counts", self._named(steps[-1]) if steps else {}, _COUNTS)
        of = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}")
        return n.groupBy("tbl", "month").agg(F.sum("n").alias("n_references"), *[of(s) for s in ("missing", "late", "deleted")])


def orphan_stream(events: DataFrame, root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the orphan state of a stream of events (``EVENTS``) until no more are there."""
    return (
        events.writeStream.foreachBatch(lambda df, i: OrphanStore(df.sparkSession, root, buckets).advance(df, i))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def orphan_states(spark: SparkSession, root: str) -> DataFrame:
    """The states of the last finished step."""
    return OrphanStore(spark, root).states()


def latest_state_stream(log: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Streaming form of keyed state: the value of the latest write of each key (for update or complete output)."""
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, value)).alias("_l")).select(key, f"_l.{value}", f"_l.{at}")


def message_counts_stream(problems: DataFrame, message: str, at: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Engine extra: messages by template and time window; rows later than the watermark are left out."""
    return (
        problems.withWatermark(at, late)
        .groupBy(F.window(at, window).alias("w"), message_template(F.col(message)).alias("template"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "template", "n")
    )
