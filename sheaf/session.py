"""Session helper and the few settings every operator relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "sheaf", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and Arrow transfer.

    Nothing is forced onto a session that a cluster has already built: settings
    given here apply only where this call creates the session.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only where none is set and all runs on this machine (tests)."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix=f"sheaf-{os.getpid()}-")
    sc.setCheckpointDir(named)
    return named


def cut(df):
    """Write ``df`` once to the shared checkpoint folder and read it back from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, *partitions: str):
    """Write ``df`` as a table to a folder of its own in the shared checkpoint folder and read it from there."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/sheaf-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df):
    """A scanned table in at least as many partitions as there are cores.

    For work that costs much a byte: a table of fewer files than cores is dealt out once; any larger
    one is left as its files are split. ``df`` must be a plain scan (its plan is looked at here).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a context, for functions that run there in Python."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_sheaf_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sheaf-"), "sheaf.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._sheaf_shipped = True
