"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "rankfold", extra: dict | None = None) -> SparkSession:
    """Session with the settings the operators assume (AQE on, UTC, no UI).

    On a cluster the master and most sizing come from spark-submit; only the
    SQL semantics settings below matter for correctness.
    """
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("RANKFOLD_DRIVER_MEMORY", "16g"),
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for lineage cuts and side tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only
    when neither is set (local tests) a private folder is created and
    registered, so later calls agree.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # unset: only in local tests/benches; register it so later calls agree
        d = tempfile.mkdtemp(prefix="rankfold-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder (never a machine-local tmp on a cluster)."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path in the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def session_setting(spark: SparkSession, key: str, value: str):
    """A session setting for the jobs run inside; the session's own is put back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def batch_bytes(spark: SparkSession, n: int):
    """Arrow batches of at most about ``n`` bytes for the jobs run inside."""
    return session_setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(n))


def shuffles_removed(spark: SparkSession):
    """Shuffle files go as soon as each job run inside has ended: for loops of
    large steps, each of which is written."""
    return session_setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context: their working
    directory and import path need not hold the repository."""
    sc = spark.sparkContext
    if getattr(sc, "_rankfold_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="rankfold-zip-"), "rankfold.zip")  # served by the driver from here
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(at)
    sc._rankfold_shipped = True


def materialize(df):
    """Write a model / intermediate table once to the shared folder (reliable
    checkpoint): later plans read it instead of re-deriving its lineage, and it
    survives executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str, at: str | None = None):
    """``materialize`` for tables as large as the input: columns in Parquet, a
    fraction of a checkpoint's bytes, and later plans read only the columns they use. ``at``: where, if not anywhere."""
    spark = df.sparkSession
    path = at or scratch_path(spark, name)
    with session_setting(spark, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
