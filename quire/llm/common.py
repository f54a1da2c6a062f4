"""Shared pieces: scratch space, tables, schema helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share. The cluster names it in
    spark.checkpoint.dir; where that is unset a local one is made on a local
    master only (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not (sc.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder: the rows survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and read it again: columnar and
    compressed, for what is large or used often. It goes with the session."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Remove a stored table that nothing will read any more."""
    if files := df.inputFiles():
        _remove(df.sparkSession, files[0].rpartition("/")[0])


def released(spark: SparkSession) -> None:
    """Shuffle files of plans that nobody holds any more go now, not when the
    driver next happens to collect its garbage. The queues of the listener bus
    hold the last event until another comes, and the end of a query has its
    plan: a job without tasks comes after it. The cleaner runs beside the
    driver: this waits until it has had nothing to do for a second, 10 at most."""
    import gc
    import time

    from py4j.protocol import Py4JJavaError

    jsc = spark.sparkContext._jsc
    jsc.emptyRDD().count()
    try:
        jsc.sc().listenerBus().waitUntilEmpty()
    except Py4JJavaError:  # it lags by more than 10 seconds: some files go later
        pass
    gc.collect()
    spark._jvm.System.gc()
    known = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    left, still, until = known.size(), 0, time.monotonic() + 10
    while still < 4 and time.monotonic() < until:
        time.sleep(0.25)
        now = known.size()
        left, still = now, still + 1 if now == left else 0


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


CACHES: list[dict] = []  # bounded per-worker caches of the operators


def release_caches() -> None:
    """Workers are reused: what operators cached there is dropped, and what was
    freed is given back."""
    import ctypes
    import gc

    import pyarrow as pa

    for cache in CACHES:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def giving_back(run):
    """`run`, a function of a task's batches, between two release_caches: idle
    workers, of which an executor may have more than cores, hold little."""

    def task(batches):
        release_caches()
        try:
            yield from run(batches)
        finally:
            release_caches()

    return task


def slices(batches, rows: int = 1000):
    """Smaller Arrow batches: what a task unpacks at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes; together a 128-bit key."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(1779033703), *cols)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
