"""Session helpers shared by the entry point, the tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-node session; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


TASK_BYTES = 4 << 20  # of a table's files, for each partition of parts()


def parts(whole: DataFrame) -> int:
    """Partitions for rows of a table: they grow with its files, so that what
    a task sorts doesn't. repartition() to a number isn't coalesced, either."""
    size = int(whole._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return max(whole.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
