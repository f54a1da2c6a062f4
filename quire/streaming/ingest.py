"""Streaming forms: windows of pages as files arrive, progress over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def page_stream(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    """Window folders as they arrive, each record with its file's window."""
    s = spark.readStream.schema(ddl).option("recursiveFileLookup", "true").json(folder)
    return s.withColumn("window_id", F.regexp_extract(F.col("_metadata.file_path"), r"(pages-\d+-\d+)", 1))


def keep_latest(batch: DataFrame, target: str, key: list[str], order: str) -> None:
    """Merge a micro-batch into a Parquet table by key: the latest record of a
    key stays. A batch writes a fresh version folder and then the pointer, so
    a retry of the batch is harmless."""
    spark = batch.sparkSession
    pointer = f"{target}/_current"
    old = spark.read.text(pointer).first()[0] if _exists(spark, pointer) else None
    rows = batch if old is None else spark.read.schema(batch.schema).parquet(f"{target}/{old}").unionByName(batch)
    latest = rows.groupBy(*key).agg(F.max_by(F.struct("*"), F.col(order)).alias("r")).select("r.*")
    version = f"v{int(old[1:]) + 1 if old else 0}"
    latest.write.mode("overwrite").parquet(f"{target}/{version}")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(pointer)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def ingest(stream: DataFrame, target: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda b, _: keep_latest(b, target, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(events: DataFrame, minutes: int = 60, lateness: str = "2 hours") -> DataFrame:
    """Events by type and tumbling window; works on a stream and on a table.
    `ts` is cast first, watermarks need a zoned timestamp."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    w = e.groupBy(F.window("at", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.unix_seconds("window.start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))
