"""JSON lines in and out, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_strict(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Fails on the first line that isn't a record of the schema."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """(records, findings): bad lines become findings (file, offset, line)."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("offset")).filter("trim(value) <> ''")
    parsed = raw.withColumn("r", F.from_json("value", ddl + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r._bad").isNotNull()
    names = [c.split()[0] for c in ddl.split(", ")]
    return parsed.filter(~bad).select("file", "offset", *[f"r.{n}" for n in names]), parsed.filter(bad).select("file", "offset", F.col("value").alias("line"))


def read_optional(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A missing file is an empty table."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return read_strict(spark, path, ddl) if there else spark.createDataFrame([], ddl)


def write(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One record a line, nulls left out, parts in order."""
    (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def windowed(spark: SparkSession, paths: list[str], ddl: str) -> DataFrame:
    """Records of several window folders with their window id (pages-a-b)."""
    r = spark.read.schema(ddl).json(paths).withColumn("file", F.col("_metadata.file_path"))
    return r.withColumn("window_id", F.regexp_extract("file", r"(pages-\d+-\d+)", 1))


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, sha256, bytes) of a folder's files, by name whatever its case."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).orderBy(F.lower("name"), "name")
