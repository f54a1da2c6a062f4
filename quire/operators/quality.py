"""Contracts, findings, statuses, gates and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEVERITY = {name: rank for rank, name in enumerate(("error", "warning", "info"))}


def missing_refs(refs: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """References (keys) without a record."""
    return refs.join(records.select(*keys).distinct(), keys, "left_anti")


def mismatched_refs(refs: DataFrame, records: DataFrame, keys: list[str], field: str, tolerance: float = 0.0) -> DataFrame:
    """References whose field differs from their record's."""
    known = records.select(*keys, F.col(field).alias("actual"))
    return refs.join(known, keys).filter(F.abs(F.col(field) - F.col("actual")) > tolerance)


def duplicate_ids(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All but the first record of an id."""
    w = Window.partitionBy(*keys).orderBy(order)
    return records.withColumn("nth", F.row_number().over(w)).filter("nth > 1")


def check(records: DataFrame, record_id: str, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """Findings (severity, code, field, record_id) of all rules (severity,
    code, field, violated) in one pass over the records."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.lit(f).alias("field"))) for s, c, f, bad in rules]))
    return records.select(F.col(record_id).cast("string").alias("record_id"), F.explode(hits).alias("x")).select("x.*", "record_id")


def severity_rank(c: str = "severity") -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col(c)), F.lit(9))


def by_severity(findings: DataFrame, key: str) -> DataFrame:
    """Counts by severity and the overall status of each key."""
    g = findings.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY])
    return g.withColumn("status", F.when(F.col("error") > 0, "failed").when(F.col("warning") > 0, "warning").otherwise("passed"))


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def page_status(pages: DataFrame, warnings: DataFrame, keys: list[str]) -> DataFrame:
    """Pages with their number of warnings: success with any becomes partial."""
    n = warnings.groupBy(*keys).agg(F.count("*").alias("warnings"))
    p = pages.join(n, keys, "left").withColumn("warnings", F.coalesce("warnings", F.lit(0)))
    return p.withColumn("status", F.when((F.col("status") == "success") & (F.col("warnings") > 0), "partial").otherwise(F.col("status")))


def job_status(pages: DataFrame, keys: list[str]) -> DataFrame:
    status = F.when(F.bool_and(F.col("status") == "failed"), "failed").when(F.bool_or(F.col("status") != "success"), "partial").otherwise("success")
    j = pages.groupBy(*keys).agg(status.alias("status"), F.count("*").alias("n_pages"))
    return j.withColumn("exit_code", F.when(F.col("status") == "success", 0).otherwise(2))


def hotspots(signatures: DataFrame) -> DataFrame:
    """Counts by category and by (adapter, domain) in one pass."""
    return signatures.groupingSets([["category"], ["adapter", "domain"]], "category", "adapter", "domain").agg(F.count("*").alias("signatures"), F.sum("documents").alias("documents"))


def signatures(failures: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """Failures of one kind, with the number of documents and a stable id."""
    ident = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256)
    return failures.groupBy(*keys).agg(F.countDistinct(doc).alias("documents"), F.count("*").alias("failures")).withColumn("signature_id", F.left(ident, F.lit(16)))


def trend(baseline: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    b = baseline.select(key, F.col(value).alias("baseline"))
    c = current.select(key, F.col(value).alias("current"))
    return b.join(c, key, "full_outer").withColumn("status", F.when(F.col("baseline").isNull(), "added").when(F.col("current").isNull(), "resolved").otherwise("persisting"))


def metric_groups(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """avg, min and max by group and metric."""
    long = df.select(group, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(group, metrics, "metric", "value").filter("value is not null")
    return long.groupBy(group, "metric").agg(F.round(F.avg("value"), 4).alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))


def regressions(baseline: DataFrame, current: DataFrame, key: list[str], value: str, tolerance: float = 0.2, higher_is_worse: bool = True) -> DataFrame:
    """Rows whose value is worse than the baseline's by more than tolerance."""
    b = baseline.select(*key, F.col(value).alias("baseline"))
    j = current.select(*key, F.col(value).alias("current")).join(b, key)
    worse = F.col("current") > F.col("baseline") * (1 + tolerance) if higher_is_worse else F.col("current") < F.col("baseline") * (1 - tolerance)
    return j.filter((F.col("baseline") > 0) & worse)


def leaves(df: DataFrame, record_id: str, json: str, pattern: str) -> DataFrame:
    """Values of JSON objects that match a pattern, with their field."""
    kv = df.select(record_id, F.explode(F.from_json(json, "map<string,string>")).alias("field", "value"))
    return kv.filter(F.col("value").rlike(pattern))


def expectation_failures(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected minimum counts that aren't reached; missing counts are 0."""
    return expected.join(actual, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < least_n")
