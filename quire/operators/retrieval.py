"""Lexical retrieval over chunks, its metrics and its gates."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import giving_back, slices
from ..functions.text import tokens

POSTINGS = 2_000_000  # query postings that are sent to all tasks
HITS = 1 << 20  # that a task counts at a time, and those of one more chunk


def retrieval_text(embedding: str = "embedding_text", text: str = "text"):
    return F.coalesce(F.when(F.trim(embedding) != "", F.col(embedding)), F.col(text), F.lit(""))


def retrieve(chunks: DataFrame, queries: DataFrame, k: int = 5, most: int = POSTINGS) -> DataFrame:
    """Top k chunks by query. chunks: chunk_id, text, priority; queries:
    query_id, query. Score = shared tokens + their share of the chunk's tokens
    + priority / 1000, ties to the smaller chunk_id.

    Up to `most` (token, query) postings are counted, sent to all tasks, and
    every task keeps its own top k while it reads the chunks: a token that all
    chunks have costs no shuffle. Beyond that both sides are equi-joined on
    tokens, which is skewed by common ones but has no bound."""
    q = queries.select("query_id", F.explode(tokens("query")).alias("token"))
    c = chunks.select("chunk_id", "priority", tokens("text").alias("tok")).withColumn("n_tok", F.size("tok"))
    whole = {"bigint", "int", "smallint", "tinyint"}  # other ids are joined
    postings = q.limit(most + 1).toArrow() if {dict(chunks.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]} <= whole else None
    if postings is not None and postings.num_rows <= most:
        scored = _scanned(c, postings, k)
    else:
        hits = c.select("chunk_id", "priority", "n_tok", F.explode("tok").alias("token")).join(q, "token")
        shared = hits.groupBy("query_id", "chunk_id", "n_tok", "priority").agg(F.count("*").alias("shared"))
        scored = shared.withColumn("score", F.col("shared") + F.col("shared") / F.col("n_tok") + F.coalesce("priority", F.lit(0)) / 1000.0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def _scanned(chunks: DataFrame, postings, k: int) -> DataFrame:
    """(query_id, chunk_id, score): the k best of each task and query."""
    import numpy as np

    ids, code = np.unique(postings.column(0).to_numpy(), return_inverse=True)
    lists: dict[str, list[int]] = {}
    for token, i in zip(postings.column(1).to_pylist(), code.tolist()):
        lists.setdefault(token, []).append(i)
    shared = chunks.sparkSession.sparkContext.broadcast((ids, {t: np.array(x, dtype=np.int64) for t, x in lists.items()}))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, lists = shared.value
        best = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]

        def merged(batch, rows: list, found: list) -> list:
            pair, count = np.unique(np.concatenate(found) * np.int64(batch.num_rows) + np.concatenate(rows), return_counts=True)
            q, r = pair // batch.num_rows, pair % batch.num_rows
            n = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)[r]
            priority = np.nan_to_num(batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64))[r]
            mine = [q, batch.column(0).to_numpy(zero_copy_only=False)[r], count + count / n + priority / 1000.0]
            q, c, s = (np.concatenate(x) for x in zip(best, mine))
            order = np.lexsort((c, -s, q))
            q, c, s = q[order], c[order], s[order]
            first = np.concatenate([[True], q[1:] != q[:-1]])
            place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
            return [x[place < k] for x in (q, c, s)]

        for batch in slices(batches, 1000):
            rows, found, held = [], [], 0
            for i, tok in enumerate(batch.column(2).to_pylist()):
                hit = [lists[t] for t in tok or () if t in lists]
                if hit:
                    found.append(np.concatenate(hit))
                    rows.append(np.full(len(found[-1]), i))
                    held += len(found[-1])
                if held > HITS:
                    best, rows, found, held = merged(batch, rows, found), [], [], 0
            if rows:
                best = merged(batch, rows, found)
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]].astype(np.int64)), pa.array(best[1]), pa.array(best[2])], ["query_id", "chunk_id", "score"])

    return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.coalesce("priority", F.lit(0)).cast("double").alias("priority"), "tok", "n_tok").mapInArrow(giving_back(run), "query_id long, chunk_id long, score double")


def query_metrics(found: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """hit@k, mean reciprocal rank and covered share, one row. found:
    query_id, source_id, rank; relevant: query_id, source_id."""
    hit = found.join(relevant, ["query_id", "source_id"]).groupBy("query_id").agg(F.min("rank").alias("first"), F.countDistinct("source_id").alias("covered"))
    expected = relevant.groupBy("query_id").agg(F.countDistinct("source_id").alias("expected"))
    per = queries.select("query_id").join(expected, "query_id", "left").join(hit, "query_id", "left")
    return per.agg(
        F.count("*").alias("query_count"),
        F.round(F.avg(F.col("first").isNotNull().cast("int")), 4).alias("hit_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.coalesce(F.sum("covered"), F.lit(0)) / F.greatest(F.sum("expected"), F.lit(1)), 4).alias("coverage"),
    )


def chunk_metrics(chunks: DataFrame, target: int = 512) -> DataFrame:
    """Intrinsic metrics of chunks (token_estimate, source_key). The 95th
    percentile is the exact order statistic at the half-even rounded index; it
    comes from counts by length, not from a collected list."""
    sized = chunks.select(F.coalesce("token_estimate", F.lit(0)).alias("tok"), "source_key")
    lengths = sized.groupBy("tok").agg(F.count("*").alias("n"))
    upto = lengths.withColumns({"cum": F.sum("n").over(Window.orderBy("tok")), "all": F.sum("n").over(Window.partitionBy())})  # a row a length
    p95 = upto.filter(F.col("cum") > F.bround((F.col("all") - 1) * 0.95)).agg(F.min("tok").alias("token_p95"))
    one = sized.agg(
        F.count("*").alias("chunk_count"), F.max("tok").alias("token_max"), F.round(F.avg("tok"), 2).alias("token_avg"), F.count_if(F.col("tok") > target).alias("over_target"),
        F.round(F.avg((F.col("tok") <= target).cast("int")), 4).alias("compliance"), (F.count("source_key") - F.countDistinct("source_key")).alias("duplicate_sources"),
        F.round((F.count("source_key") - F.countDistinct("source_key")) / F.greatest(F.count("source_key"), F.lit(1)), 4).alias("duplicate_ratio"),
    )
    both = one.unionByName(p95, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def calibrate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Failures of thresholds (metric, direction min|max, bound) against one
    row of metrics; a metric that is missing fails."""
    long = metrics.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in metrics.columns]), F.array(*[F.col(c).cast("double") for c in metrics.columns]))).alias("metric", "current"))
    failed = F.col("current").isNull() | ((F.col("direction") == "min") & (F.col("current") < F.col("bound"))) | ((F.col("direction") == "max") & (F.col("current") > F.col("bound")))
    return thresholds.join(long, "metric", "left").filter(failed).select("metric", "direction", "bound", "current", F.when(F.col("current").isNull(), "missing_metric").otherwise("threshold").alias("reason"))


def coverage_sets(found: str, expected: str) -> tuple:
    """covered and missing of two id arrays."""
    return F.array_intersect(expected, found), F.array_except(expected, found)
