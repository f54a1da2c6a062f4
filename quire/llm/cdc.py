"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 32 bytes cuts texts where its low bits are
zero, so cuts follow content: an insertion moves the chunks around it and no
others. Chunks are deduplicated by a 128-bit digest across and within documents: a chunk
that is repeated stays at its first place in the smallest doc_id. Only runs
of such chunks of at least `min_span` bytes, or of a whole text, count, so a stock phrase that
happens to fill a chunk doesn't.

The text never moves. Chunk rows are pre-aggregated to each digest's smallest
and largest doc_id; only digests that repeat are joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CHUNK, MEAN_BITS, MAX_CHUNK, MIN_SPAN = 16, 5, 1024, 48
GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:4] for i in range(256)), dtype=np.uint32)
LOW = -(1 << 63)


def cuts(raw: bytes, min_chunk: int = MIN_CHUNK, bits: int = MEAN_BITS, max_chunk: int = MAX_CHUNK) -> np.ndarray:
    """Ends of the chunks of a text; none for an empty one. Cuts lie between
    characters of valid UTF-8."""
    n = len(raw)
    if not n:
        return np.empty(0, dtype=np.int64)
    b = np.frombuffer(raw, dtype=np.uint8)
    h = GEAR[b]
    for k in (1, 2, 4, 8, 16):  # h_i = sum of gear[b_(i-j)] << j over 32 bytes, by doubling
        h[k:] += h[:-k] << np.uint32(k)
    edge = np.empty(n, dtype=bool)  # a cut may follow byte i
    edge[:-1] = (b[1:] & 0xC0) != 0x80
    edge[-1] = True
    # The top bits have seen the whole window.
    found = np.flatnonzero(((h >> np.uint32(32 - bits)) == 0) & edge) + 1
    ends, last = [], 0
    for e in [*found.tolist(), n]:
        while e - last > max_chunk:
            forced = last + max_chunk
            while not edge[forced - 1]:
                forced -= 1
            ends.append(forced)
            last = forced
        if e - last >= min_chunk or e == n and e > last:
            ends.append(e)
            last = e
    return np.asarray(ends, dtype=np.int64)


def digests(raw: bytes, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit halves for each chunk."""
    out, start, blake = [], 0, hashlib.blake2b
    for e in ends.tolist():
        out.append(blake(raw[start:e], digest_size=16).digest())
        start = e
    return np.frombuffer(b"".join(out), dtype="<i8").reshape(-1, 2)


def chunks(docs: DataFrame, positions: bool, **kw) -> DataFrame:
    """(h1, h2, doc_id, several) a distinct chunk of each row, several if the
    row repeats it, or with `positions` (h1, h2, doc_id, t, start, length,
    n_bytes, again) every chunk, again if the row had it before; t is a hash of
    the row's text."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["h1", "h2", "doc_id"] + (["t", "start", "length", "n_bytes", "again"] if positions else ["several"])
        for batch in batches:
            held: list[list[np.ndarray]] = [[] for _ in names]
            for doc_id, t, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not text:
                    continue
                raw = text.encode()
                ends = cuts(raw, **kw)
                d = digests(raw, ends)
                _, at, count = np.unique(d, axis=0, return_index=True, return_counts=True)
                if positions:
                    starts = np.concatenate([[0], ends[:-1]])
                    held[3].append(np.full(len(d), t, dtype=np.int64)), held[4].append(starts.astype(np.int32)), held[5].append((ends - starts).astype(np.int32)), held[6].append(np.full(len(d), len(raw), dtype=np.int32)), held[7].append(~np.isin(np.arange(len(d)), at))
                else:
                    d = d[at]
                    held[3].append(count > 1)
                held[0].append(d[:, 0]), held[1].append(d[:, 1]), held[2].append(np.full(len(d), doc_id, dtype=np.int64))
            if held[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in held], names)

    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return ids.mapInArrow(run, "h1 long, h2 long, doc_id long" + (", t long, start int, length int, n_bytes int, again boolean" if positions else ", several boolean"))


def spans(docs: DataFrame, min_span: int = MIN_SPAN, **kw) -> DataFrame:
    """(doc_id, t, repeated_bytes, removed_bytes, spans) of the texts with
    repeats, by doc_id and hash of the text. `spans` are the byte ranges to
    remove, in order."""
    held = chunks(docs, False, **kw).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("several").alias("several"))
    repeated = held.filter("first < last or several").select("h1", "h2", "first")
    rows = chunks(docs, True, **kw).join(repeated, ["h1", "h2"]).select("doc_id", "t", F.struct("start", "length", "n_bytes", ((F.col("doc_id") > F.col("first")) | F.col("again")).alias("later")).alias("c"))
    per = rows.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("c")).alias("c"))  # no more than the text's chunks, however often the row is repeated

    def runs(c: list, later: bool) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        size = c[0]["n_bytes"]
        for x in c:
            if later and not x["later"]:
                continue
            if out and out[-1][1] >= x["start"]:
                out[-1] = (out[-1][0], max(out[-1][1], x["start"] + x["length"]))
            else:
                out.append((x["start"], x["start"] + x["length"]))
        return [x for x in out if x[1] - x[0] >= min_span or x == (0, size)]

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            ids, texts, again, gone, at = [], [], [], [], []
            for doc_id, t, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                every, later = runs(c, False), runs(c, True)
                if every:
                    ids.append(doc_id), texts.append(t), again.append(sum(b - a for a, b in every)), gone.append(sum(b - a for a, b in later)), at.append([{"start": a, "end": b} for a, b in later])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(again, pa.int64()), pa.array(gone, pa.int64()), pa.array(at, kind)], ["doc_id", "t", "repeated_bytes", "removed_bytes", "spans"])

    return per.mapInArrow(merge, "doc_id long, t long, repeated_bytes long, removed_bytes long, spans array<struct<start:int,end:int>>")


def report(docs: DataFrame, min_span: int = MIN_SPAN, **kw) -> DataFrame:
    """doc_id, n_bytes, repeated_bytes, removed_bytes, spans for every row.

    Null and empty texts have no chunks. Rows with one doc_id are parts of one
    document: they don't repeat each other; each lists the spans of its own
    text. Null doc_ids are one document, below all others. Very long texts are
    cut whole. Extra columns are ignored; an empty table gives an empty one.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("key"), F.xxhash64("text").alias("t"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    found = spans(docs.select("doc_id", "text"), min_span, **kw).withColumnRenamed("doc_id", "key")
    zero = F.lit(0).cast("long")
    return base.join(found, ["key", "t"], "left").select("doc_id", "n_bytes", F.coalesce("repeated_bytes", zero).alias("repeated_bytes"), F.coalesce("removed_bytes", zero).alias("removed_bytes"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def dedup(docs: DataFrame, min_span: int = MIN_SPAN, **kw) -> DataFrame:
    """docs with the repeated spans taken out of `text`, row by row as in
    report(): a row loses the spans of its own text only, also where others
    share its doc_id. Null and empty texts stay. Extra columns pass through,
    but for cdc_key, cdc_t and cdc_spans; an empty table gives an empty one."""
    docs = docs.drop("cdc_key", "cdc_t", "cdc_spans")

    @F.pandas_udf("string")
    def strip(text, at):
        import pandas as pd

        def one(t, s):
            if t is None or s is None or not len(s):
                return t
            raw, out, last = t.encode(), [], 0
            for x in s:
                out.append(raw[last : x["start"]])
                last = x["end"]
            return b"".join([*out, raw[last:]]).decode("utf-8", "ignore")

        return pd.Series([one(t, s) for t, s in zip(text, at)])

    found = spans(docs.select("doc_id", "text"), min_span, **kw).select(F.col("doc_id").alias("cdc_key"), F.col("t").alias("cdc_t"), F.col("spans").alias("cdc_spans"))
    keyed = docs.join(found, (F.coalesce(docs["doc_id"].cast("long"), F.lit(LOW)) == F.col("cdc_key")) & (F.xxhash64("text") == F.col("cdc_t")), "left")
    return keyed.select(*[strip("text", "cdc_spans").alias(c) if c == "text" else F.col(c) for c in docs.columns])
