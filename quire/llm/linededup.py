"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line's key is its trimmed, ASCII-lower-cased text, held as a 128-bit hash.
The exact tables say how many documents hold a key and which is the largest;
they decide. One cuckoo filter a shard holds the keys that are repeated; it
lets documents without any repeated line (most of them) pass without a join
or a shuffle of their text. Filters forget keys as well as they learn them, and counts change by the
keys of what comes or goes, so documents can be inserted and deleted and every
decision follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut, giving_back, slices

SHARDS = 64
MIN_CHARS, MIN_DOCS = 20, 3
WORK = ("k_id", "k_text", "hits", "drops")  # names of columns on the way
FILTER_BYTES = 64 << 20  # filters up to this size in all are broadcast


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; keys come as two 64-bit hashes."""

    SLOTS = 4

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        n = 1
        while n * self.SLOTS * 0.9 < max(1, capacity):
            n *= 2
        self.table = np.zeros((n, self.SLOTS), dtype=np.uint16) if table is None else table
        self.mask = len(self.table) - 1

    def _places(self, a, b):
        """Fingerprint and both buckets. The step to the other bucket is a
        function of the fingerprint alone, so it leads back as well."""
        a, b = np.asarray(a, dtype=np.int64).view(np.uint64), np.asarray(b, dtype=np.int64).view(np.uint64)
        print_ = ((b >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = (a & np.uint64(self.mask)).astype(np.int64)
        return print_, first, first ^ self._step(print_)

    def _step(self, print_):
        return ((np.asarray(print_, dtype=np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7)) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, a, b) -> np.ndarray:
        p, i, j = self._places(a, b)
        return (self.table[i] == p[:, None]).any(axis=1) | (self.table[j] == p[:, None]).any(axis=1)

    def insert(self, a: int, b: int) -> bool:
        """False if no place is found: the caller builds a larger filter."""
        p, i, j = (x[0] for x in self._places([a], [b]))
        for at in (i, j):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return True
        at, before = int(i), self.table.copy() if len(self.table) <= 1024 else None
        trail = []
        for kick in range(500):
            slot = kick % self.SLOTS
            trail.append((at, slot, self.table[at, slot]))
            p, self.table[at, slot] = self.table[at, slot], p
            at = int(at ^ self._step([p])[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return True
        if before is not None:
            self.table[:] = before
        else:
            for at, slot, old in reversed(trail):
                self.table[at, slot] = old
        return False

    def delete(self, a: int, b: int) -> bool:
        p, i, j = (x[0] for x in self._places([a], [b]))
        for at in (i, j):
            held = np.flatnonzero(self.table[at] == p)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def dumps(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def loads(cls, raw: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(raw, dtype=np.uint16).reshape(-1, cls.SLOTS).copy())

    @classmethod
    def build(cls, a, b) -> CuckooFilter:
        size = len(a)
        while True:
            f = cls(size)
            if all(f.insert(int(x), int(y)) for x, y in zip(a, b)):
                return f
            size = max(2 * size, 4)


def marks(text: str | None, min_chars: int = MIN_CHARS) -> tuple[int, list[int], np.ndarray]:
    """Number of lines, positions of the lines long enough to count, and the
    128-bit hashes of their keys as two columns."""
    import xxhash

    lines, at, raw = (text or "").split("\n"), [], []
    digest = xxhash.xxh3_128_digest
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            line = line.strip(ASCII_SPACE)
            if len(line) >= min_chars:
                at.append(i)
                raw.append(digest(line.encode().lower()))  # bytes.lower() knows A-Z alone
    return len(lines), at, np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, 2)


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b, doc_id), once a document and key."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            keys, rows = [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                _, _, k = marks(text, min_chars)
                if len(k):
                    k = np.unique(k, axis=0) if len(k) > 1 else k
                    keys.append(k), rows.append(np.full(len(k), r))
            if keys:
                k = np.concatenate(keys)
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), batch.column(0).take(pa.array(np.concatenate(rows)))], ["a", "b", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(giving_back(run), "a long, b long, doc_id long")


def reference_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


def shard_of(shards: int = SHARDS) -> Column:
    return F.pmod(F.shiftright("a", 20), F.lit(shards)).cast("int")


def build_filters(keys: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, filter) over keys (a, b)."""
    def build(pdf):
        import pandas as pd

        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [CuckooFilter.build(pdf["a"].to_numpy(), pdf["b"].to_numpy()).dumps()]})

    return keys.select(shard_of(shards).alias("shard"), "a", "b").groupBy("shard").applyInPandas(build, "shard int, filter binary")


class LineIndex:
    """Exact reference tables and their filters, kept under insertions and
    deletions of documents. Every state is a set of lineage-free tables; a
    change recounts the keys of the documents that come or go, and no others.

    Rows are documents, null doc_ids too (as one id below all others); deleting
    an id deletes all its rows, deleting an unknown one nothing.
    """

    def __init__(self, posts: DataFrame, counts: DataFrame, filters: DataFrame, min_chars: int, min_docs: int, shards: int):
        self.posts, self.counts, self.filters = posts, counts, filters
        self.min_chars, self.min_docs, self.shards = min_chars, min_docs, shards

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int = SHARDS) -> LineIndex:
        posts = cut(postings(docs, min_chars))
        counts = cut(reference_counts(posts))
        return cls(posts, counts, cut(build_filters(counts.filter(F.col("n") >= min_docs), shards)), min_chars, min_docs, shards)

    def _moved(self, posts: DataFrame, touched: DataFrame) -> LineIndex:
        """`touched`: (a, b, n, last) anew of the keys that changed, n = 0 if
        no document holds the key any more."""
        key = ["a", "b"]
        old = self.counts.join(touched.select(*key), key, "left_semi").select(*key, F.col("n").alias("was"))
        moved = touched.join(old, key, "left")
        flips = moved.select(shard_of(self.shards).alias("shard"), *key, (F.col("n") >= self.min_docs).alias("add"), (F.coalesce("was", F.lit(0)) >= self.min_docs).alias("had")).filter("add <> had")
        counts = cut(self.counts.join(touched.select(*key), key, "left_anti").select(*key, "n", "last").unionByName(touched.filter("n > 0")))

        def change(group, delta_pdf, filter_pdf):
            import pandas as pd

            f = CuckooFilter.loads(filter_pdf["filter"].iloc[0]) if len(filter_pdf) else CuckooFilter(4)
            full = False
            for a, b, add in zip(delta_pdf["a"], delta_pdf["b"], delta_pdf["add"]):
                if add:
                    full |= not f.insert(int(a), int(b))
                else:
                    f.delete(int(a), int(b))
            return pd.DataFrame({"shard": [int(group[0])], "filter": [f.dumps()], "full": [full]})

        changed = cut(flips.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(change, "shard int, filter binary, full boolean"))
        # Shards whose filter ran full are built anew, larger.
        again = build_filters(counts.filter(F.col("n") >= self.min_docs).withColumn("shard", shard_of(self.shards)).join(changed.filter("full").select("shard"), "shard", "left_semi"), self.shards)
        filters = cut(changed.filter("not full").select("shard", "filter").unionAll(again))
        return LineIndex(posts, counts, filters, self.min_chars, self.min_docs, self.shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        new = cut(postings(docs, self.min_chars))
        delta = reference_counts(new).withColumnsRenamed({"n": "more", "last": "latest"})
        held = delta.join(self.counts, ["a", "b"], "left")
        touched = cut(held.select("a", "b", (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n"), F.greatest("last", "latest").alias("last")))
        return self._moved(self.posts.unionAll(new), touched)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("gone_id")).distinct()
        same = self.posts["doc_id"].eqNullSafe(ids["gone_id"])
        keys = self.posts.join(ids, same, "left_semi").select("a", "b").distinct()
        posts = cut(self.posts.join(ids, same, "left_anti"))
        left = reference_counts(posts.join(keys, ["a", "b"], "left_semi"))
        touched = cut(keys.join(left, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), "last"))
        return self._moved(posts, touched)

    def apply(self, docs: DataFrame) -> DataFrame:
        return apply_index(docs, self.counts.filter(F.col("n") >= self.min_docs).select("a", "b", "last"), self.filters, self.min_chars, self.shards)


def probed(docs: DataFrame, filters: DataFrame | None, min_chars: int, shards: int) -> DataFrame:
    """docs with n_lines, k_text (a hash of the text) and `hits`: the lines
    whose key may be repeated, as structs of position and hashes."""
    from pyspark.sql.types import StructType

    shared = None if filters is None else docs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in filters.collect()})
    made = StructType.fromDDL("n_lines long, k_text long, hits array<struct<i:int,a:bigint,b:bigint>>")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        held = None if shared is None else {k: CuckooFilter.loads(v) for k, v in shared.value.items()}
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = [marks(t, min_chars) for t in texts]
            k = np.concatenate([x[2] for x in found]) if found else np.empty((0, 2), dtype=np.int64)
            at = np.fromiter((i for x in found for i in x[1]), dtype=np.int32, count=len(k))
            row = np.repeat(np.arange(len(found)), [len(x[1]) for x in found])
            keep = np.ones(len(k), dtype=bool)
            if held is not None:
                shard, keep = (k[:, 0] >> 20) % shards, np.zeros(len(k), dtype=bool)
                for s in np.unique(shard):
                    if (f := held.get(int(s))) is not None:
                        m = shard == s
                        keep[m] = f.contains(k[m, 0], k[m, 1])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(found)))]).astype(np.int32)
            hits = pa.StructArray.from_arrays([pa.array(at[keep]), pa.array(k[keep, 0]), pa.array(k[keep, 1])], ["i", "a", "b"])
            extra = [pa.array([x[0] for x in found], pa.int64()), pa.array([xxhash.xxh3_64_intdigest(t or "") - (1 << 63) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), hits)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *made.names])

    return docs.mapInArrow(giving_back(run), StructType([*docs.schema.fields, *made.fields]))


def apply_index(docs: DataFrame, repeated: DataFrame, filters: DataFrame | None, min_chars: int = MIN_CHARS, shards: int = SHARDS) -> DataFrame:
    """Every column of docs, with `kept` (the text that stays), `n_lines` and
    `n_dropped`. A repeated line stays only in the document `last`. Filters of
    up to FILTER_BYTES in all are broadcast and spare the other lines a
    shuffle; without them all lines that count meet the exact table."""
    docs = docs.drop("kept", "n_lines", "n_dropped", *WORK)
    if filters is not None and filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0))).first()[0] > FILTER_BYTES:
        filters = None  # too large to broadcast: every counting line goes to the exact table
    names = docs.columns
    seen = probed(docs, filters, min_chars, shards)
    clean = seen.filter(F.size("hits") == 0).select(*names, F.coalesce("text", F.lit("")).alias("kept"), "n_lines", F.lit(0).cast("long").alias("n_dropped"))
    keyed = seen.filter(F.size("hits") > 0).withColumn("k_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    lines = keyed.select("k_id", "k_text", "doc_id", F.explode("hits").alias("h")).select("k_id", "k_text", "doc_id", "h.i", "h.a", "h.b")
    gone = F.col("last").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))
    drops = lines.join(repeated, ["a", "b"]).filter(gone).groupBy("k_id", "k_text").agg(F.collect_set("i").alias("drops"))

    def assemble(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            kept, n_gone = [], []
            for text, drop in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                at = set(drop or ())
                kept.append("\n".join([x for i, x in enumerate((text or "").split("\n")) if i not in at]) if at else text or "")
                n_gone.append(len(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(kept, pa.string()), batch.column(batch.num_columns - 2), pa.array(n_gone, pa.int64())], [*batch.schema.names[:-2], "kept", "n_lines", "n_dropped"])

    joined = keyed.select(*names, "k_id", "k_text", "n_lines").join(drops, ["k_id", "k_text"], "left").select(*names, "n_lines", "drops")
    return clean.unionByName(joined.mapInArrow(giving_back(assemble), clean.schema))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int = SHARDS) -> DataFrame:
    """Batch form: lines whose key of at least `min_chars` code points occurs
    in at least `min_docs` documents go, but for the largest doc_id's.

    Null and empty texts are one empty line. Rows are documents: repeated rows
    count each, and with equal doc_ids they are all the largest. Null doc_ids
    are below all others. Extra columns pass through but for those with a name
    of the result or of WORK, which are left out. Empty in, empty out.
    """
    docs = docs.drop("kept", "n_lines", "n_dropped", *WORK)
    repeated = cut(reference_counts(postings(docs, min_chars)).filter(F.col("n") >= min_docs).select("a", "b", "last"))
    # 16-bit fingerprints in tables of a power of two: at most 5 bytes a key.
    small = 5 * repeated.count() <= FILTER_BYTES
    return apply_index(docs, repeated, cut(build_filters(repeated, shards)) if small else None, min_chars, shards)
