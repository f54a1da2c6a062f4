"""SpotSigs document fingerprints.

Common words are anchors; each anchor with the next `CHAIN` content words after
it is one signature, and the set of a text's signatures is its fingerprint.
Anchors are the function words of four languages and, so that texts of any
language have spots, the content words whose hash says so; both are properties
of a word alone, so an edit moves only the signatures around it. A chain that
runs over the end is kept short. A text with words but without any anchor
takes its first word for one.

Similar documents are found over representatives of equal fingerprints:
documents are partitioned by set length, only partitions whose lengths allow
the threshold meet, a document offers just a prefix of its signatures, common
ones last (any pair at the threshold shares one of them), places in the prefix
prune further, and the Jaccard likeness is then exact.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, partitions, stored

FUNCTION_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or our she so than that the their them then there these they this to was we were what when which who will with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur lui mais ne nous on ou par pas pour qui que sa se ses son sur un une vous "
    "aber als am auch auf aus bei das dem den der des die ein eine einer er es für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind so und von vor war wie wir zu zum zur "
    "al como con de del el ella en es esta este la las lo los más no para pero por que se sin su sus un una y ya".split()
)
WORD = re.compile(r"\w+")
CHAIN = 2
ANCHOR_EVERY = 8
WORD_CACHE = 250_000
SAMPLE_ONE_IN, HOT_SIGNATURES = 32, 1 << 16


class _Words(dict):
    """word -> 62-bit hash, with bit 0 for function words; bounded."""

    def __missing__(self, word: str) -> int:
        import xxhash

        x = (xxhash.xxh3_64_intdigest(word) & ~1 | (word in FUNCTION_WORDS)) & 0x7FFFFFFFFFFFFFFF
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = x
        return x


_WORDS = _Words()
CACHES.append(_WORDS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def signatures(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit signatures of a whole text; none for null and
    empty ones. A text without words is one signature of its characters."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    words = WORD.findall(text.lower())
    if not words:
        return np.array([int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")], dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    content = (h & np.uint64(1)) == 0
    anchor = ~content | ((h >> np.uint64(8)) % np.uint64(ANCHOR_EVERY) == 0)
    if not anchor.any():
        anchor[0] = True
    at = np.flatnonzero(anchor)
    following = np.cumsum(content)[at]  # content words up to the anchor: index of the next
    chain = np.concatenate([h[content], np.zeros(CHAIN, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        s = _mix(h[at])
        for k in range(CHAIN):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + chain[following + k])
    return np.unique(s)


def fingerprint(sigs: np.ndarray) -> str:
    return base64.b64encode(sigs.astype("<u8").tobytes()).decode()


def unpack(print_: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(print_), dtype="<u8")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two signature sets; two empty sets are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `fingerprint` and `n_signatures`. Null and empty texts have
    the empty fingerprint; repeated rows equal ones; very long texts are read
    whole; an empty table gives an empty one. Extra columns pass through, but
    for those of these names and fp."""
    docs = docs.drop("fp", "fingerprint", "n_signatures")
    @F.pandas_udf("fingerprint string, n_signatures int")
    def run(batch):
        import pandas as pd

        s = [signatures(x) for x in batch]
        return pd.DataFrame({"fingerprint": [fingerprint(x) for x in s], "n_signatures": [len(x) for x in s]})

    return docs.withColumn("fp", run(text)).select(*docs.columns, "fp.*")


def successors(docs: DataFrame):
    """Rows in buckets by doc_id range, each followed by the first row of the
    next bucket (`extra`), so one sorted pass sees every document's successor.
    The text is shuffled once; the bounds are as many as the buckets."""
    spark = docs.sparkSession
    n = partitions(spark)
    low = -(1 << 63)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("ord"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("ord"))
    bounds = ids.agg(F.percentile_approx("ord", [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] if n > 1 else []
    bounds = sorted(set(bounds or []))
    buckets = lambda: F.aggregate(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), F.lit(0), lambda k, b: k + (F.col("ord") >= b).cast("int"))
    firsts = ids.withColumn("bucket", buckets()).groupBy("bucket").agg(F.min("ord").alias("first")).orderBy("bucket").collect()  # a row a bucket
    if not firsts:
        return d.withColumns({"bucket": F.lit(0), "extra": F.lit(False)}).limit(0)
    before = {r["first"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}  # the first bucket follows the last
    prior = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("ord"))
    places = F.when(F.col("ord").isin(list(before)), F.array(F.struct(buckets().alias("bucket"), F.lit(False).alias("extra")), F.struct(prior.alias("bucket"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct(buckets().alias("bucket"), F.lit(False).alias("extra"))))
    rows = d.withColumn("p", F.explode(places)).select("p.bucket", "p.extra", "ord", "doc_id", "text")
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", "ord", "text")


def edited(text: str, follower: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + follower[:k]


def edit_study(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_signatures for each row.

    The successor is the next row by (doc_id, text), null doc_ids first, the
    first row after the last; a single row follows itself. Null texts count as
    empty; extra columns are ignored; an empty table gives an empty one.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
        out: list[list] = [[] for _ in names]
        held = None  # bucket, doc_id, text, signatures of the row that waits for its successor

        def settle(text: str, sigs: np.ndarray) -> None:
            _, doc_id, own, own_sigs = held
            changed = edited(own, text)
            changed_sigs = signatures(changed)
            for column, x in zip(out, (doc_id, len(own), hashlib.sha256(changed.encode()).hexdigest(), fingerprint(own_sigs), fingerprint(changed_sigs), jaccard(own_sigs, changed_sigs), jaccard(own_sigs, sigs), len(own_sigs))):
                column.append(x)

        for batch in batches:
            for bucket, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if held is None and extra:
                    continue  # a further row with the next bucket's first doc_id
                sigs = signatures(text)
                if held is not None:
                    settle(text, sigs)
                held = None if extra else (bucket, doc_id, text, sigs)
            if len(out[0]) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)
                out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures int"
    return successors(docs).mapInArrow(run, schema)


def near_pairs(docs: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes at or above the threshold, membership).

    Membership has (doc_id, class_id): rows of one fingerprint are a class
    named by its smallest doc_id. Pairs are (a, b, likeness), a and b the
    numbers of classes by fingerprint hash, with their class_ids id_a, id_b.
    Texts without signatures form one class that pairs with none. Null texts
    count as empty, null doc_ids as one below all others; repeated rows are of
    one class; an empty table gives empty ones. Extra columns are ignored.

    A pair at the threshold has lengths within it, and shares one of the first
    n - ceil(threshold n) + 1 signatures of each side in any common order: here
    by how common they are in a sample, the commonest last. So only partitions of set length that
    allow the threshold meet, and there only rows with a signature of that
    prefix; a signature's place in both sets bounds what they may share, which
    prunes the pair before its sets are sent. The join on (signature, partition)
    is split by Spark where a signature is hot.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    prints = stored(fingerprints(docs.select(key.alias("doc_id"), "text")).select("doc_id", "fingerprint", "n_signatures", F.xxhash64("fingerprint").alias("c")))
    classes = stored(prints.groupBy("c").agg(F.first("fingerprint").alias("fingerprint"), F.first("n_signatures").alias("n"), F.min("doc_id").alias("class_id")))
    back = F.when(F.col("class_id") != -(1 << 63), F.col("class_id"))
    members = prints.join(classes.select("c", "class_id"), "c").select(F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"), back.alias("class_id"), "c")
    common = stored(_common(classes))
    hot = sorted((r["sig"], r["count"]) for r in common.collect())  # HOT_SIGNATURES at most
    shared = docs.sparkSession.sparkContext.broadcast(np.array(hot, dtype=np.int64).reshape(-1, 2).T.copy())

    def prefixes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, counts = shared.value
        for batch in batches:
            c, s, at, n = [], [], [], []
            for name, print_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sigs = unpack(print_).view(np.int64)
                sigs = rare_first(sigs, known, counts)
                m = len(sigs) - int(np.ceil(len(sigs) * threshold - 1e-9)) + 1
                c.append(np.full(m, name)), s.append(sigs[:m]), at.append(np.arange(m)), n.append(np.full(m, len(sigs)))
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip((c, s, at, n), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["c", "sig", "at", "n"])

    some = classes.filter("n > 0")
    prefix = some.select("c", "fingerprint").mapInArrow(prefixes, "c long, sig long, at int, n int")
    # Lengths within one factor of 1/threshold are of one partition or of neighbours.
    part = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1 / threshold)) + 1e-9)
    left = prefix.select("sig", F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.explode(F.array(part, part + 1)).alias("part"))
    right = prefix.select("sig", F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), part.alias("part"))
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # shared from here on; at the first shared one: in all
    enough = most >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9  # at any shared one: then at the first, too
    met = left.join(right, ["sig", "part"]).filter(order & (F.col("n_a") >= F.col("n_b") * threshold - 1e-9) & enough).select("a", "b").distinct()
    side = lambda c: classes.select(F.col("c").alias(c), F.col("fingerprint").alias(f"f_{c}"), back.alias(f"id_{c}"))
    both = met.join(side("a"), "a").join(side("b"), "b")

    @F.pandas_udf("double")
    def likeness(x, y):
        import pandas as pd

        return pd.Series([jaccard(unpack(p), unpack(q)) for p, q in zip(x, y)])

    return both.withColumn("likeness", likeness("f_a", "f_b")).filter(F.col("likeness") >= threshold - 1e-12).select("a", "b", "id_a", "id_b", "likeness"), members


def rare_first(sigs: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """sigs by their counts (of `known`, sorted; others are rare), then value:
    one order for all sets."""
    if not len(known):
        return np.sort(sigs)
    at = np.minimum(np.searchsorted(known, sigs), len(known) - 1)
    return sigs[np.lexsort((sigs, np.where(known[at] == sigs, counts[at], 0)))]


def _common(classes: DataFrame) -> DataFrame:
    """The signatures that most classes of a sample have; they only order."""
    @F.pandas_udf("array<long>")
    def sets(batch):
        return batch.map(lambda x: unpack(x).view(np.int64))

    some = classes.filter(F.pmod("c", F.lit(SAMPLE_ONE_IN)) == 0).select(F.explode(sets("fingerprint")).alias("sig"))
    return some.groupBy("sig").count().filter("count > 1").orderBy(F.col("count").desc(), "sig").limit(HOT_SIGNATURES)


def near_classes(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, class_id, n_near for each row: n_near counts the other classes
    whose likeness reaches the threshold. Rows as in near_pairs."""
    pairs, members = near_pairs(docs, threshold)
    links = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("n_near"))
    return members.join(links, "c", "left").select("doc_id", "class_id", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
