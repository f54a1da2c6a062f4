"""Toxicity by multiple-instance learning.

A document is a bag of sentences and is toxic if any of them is: sentence
probabilities p_j combine by noisy-or, P = 1 - prod(1 - p_j). Only documents
carry labels; the gradient of the document's log-loss reaches a sentence in
proportion to its p_j, so training finds the offending sentences by itself.

Sentences are bags of their words and of word beginnings (stems of inflecting
languages). The classifier is fitted in one task on a bounded sample
(`max_docs` labelled documents, picked by a hash of doc_id); everything else
runs over all rows without a shuffle. Scoring looks each word up once: a
word's weight is the sum over its features.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, giving_back, slices

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
MAX_DOCS, MAX_FEATURES = 12_000, 50_000
WORD_CACHE = 200_000


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}-" for k in (3, 4, 5, 6) if len(word) > k)]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def fit_bags(texts: list[str], labels: list[int], epochs: int = 240, l2: float = 2e-4, min_docs: int = 5, max_features: int = MAX_FEATURES) -> tuple[dict[str, float], float]:
    """Weights by feature, and the bias. Deterministic."""
    import numpy as np

    # Words and features as numbers: tokens of all sentences in one array.
    words: dict[str, int] = {}
    known: dict[str, int] = {}
    of_word, tokens, ends, doc_of = array("i"), array("i"), array("q"), array("i")
    for d, text in enumerate(texts):
        for s in SENTENCE.findall(text.lower()):
            if not (found := set(WORD.findall(s))):
                continue
            for w in sorted(found):
                x = words.get(w)
                if x is None:
                    x = words[w] = len(words)
                    ids = [known.setdefault(f, len(known)) for f in features(w)]
                    of_word.extend(ids + [-1] * (5 - len(ids)))
                tokens.append(x)
            ends.append(len(tokens))
            doc_of.append(d)
    y = np.asarray(labels, dtype=np.float64)
    if not len(doc_of) or y.min() == y.max():
        return {}, -30.0 if not len(y) or y.max() == 0 else 0.0
    table = np.frombuffer(of_word, dtype=np.int32).reshape(-1, 5)
    tok, stop, doc_of = np.frombuffer(tokens, dtype=np.int32), np.frombuffer(ends, dtype=np.int64), np.frombuffer(doc_of, dtype=np.int32)
    # Document frequencies, then the features kept: the commonest, ties by name.
    df = np.zeros(len(known), dtype=np.int32)
    starts = np.concatenate([[0], stop])[np.searchsorted(doc_of, np.arange(1, len(texts)), "left")]
    for part in np.split(tok, starts):
        f = np.unique(table[np.unique(part)])
        df[f[f >= 0]] += 1
    names = list(known)
    kept = sorted(np.flatnonzero(df >= min_docs).tolist(), key=lambda i: (-df[i], names[i]))[:max_features]
    names = [names[i] for i in kept]
    remap = np.full(len(known) + 1, -1, dtype=np.int32)
    remap[kept] = np.arange(len(kept))
    table = remap[table]
    del words, known, remap
    sent = np.repeat(np.arange(len(stop)), np.diff(stop, prepend=0))
    if not names:
        return {}, 0.0
    blocks, first = [], 0  # distinct (sentence, feature) pairs, by blocks of whole sentences
    while first < len(stop):
        last = min(len(stop), first + (1 << 14))
        span = slice(stop[first - 1] if first else 0, stop[last - 1])
        f = table[tok[span]]
        pair = np.unique((sent[span, None] * np.int64(len(names)) + f)[f >= 0])
        blocks.append(((pair // len(names)).astype(np.int32), (pair % len(names)).astype(np.int32)))
        first = last
    del sent, tok, tokens, table, f, pair
    n_docs, n_sents, k = len(y), len(doc_of), len(names)

    def spread(w):
        """Sums of feature weights by sentence."""
        out = np.zeros(n_sents)
        for rows, cols in blocks:
            if len(rows):
                out[rows[0] : rows[-1] + 1] += np.bincount(rows - rows[0], weights=w[cols])
        return out

    def gather(g):
        """Sums of sentence values by feature."""
        return sum(np.bincount(cols, weights=g[rows], minlength=k) for rows, cols in blocks)

    w, bias = np.zeros(k), math.log(max(y.mean(), 1e-3)) - math.log(n_sents / n_docs)
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, epochs + 1):
        s = bias + spread(w)
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        none = -np.bincount(doc_of, weights=np.logaddexp(0, s), minlength=n_docs)  # log prod(1 - p)
        any_ = np.clip(-np.expm1(none), 1e-12, None)
        g = p * np.where(y == 1, -np.exp(none) / any_, 1.0)[doc_of]
        grad = np.append(gather(g) / n_docs + l2 * w, g.sum() / n_docs)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return {names[i]: float(w[i]) for i in range(k) if abs(w[i]) > 1e-3}, float(bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_docs: int = MAX_DOCS, max_features: int = MAX_FEATURES) -> tuple[dict[str, float], float]:
    """Fit on at most `max_docs` labelled documents that aren't held out.

    Null labels, null doc_ids and null texts take no part; a doc_id labelled
    repeatedly counts as toxic if any row says so. Without labels of both
    kinds the model scores every document alike.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sample = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    bags = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id")  # max_docs rows of 12 bytes

    def train(batches: Iterator) -> Iterator:
        import pandas as pd

        held = [b for b in batches if len(b)]
        rows = pd.concat(held, ignore_index=True).drop_duplicates("doc_id").sort_values("doc_id") if held else pd.DataFrame({"text": [], "y": []})
        weights, bias = fit_bags(rows["text"].tolist(), rows["y"].tolist(), max_features=max_features)
        yield pd.DataFrame({"feature": [*weights, ""], "weight": [*weights.values(), bias]})

    model = bags.repartition(1).mapInPandas(giving_back(train), "feature string, weight double").collect()  # at most max_features + 1 rows
    if not model:
        return {}, -30.0
    return {r["feature"]: r["weight"] for r in model if r["feature"]}, next(r["weight"] for r in model if not r["feature"])


class Scorer:
    """Sentence and document probabilities of one text."""

    def __init__(self, weights: dict[str, float], bias: float):
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> float:
                x = outer._word(word)
                if len(self) >= WORD_CACHE:
                    self.clear()
                self[word] = x
                return x

        self.weights, self.bias, self.words = weights, bias, Words()

    def _word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, log-odds) of each sentence that has words."""
        low = text.lower()
        if len(low) != len(text):  # a few letters lengthen in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        weight, find, bias = self.words.__getitem__, WORD.findall, self.bias
        for m in SENTENCE.finditer(low):
            if words := set(find(m.group())):
                yield m.start(), m.end(), bias + sum(map(weight, words))

    def document(self, text: str | None) -> tuple[float, int, int, int, float]:
        """score, sentences, and start, end, score of the worst sentence."""
        none, n, worst = 0.0, 0, (-1, -1, -math.inf)
        for a, b, s in self.sentences(text or ""):
            n += 1
            none -= s if s > 30 else math.log1p(math.exp(s))
            if s > worst[2]:
                worst = (a, b, s)
        p = lambda s: 1 / (1 + math.exp(-max(min(s, 500.0), -500.0)))
        return -math.expm1(none), n, worst[0], worst[1], p(worst[2]) if n else 0.0


def score(docs: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """docs with score, predicted, n_sentences and the worst sentence's span.

    Null and empty texts, and texts without words, score 0. Extra columns pass
    through but for those with a name of the result, which are replaced;
    repeated rows are scored alike, ids (null or not) are never read. Very long
    texts are scored whole, by all their sentences; an empty table gives an
    empty one.
    """
    docs = docs.drop("score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "score double, n_sentences int, worst_start int, worst_end int, worst_score double"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(*shared.value)
        for batch in slices(batches):
            out = list(zip(*map(scorer.document, batch.column(batch.schema.get_field_index("text")).to_pylist()))) or [()] * 5
            made = [pa.array(x, t) for x, t in zip(out, (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(f.split()[0] for f in fields.split(", "))])

    from pyspark.sql.types import StructType

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(fields).fields])
    return docs.mapInArrow(giving_back(run), schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def offending(docs: DataFrame, model: tuple[dict[str, float], float], threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, sentence_score, sentence) of sentences that are
    toxic by themselves. Null and empty texts have none, null ids stay null,
    repeated rows give their sentences each, an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        scorer, least = Scorer(*shared.value), math.log(threshold / (1 - threshold))
        for b in batches:
            rows = [(i, a, e, 1 / (1 + math.exp(-s)), t[a:e]) for i, t in zip(b["doc_id"], b["text"]) if t for a, e, s in scorer.sentences(t) if s >= least]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "sentence_score", "sentence"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, start int, end int, sentence_score double, sentence string")
