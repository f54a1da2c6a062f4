"""Token counts without token ids.

A byte-level BPE splits a text into pre-tokens and encodes each on its own, so
a document's count is the sum over its distinct pre-tokens of frequency times
pieces. Pieces are counted once per distinct pre-token of the corpus. The most
frequent pre-tokens (at most `head`, a fixed bound) are broadcast and summed
where the text is read; the rest goes, one row per document and distinct
pre-token, through a shuffle join on the pre-token. The hottest keys are in
the head by construction, so that join has no skew.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# The split that the byte-level pre-tokeniser documents.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAD = 1 << 18


# Line feed, printable ASCII and Latin letters: nearly all texts are made of these.
PLAIN = re.compile("[^\n -~\u00c0-\u024f]").search


@functools.cache
def _odd(char: str) -> bool:
    """Whether the fast split may read a code point otherwise than the
    tokeniser: white space other than space and line feed, numbers other than
    decimal digits, and what this Unicode version leaves unassigned."""
    return unicodedata.category(char) in ("Cn", "No", "Nl") or char.isspace() and char not in " \n"


def unusual(text: str) -> bool:
    return PLAIN(text) is not None and any(map(_odd, set(text)))


class Splitter:
    """Pre-tokens of texts.

    A space that has no white space beside it starts a pre-token, so a text
    without such neighbours is its space-separated words, each split on its
    own: distinct words are split once, however often they occur.
    """

    def __init__(self, tokenizer_path: str):
        import json

        import regex

        self.path, self.library = tokenizer_path, None
        self.find = regex.compile(SPLIT).findall
        with open(tokenizer_path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        if made.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only tokenisers with a plain byte-level split have this form")
        self.added = [x["content"] for x in made["added_tokens"]]
        self.cut_at = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _by_library(self, part: str) -> list[str]:
        """Unicode versions differ between libraries: unusual texts are split by the tokeniser's own splitter."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]

    def split(self, text: str) -> tuple[list[str], int]:
        """All pre-tokens in order, and the number of added tokens."""
        find = self._by_library if unusual(text) else self.find
        if not any(a in text for a in self.added):
            return find(text), 0
        parts = self.cut_at.split(text)
        return [x for part in parts for x in find(part)], len(parts) - 1

    def words(self, text: str) -> tuple[list[str], list[str], int]:
        """Words that follow a space, in order, other pre-tokens, added tokens."""
        if "  " in text or " \n" in text or "\n " in text or any(a in text for a in self.added) or unusual(text):
            return [], *self.split(text)
        first, _, rest = text.partition(" ")
        return rest.split(" ") if _ else [], self.find(first), 0

    def of(self, word: str) -> list[str]:
        """Pre-tokens of a word that follows a space; ASCII letters alone are one."""
        return [" " + word] if word.isalpha() and word.isascii() else self.find(" " + word)


def piece_counter(tokenizer_path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(tokenizer_path)
    t.no_padding()
    t.no_truncation()
    t.encode_special_tokens = True

    def count(words: list[str]) -> list[int]:
        return [len(e) for e in t.encode_batch(words, add_special_tokens=False)]

    return count


def pretokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(pretoken, freq), partial sums by task; group them before use."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        splitter, words, loose = Splitter(tokenizer_path), Counter(), Counter()
        of, get = splitter.of, loose.get

        def flush():
            for word, freq in words.items():
                for x in of(word):
                    loose[x] = get(x, 0) + freq
            return pa.RecordBatch.from_arrays([pa.array(list(loose.keys()), pa.string()), pa.array(list(loose.values()), pa.int64())], ["pretoken", "freq"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    spaced, rest, _ = splitter.words(text)
                    words.update(spaced)
                    loose.update(rest)
                    if len(words) + len(loose) > 500_000:
                        yield flush()
                        words.clear(), loose.clear()
        if words or loose:
            yield flush()

    return docs.select("text").mapInArrow(run, "pretoken string, freq long")


def dictionary(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Every distinct pre-token with its frequency and number of pieces."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = piece_counter(tokenizer_path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count(words), pa.int32())], ["pretoken", "freq", "pieces"])

    return pretokens(docs, tokenizer_path).groupBy("pretoken").agg(F.sum("freq").alias("freq")).mapInArrow(run, "pretoken string, freq long, pieces int")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row a row of `docs`.

    Null and empty texts have 0 bytes and tokens. Rows are told apart by a row
    key, so repeated rows and null doc_ids count on their own. Columns besides
    doc_id and text are ignored. `head` bounds the broadcast dictionary.
    """
    spark = docs.sparkSession
    words = stored(dictionary(docs, tokenizer_path))
    # The head is what is at least as frequent as a power of two that leaves it within `head`.
    octave = F.floor(F.log2(F.col("freq").cast("double"))).cast("int")
    floor, room = 1 << 62, head
    for r in words.groupBy(octave.alias("octave")).count().orderBy(F.col("octave").desc()).collect():  # 63 rows at most
        room -= r["count"]
        if room < 0:
            break
        floor = 1 << r["octave"]
    top = words.filter(F.col("freq") >= floor).select("pretoken", "pieces").toArrow()  # at most `head` rows
    known = spark.sparkContext.broadcast((top.column(0).to_pylist(), top.column(1).to_pylist()))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        splitter, get = Splitter(tokenizer_path), dict(zip(*known.value)).get
        rare: dict[str, tuple] = {}  # the unknown pre-tokens of words in seen that have some

        class Seen(dict):  # pieces of the known pre-tokens of a word
            def __missing__(self, word: str) -> int:
                n, unknown = parts(splitter.of(word))
                self[word] = n
                if unknown:
                    rare[word] = unknown
                return n

        seen = Seen()

        def parts(found: list[str]) -> tuple[int, tuple]:
            """Pieces of known pre-tokens, and the unknown ones."""
            pieces = [(x, get(x)) for x in found]
            return sum(n for _, n in pieces if n is not None), tuple(x for x, n in pieces if n is None)

        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for key, doc_id, text in zip(keys, ids, batch.column(2).to_pylist()):
                total, tail = 0, {}
                if text:
                    spaced, rest, total = splitter.words(text)
                    n, unknown = parts(rest)
                    total += n
                    for x in unknown:
                        tail[x] = tail.get(x, 0) + 1
                    if len(seen) >= 300_000:
                        seen.clear(), rare.clear()
                    total += sum(map(seen.__getitem__, spaced))
                    for word in filter(rare.__contains__, spaced):
                        for x in rare[word]:
                            tail[x] = tail.get(x, 0) + 1
                # The first row of a document carries what is summed already, under a key that no pre-token has.
                out[0].append(key), out[1].append(doc_id), out[2].append(len(text.encode()) if text else 0), out[3].append(total), out[4].append(f"{key} {key}"), out[5].append(0)
                zeros = [0] * len(tail)
                out[0].extend([key] * len(tail)), out[1].extend([None] * len(tail)), out[2].extend(zeros), out[3].extend(zeros), out[4].extend(tail), out[5].extend(tail.values())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["key", "doc_id", "n_bytes", "part", "pretoken", "freq"])

    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = keyed.mapInArrow(run, "key long, doc_id long, n_bytes long, part long, pretoken string, freq long")
    rest = words.filter(F.col("freq") < floor).select("pretoken", "pieces")
    summed = rows.join(rest, "pretoken", "left").groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("part") + F.col("freq") * F.coalesce("pieces", F.lit(0))).alias("n_tokens")
    )
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
