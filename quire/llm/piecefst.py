"""SentencePiece encoding and decoding as weighted finite-state transduction.

Three transducers are compiled from a model file: N, the normaliser (longest
match in its character map, spaces to U+2581, an optional dummy prefix); P, the
pieces (a trie whose finals emit an id at weight -score); B, byte fallback
(a character without a piece emits its UTF-8 bytes). A text is composed with
N, then P|B, which gives an acyclic lattice over positions; the encoding is
its shortest path in the tropical semiring (min, +), found in one pass as the
states are in topological order.

For a BPE model the piece scores rank merges and their sum does not order
segmentations. There the lattice is further composed with M, an acceptor over
adjacent pieces: the arc from piece a to piece b has weight 0 if merging the
characters of a and b gives back exactly a, b, and no weight (the semiring's
zero) otherwise. A sequence whose every adjacent pair passes M is the merge
result itself, so M leaves one path, and the shortest path is exact.

No piece has U+2581 after another character, so texts fall apart before each
run of it; segments are encoded once each per task (bounded memory).
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, giving_back, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, BPE = 1, 2
UNK_PENALTY = 10.0
WORDS, SEGMENTS, PAIRS = 250_000, 120_000, 300_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protocol buffer message."""
    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = raw[i]
            n |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return n, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = raw[i : i + n], i + n
        else:
            size = 8 if kind == 1 else 4
            value, i = raw[i : i + size], i + size
        yield tag >> 3, value


class Normaliser:
    """N: a precompiled character map (a double-array trie over UTF-8 bytes
    with a pool of replacements) and the rules for spaces."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.dummy_prefix, self.squeeze, self.space = dummy_prefix, squeeze, SPACE if escape else " "
        self.units, self.pool = (), b""
        if charsmap:
            size = struct.unpack_from("<I", charsmap)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
            self.pool = charsmap[4 + size :]

    def _longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        units, best = self.units, None
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node = offset(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= offset(unit)
            if (unit >> 8) & 1:
                to = units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.pool[to : self.pool.index(b"\0", to)])
        return best

    def _mapped(self, text: str) -> str:
        if not self.units:
            return text
        raw, out, i = text.encode(), [], 0
        while i < len(raw):
            if hit := self._longest(raw, i):
                out.append(hit[1])
                i += hit[0]
            else:
                n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
                out.append(raw[i : i + n])
                i += n
        return b"".join(out).decode()

    def __call__(self, text: str) -> str:
        text = self._mapped(text)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return ((" " if self.dummy_prefix else "") + text).replace(" ", self.space)


class Transducer:
    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, unk_surface, norm = UNIGRAM, " ⁇ ", {}
        for field, value in _fields(model):
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif field == 2:
                x = dict(_fields(value))
                self.kind = x.get(3, UNIGRAM)
                unk_surface = x[44].decode() if 44 in x else unk_surface
            elif field == 3:
                norm = dict(_fields(value))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have this form")
        self.unk_surface = unk_surface
        self.normalise = Normaliser(norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))
        self.text_ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER, UNUSED)}
        if any(t in (USER, UNUSED) for _, _, t in self.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.scores = [s for _, s, _ in self.pieces]
        self.unk = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.longest = max(map(len, self.text_ids), default=1)
        self.unk_score = min((self.scores[i] for i in self.text_ids.values()), default=0.0) - UNK_PENALTY
        # Characters of a trie node: which prefixes of pieces exist (P's states).
        self.states = {p[:k]: -1 for p in self.text_ids for k in range(1, len(p) + 1)} | self.text_ids
        # Neighbours within some piece; between any others every text may be cut.
        self.inner = {(p[k], p[k + 1]) for p in self.text_ids for k in range(len(p) - 1)}
        self.trie: dict = {}
        for p, x in self.text_ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = x
        self.separable = not any(SPACE in p.lstrip(SPACE) for p in self.text_ids)
        self.allowed: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}  # by word, without the space before it
        self.old_words: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.surface = [
            bytes([int(p[3:5], 16)]).decode("utf-8", "surrogateescape") if t == BYTE else "" if t == CONTROL else unk_surface if t == UNKNOWN else p.replace(SPACE, " ") for p, _, t in self.pieces
        ]

    # M, for BPE
    def _merge(self, symbols: list[str]) -> list[str]:
        """The merge process itself, on the few characters of two pieces."""
        ids, scores = self.text_ids, self.scores
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                x = ids.get(symbols[i] + symbols[i + 1])
                if x is not None and (best is None or scores[x] > best):
                    best, at = scores[x], i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _adjacent(self, before: int, x: int) -> bool:
        if len(self.allowed) >= PAIRS:
            self.allowed.clear()
        a = "" if before == -1 else chr(-10 - before) if before < 0 else self.pieces[before][0]
        b = self.pieces[x][0]
        ok = self.allowed[(before << 20) + x] = self._merge([*a, *b]) == ([a, b] if a else [b])
        return ok

    def lattice(self, s: str, i: int) -> Iterator[tuple[str, int | None]]:
        """Arcs of the composed lattice that leave position i: piece and id,
        id None for a character that only B or the unknown piece takes."""
        get, single = self.states.get, False
        for j in range(i + 1, min(len(s), i + self.longest) + 1):
            piece = s[i:j]
            x = get(piece)
            if x is None:
                break
            if x >= 0:
                single |= j == i + 1
                yield piece, x
        if not single:
            yield s[i], None

    def _shortest(self, s: str) -> list[tuple[str, int | None]]:
        """Tropical shortest path, in topological order of the positions."""
        n = len(s)
        cost: list[float | None] = [0.0] + [None] * n
        back: list[tuple[str, int | None]] = [("", None)] * (n + 1)
        for i in range(n):
            if cost[i] is None:
                continue
            for piece, x in self.lattice(s, i):
                j, c = i + len(piece), cost[i] - (self.unk_score if x is None else self.scores[x])
                if cost[j] is None or c < cost[j]:
                    cost[j], back[j] = c, (piece, x)
        return self._path(back, n)

    def _only(self, s: str) -> list[int]:
        """The same over the lattice composed with M, as ids. Weights are 0 or
        none and at most one path leads into a position, so a best-first
        search that takes long arcs first ends with the shortest path, and a
        position that led nowhere never will. A character that only B takes
        has code -10 - ord."""
        n, root, allowed = len(s), self.trie, self.allowed.get
        path: list[int] = []
        starts: list[int] = []
        open_: list[list[tuple[int, int]]] = []  # arcs left to try, by depth
        dead: set[int] = set()
        i, before, fresh = 0, -1, True
        while i < n:
            if fresh:
                arcs, node, j = [], root.get(s[i]), i + 1
                if node is None or "" not in node:
                    arcs.append((-10 - ord(s[i]), j))
                while node is not None:
                    x = node.get("")
                    if x is not None:
                        arcs.append((x, j))
                    if j == n:
                        break
                    node = node.get(s[j])
                    j += 1
                open_.append(arcs)
            arcs, fresh = open_[-1], False
            while arcs:
                x, j = arcs.pop()
                if j in dead:
                    continue
                if x >= 0:
                    ok = allowed((before << 20) + x)
                    if not (ok or ok is None and self._adjacent(before, x)):
                        continue
                path.append(x)
                starts.append(i)
                i, before, fresh = j, x, True
                break
            if not fresh:
                dead.add(i)
                open_.pop()
                path.pop()
                i = starts.pop()
                before = path[-1] if path else -1
        return path if not path or min(path) >= 0 else self._fallback(path)

    def _fallback(self, path: list[int]) -> list[int]:
        out, unknown = [], False
        for x in path:
            if x >= 0:
                out.append(x)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(-10 - x).encode()]
            elif not unknown:
                out.append(self.unk)
            unknown = x < 0
        return out

    @staticmethod
    def _path(back: list, n: int) -> list[tuple[str, int | None]]:
        path = []
        while n:
            path.append(back[n])
            n -= len(back[n][0])
        return path[::-1]

    def _emit(self, path: list[tuple[str, int | None]]) -> list[int]:
        out, unknown = [], False
        for piece, x in path:
            if x is not None:
                out.append(x)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            elif not unknown:  # neighbouring unknown characters make one unknown piece
                out.append(self.unk)
            unknown = x is None
        return out

    def segments(self, s: str) -> list[str]:
        """Cuts before each run of U+2581: no piece spans one."""
        if not self.separable:
            return [s]
        parts, held = [], ""
        for x in s.split(SPACE):
            # each x followed an U+2581, but for the first
            parts.append(x)
        out = []
        for k, x in enumerate(parts):
            if k:
                held += SPACE
            if x:
                out.append(held + x)
                held = ""
        if held:
            out.append(held)
        return out

    def _ids(self, s: str) -> bytes:
        return array("I", self._only(s) if self.kind == BPE else self._emit(self._shortest(s))).tobytes()

    def _segment(self, s: str) -> bytes:
        """Ids of a segment, four bytes each; the segment is first cut where
        no piece spans two neighbouring characters."""
        if not self.bytes:
            return self._ids(s)
        inner, last, parts = self.inner, 0, []
        for k, pair in enumerate(zip(s, s[1:]), 1):
            if pair not in inner:
                parts.append(s[last:k])
                last = k
        if not last:
            return self._ids(s)
        return b"".join([self._known(x, self._ids) for x in (*parts, s[last:])])

    def _known(self, s: str, make) -> bytes:
        """From the cache of two generations: a full one becomes the old one,
        what is used from it moves on."""
        ids = self.cache.get(s)
        if ids is None:
            ids = self.old.get(s)
            if ids is None:
                ids = make(s)
            if len(s) <= 64:
                if len(self.cache) >= SEGMENTS:
                    self.old, self.cache = self.cache, {}
                self.cache[s] = ids
        return ids

    def packed(self, text: str | None) -> bytes:
        """Ids of a text, four bytes each."""
        if not text:
            return b""
        s = self.normalise(text)
        if self.separable and s[:1] == SPACE and s[-1:] != SPACE and SPACE * 2 not in s:
            parts = s[1:].split(SPACE)
            found = list(map(self.words.get, parts))
            if None in found:
                words, old = self.words, self.old_words
                for k, x in enumerate(found):
                    if x is None:
                        part = parts[k]
                        found[k] = x = old.get(part) or words.get(part) or self._segment(SPACE + part)
                        if len(words) >= WORDS:
                            self.old_words, self.words = old, words = words, {}
                        if len(part) <= 64:
                            words[part] = x
            return b"".join(found)
        return b"".join([self._known(x, self._segment) for x in self.segments(s)])

    def encode(self, text: str | None) -> list[int]:
        """Ids as the library gives them; null and empty texts have none."""
        return array("I", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The inverse transduction: bytes join to characters, control pieces
        vanish, U+2581 becomes a space, the dummy prefix goes."""
        text = "".join([self.surface[x] for x in ids])
        if self.normalise.dummy_prefix and text[:1] == " ":
            first = next(x for x in ids if self.surface[x])
            if self.pieces[first][2] == NORMAL:
                text = text[1:]
        try:
            text.encode()
        except UnicodeEncodeError:  # bytes from 0x80 on stand as lone surrogates
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text: str = "text", round_trip: bool = False) -> DataFrame:
    """docs with ids array<int> (empty for null and empty texts) and, with
    round_trip, `decoded`. One narrow pass; the model file (its size is fixed)
    goes along by broadcast. Rows are coded each on their own, so repeated rows
    and null ids stay as they are; very long texts are coded whole; an empty
    table gives an empty one. Extra columns pass through but for ids and
    decoded, which are replaced."""
    docs = docs.drop("ids", "decoded")
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        t = transducer(shared.value)
        for batch in slices(batches):
            packed = [t.packed(x) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
            values = np.frombuffer(b"".join(packed), dtype=np.uint32).view(np.int32)
            columns, names = [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))], [*batch.schema.names, "ids"]
            if round_trip:
                columns.append(pa.array([t.decode(array("I", x)) for x in packed], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    more = [StructField("ids", ArrayType(IntegerType(), True))] + [StructField("decoded", StringType())] * round_trip
    return docs.mapInArrow(giving_back(run), StructType([*docs.schema.fields, *more]))


_LOADED: dict[int, Transducer] = {}
CACHES.append(_LOADED)


def transducer(model: bytes) -> Transducer:
    """One compiled transducer, with its segment cache, while a task of encode runs."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Transducer(model)
    return _LOADED[key]


def decode(df: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """df with `decoded`; null id lists decode to null."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(batch):
        t = transducer(shared.value)
        return batch.map(lambda x: None if x is None else t.decode(list(x)))

    return df.withColumn("decoded", run(F.col(ids)))
