"""The ten operators against brute force, and on awkward rows: nulls, empty
and very long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import cdc, covertree, ensemble, linededup, mixture, piecefst, spotsigs, tokencount, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, ids string, fp string, hits string, key string, n string, node string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu the of and to in".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice("abcdefgh") * r.randint(0, 3)) for _ in range(n))


def rows() -> list[tuple]:
    out = [prose(i, 40 + 7 * i) for i in range(12)]
    out += [out[3], out[3], out[4].replace("alpha", "omega"), None, "", "\n\n", "Ünï ² <|endoftext|> x", prose(99, 30_000), "a repeated line of some length\nx", "A repeated line of some length \ny", "\ta repeated line of some length", "!!! ???"]
    made = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x", "x") for i, t in enumerate(out)]
    return [*made, made[2], (None, "no id here at all", None, None, None, *["x"] * 8)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1 --------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/b", "<html><head><title> T &amp; u </title></head><body><p>One<br>two &lt;3</p><script>x()</script></body></html>"), (2, None, None), (3, "http://c", "")], "page_id long, url string, html string")
    got = {(r["page_id"], r["warc_type"]): r for r in warc.derivatives(warc.page_responses(pages), keep=("page_id",)).collect()}
    assert len(got) == 6
    text, meta = got[1, "conversion"], got[1, "metadata"]
    assert text["block"] == "One\ntwo <3" and "title: T &amp; u" in meta["block"]
    assert text["refers_to"] == meta["refers_to"] != text["record_id"] and text["source_digest"] == meta["source_digest"]
    assert text["block_digest"] == "sha256:" + hashlib.sha256(text["block"].encode()).hexdigest()
    assert got[2, "conversion"]["block"] == "" and got[2, "conversion"]["refers_to_target_uri"] is None
    other = warc.page_responses(pages).withColumn("content_type", F.lit("image/png"))
    assert {r["warc_type"] for r in warc.derivatives(other).collect()} == {"metadata"}
    written = warc.write_warc(warc.derivatives(warc.page_responses(pages)), str(tmp_path))
    assert sum(r["records"] for r in written.collect()) == 6
    back = warc.read_warc(spark, str(tmp_path)).collect()
    assert Counter(r["warc_type"] for r in back) == {"metadata": 3, "conversion": 3}
    assert {bytes(r["block"]).decode() for r in back if r["headers"].get("WARC-Target-URI") == "http://a/b" and r["warc_type"] == "conversion"} == {"One\ntwo <3"}
    source = {r["record_id"]: r for r in warc.page_responses(pages).collect()}
    for r in back:
        h = r["headers"]
        of = source[h["WARC-Refers-To"]]
        assert h["WARC-Date"] == warc.CREATED and h["WARC-Refers-To-Date"] == of["warc_date"] and h.get("WARC-Refers-To-Target-URI") == of["target_uri"] and "WARC-Payload-Digest" not in h
        assert h["X-Source-Payload-Digest"] == of["payload_digest"] and base64.b64decode(h["X-Source-Headers"]).decode() == of["http_headers"]
        assert h["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(r["block"]).hexdigest()
    long = spark.createDataFrame([(1, "u", "<p>" + "word &lt; " * 400_000 + "</p>"), (1, "u", "<p>x</p>"), (1, "u", "<p>x</p>")], "page_id long, url string, html string")
    rows_ = warc.derivatives(warc.page_responses(long).withColumn("block", F.lit("clash")), keep=("page_id", "block", "record_id")).collect()
    assert len(rows_) == 6 and rows_[0].__fields__.count("block") == 1 and max(r["content_length"] for r in rows_) == len("word < " * 400_000) - 1 and len({r["record_id"] for r in rows_}) == 4
    assert list(warc.parse_warc(gzip.compress(b""))) == []
    assert warc.derivatives(warc.page_responses(pages.limit(0))).count() == 0


# 2 --------------------------------------------------------------------------


def test_spotsigs(docs, none):
    got = spotsigs.edit_study(docs).collect()
    order = sorted([(-1 if r[0] is None else r[0], r[1] or "") for r in rows()])
    want = Counter()
    for (_, a), (_, b) in zip(order, order[1:] + order[:1]):
        k = len(a) // 4
        want[len(a), hashlib.sha256((a[: len(a) - k] + b[:k]).encode()).hexdigest()] += 1
    assert Counter((r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    long = [r for r in got if r["n_chars"] > 200]
    assert all(r["near_edited"] > 0.3 for r in long)
    assert spotsigs.edit_study(none).count() == 0
    one = docs.filter("doc_id = 1")
    assert spotsigs.edit_study(one).first()["near_next"] == 1.0


def test_common_signatures_come_last():
    """By their counts, not all common ones alike; those that no sample has first."""
    known, counts = np.array([3, 7, 9]), np.array([50, 2, 900])
    assert spotsigs.rare_first(np.array([1, 3, 7, 8, 9]), known, counts).tolist() == [1, 8, 7, 3, 9]
    assert spotsigs.rare_first(np.array([2, 1]), known[:0], counts[:0]).tolist() == [1, 2]


def test_spotsigs_pairs(spark):
    base = [prose(i, 60) for i in range(30)]
    base += [t + " omega the end of it" for t in base[:10]] + [base[0]]
    df = spark.createDataFrame(list(enumerate(base)), "doc_id long, text string")
    pairs, members = spotsigs.near_pairs(df, 0.5)
    sets = [set(naive_signatures(t)) for t in base[:40]]
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5}
    assert {tuple(sorted((r["id_a"], r["id_b"]))) for r in pairs.collect()} == want and want
    got = {r["doc_id"]: (r["class_id"], r["n_near"]) for r in spotsigs.near_classes(df).collect()}
    degree = Counter(i for p in want for i in p)
    assert got == {i: (0 if i == 40 else i, degree[0 if i == 40 else i]) for i in range(41)}


def naive_signatures(text: str) -> list[tuple]:
    """Chains word by word: an anchor and the next content words."""
    import xxhash

    words = spotsigs.WORD.findall(text.lower())
    common = [w in spotsigs.FUNCTION_WORDS for w in words]
    anchor = [c or (((xxhash.xxh3_64_intdigest(w) & ~1) >> 8) & (1 << 55) - 1) % spotsigs.ANCHOR_EVERY == 0 for w, c in zip(words, common)]
    if words and not any(anchor):
        anchor[0] = True
    return [(words[i], *[w for w, c in zip(words[i + 1 :], common[i + 1 :]) if not c][: spotsigs.CHAIN]) for i in range(len(words)) if anchor[i]]


def test_spotsigs_likeness_against_brute_force(docs):
    """near_edited and near_next by naive chains."""
    order = sorted([(-1 if r[0] is None else r[0], r[1] or "") for r in rows()])
    sets = lambda t: set(naive_signatures(t)) if spotsigs.WORD.search(t.lower()) else {t} - {""}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = Counter()
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        k = len(a) // 4
        want[None if i < 0 else i, round(like(sets(a), sets(a[: len(a) - k] + b[:k])), 9), round(like(sets(a), sets(b)), 9)] += 1
    assert Counter((r["doc_id"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in spotsigs.edit_study(docs).collect()) == want


# 3 --------------------------------------------------------------------------


def test_pieces_match_library(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = piecefst.encode(docs, piecefst.load(path), round_trip=True).collect()
    for r in got:
        ids = library.encode(r["text"] or "")
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)
    r = random.Random(3)
    t = piecefst.Transducer(piecefst.load(path))
    for _ in range(1500):
        s = "".join(r.choice("ab cdé日😀 \n\t▁.,<>0x") for _ in range(r.randint(0, 40)))
        assert t.encode(s) == library.encode(s) and t.decode(t.encode(s)) == library.decode(library.encode(s))
    assert piecefst.encode(none, piecefst.load(path)).count() == 0
    back = piecefst.decode(piecefst.encode(docs, piecefst.load(path)), piecefst.load(path))
    assert {r["decoded"] for r in back.collect()} == {r["decoded"] for r in got}


def _message(*fields) -> bytes:
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return b"".join(varint(k << 3 | (2 if isinstance(v, bytes) else 5 if isinstance(v, float) else 0)) + (varint(len(v)) + v if isinstance(v, bytes) else np.float32(v).tobytes() if isinstance(v, float) else varint(v)) for k, v in fields)


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_shortest_path(fallback):
    """A hand-made unigram model: the tropical shortest path is the library's."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * fallback
    pieces += [(p, s, 1) for p, s in (("▁", -3.1), ("a", -4.2), ("b", -4.4), ("c", -5.3), ("ab", -5.9), ("▁a", -5.2), ("▁ab", -7.0), ("bc", -6.5), ("abc", -9.1), ("ca", -7.7))]
    trainer = _message((3, 1), (4, len(pieces)), (35, int(fallback)), (40, 0), (41, 1), (42, 2), (43, 2**64 - 1))
    model = b"".join(_message((1, _message((1, p.encode()), (2, float(s)), (3, t)))) for p, s, t in pieces) + _message((2, trainer), (3, _message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    library, mine = sentencepiece.SentencePieceProcessor(model_proto=model), piecefst.Transducer(model)
    r = random.Random(7)
    for _ in range(400):
        s = "".join(r.choice("abc  dé") for _ in range(r.randint(0, 20)))
        assert mine.encode(s) == library.encode(s), s


# 4 --------------------------------------------------------------------------


def test_toxicity(spark, docs, none):
    r = random.Random(5)
    texts, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        s = [prose(1000 * i + k, 9) for k in range(r.randint(2, 9))]
        if bad:
            s[r.randrange(len(s))] += " vile" + r.choice(["a", "en", "ly"])
        texts.append((i, ". ".join(s) + "."))
        labels.append((i, 1, int(bad)))
    df, lab = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab)
    got = toxicity.score(df, model).withColumn("held", toxicity.held_out()).collect()
    held = [x for x in got if x["held"]]
    assert held and sum(x["predicted"] == int(x["doc_id"] % 6 == 0) for x in held) / len(held) > 0.95
    worst = [x for x in got if x["doc_id"] % 6 == 0 and x["predicted"]]
    assert sum("vile" in x["text"][x["worst_start"] : x["worst_end"]] for x in worst) / len(worst) > 0.95
    spans = toxicity.offending(df, model).collect()
    assert spans and all("vile" in x["sentence"] for x in spans[:20])
    awkward = toxicity.score(docs, model).collect()
    assert len(awkward) == len(rows()) and all(0 <= x["score"] <= 1 for x in awkward)
    assert all(x["score"] == 0 for x in awkward if not x["text"])
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.fit(none, lab.limit(0))
    assert toxicity.score(docs, blank).filter("predicted = 1").count() == 0


def test_toxicity_fit_sample():
    import inspect

    assert toxicity.MAX_DOCS == 12_000 == inspect.signature(toxicity.fit).parameters["max_docs"].default


# 5 --------------------------------------------------------------------------


def test_chunks_resist_shifts():
    raw = prose(1, 4000).encode()
    ends = cdc.cuts(raw)
    assert ends[-1] == len(raw) and (np.diff([0, *ends]) <= cdc.MAX_CHUNK).all()
    a = {tuple(x) for x in cdc.digests(raw, ends)}
    moved = b"inserted words " + raw
    b = {tuple(x) for x in cdc.digests(moved, cdc.cuts(moved))}
    assert len(a - b) <= 4
    for s in ("é日😀" * 500, "", "x" * 5000):
        e = cdc.cuts(s.encode())
        parts = [s.encode()[i:j] for i, j in zip([0, *e], e)]
        assert b"".join(parts) == s.encode() and all(p.decode() for p in parts)


def test_content_chunks(spark, docs, none):
    passage = prose(7, 70)
    texts = [(i, prose(50 + i, 200)) for i in range(20)] + [(100 + i, prose(200 + i, 60) + " " + passage + " " + prose(300 + i, 60)) for i in range(5)] + [(200, "tiny copy"), (201, "tiny copy")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in cdc.report(df).collect()}
    assert all(got[i]["repeated_bytes"] == 0 for i in range(20))
    assert all(got[100 + i]["repeated_bytes"] > 0.4 * len(passage) for i in range(5))
    assert got[100]["removed_bytes"] == 0 and all(got[100 + i]["removed_bytes"] > 0 for i in range(1, 5))
    assert got[200]["removed_bytes"] == 0 and got[201]["removed_bytes"] == 9
    kept = {r["doc_id"]: r["text"] for r in cdc.dedup(df).collect()}
    assert kept[201] == "" and len(kept[101].encode()) == got[101]["n_bytes"] - got[101]["removed_bytes"]
    awkward = cdc.report(docs).collect()
    assert len(awkward) == len(rows())
    assert {r["doc_id"]: r["removed_bytes"] == r["n_bytes"] for r in awkward if r["doc_id"] in (12, 13)} == {12: True, 13: True}
    assert cdc.report(none).count() == 0 and cdc.dedup(docs).count() == len(rows())


def test_chunks_of_short_passages_and_within_a_text(spark):
    texts = []
    for i in range(150):
        passage = " ".join(prose(4000 + i, 60).split()[:51])
        texts += [(2 * i + k, prose(5000 + 2 * i + k, 80) + " " + passage + " " + prose(6000 + 2 * i + k, 80)) for k in (0, 1)]
    one = prose(9000, 51)
    texts.append((1000, " ".join([prose(9001, 60), one, prose(9002, 60), one, prose(9003, 60)])))
    got = {r["doc_id"]: r for r in cdc.report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert sum(got[i]["repeated_bytes"] > 0 for i in range(300)) >= 0.98 * 300
    assert got[1000]["repeated_bytes"] > got[1000]["removed_bytes"] > 0


def naive_chunks(raw: bytes) -> list[bytes]:
    """The chunker byte by byte: a gear hash of the last 32 bytes."""
    out, start, h = [], 0, 0
    for i, b in enumerate(raw):
        h = (h * 2 + int(cdc.GEAR[b])) & 0xFFFFFFFF
        end = i + 1
        whole = end == len(raw) or raw[end] & 0xC0 != 0x80
        full = end - start == cdc.MAX_CHUNK
        if full and not whole:
            while raw[end] & 0xC0 == 0x80:
                end -= 1
        if full or whole and h >> (32 - cdc.MEAN_BITS) == 0 and end - start >= cdc.MIN_CHUNK or i + 1 == len(raw):
            out.append(raw[start:end])
            start = end
            if end < i + 1 and i + 1 == len(raw):
                out.append(raw[end:])
    return out


def test_chunks_against_brute_force(spark, docs):
    """The whole query by a naive chunker and plain dictionaries."""
    texts = [(r[0], r[1]) for r in rows()] + [(300 + i, prose(i % 5, 80) + " " + prose(800 + i, 40)) for i in range(12)] + [(300, prose(3, 300)), (None, prose(0, 80)), (None, "é" * 3000)]
    for _, t in texts:
        raw = (t or "").encode()
        ends = cdc.cuts(raw).tolist()
        assert [raw[a:b] for a, b in zip([0, *ends], ends)] == naive_chunks(raw)
    held = defaultdict(lambda: [set(), False])
    low = lambda i: -1 if i is None else i
    for i, t in texts:
        for c, n in Counter(naive_chunks((t or "").encode())).items():
            held[c][0].add(low(i))
            held[c][1] |= n > 1
    want = []
    for i, t in texts:
        raw, at, seen, marks = (t or "").encode(), 0, set(), []
        for c in naive_chunks(raw):
            if len(held[c][0]) > 1 or held[c][1]:
                marks.append((at, at + len(c), low(i) > min(held[c][0]) or c in seen))
            seen.add(c)
            at += len(c)

        def total(spans):
            runs = []
            for a, b, _ in spans:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            return sum(b - a for a, b in runs if b - a >= cdc.MIN_SPAN or (a, b) == (0, len(raw)))

        want.append((i, len(raw), total(marks), total([m for m in marks if m[2]])))
    got = [tuple(r)[:4] for r in cdc.report(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(x[3] for x in want)


def test_chunk_dedup_keeps_rows_of_one_id_apart(spark):
    shared, a, b, c = prose(1, 90), prose(2, 90), prose(3, 90), prose(4, 90)
    df = spark.createDataFrame([(1, shared), (2, a + " " + shared), (2, shared + " " + b), (None, c), (None, b), (2, a + " " + shared)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in cdc.dedup(df).collect()), key=repr)
    left = [t for i, t in got if i == 2]
    assert (1, shared) in got and (None, c) in got and (None, b) in got and left.count(left[0]) + left.count(left[1]) + left.count(left[2]) == 5
    assert sum(a[:400] in t for t in left) == 2 and all(shared not in t for t in left)


# 6 --------------------------------------------------------------------------


def test_dual_tree(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 1, (700, 8)) * 0.3 + r.normal(0, 1, 8) for _ in range(3)])
    data = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    data += [(20, data[20][1], 5), (5001, None, 1), (5002, [1.0] * 7 + [None], 1), (5003, [math.nan] + [0.0] * 7, 1), (5004, [math.inf] * 8, 1), (None, [0.0] * 8, 1), (5020, [1.0, 2.0], 1), (5021, [1.0, 3.0], 1), (5022, [], 1)]
    data += [(6000 + i, data[40][1], 1) for i in range(30)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in covertree.top_k(df, k=20).collect())
    clean = [(i, np.floor(64 * np.array(v))) for i, v, _ in data if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for q in sorted({i for i, _ in clean if i % 20 == 0}):
        v = next(v for i, v in clean if i == q)
        best = sorted((-int(v @ c), i) for i, c in clean if i != q and len(c) == len(v))[:20]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert covertree.top_k(df.limit(0)).count() == 0


def test_cover_tree_invariants():
    """Separation, covering and nesting of centres; every point in one leaf."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, (400, 5)) * 0.1 + c for c in r.normal(0, 4, (6, 5))] + [np.ones((300, 5))])
    deep, open_ = 0, [(covertree.cover_tree(x, 16), 0)]
    assert sorted(np.concatenate([n.rows for n in covertree.leaves(open_[0][0])]).tolist()) == list(range(len(x)))
    while open_:
        node, level = open_.pop()
        deep = max(deep, level)
        assert (np.linalg.norm(x[node.rows] - node.centre, axis=1) <= node.radius + 1e-6).all()
        c = np.array([n.centre for n in node.children])
        if len(c):
            assert (c == node.centre).all(axis=1).any() and 1 < len(c) <= covertree.NET
            assert all(n.radius <= node.radius / covertree.BASE + 1e-6 for n in node.children)
            d = np.linalg.norm(c[:, None] - c[None], axis=2) + np.eye(len(c)) * 1e9
            assert d.min() > node.radius / covertree.BASE - 1e-6
        open_ += [(n, level + 1) for n in node.children]
    assert deep >= 3


def test_cells_are_pruned_before_copies(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(0, 0.02, (300, 6)) + c for c in np.eye(6) * 9])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    keep = covertree.pairs_of_cells
    covertree.pairs_of_cells = lambda *a: seen.append(keep(*a)) or seen[0]
    try:
        got = {(t["query_id"], t["rank"]): t["vec_id"] for t in covertree.top_k(df, k=5).collect()}
    finally:
        covertree.pairs_of_cells = keep
    q, d = len({p[1] for p in seen[0]}), len({p[2] for p in seen[0]})
    assert len(seen[0]) < 0.5 * q * d
    v = np.floor(64 * x)
    for i in range(0, len(x), 20):
        s = v @ v[i]
        s[i] = -np.inf
        assert [got[i, k + 1] for k in range(5)] == np.lexsort((np.arange(len(x)), -s))[:5].tolist()


def test_bound_is_sound():
    r = np.random.default_rng(4)
    q, d = np.floor(r.normal(0, 20, (300, 6))), np.floor(r.normal(0, 20, (900, 6)))
    got = covertree.search(q, np.arange(300) + 10_000, d, np.arange(900), 7)
    for i, (ids, scores) in enumerate(got):
        s = d @ q[i]
        best = np.lexsort((np.arange(900), -s))[:7]
        assert ids.tolist() == best.tolist() and scores.tolist() == s[best].tolist()


# 7 --------------------------------------------------------------------------


def brute_links(texts: dict[int, str]):
    first = {}
    for i, t in sorted(texts.items()):
        first.setdefault(t, i)
    s = {i: set(ensemble.shingles(t).tolist()) for t, i in first.items()}
    return first, {(i, j) for i in s for j in s if i < j and s[i] and s[j] and len(s[i] & s[j]) >= 0.7 * min(len(s[i]), len(s[j])) - 1e-9}


@pytest.mark.parametrize("tile", [ensemble.TILE, 16])
def test_containment_ensemble(spark, docs, none, tile, monkeypatch):
    monkeypatch.setattr(ensemble, "TILE", tile)
    r = random.Random(1)
    texts = {i: prose(i + 70, 120) for i in range(40)}
    for i in range(60):  # near copies: a few words replaced
        w = texts[i % 3].split()
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = "changed" + str(r.randrange(99))
        texts[100 + i] = " ".join(w)
    texts |= {200 + i: texts[i] for i in range(5)} | {300: texts[7] + " " + prose(5, 60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    first, links = brute_links(texts)
    got = {x["doc_id"]: x for x in ensemble.near_duplicates(df).collect()}
    degree = Counter(i for p in links for i in p)
    found = sum(got[i]["n_links"] for i in first.values())
    assert found >= 0.95 * 2 * len(links) and all(got[i]["n_links"] <= degree[i] for i in first.values())
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in [*links, *((first[t], i) for i, t in texts.items())]:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    assert {i: x["class_id"] for i, x in got.items()} == {i: root(i) for i in texts}
    assert got[200]["text_class"] == 0 and got[200]["n_copies"] == 2
    if tile != 16:
        awkward = ensemble.near_duplicates(docs).collect()
        assert len(awkward) == len(rows()) and {x["class_id"] for x in awkward if x["doc_id"] in (3, 12, 13)} == {3}
        assert ensemble.near_duplicates(none).count() == 0


def all_links(texts: dict[int, str]) -> set[tuple[int, int]]:
    """Brute force over all pairs of texts, whatever their sizes."""
    s = {i: set(ensemble.shingles(t).tolist()) for i, t in texts.items()}
    return {(i, j) for i in s for j in s if i < j and s[i] and s[j] and len(s[i] & s[j]) >= 0.7 * min(len(s[i]), len(s[j])) - 1e-9}


def test_containment_at_any_ratio(spark):
    r = random.Random(11)
    texts = {}
    for i, n in enumerate((3, 5, 8, 20, 40, 90, 150, 400)):
        quoted = prose(500 + i, n)
        for k, times in enumerate((2.1, 3, 8, 40)):
            w = quoted.split()
            if k % 2 and n > 20:
                w[r.randrange(n)] = "changed"
            texts[100 * i + k] = prose(900 + 10 * i + k, int(n * times) // 2) + " " + " ".join(w) + " " + prose(700 + 10 * i + k, int(n * times) // 2)
        texts[100 * i + 50] = quoted
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    links = all_links(texts)
    degree = Counter(i for p in links for i in p)
    got = {x["doc_id"]: x for x in ensemble.near_duplicates(df).collect()}
    assert len(links) >= 30 and {i: x["n_links"] for i, x in got.items()} == {i: degree[i] for i in texts}
    assert all(got[100 * i + k]["class_id"] == got[100 * i + 50]["class_id"] for i in range(8) for k in range(4))
    near = {x["doc_id"]: x["n_links"] for x in ensemble.near_duplicates(df, max_ratio=2.0).collect()}
    size = {i: len(ensemble.shingles(t)) for i, t in texts.items()}
    within = Counter(i for p in links if max(size[p[0]], size[p[1]]) <= 2 * min(size[p[0]], size[p[1]]) for i in p)
    assert all(n <= within[i] for i, n in near.items()) and sum(near.values()) >= 0.9 * sum(within.values())


def test_texts_of_common_lines_have_no_row_for_each_link(spark, monkeypatch):
    """Short texts made of lines that many larger ones hold: links and classes
    are exact in one block and in many, and far fewer rows leave the cells."""
    r, lines = random.Random(12), [prose(1300 + i, 9) for i in range(4)]
    texts = {i: prose(1400 + i, 3) + " " + " ".join(r.sample(lines, 2)) for i in range(40)}
    texts |= {100 + i: prose(1500 + i, 40) + " " + " ".join(r.sample(lines, r.randint(1, 3))) + " " + prose(1700 + i, 70) for i in range(120)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    links, rows, cells = all_links(texts), [], ensemble.in_cells
    degree = Counter(i for p in links for i in p)
    far = [p for p in links if p[0] < 100 <= p[1]]
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    monkeypatch.setattr(ensemble, "RARE", 8)
    monkeypatch.setattr(ensemble, "in_cells", lambda *a: rows.append(cells(*a)) or rows[-1])
    for at_once in (ensemble.CELL_ROWS, 60):
        monkeypatch.setattr(ensemble, "CELL_ROWS", at_once)
        got = {x["doc_id"]: x for x in ensemble.near_duplicates(df).collect()}
        assert all(abs(got[i]["n_links"] - degree[i]) <= (0 if i >= 100 else 0.1 * degree[i]) for i in texts)
        assert {i: x["class_id"] for i, x in got.items()} == {i: root(i) for i in texts}
    assert len(far) > 600 and sum(x["n"] for x in rows[0].filter("n > 0").collect()) == 2 * len(far) and rows[0].count() < len(far) / 2


@pytest.mark.parametrize("rare", [ensemble.RARE, 4])
def test_quoting_makes_no_copies(spark, rare, monkeypatch):
    """Texts that hold the same short one are no copies of each other, though
    all are linked; by pairs and in cells."""
    monkeypatch.setattr(ensemble, "RARE", rare)
    texts = {100: prose(3000, 12), 200: prose(3001, 90)}
    texts |= {i: prose(3100 + i, 30) + " " + texts[100] + " " + prose(3200 + i, 50) for i in range(20)}
    texts |= {300 + i: texts[i] + " " + prose(3300 + i, 8) for i in range(5)} | {400 + i: texts[100] + f" more{i}" for i in range(3)} | {500: texts[100] + " " + prose(3400, 5)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    size, links = {i: len(ensemble.shingles(t)) for i, t in texts.items()}, all_links(texts)

    def roots(pairs) -> dict[int, int]:
        to = {i: i for i in texts}
        for _ in texts:
            for a, b in pairs:
                to[a] = to[b] = min(to[a], to[b])
        return to

    got = {x["doc_id"]: x for x in ensemble.near_duplicates(df, copy_ratio=2.0).collect()}
    degree = Counter(i for p in links for i in p)
    assert {i: x["n_links"] for i, x in got.items()} == {i: degree[i] for i in texts}
    assert {i: x["linked_id"] for i, x in got.items()} == roots(links)
    copies = roots([(a, b) for a, b in links if max(size[a], size[b]) <= 2 * min(size[a], size[b])])
    assert {i: x["class_id"] for i, x in got.items()} == copies and len({copies[i] for i in range(20)}) == 20


def test_large_sets_travel_once(spark, monkeypatch):
    """A text that holds many short ones is in one group with them, not in one
    for each."""
    short = {i: prose(3500 + i, 12) for i in range(30)}
    texts = short | {100 + k: " ".join([prose(3600 + k, 90), *[short[i] for i in range(k, 30, 3)], prose(3700 + k, 90)]) for k in range(3)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    seen, celled = [], ensemble.celled

    def both(held):
        out = celled(held)
        seen.append(Counter(r["node"] for r in out[1].collect()))
        return out

    monkeypatch.setattr(ensemble, "celled", both)
    got = {x["doc_id"]: x["n_links"] for x in ensemble.near_duplicates(df).collect()}
    assert got == {i: 1 for i in short} | {100 + k: 10 for k in range(3)}
    ids = {r["doc_id"]: r["t"] for r in df.select("doc_id", ensemble.hash128("text")[0].alias("t")).collect()}
    assert [seen[-1][ids[100 + k]] for k in range(3)] == [1, 1, 1]


def test_far_sets_are_sieved(spark, monkeypatch):
    """Of a large text only what its short ones may hold is sent; links are as
    by brute force, also where a large text has near copies."""
    short = {i: prose(5500 + i, 12) for i in range(12)}
    texts = short | {100 + k: " ".join([prose(5600 + k, 300), *[short[i] for i in range(k, 12, 4)], prose(5700 + k, 300)]) for k in range(4)}
    texts |= {200: texts[100] + " one more", 300: " ".join(prose(5503, 12).split()[:7]) + " " + prose(5800, 400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    seen, sent = [], ensemble.sent_sets

    def both(*args):
        out = sent(*args)
        seen.extend(out.select("far", "n", F.octet_length("s").alias("bytes")).collect())
        return out

    monkeypatch.setattr(ensemble, "sent_sets", both)
    got = {x["doc_id"]: x["n_links"] for x in ensemble.near_duplicates(df).collect()}
    degree = Counter(i for p in all_links(texts) for i in p)
    assert got == {i: degree[i] for i in texts} and degree[100] == 4
    large = [x for x in seen if x["far"] and x["n"] > 300]
    assert len(large) >= 5 and all(x["bytes"] < 5 * x["n"] / 4 for x in large)
    assert all(x["bytes"] == 5 * x["n"] for x in seen if not x["far"] or x["n"] < 20)


def test_filing_takes_turns(spark, monkeypatch):
    """No turn files nearly all, together they file every entry, and no stored
    posting outlives its use."""
    texts = {i: prose(6000 + i, 60 + 9 * i) for i in range(60)} | {100 + i: prose(6000 + i, 60 + 9 * i) + " x y z" for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ensemble, "BUCKET_ENTRIES", 1000)
    sizes, gone, packed, discarded = [], [], ensemble.packed, ensemble.discarded

    def count(*args):
        out = packed(*args)
        sizes.append(sum(len(x["blob"]) for x in out.collect()))
        return out

    monkeypatch.setattr(ensemble, "packed", count)
    monkeypatch.setattr(ensemble, "discarded", lambda x: gone.append(x.inputFiles()) or discarded(x))
    got = {x["doc_id"]: x["n_links"] for x in ensemble.near_duplicates(df).collect()}
    degree = Counter(i for p in all_links(texts) for i in p)
    assert got == {i: degree[i] for i in texts}
    assert len(sizes) == 2 and max(sizes) < 0.8 * sum(sizes) and sum(map(len, gone)) and not any(Path(urlparse(f).path).exists() for x in gone for f in x)


def test_places_in_a_group_come_back():
    """Each bucket of a group, with flags and without; a text is listed once a group."""
    r = np.random.default_rng(2)
    text = np.repeat(np.arange(50), 30)
    key, t, n, place = r.integers(0, 1 << 32, len(text), dtype=np.uint32), np.sort(r.integers(-(1 << 62), 1 << 62, 50)), np.full(50, 30), r.integers(0, ensemble.GROUP, len(text))
    flag = np.arange(len(text)) % 30 < 7
    for flags in (False, True):
        ((_, blob),) = ensemble.pack(np.zeros(len(text), dtype=np.int32), text, key, t, flag if flags else None, n if flags else None, place)
        assert len(blob) == 8 + 4 * len(text) + 2 * -(-len(text) // 8) + 50 * (8 + 1 + 5 * flags)
        for k in range(ensemble.GROUP):
            own, got = place == k, ensemble.unpack(blob, np.uint32, flags, k)
            assert (got[0][got[2]] == t[text[own]]).all() and (got[3] == key[own]).all() and len(got[0]) == len(set(text[own].tolist()))
            assert (got[4] == (flag[own] if flags else False)).all() and (not flags or (got[1] == 30).all())


def test_packed_entries_come_back():
    """Counts of one byte and of four, with flags and without."""
    r = np.random.default_rng(1)
    for many in (5, 900):
        text = np.repeat(np.arange(4), [many, 2, 1, 3])
        key, flag, t, n = r.integers(0, 1 << 32, len(text), dtype=np.uint32), np.arange(len(text)) % many < 2, r.integers(-(1 << 62), 1 << 62, 4), np.array([many, 7, 1, 3])
        flag = np.concatenate([np.sort(flag[text == i])[::-1] for i in range(4)])
        for flags in (False, True):
            ((bucket, blob),) = ensemble.pack(np.zeros(len(text), dtype=np.int32), text, key, t, *((flag, n) if flags else ()))
            got = ensemble.unpack(blob, np.uint32, flags)
            assert bucket == 0 and (got[0] == t).all() and (got[2] == text).all() and (got[3] == key).all() and (not flags or (got[1] == n).all() and (got[4] == flag).all())
            assert len(blob) == 8 + 4 * len(text) + 4 * (8 + (1 if many < 256 else 4) * (1 + flags) + 4 * flags)


def test_pairs_of_a_few_common_lines_are_not_compared(spark, monkeypatch):
    """Of pairs that share a band most share only a line: their sets aren't
    sent; no pair at the threshold goes with them."""
    lines = [prose(2000 + i, 50) for i in range(3)]
    texts = {i: prose(2100 + i, 60) + " " + lines[i % 3] + " " + prose(2300 + i, 60 + i % 40) for i in range(150)}
    texts |= {1000 + i: " ".join(texts[i].split()[:-12]) + " " + prose(2500 + i, 25) for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    seen, likely = [], ensemble.likely

    def both(filed, *rest):
        out = likely(filed, *rest)
        seen.extend({p for x in f.collect() for p in zip(*(y.tolist() for y in ensemble.filed_pairs(x["blob"])))} for f in (filed, out[0]))
        return out

    monkeypatch.setattr(ensemble, "likely", both)
    degree = Counter(i for p in all_links(texts) for i in p)
    got = {x["doc_id"]: x["n_links"] for x in ensemble.near_duplicates(df).collect()}
    met, kept = seen
    assert kept <= met and len(met) > 200 and len(kept) < 0.3 * len(met)
    assert sum(degree.values()) >= 40 and got == {i: degree[i] for i in texts}


def test_shingles_are_those_of_the_words():
    """Hashed together or alone, and as many as there are different runs of words."""
    odd = ["", None, "!!", "a", "A b", "a b c", "\u0130stanbul \u0391\u03a3 \u0391\u03a3 x", "\u00e91_\u00b2 x y", "a b c a b c", *[prose(i, 40 + i) for i in range(30)]]
    sets = ensemble.shingle_sets(odd)
    assert all((a == ensemble.shingles(t)).all() and len(a) == len(ensemble.shingles(t)) for t, a in zip(odd, sets))
    words = [re.findall(r"\w+", (t or "").lower()) for t in odd]
    runs = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else {t} if t else set() for t, w in zip(odd, words)]
    assert [len(x) for x in sets] == [len(x) for x in runs]
    assert len(np.unique(np.concatenate(sets))) == len(set().union(*runs))


@pytest.mark.parametrize("hot", [False, True])
def test_recall_at_the_threshold(spark, hot, monkeypatch):
    """Pairs of texts just at the threshold, the larger up to four times as
    large; also with every repeated key taken for hot (tiles, spread shingles)."""
    r, texts = random.Random(10), {}
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(7))
    ratios = (1.0, 1.5, 2.0, 4.0)
    for i in range(600):
        shared, own = [word() for _ in range(143)], [word() for _ in range(60)]
        texts[2 * i], texts[2 * i + 1] = " ".join(shared + own), " ".join([word() for _ in range(int(203 * ratios[i % 4]) - 143)] + shared)
    if hot:
        monkeypatch.setattr(ensemble, "ROUTE", 1)
        monkeypatch.setattr(ensemble, "TILE", 4)
    got = {x["doc_id"]: x["n_links"] for x in ensemble.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()}
    sets = {i: set(ensemble.shingles(t).tolist()) for i, t in texts.items()}
    wanted = Counter(i % 4 for i in range(600) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.7 * min(len(sets[2 * i]), len(sets[2 * i + 1])) - 1e-9)
    found = Counter(i % 4 for i in range(600) if got[2 * i])
    assert all(wanted[k] >= 130 and 0.93 * wanted[k] <= found[k] <= wanted[k] for k in range(4)), (wanted, found)


def test_bandings_differ():
    plans = {(b, r) for p in range(12) for _, _, _, b, r in ensemble.plans_of(p, 0.7)} | {(b, r) for p in range(12) for _, _, _, b, r in ensemble.plans_of(p, 0.9)}
    assert len({(b, r) for _, _, _, b, r in ensemble.plans_of(6, 0.7)}) == 2 and len(plans) >= 4


def test_repeated_and_null_ids_keep_their_texts_apart(spark):
    a, b, c = prose(1, 90), prose(2, 90), prose(3, 90)
    df = spark.createDataFrame([(None, a), (None, b), (None, c), (5, a + " tail"), (5, b), (5, "other words entirely here"), (6, c)], "doc_id long, text string")
    got = sorted(((x["doc_id"], x["class_id"], x["n_links"], x["n_copies"]) for x in ensemble.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, None, 1, 1), (None, None, 0, 2), (None, None, 0, 2), (5, None, 1, 1), (5, None, 0, 2), (5, 5, 0, 1), (6, None, 0, 2)], key=repr)


def test_tuning():
    for ratio in (1.0, 1.4, 2.0):
        b, k = ensemble.tune(0.7, ratio)
        assert b * k <= ensemble.HASHES and 1 - (1 - ensemble.jaccard_at(0.7, ratio) ** k) ** b >= ensemble.RECALL


# 8 --------------------------------------------------------------------------


def brute_lines(pairs: list[tuple]):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    at = defaultdict(list)
    for n, (i, t) in enumerate(pairs):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                at[k].append((-1 if i is None else i, n))
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(at.get(key(x), ())) >= 3 and (-1 if i is None else i) < max(at[key(x)])[0])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(docs, none, monkeypatch):
    pick = lambda df: sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=repr)
    want = sorted(brute_lines([(r[0], r[1]) for r in rows()]), key=repr)
    assert pick(linededup.dedup_lines(docs)) == want and any(x[2] for x in want)
    monkeypatch.setattr(linededup, "FILTER_BYTES", -1)  # the way without filters
    assert pick(linededup.dedup_lines(docs)) == want
    assert linededup.dedup_lines(none).count() == 0


def test_line_index_is_reversible(spark):
    r = random.Random(9)
    stock = [f"this is stock line number {i}" for i in range(60)]
    texts = [(i, "\n".join(r.choice(stock) for _ in range(6))) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    a, b = df.filter("doc_id < 80"), df.filter("doc_id >= 80")
    pick = lambda x: sorted(((r["doc_id"], r["kept"]) for r in x.collect()))
    index = linededup.LineIndex.of(a, shards=4)
    grown = index.insert(b)
    assert pick(grown.apply(df)) == pick(linededup.dedup_lines(df))
    back = grown.delete(b.select("doc_id"))
    assert pick(back.apply(a)) == pick(linededup.dedup_lines(a)) == pick(index.apply(a))
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, index.counts.collect()))


def test_line_index_awkward_rows(spark, docs, none):
    """Null and repeated ids come and go; an empty insertion or deletion, and
    an index of nothing."""
    pick = lambda df: sorted(((r["doc_id"], r["n_dropped"], r["kept"]) for r in df.collect()), key=repr)
    index = linededup.LineIndex.of(docs, shards=4)
    assert pick(index.apply(docs)) == pick(linededup.dedup_lines(docs))
    less = index.delete(docs.filter("doc_id is null or doc_id = 2").select("doc_id"))
    assert sorted(map(tuple, less.counts.collect())) == sorted(map(tuple, linededup.reference_counts(linededup.postings(docs.filter("doc_id <> 2"))).collect()))
    back = less.insert(docs.filter("doc_id is null or doc_id = 2"))
    assert sorted(map(tuple, back.counts.collect()), key=repr) == sorted(map(tuple, index.counts.collect()), key=repr)
    same = linededup.LineIndex.of(none, shards=4).insert(none).delete(none.select("doc_id")).insert(docs)
    assert pick(same.apply(docs)) == pick(index.apply(docs))


def test_cuckoo_filter():
    r = np.random.default_rng(1)
    keys = r.integers(-(1 << 62), 1 << 62, (5000, 2))
    f = linededup.CuckooFilter.build(keys[:, 0], keys[:, 1])
    assert f.contains(keys[:, 0], keys[:, 1]).all()
    other = r.integers(-(1 << 62), 1 << 62, (20000, 2))
    assert f.contains(other[:, 0], other[:, 1]).mean() < 0.01
    for a, b in keys[:2500]:
        assert f.delete(int(a), int(b))
    g = linededup.CuckooFilter.loads(f.dumps())
    assert g.contains(keys[2500:, 0], keys[2500:, 1]).all() and g.contains(keys[:2500, 0], keys[:2500, 1]).mean() < 0.01


# 9 --------------------------------------------------------------------------


def test_plain_words_need_no_expression():
    """Most words are ASCII letters: they are one pre-token without a search;
    every word is split as the expression splits it."""
    splitter = tokencount.Splitter(public_tokenizers.path("byte_bpe_50k.json"))
    find, calls = splitter.find, []
    splitter.find = lambda x: calls.append(x) or find(x)
    plain = ["a", "word", "Word", "WORD", "s", "t", "re", "ll"]
    assert [splitter.of(w) for w in plain] == [[" " + w] for w in plain] == [find(" " + w) for w in plain] and not calls
    for w in ["", "it's", "'s", "don't", "a\nb", "\n", "x1", "42", "end.", "naïve", "ªb", "日本", "a_b", "--", "x\n\ny", "''", "'re", "İ"]:
        assert splitter.of(w) == find(" " + w)


@pytest.mark.parametrize("head", [3, tokencount.HEAD])
def test_token_counts(docs, none, head):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.token_counts(docs, path, head=head).collect())
    want = Counter()
    for r in rows():
        n = len(t.encode(r[1] or "", add_special_tokens=False).ids)
        want[r[0], len((r[1] or "").encode()), n, n > 1024] += 1
    assert got == want
    assert tokencount.token_counts(none, path).count() == 0


# 10 -------------------------------------------------------------------------


def brute_targets(size: dict) -> dict:
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    pool, full = 1.5 * sum(size.values()), set()
    while True:
        left, open_ = pool - sum(2 * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 2 * size[s] if s in full else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * size[s]}
        if not over:
            return target
        full |= over


def test_mixture(spark, docs, none):
    r = random.Random(3)
    data = [(i, None if i % 17 == 0 else "w " * r.choice([1, 5, 5, 5, 40, 300]), r.choice(["a", "b", "c", "Z", None]) if i % 3 else "a") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixture.mix(df).collect()
    size = defaultdict(int)
    for _, t, s in data:
        size[s] += len((t or "").split())
    target, taken = brute_targets(size), Counter()
    for x in got:
        assert abs(x["target"] - target[x["source"]]) < 1e-6 * target[x["source"]] + 1e-6 and x["source_size"] == size[x["source"]] and 0 <= x["copies"] <= 2
        taken[x["source"]] += x["copies"] * x["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = {x["doc_id"]: x["copies"] for x in mixture.mix(df.repartition(9)).collect()}
    assert again == {x["doc_id"]: x["copies"] for x in got}
    assert len(mixture.mix(docs).collect()) == len(rows()) and mixture.mix(none).count() == 0


def test_tilt_solves_the_dual(spark):
    """Against Newton on the same dual, in numpy; rates differ by size."""
    r = random.Random(4)
    sizes = {"a": Counter({n: r.randint(1, 40) for n in (1, 3, 10, 60, 400, 20_000)}), "b": Counter({n: r.randint(1, 9) for n in range(1, 200)}), "c": Counter({7: 5}), "d": Counter({n: 2 for n in (5, 90)})}
    total = {s: sum(n * k for n, k in c.items()) for s, c in sizes.items()}
    target = {"a": 0.3 * total["a"], "b": 1.7 * total["b"], "c": 0.01 * total["c"], "d": 2.0 * total["d"]}
    classes = spark.createDataFrame([(s, False, n, k) for s, c in sizes.items() for n, k in c.items()], "s string, s_null boolean, size long, n long")
    targets = spark.createDataFrame([(s, False, total[s], target[s]) for s in sizes], "s string, s_null boolean, source_size long, target double")
    lam = {x["s"]: x["lam"] for x in mixture.tilt(targets, classes).collect()}
    rate = lambda v, n: 2 / (1 + np.exp(-np.clip(v * n, -500, 500)))
    for s in "abc":
        n, k = np.array(list(sizes[s])), np.array(list(sizes[s].values()))
        lo, hi = -1e3, 1e3  # the gradient is monotone: bisection is brute and sure
        for _ in range(300):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (n * k * rate(mid, n)).sum() < target[s] else (lo, mid)
        assert lam[s] == pytest.approx(lo, rel=1e-6)
    assert lam["d"] == math.inf and rate(lam["a"], 1) > rate(lam["a"], 400) and rate(lam["b"], 1) < rate(lam["b"], 150)


def test_mixture_of_repeated_ids_and_clashing_columns(spark):
    data = [(1, "w " * k, "a", "x") for k in (3, 3, 5, 9)] + [(None, "w w", None, "x"), (None, None, None, "x"), (2, "v " * 400, "b", "x"), (1, "w " * 3, "a", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, rate string")
    runs = [sorted((repr(tuple(r)) for r in mixture.mix(df.repartition(k), keep=("text", "rate", "size")).collect())) for k in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(data)
