"""The pipeline's stages, each against brute force on the rows it got."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as pipeline
from quire.llm import ensemble, toxicity

from .test_dealt import brute_lines, brute_links, brute_targets, prose

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def fixture_rows() -> list[tuple]:
    r = random.Random(11)
    stock = "a stock line that many documents share"
    out = []
    for i in range(240):
        t = "\n".join(prose(500 * i + k, r.randint(8, 30)) + "." for k in range(r.randint(1, 5)))
        if i % 7 == 0:
            t += " vile" + r.choice(["a", "en", "ly"]) + "."
        if i % 4 == 1:
            t += "\n" + stock
        out.append(t)
    for i in range(240, 280):  # copies and near copies
        w = out[i % 12].split(" ")
        for _ in range(i % 3):
            w[r.randrange(len(w))] = f"edit{r.randrange(99)}"
        out.append(" ".join(w))
    out += ["", None, out[5]]
    return [(i, t, "en", None if i % 11 == 0 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """name -> (rows in, rows out)"""
    d = str(tmp_path_factory.mktemp("sf"))
    rows = fixture_rows()
    spark.createDataFrame(rows, DDL).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out, docs = {}, spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        done = stage(spark, docs, d)
        if k < len(pipeline.STAGES) - 1:
            assert dict(done.dtypes) == dict(docs.dtypes) and done.columns == pipeline.COLUMNS
        done.write.parquet(f"{d}/{k}")
        out[name] = ([tuple(r) for r in docs.collect()], [tuple(r) for r in spark.read.parquet(f"{d}/{k}").collect()])
        docs = spark.read.parquet(f"{d}/{k}")
    out["run"] = ([], [tuple(r) for r in pipeline.run(spark, d).collect()])
    return out


def test_toxicity_stage(stages):
    before, after = stages["toxicity"]
    known = sorted((i, t, int(i % 7 == 0)) for i, t, *_ in before if i < 240 and zlib.crc32(str(i).encode()) % 5)
    scorer = toxicity.Scorer(*toxicity.fit_bags([t for _, t, _ in known], [y for *_, y in known]))
    assert sorted(after, key=repr) == sorted((r for r in before if scorer.document(r[1])[0] < 0.5), key=repr)
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert sum(i % 7 == 0 for i in gone if i < 240) / 35 > 0.9 and sum(i % 7 != 0 for i in gone if i < 240) <= 3


def test_line_stage(stages):
    before, after = stages["line dedup"]
    kept = {i: (t, dropped) for i, _, dropped, t in brute_lines([(r[0], r[1]) for r in before])}
    want = [(i, kept[i][0] if kept[i][1] else t, la, s, len(kept[i][0]) if kept[i][1] else n) for i, t, la, s, n in before]
    assert sorted(after, key=repr) == sorted(want, key=repr) and any(d for _, d in kept.values())


def test_near_stage(stages):
    before, after = stages["near dedup"]
    texts = {r[0]: r[1] or "" for r in before}
    first, links = brute_links(texts)
    size = {i: len(ensemble.shingles(t)) for i, t in texts.items()}
    links = {(i, j) for i, j in links if max(size[i], size[j]) <= 2 * min(size[i], size[j])}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in [*links, *((first[t], i) for i, t in texts.items())]:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    assert sorted(r[0] for r in after) == sorted({root(i) for i in texts})
    assert len(after) < len(before)


def test_mixture_stage(stages):
    before, after = stages["mixture"]
    words = {r[0]: len((r[1] or "").split()) for r in before}
    size, taken = Counter(), Counter()
    for r in before:
        size[r[3]] += words[r[0]]
    for r in after:
        taken[r[3]] += words[r[0]]
    target = brute_targets(dict(size))
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)
    assert max(Counter(r[0] for r in after).values()) <= 2 and {r[0] for r in after} <= {r[0] for r in before}


def test_encoding_stage(stages):
    before, after = stages["piece encoding"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r[0], r[3], tuple(library.encode(r[1] or ""))) for r in before)
    assert Counter((i, s, tuple(ids)) for i, s, ids, _ in after) == want
    digest = lambda rows: hashlib.sha256(repr(sorted(rows, key=repr)).encode()).hexdigest()
    assert digest(stages["run"][1]) == digest(after)


AWKWARD = [
    (None, prose(1, 60), "en", "a", 1), (None, prose(2, 60), None, "a", 1), (None, prose(3, 60), "en", None, None), (None, None, None, None, None), (7, prose(4, 60), "en", "a", 1), (7, prose(5, 60), "en", "a", 1), (7, prose(4, 60), "en", "a", 1),
    (8, "", "en", "b", 0), (9, prose(6, 30_000), "en", "b", 1), (10, prose(4, 60), "en", "b", 1), (11, "a repeated line of some length\n" + prose(12, 30), "en", "c", 1), (12, "a repeated line of some length\n" + prose(13, 30), "en", "c", 1), (13, "A repeated line of some length\n" + prose(14, 30), "en", "c", 1),
]


def test_awkward_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, empty and very long texts, an
    extra column: every stage gives what its docstring says; then no rows."""
    d = str(tmp_path)
    df = spark.createDataFrame([(*r, "x", "x") for r in AWKWARD], DDL + ", size string, ids string").repartition(3)
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    stage = dict(pipeline.STAGES)
    assert len(stage["toxicity"](spark, df, d).collect()) == len(AWKWARD)
    lines = stage["line dedup"](spark, df, d).collect()
    assert len(lines) == len(AWKWARD) and sum("repeated line" in (r["text"] or "").lower() for r in lines) == 1
    near = stage["near dedup"](spark, df, d).collect()
    assert Counter(r["text"] or "" for r in near) == Counter({t or "": 1 for _, t, *_ in AWKWARD})
    assert {r["doc_id"] for r in near if r["text"] == AWKWARD[4][1]} == {7}
    mixed = stage["mixture"](spark, df, d).collect()
    assert {r["text"] for r in mixed} <= {r[1] for r in AWKWARD} and max(Counter((r["doc_id"], r["text"]) for r in mixed).values()) <= 4
    assert len(stage["piece encoding"](spark, df, d).collect()) == len(AWKWARD)
    assert all(f(spark, df.limit(0), d).count() == 0 for f in stage.values())
