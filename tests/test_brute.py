"""Document queries that have no SQL, against brute force over whole tables."""

import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

from quire.operators import lines, semantics
from quire.plans import q_tables
from quire.plans.catalog import QUERIES
from quire.plans.corpus_data import geo, spec
from quire.plans.q_headers import grids as header_grids
from quire.session import table
from quire.sources.pages import parse_pages

DATA = "/root/testdata/sf0.001"


def split(text: str) -> list[str]:
    """Sentences by a scan over characters: lines, then an end before an opening."""
    out = []
    for line in text.split("\n"):
        start = 0
        for m in re.finditer(r"[.!?]\s+(?=[A-Z0-9(\"'])", line):
            out.append(line[start : m.start() + 1].strip())
            start = m.end()
        out.append(line[start:].strip())
    return [s for s in out if s]


def test_spans_hold_their_labels(spark):
    """Every span lies in its text, ends with its label, and comes in order."""
    texts = {r["unit"]: r["text"] for r in spec(spark, DATA).collect()}
    got = defaultdict(list)
    for r in QUERIES["crossref_spans"](spark, DATA).collect():
        got[r["unit"]].append((r["start"], r["end"], r["target_type"], r["label"]))
    want = {u: [(a, b, k, label) for k, label, a, b in semantics.references(t)] for u, t in texts.items()}
    assert {u: sorted(x) for u, x in got.items()} == {u: sorted(x) for u, x in want.items() if x}
    assert all(t in texts[u][a:b] for u, x in got.items() for a, b, _, t in x)


def test_sentence_of_each_reference(spark):
    texts = {r["unit"]: r["text"] for r in spec(spark, DATA).collect()}
    want = Counter()
    for u, t in texts.items():
        for kind, label, a, b in semantics.references(t):
            inside = [s for s in split(t) if t.find(s) <= a and b <= t.find(s) + len(s)]
            want[u, kind, label, inside[0] if inside else t.strip()] += 1
    got = Counter(map(tuple, QUERIES["reference_sentences"](spark, DATA).select("unit", "target_type", "label", "sentence").collect()))
    assert got == want


def test_similarity(spark):
    want = {r["p_partkey"]: SequenceMatcher(None, r["p_name"], r["p_type"]).ratio() for r in table(spark, DATA, "part").collect()}
    assert {r["p_partkey"]: r["ratio"] for r in QUERIES["sequence_similarity"](spark, DATA).collect()} == want


def naive_parts(text: str, most: int) -> list[str]:
    """Character by character: the last sentence end before white space, else
    the last line break or space past half of the budget, else the budget."""
    out, rest = [], text.strip()
    while len(rest) > most:
        at = 0
        for k in range(1, most):
            if rest[k - 1] in ".!?" and rest[k].isspace():
                at = k
        if not at:
            soft = max((k for k in range(most) if rest[k] in "\n "), default=-1)
            at = soft if soft >= most // 2 else most
        if rest[:at].strip():
            out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [*out, rest] if rest else out


def test_parts_of_whole_texts(spark):
    want = Counter()
    for r in table(spark, DATA, "documents").collect():
        parts = naive_parts(r["text"] or "", 512)
        for n, x in enumerate(parts, 1):
            want[r["doc_id"], n, len(parts), len(x), (len(x) + 3) // 4] += 1
    assert Counter(map(tuple, QUERIES["budget_split"](spark, DATA).collect())) == want


def test_realigned_headers_by_hand(spark):
    """The moves again, cell by cell in plain loops."""
    want = {}
    for r in header_grids(spark, DATA).collect():
        head, body, moves = list(r["grid"][0]), r["grid"][1:], 0
        full = [sum(bool(row[k].strip()) for row in body) for k in range(len(head))]
        for k in range(len(head)):
            if not head[k].strip() or full[k]:
                continue
            free = [j for j in (k - 1, k + 1) if 0 <= j < len(head) and full[j] and not head[j].strip()]
            if not free:
                continue
            most = max(full[j] for j in free)
            right = full[k + 1] if k + 1 < len(head) else 0
            to = k - 1 if k - 1 in free and full[k - 1] >= right else k + 1 if k + 1 in free else free[0]
            assert most
            head[to], head[k], moves = head[k].strip(), "", moves + 1
        want[r["grid_id"]] = (moves, ";".join("/".join(x) for x in [head, *body]))
    assert {r["grid_id"]: (r["shifts"], r["cells"]) for r in QUERIES["header_realign"](spark, DATA).collect()} == want


def test_row_pipeline(spark):
    """The whole way of a grid in plain loops."""
    from quire.operators.headers import HINTS

    full = lambda r: sum(bool(x) for x in r)
    dense = lambda rows: sum(map(full, rows)) / max(1, sum(map(len, rows)))

    def unique(names: list[str]) -> list[str]:
        return [x if names[: i + 1].count(x) == 1 else f"{x} {names[: i + 1].count(x)}" for i, x in enumerate(names)]

    want = {}
    for r in header_grids(spark, DATA).collect():
        g = [[x.strip() for x in row] for row in r["grid"]]
        kept = [row for n, row in enumerate(g) if full(row) or n == 0]
        use = [k for k in range(len(kept[0])) if any(row[k] for row in kept)]
        g = [[row[k] for k in use] for row in kept]
        promoted = 0
        if len(g) >= 3 and not full(g[0]) and full(g[1]) / len(g[1]) >= 0.5 and sum(bool(set(re.split("[^a-z]+", x.lower())) & set(HINTS)) for x in g[1]) >= 2 and dense(g[2:]) >= 0.35:
            g, promoted = g[1:], 1
        head, body, moves = list(g[0]), g[1:], 0
        n = [sum(bool(row[k]) for row in body) for k in range(len(head))]
        for k in range(len(head)):
            if head[k] and not n[k]:
                left = k > 0 and n[k - 1] > 0 and not head[k - 1]
                right = k + 1 < len(head) and n[k + 1] > 0 and not head[k + 1]
                far = n[k + 1] if k + 1 < len(head) else 0
                to = k - 1 if left and n[k - 1] >= far else k + 1 if right else k - 1 if left else None
                if to is not None and len(g) >= 2:
                    head[to], head[k], moves = head[k], "", moves + 1
        multi = False
        if len(body) >= 2:
            second = body[0]
            again = any(a and a == b for a, b in zip(head, head[1:]))
            blank = sum(not a and bool(b) for a, b in zip(head, second))
            multi = full(second) >= max(2, len(second) // 2) and dense(body[1:]) >= 0.35 and (again or blank >= 2) and full(head) > 0
        if multi:
            names, last = [], ""
            for k, (a, b) in enumerate(zip(head, body[0])):
                parent = a or (last if last and b else "")
                last = a or last
                names.append(f"{parent} / {b}" if parent and b and parent != b else b or parent or f"Column {k + 1}")
            body = body[1:]
        else:
            names = [x or f"Column {k + 1}" for k, x in enumerate(head)]
        want[r["grid_id"]] = (",".join(unique(names)), ";".join("/".join(x) for x in body), promoted, moves, multi, 0)
    assert {r["grid_id"]: tuple(r)[1:] for r in QUERIES["table_row_pipeline"](spark, DATA).collect()} == want


def test_captions_once(spark):
    """Within 30 points of the last kept caption of one text of a document."""
    at = defaultdict(list)
    for r in lines.typed(geo(spark, DATA)).filter("line_type in ('figure_caption', 'table_caption')").collect():
        at[r["doc_id"], r["text"]].append((r["top"], r["line_no"]))
    want = Counter()
    for (doc, text), found in at.items():
        last = -1e9
        for top, line in sorted(found):
            if top - last > 30:
                want[doc, text, line] += 1
                last = top
    assert Counter(map(tuple, QUERIES["captions_once"](spark, DATA).collect())) == want and sum(want.values()) < sum(map(len, at.values()))


def test_pruned_candidates(spark):
    """Accepted by rank unless an accepted one holds 90 % of the area."""
    pages = defaultdict(list)
    for r in q_tables.candidates(spark, DATA).collect():
        pages[r["page"]].append(r)
    want = set()
    for page, found in pages.items():
        best = {}
        for r in sorted(found, key=lambda r: (-r["quality"], r["strategy"], r["candidate_id"])):
            best.setdefault(tuple(round(r[c], 1) for c in ("x0", "top", "x1", "bottom")), r)
        area = lambda r: (r["x1"] - r["x0"]) * (r["bottom"] - r["top"])
        order = sorted(best.values(), key=lambda r: (-(r["quality"] + min(0.2 * area(r) / 484704.0, 0.1)), -area(r), r["candidate_id"]))[:20]
        kept = []
        for n, r in enumerate(order, 1):
            shared = lambda k: max(0.0, min(r["x1"], k["x1"]) - max(r["x0"], k["x0"])) * max(0.0, min(r["bottom"], k["bottom"]) - max(r["top"], k["top"]))  # noqa: B023, E731
            if all(shared(k) < 0.9 * area(r) for k in kept):
                kept.append(r)
                want.add((page, r["candidate_id"], n))
    assert set(map(tuple, QUERIES["candidate_prune"](spark, DATA).collect())) == want


def test_repaired_grids(spark):
    """Leftmost neighbours that never both hold text merge until none are left."""
    want = {}
    for r in q_tables.grids(spark, DATA).collect():
        columns = [list(c) for c in zip(*r["grid"])]
        while True:
            at = next((i for i in range(len(columns) - 1) if not any(x.strip() and y.strip() for x, y in zip(columns[i], columns[i + 1]))), None)
            if at is None:
                break
            columns[at : at + 2] = [[x.strip() or y.strip() for x, y in zip(columns[at], columns[at + 1])]]
        want[r["grid_id"]] = ";".join("/".join(x) for x in zip(*columns))
    assert dict(map(tuple, QUERIES["grid_repair"](spark, DATA).collect())) == want


def test_line_runs(spark):
    """Runs of body lines by indent, gap and sentence end, line after line."""
    pages = defaultdict(list)
    for r in lines.typed(geo(spark, DATA)).collect():
        pages[r["doc_id"], r["page"]].append(r)
    want = set()
    for key, found in pages.items():
        runs = []
        for r in sorted(found, key=lambda r: r["line_no"]):
            body = r["line_type"] == "body_line"
            if runs and body and all(x["line_type"] == "body_line" for x in runs[-1][-1:]):
                last = runs[-1]
                near = abs(r["x0"] - last[0]["x0"]) <= 6 and r["top"] - max(x["bottom"] for x in last) <= 18
                if near and (last[-1]["text"].strip() or "?")[-1] not in ".:;?!":
                    last.append(r)
                    continue
            runs.append([r])
        want |= {(*key, n, len(x), x[0]["line_no"]) for n, x in enumerate(runs, 1)}
    assert set(map(tuple, QUERIES["greedy_line_merge"](spark, DATA).collect())) == want


def test_page_ranges():
    assert parse_pages("1-3,7,2", 9) == [1, 2, 3, 7] and parse_pages(None, 2) == [1, 2]
    for bad in ("3-1", "0", "11", "x", "1,,2"):
        try:
            parse_pages(bad, 10)
        except ValueError:
            continue
        raise AssertionError(bad)
