"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are both indexed by cover trees. A node has one of its points
for a centre and a covering radius r; its children are a net of it: their
centres lie further than r / BASE apart (separation), and every point is within
r / BASE of its child's centre (covering). A node whose net would take more
than NET centres has no structure to prune by and stays a leaf. For a query
node and a data node no inner product exceeds
    cq.cd + rq |cd| + rd |cq| + rq rd,
so the pair is pruned when that lies below the worst kth score so far among
the node's queries. What isn't pruned ends in a dense product of two leaves.

The same bound prunes before anything is copied: PIVOTS points of a sample
split queries and data into cells, whose covering radii are one aggregation.
A cell of queries meets only the cells of data that may reach the worst of its
queries' first bounds. Within a cell, queries fall into groups and data into
blocks of bounded size; a task searches one group in one block, and the partial
top-k lists are merged. Scores are integers, computed exactly in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

LEAF, NET, BASE, BLOCK, GROUP, PIVOTS, SEEDS = 128, 64, 1.3, 8192, 8192, 32, 2048


class Node:
    __slots__ = ("rows", "centre", "radius", "norm", "children")

    def __init__(self, x: np.ndarray, rows: np.ndarray, at: int, far: float):
        self.rows, self.centre, self.radius = rows, x[at], far
        self.norm = float(np.sqrt((self.centre**2).sum()))
        self.children: list[Node] = []


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """Nodes of at most `leaf` points, of radius 0, or whose net would take
    more than NET centres are leaves. Nets come by farthest-first traversal."""
    square = (x**2).sum(axis=1)

    def apart(rows: np.ndarray, at: int) -> np.ndarray:
        return np.sqrt(np.maximum(square[rows] + square[at] - 2 * (x[rows] @ x[at]), 0.0))

    every = np.arange(len(x))
    first = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    root = Node(x, every, first, float(apart(every, first).max()))
    open_ = [(root, first)]
    while open_:
        node, at = open_.pop()
        rows, reach = node.rows, node.radius / BASE
        if len(rows) <= leaf or node.radius == 0:
            continue
        nearest, centres = apart(rows, at), [at]  # a node's centre is the first of its children's
        owner = np.zeros(len(rows), dtype=np.int64)
        while nearest.max() > reach and len(centres) <= NET:
            centres.append(int(rows[nearest.argmax()]))
            d = apart(rows, centres[-1])
            closer = d < nearest
            owner[closer], nearest = len(centres) - 1, np.minimum(nearest, d)
        if len(centres) > NET:
            continue
        for k, c in enumerate(centres):
            held = owner == k
            node.children.append(Node(x, rows[held], c, float(nearest[held].max())))
            open_.append((node.children[-1], c))
    return root


def leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


def search(q: np.ndarray, q_ids: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, scores) of its k best, ties to the smaller id,
    without rows of its own id. `floor`: scores the kth best reaches for sure."""
    n = len(q)
    worst = np.full(n, -np.inf) if floor is None else floor.astype(np.float64).copy()
    ids, scores = [np.empty(0, dtype=np.int64)] * n, [np.empty(0)] * n

    def base(a: Node, b: Node) -> None:
        s = q[a.rows] @ d[b.rows].T
        s[q_ids[a.rows][:, None] == d_ids[b.rows][None, :]] = -np.inf
        take = s >= worst[a.rows][:, None]
        for i in np.flatnonzero(take.any(axis=1) & np.isfinite(s.max(axis=1))):
            row, m = a.rows[i], take[i] & np.isfinite(s[i])
            all_ids, all_scores = np.concatenate([ids[row], d_ids[b.rows][m]]), np.concatenate([scores[row], s[i][m]])
            best = np.lexsort((all_ids, -all_scores))[:k]
            ids[row], scores[row] = all_ids[best], all_scores[best]
            if len(best) == k:
                worst[row] = max(worst[row], scores[row][-1])

    stack = [(np.inf, cover_tree(q), cover_tree(d))]
    bound = lambda a, b: float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius + 1e-6
    while stack:
        top, a, b = stack.pop()
        if top < worst[a.rows].min():
            continue
        if not a.children and not b.children:
            base(a, b)
            continue
        split_q = bool(a.children) and (not b.children or a.radius > b.radius)
        pairs = [(bound(x, b), x, b) for x in a.children] if split_q else [(bound(a, x), a, x) for x in b.children]
        stack += sorted(pairs, key=lambda p: p[0])  # the most promising is taken next
    return list(zip(ids, scores))


def quantised(df: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) by component. Vectors that are null,
    empty or hold null or non-finite components are left out, as are null ids."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("double"))
    return df.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def pairs_of_cells(queries: DataFrame, data: DataFrame, pivots: dict[int, np.ndarray], k: int) -> list[tuple[int, int, int, int, int]]:
    """(dim, query cell, data cell, groups, blocks) of the cells that may hold
    a pair in somebody's top k; both sides have a row a cell here."""
    of = lambda df, *more: {(r["dim"], r["cell"]): r for r in df.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), *more).collect()}
    q, d = of(queries, F.min("floor").alias("floor")), of(data)
    out = []
    for (dim, i), a in sorted(q.items()):
        for (other, j), b in sorted(d.items()):
            if other != dim:
                continue
            p = pivots.get(dim)
            x, y = (p[i], p[j]) if p is not None else (np.zeros(1), np.zeros(1))
            top = np.inf if p is None else float(x @ y) + a["radius"] * np.linalg.norm(y) + b["radius"] * np.linalg.norm(x) + a["radius"] * b["radius"] + 1e-6
            if top >= a["floor"]:
                out.append((dim, i, j, -(-a["n"] // GROUP), -(-b["n"] // BLOCK)))
    return out


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score of each query (vec_id divisible by
    `every`) against every row but those of its own id.

    Repeated rows are candidates each; of a repeated query id the smallest
    vector asks. Vectors of unequal length don't meet. Ties go to the smaller
    vec_id. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    data = quantised(df, scale).withColumn("dim", F.size("v"))
    queries = data.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    # Pivots and seeds: bounded samples. They steer blocks and first bounds, not results.
    sample = data.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(SEEDS).collect()
    pivots: dict[int, np.ndarray] = {}
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in sample}:
        rows = [r for r in sample if r["dim"] == dim]
        x = np.array([r["v"] for r in rows])
        pivots[dim], seeds[dim] = x[:PIVOTS], (x, np.array([r["vec_id"] for r in rows]))
    shared = spark.sparkContext.broadcast((pivots, seeds))

    def place(batches: Iterator) -> Iterator:
        """The nearest pivot, and the distance from it."""
        for b in batches:
            v = b["v"].to_list()
            at, away = np.zeros(len(b), dtype=np.int32), np.zeros(len(b))
            for dim, p in shared.value[0].items():
                m = np.flatnonzero((b["dim"] == dim).to_numpy())
                if len(m):
                    x = np.stack([v[i] for i in m])
                    d = (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None, :] - 2 * x @ p.T
                    at[m], away[m] = d.argmin(axis=1), np.sqrt(np.maximum(d.min(axis=1), 0.0))
            if "floor" not in b:
                yield b.assign(cell=at, away=away)
                continue
            floor = np.full(len(b), -np.inf)  # each query's kth best score among the seeds
            for dim, (x, x_ids) in shared.value[1].items():
                m = np.flatnonzero((b["dim"] == dim).to_numpy())
                for part in np.array_split(m, max(1, len(m) // 1024)):
                    if len(part) and len(x) > k:
                        s = np.stack([v[i] for i in part]) @ x.T
                        s[b["vec_id"].to_numpy()[part][:, None] == x_ids[None, :]] = -np.inf
                        floor[part] = np.partition(s, -k, axis=1)[:, -k]
            yield b.assign(cell=at, away=away, floor=floor)

    fields = "vec_id long, dim int, v array<double>"
    data = cut(data.select("vec_id", "dim", "v").mapInPandas(place, f"{fields}, cell int, away double"))
    queries = cut(queries.select("vec_id", "dim", "v", F.lit(0.0).alias("floor")).mapInPandas(place, f"{fields}, floor double, cell int, away double"))
    near = pairs_of_cells(queries, data, pivots, k)
    if not near:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kept = F.broadcast(spark.createDataFrame(near, "dim int, q_cell int, d_cell int, groups int, blocks int"))  # PIVOTS squared rows a dimension at most
    salt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = ["dim", "q_cell", "d_cell", "grp", "block"]
    left = queries.withColumnRenamed("cell", "q_cell").join(kept, ["dim", "q_cell"]).select("vec_id", "v", "floor", "dim", "q_cell", "d_cell", salt("groups").alias("grp"), every("blocks").alias("block"))
    right = data.withColumnRenamed("cell", "d_cell").join(kept, ["dim", "d_cell"]).select("vec_id", "v", "dim", "q_cell", "d_cell", salt("blocks").alias("block"), every("groups").alias("grp"))

    def meet(q, d):
        import pandas as pd

        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, d = q.sort_values("vec_id"), d.sort_values("vec_id")
        ids = q["vec_id"].to_numpy()
        found = search(np.stack(q["v"].to_list()), ids, np.stack(d["v"].to_list()), d["vec_id"].to_numpy(), k, q["floor"].to_numpy())
        return pd.DataFrame({"query_id": np.repeat(ids, [len(x) for x, _ in found]), "vec_id": np.concatenate([x for x, _ in found]), "score": np.concatenate([s for _, s in found]).astype(np.int64)})

    part = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
