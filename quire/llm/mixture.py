"""Mixing sources to target weights by entropy balancing.

Each document's rate w lies between 0 and `cap` copies. The rates minimise the
relative entropy to taking every document once, bounded above,

    sum_d  w log w + (cap - w) log((cap - w) / (cap - 1)),

under one token constraint a source, sum_d n_d w_d = T_s (n_d: a document's
words). The dual is convex and its solution is an exponential tilt by size,

    w = cap e^(lambda_s n) / (cap - 1 + e^(lambda_s n)).

Newton's method solves it for all sources at once: a step is one aggregation of
gradient and Hessian by source, over counts of (source, size) and not over
documents; the Hessian is diagonal because a document has one source. A bracket
of the root guards each step. Rates are then rounded into whole copies.

Rounding: all documents of one source and one size are alike, so copies are
first settled by (source, size), largest sizes first, carrying the words still
owed to the next smaller size; a source misses its target by less than about
half its smallest document where it has small ones. The sizes of one source
are few (k distinct sizes need k*k/2 words), which bounds the fold. Within a
(source, size) the copies fall to documents by hash order; ranks come from
counts of hash bins, so no window holds a hot source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
RESULT = ("doc_id", "source", "size", "source_size", "target", "rate", "copies")


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, rounds: int = 40) -> DataFrame:
    """Targets by source, from rows (source, source_size).

    Sources in code point order, null last, weigh `weights` in turn and share
    `share` of all words; a target stops at `cap` times its source's size and
    the excess is shared again by weight. That is water filling: sources are
    full up to some level L of cap*size/weight, so one sorted pass finds L.
    `sizes` has a row a source. Sources of no words have target 0.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(one) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * float(cap)).withColumn("level", F.col("limit") / F.col("weight"))
    up = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumns({
        "full": F.coalesce(F.sum("limit").over(up), F.lit(0.0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)),
        "pool": F.sum("source_size").over(everything) * float(share),
    })
    # A source is full if, with all lower levels full, its share would pass its limit.
    s = s.withColumn("is_full", (F.col("pool") - F.col("full")) / F.col("weight_left") >= F.col("level"))
    s = s.withColumns({
        "left": F.col("pool") - F.coalesce(F.sum(F.when(F.col("is_full"), F.col("limit"))).over(everything), F.lit(0.0)),
        "open": F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(everything),
    })
    return s.select("source", "source_size", F.when(F.col("is_full"), F.col("limit")).otherwise(F.col("left") * F.col("weight") / F.col("open")).alias("target"))


def rate_of(lam, size, cap: float):
    """Copies of a document of `size` words at multiplier lam."""
    return F.lit(cap) / (1 + (cap - 1) * F.exp(-F.least(F.greatest(lam * size, F.lit(-500.0)), F.lit(500.0))))


def tilt(targets: DataFrame, classes: DataFrame, cap: float = 2.0, tolerance: float = 1e-10, steps: int = 200) -> DataFrame:
    """targets (s, s_null, source_size, target) with the multiplier lam of
    each source, from classes (s, s_null, size, n).

    A source whose target is cap times its size has an infinite multiplier,
    one without words or target an infinite negative one. Steps end when
    every source is within `tolerance` of its target, relatively.
    """
    key, inf = ["s", "s_null"], float("inf")
    size, n = F.col("size").cast("double"), F.col("n").cast("double")
    live = (F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    moments = classes.groupBy(*key).agg((F.sum(n * size * size) / F.greatest(F.sum(n * size), F.lit(1.0))).alias("mean"))
    share = F.col("target") / F.col("source_size")
    start = F.log(share * (cap - 1) / (cap - share)) / F.col("mean")
    done = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.lit(inf)).otherwise(F.lit(-inf))
    state = cut(targets.join(moments, key).withColumn("live", live).select(*key, "source_size", "target", "live", F.when(F.col("live"), start).otherwise(done).alias("lam"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi")))
    w = rate_of(F.col("lam"), size, cap)
    for _ in range(steps):
        sums = classes.join(state.filter("live").select(*key, "lam"), key).groupBy(*key).agg(F.sum(n * size * w).alias("sum"), F.sum(n * size * size * w * (1 - w / cap)).alias("slope"))
        lam, miss = F.col("lam"), F.col("sum") - F.col("target")
        lo, hi = F.when(miss < 0, lam).otherwise(F.col("lo")), F.when(miss > 0, lam).otherwise(F.col("hi"))
        newton = lam - miss / F.col("slope")
        # Outside the bracket: halve it, or double where one side is open.
        guarded = F.when((F.col("slope") > 0) & (newton > lo) & (newton < hi), newton).when(hi == inf, F.greatest(2 * lam, lam + 1e-9)).when(lo == -inf, F.least(2 * lam, lam - 1e-9)).otherwise((lo + hi) / 2)
        moved = F.col("live") & (F.abs(miss) > tolerance * F.col("target"))
        state = cut(state.join(sums, key, "left").select(*key, "source_size", "target", moved.alias("live"), F.when(moved, guarded).otherwise(lam).alias("lam"), F.when(moved, lo).otherwise(F.col("lo")).alias("lo"), F.when(moved, hi).otherwise(F.col("hi")).alias("hi")))
        if not state.filter("live").head(1):
            break
    return state.select(*key, "source_size", "target", "lam")


def settle(classes: DataFrame, cap: float) -> DataFrame:
    """Whole copies `m` for each (s, s_null, size) class of n documents."""
    most = int(cap)

    def fold(pdf):
        import numpy as np

        pdf = pdf.sort_values("size", ascending=False, kind="stable")
        size, n, rate = pdf["size"].to_numpy(), pdf["n"].to_numpy(), pdf["rate"].to_numpy()
        m, owed = np.zeros(len(size), dtype=np.int64), 0.0
        for i in range(len(size)):
            owed += float(n[i]) * float(size[i]) * float(rate[i])
            m[i] = min(int(n[i]) * most, max(0, int(np.floor(owed / size[i] + 0.5))))
            owed -= float(m[i]) * float(size[i])
        return pdf.assign(m=m)[["s", "s_null", "size", "n", "m"]]

    return classes.groupBy("s", "s_null").applyInPandas(fold, "s string, s_null boolean, size long, n long, m long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies a row of `docs`,
    and the columns named in `keep`.

    Null texts have size 0; a null source is a source of its own. Rows with
    equal doc_ids are distinct rows, each taken on its own; ties between them
    are broken by their texts. Documents without words get no copy. Other
    columns are ignored; of `keep` those with a name of the result are left
    out. Empty in, empty out.
    """
    keep = tuple(c for c in dict.fromkeys(keep) if c not in RESULT)
    d = docs.select(
        "doc_id", F.xxhash64("text").alias("tie"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s_null"), word_count().alias("size"), F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BINS)).cast("int").alias("bin"), *[F.col(c).alias(f"keep_{c}") for c in keep]
    )
    cls = ["s", "s_null", "size"]
    bins = cut(d.groupBy(*cls, "bin").agg(F.count("*").alias("n")))
    classes = bins.groupBy(*cls).agg(F.sum("n").alias("n"))
    sizes = classes.groupBy("s", "s_null").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    named = source_targets(sizes.select(F.when(~F.col("s_null"), F.col("s")).alias("source"), "source_size"), weights, share, cap)
    targets = named.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s_null"), "source_size", "target")
    filled = cut(classes.filter("size > 0"))
    rates = tilt(targets, filled, cap).unionByName(targets.join(filled.select("s", "s_null").distinct(), ["s", "s_null"], "left_anti").withColumn("lam", F.lit(float("-inf"))))
    rates = cut(rates)
    rate = F.when(F.col("size") > 0, rate_of(F.col("lam"), F.col("size").cast("double"), cap)).otherwise(F.lit(0.0))
    copies = settle(filled.join(rates.select("s", "s_null", "lam"), ["s", "s_null"]).select("s", "s_null", "size", "n", rate.alias("rate")), cap)
    before = Window.partitionBy(*cls).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        bins.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
        .join(copies, cls, "left")
        .join(rates, ["s", "s_null"])
        .select(*cls, "bin", "offset", "source_size", "target", rate.alias("rate"), F.coalesce(F.floor(F.col("m") / F.col("n")), F.lit(0)).alias("base"), F.coalesce(F.col("m") % F.col("n"), F.lit(0)).alias("extra"))
    )
    within = Window.partitionBy(*cls, "bin").orderBy("doc_id", "tie")
    ranked = d.withColumn("rank", F.row_number().over(within)).join(plan, [*cls, "bin"])
    taken = F.col("base") + F.when(F.col("offset") + F.col("rank") <= F.col("extra"), 1).otherwise(0)
    return ranked.select("doc_id", F.when(~F.col("s_null"), F.col("s")).alias("source"), "size", "source_size", "target", "rate", taken.cast("int").alias("copies"), *[F.col(f"keep_{c}").alias(c) for c in keep])
