"""Sufficient statistics: nuisance variability, Gram matrices, layer inner products, tails, rankings.

Matrices are summed as partial products, one small matrix a task, and never as a self-join of exploded
coordinates; the exploded forms below are for what SQL states best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6


def variability(pairs: DataFrame, keys: list[str], epsilon: float = EPSILON) -> DataFrame:
    """``keys, j, ratio`` of ``pairs(keys, v, w)``: mean squared change over the clean population variance.

    Sums merge, so any batching gives the same numbers.
    """
    both = pairs.select(*keys, F.posexplode(F.arrays_zip("v", "w")).alias("j", "p")).select(*keys, "j", F.col("p.v").alias("x"), F.col("p.w").alias("z"))
    return both.groupBy(*keys, "j").agg((F.avg((F.col("z") - F.col("x")) * (F.col("z") - F.col("x"))) / (F.var_pop("x") + F.lit(epsilon))).alias("ratio"), F.count("*").alias("n"))


def covered_alike(pairs: DataFrame) -> None:
    """Raise unless every kind of perturbation covers the same number of rows."""
    counts = pairs.groupBy("kind").count().agg(F.min("count"), F.max("count")).first()
    if counts[0] != counts[1]:
        raise ValueError(f"perturbation kinds cover between {counts[0]} and {counts[1]} rows")


def norm_summary(rows: DataFrame, column: str = "v") -> DataFrame:
    from fathom.functions.vectors import norm

    return rows.select(norm(column).alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))


def gram(rows: DataFrame, column: str = "v", divide: bool = True) -> np.ndarray:
    """``XᵀX`` (over the number of rows), summed over one partial product a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for frame in frames:
            if len(frame):
                x = np.array(frame[column].tolist(), dtype=np.float64)
                total = x.T @ x if total is None else total + x.T @ x
                n += len(x)
        if total is not None:
            yield pd.DataFrame({"n": [n], "d": [len(total)], "part": [total.tobytes()]})

    def add(a, b):
        return a[0] + b[0], a[1] + b[1]

    parts = rows.select(column).mapInPandas(run, "n long, d int, part binary")
    folded = parts.rdd.map(lambda r: (r["n"], np.frombuffer(r["part"]).reshape(r["d"], r["d"]))).treeReduce(add)
    return folded[1] / folded[0] if divide else folded[1]


def gram_long(rows: DataFrame, column: str = "v") -> DataFrame:
    """``i, j, g``: the defining form of the Gram matrix, upper triangle."""
    pairs = rows.select(F.posexplode(column).alias("i", "x"), F.col(column)).select("i", "x", F.posexplode(column).alias("j", "y")).filter("i <= j")
    return pairs.groupBy("i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("g"))


def squared_gram(g: np.ndarray) -> np.ndarray:
    """Elementwise square over its total: the quadratic form of the cosine-free objective."""
    h = g * g
    return h / h.sum()


def layer_inner_products(rows: DataFrame, layers: int, width: int, mode: str = "l2") -> np.ndarray:
    """``Q[l, m] = |F_lᵀ F_m|²`` over all pairs of layers: Gram geometry without any rows-by-rows matrix."""
    from fathom.functions.vectors import concat_layers

    whole = gram(rows.select(concat_layers("v", range(layers), width, mode).alias("v")), divide=False)
    blocks = whole.reshape(layers, width, layers, width)
    return np.einsum("aibj,aibj->ab", blocks, blocks)


def layer_error(q: np.ndarray, difference: np.ndarray) -> float:
    """``sqrt(dᵀQd) / sqrt(rᵀQr)`` with the uniform reference ``r``."""
    r = np.full(len(q), 1 / len(q))
    return float(np.sqrt(max(difference @ q @ difference, 0.0)) / np.sqrt(r @ q @ r))


def compare_neighbourhoods(reference: DataFrame, changed: DataFrame) -> DataFrame:
    """``relative_error, agreement, regret`` of the cosine Gram of ``changed`` against ``reference``.

    Both have ``vec_id, v``.  Error: Frobenius over all pairs, which the products of columns give without any
    pair of rows (``|A Aᵀ - B Bᵀ|² = |AᵀA|² - 2 |AᵀB|² + |BᵀB|²``); agreement: share of rows whose nearest other
    row is the same; regret: mean reference cosine lost by taking the changed nearest row.
    """
    from fathom.functions.vectors import dot, l2_normalized
    from fathom.operators.neighbours import nearest

    a, b = reference.select("vec_id", l2_normalized("v").alias("a")), changed.select("vec_id", l2_normalized("v").alias("b"))
    both = a.join(b, "vec_id")
    width = a.select(F.max(F.size("a"))).first()[0] or 0
    g = gram(both.select(F.concat("a", "b").alias("v")), divide=False)
    on = float((g[:width, :width] ** 2).sum())
    off = on - 2 * float((g[:width, width:] ** 2).sum()) + float((g[width:, width:] ** 2).sum())

    def first(rows, name):
        alone = rows.select("vec_id", F.col("vec_id").alias("image_id"), F.col(name).alias("v"))  # no row is its own neighbour
        return nearest(alone, alone, 1, other_group=True)

    best = first(a, "a").select(F.col("query_id").alias("vec_id"), F.col("ref_id").alias("r"), F.col("cosine").alias("t"))
    taken = first(b, "b").select(F.col("query_id").alias("vec_id"), F.col("ref_id").alias("taken"))
    there = a.select(F.col("vec_id").alias("taken"), F.col("a").alias("ra"))
    per = best.join(taken, "vec_id").join(a, "vec_id").join(there, "taken")
    return per.agg(
        F.lit(float(np.sqrt(max(off, 0.0) / on))).alias("relative_error"),
        F.avg((F.col("r") == F.col("taken")).cast("double")).alias("agreement"),
        F.avg(F.col("t") - dot("a", "ra")).alias("regret"),
    )


def budget_bound(shares: DataFrame, tolerance: float) -> DataFrame:
    """``needed``: how many of the largest ``shares(j, share)`` cover ``1 - tolerance`` of their sum.

    ``shares`` has one row a feature.
    """
    w = Window.orderBy(F.desc("share"), "j").rowsBetween(Window.unboundedPreceding, 0)
    run = shares.select("share", F.sum("share").over(w).alias("covered"), F.row_number().over(Window.orderBy(F.desc("share"), "j")).alias("place"), F.sum("share").over(Window.partitionBy()).alias("whole"))
    return run.filter(F.col("covered") >= (1 - tolerance) * F.col("whole")).agg(F.min("place").alias("needed"))


def upper_tail_mean(values: DataFrame, keys: list[str], fraction: float) -> DataFrame:
    """``keys, cvar``: mean of the upper ``fraction`` of ``values(keys, x)``, the boundary value in part."""
    w = Window.partitionBy(*keys)
    ranked = values.select(*keys, "x", F.row_number().over(w.orderBy(F.desc("x"))).alias("place"), (F.count("*").over(w) * F.lit(fraction)).alias("mass"))
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("mass") - (F.col("place") - 1)))
    return ranked.groupBy(*keys).agg((F.sum(weight * F.col("x")) / F.max("mass")).alias("cvar"))


def cluster_standard_error(values: DataFrame, group: str) -> DataFrame:
    """``mean, se``: standard error of the mean when rows of a group move together."""
    mean = values.agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    per = values.crossJoin(F.broadcast(mean)).groupBy(group).agg(F.sum(F.col("x") - F.col("m")).alias("r"), F.max("m").alias("m"), F.max("n").alias("n"))
    g = F.count("*")
    return per.agg(F.max("m").alias("mean"), F.when(g > 1, F.sqrt(g / (g - 1) * F.sum(F.col("r") * F.col("r"))) / F.max("n")).alias("se"))


def laplacian_scores(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``j, score``: weighted squared change along ``edges(query_id, ref_id, weight)`` over the variance.

    Columns of (nearly) no variance score infinity.
    """
    x = rows.select("vec_id", F.posexplode("v").alias("j", "x"))
    a = edges.join(x.withColumnRenamed("vec_id", "query_id"), "query_id")
    b = x.select(F.col("vec_id").alias("ref_id"), "j", F.col("x").alias("z"))
    moved = a.join(b, ["ref_id", "j"]).groupBy("j").agg((F.sum(F.col("weight") * (F.col("x") - F.col("z")) * (F.col("x") - F.col("z"))) / F.sum("weight")).alias("moved"))
    spread = x.groupBy("j").agg(F.var_pop("x").alias("var"))
    return moved.join(spread, "j").select("j", F.when(F.col("var") > 1e-12, F.col("moved") / F.col("var")).otherwise(F.lit(float("inf"))).alias("score"))


def split_repeatability(rows: DataFrame) -> DataFrame:
    """``j, ratio``: smaller over larger variance of a column in the even and the odd images by order."""
    from fathom.operators.metrics import places

    found = places(rows.select(F.col("image_id").alias("s")).distinct())
    order = found.select(F.col("s").cast("long").alias("image_id"), ((F.col("below") + 1) % 2).cast("int").alias("half"))
    x = rows.join(order, "image_id").select("half", F.posexplode("v").alias("j", "x"))
    var = x.groupBy("j").agg(F.var_pop(F.when(F.col("half") == 0, F.col("x"))).alias("a"), F.var_pop(F.when(F.col("half") == 1, F.col("x"))).alias("b"))
    return var.select("j", (F.least("a", "b") / F.greatest(F.greatest("a", "b"), F.lit(1e-12))).alias("ratio"))


def query_weights(distances: DataFrame) -> DataFrame:
    """``query_id, weight``: ``min(4, 1 + d / mean d)`` over its own mean."""
    raw = distances.agg(F.avg("distance").alias("m"))
    first = distances.crossJoin(F.broadcast(raw)).select("query_id", F.least(F.lit(4.0), 1 + F.col("distance") / F.greatest("m", F.lit(1e-4))).alias("raw"))
    mean = first.agg(F.avg("raw").alias("m"))
    return first.crossJoin(F.broadcast(mean)).select("query_id", (F.col("raw") / F.col("m")).alias("weight"))


def coordinate_scores(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``j, energy, stability, energy_rank, stability_rank``: mean square, and mean square over nuisance."""
    e = rows.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.avg(F.col("x") * F.col("x")).alias("energy"))
    n = pairs.select(F.posexplode(F.arrays_zip("v", "w")).alias("j", "p")).groupBy("j").agg(F.avg((F.col("p.v") - F.col("p.w")) * (F.col("p.v") - F.col("p.w"))).alias("nuisance"))
    both = e.join(n, "j").select("j", "energy", (F.col("energy") / (F.col("nuisance") + F.lit(EPSILON))).alias("stability"))
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "j"))
    return both.select("*", rank("energy").alias("energy_rank"), rank("stability").alias("stability_rank"))


def covering_support(x: np.ndarray, ranking: np.ndarray, count: int) -> np.ndarray | None:
    """The first ``count`` columns of ``ranking``, mended so that no row is all zero on them.

    Columns that cover the most bare rows replace the last ranked ones that can be spared; None if the
    rows cannot be covered by ``count`` columns found this way.
    """
    chosen = [int(j) for j in ranking[:count]]
    holds = x != 0
    if holds[:, chosen].any(1).all():
        return np.sort(np.array(chosen))
    cover: list[int] = []
    bare = np.ones(len(x), dtype=bool)
    while bare.any():
        gain = holds[bare].sum(0)
        j = int(max(range(x.shape[1]), key=lambda c: (gain[c], -c)))
        if not gain[j] or len(cover) == count:
            return None
        cover.append(j)
        bare &= ~holds[:, j]
    rest = [j for j in chosen if j not in cover][: count - len(cover)]
    return np.sort(np.array(cover + rest))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rho``: correlation of average ranks, from counted pairs of values."""
    from fathom.operators.metrics import places

    def rank(c, name):
        return places(rows.select(F.col(c).alias("s"))).select(F.col("s").alias(c), (F.col("below") + (F.col("same") + 1) / 2).alias(name))

    pairs = rows.groupBy(F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b)).agg(F.count("*").cast("double").alias("w"))
    ranked = pairs.join(rank(a, "ra"), a).join(rank(b, "rb"), b)
    mean = ranked.agg((F.sum(F.col("w") * F.col("ra")) / F.sum("w")).alias("ma"), (F.sum(F.col("w") * F.col("rb")) / F.sum("w")).alias("mb"))
    x, y, w = F.col("ra") - F.col("ma"), F.col("rb") - F.col("mb"), F.col("w")
    return ranked.crossJoin(F.broadcast(mean)).agg((F.sum(w * x * y) / F.sqrt(F.sum(w * x * x) * F.sum(w * y * y))).alias("rho"))


def edge_leverage(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``j, leverage, place``: weighted mean squared change to the near and the far neighbour, largest first.

    ``edges`` has ``query_id, near_id, far_id, weight``; ``rows`` has ``vec_id, v``.
    """
    x = rows.select("vec_id", "v")
    wide = edges.join(x.toDF("query_id", "q"), "query_id").join(x.toDF("near_id", "a"), "near_id").join(x.toDF("far_id", "b"), "far_id")
    each = wide.select("weight", F.posexplode(F.arrays_zip("q", "a", "b")).alias("j", "p"))
    moved = ((F.col("p.q") - F.col("p.a")) * (F.col("p.q") - F.col("p.a")) + (F.col("p.q") - F.col("p.b")) * (F.col("p.q") - F.col("p.b"))) / 2
    by = each.groupBy("j").agg(F.avg(F.col("weight") * moved).alias("leverage"))  # one row a column
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("leverage"), "j")))
