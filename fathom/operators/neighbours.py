"""Exact cosine neighbours.

Queries stay where they are and meet the references as matrix products.  References that fit a stated
size are sent to every task as blocks of one broadcast array; larger ones are dealt into numbered
blocks and every query block visits each of them, with a partial best list a block and one merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.vectors import dot

#: References up to this many bytes go to every task.
BROADCAST_BYTES = 64 << 20
#: Rows of a reference block.
BLOCK_ROWS = 4096
#: Cosines that a task holds at once (8 bytes each, and a few copies of them).
PAIRS = 1 << 20
_FOUND = "query_id long, ref_id long, cosine double"


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]


def _best(q_ids, q_groups, q, r_ids, r_groups, r, k: int, other_group: bool) -> Iterator[pd.DataFrame]:
    """The ``k`` references with the largest cosine of each query, smaller ids first on ties.

    Queries go in lots of at most ``PAIRS`` cosines, so a task's memory does not grow with the references.
    """
    lot = max(1, PAIRS // max(1, len(r)))
    for at in range(0, len(q), lot):
        own = slice(at, at + lot)
        yield _best_of_lot(q_ids[own], q_groups[own], q[own], r_ids, r_groups, r, min(k, len(r)), other_group)


def _best_of_lot(q_ids, q_groups, q, r_ids, r_groups, r, k: int, other_group: bool) -> pd.DataFrame:
    if k < 1:
        return pd.DataFrame({"query_id": [], "ref_id": [], "cosine": []}).astype({"query_id": "int64", "ref_id": "int64"})
    cosine = q @ r.T
    np.clip(cosine, -1.0, 1.0, out=cosine)
    if other_group:
        cosine[q_groups[:, None] == r_groups[None, :]] = -np.inf
    if k == 1:
        edge = np.fmax.reduce(cosine, axis=1)
    else:
        edge = -np.partition(-cosine, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero((cosine >= edge[:, None]) & np.isfinite(cosine))
    order = np.lexsort((r_ids[col], -cosine[row, col], row))
    row, col = row[order], col[order]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, dtype=int)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    row, col = row[place < k], col[place < k]
    return pd.DataFrame({"query_id": q_ids[row], "ref_id": r_ids[col], "cosine": cosine[row, col]})


def nearest(queries: DataFrame, references: DataFrame, k: int = 1, other_group: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(query_id, rank, ref_id, cosine)`` of the ``k`` nearest references of every query.

    Both sides have ``vec_id, image_id, v``.  With ``other_group`` a reference of the query's own image is
    no candidate.  Ties go to the smaller reference id.
    """
    size = references.select(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size["n"]:
        raise ValueError("the memory bank is empty")
    queries, references = queries.select("vec_id", "image_id", "v"), references.select("vec_id", "image_id", "v")
    if size["n"] * size["d"] * 8 <= broadcast_bytes:
        found = _against_broadcast(queries, references, k, other_group)
    else:
        found = _against_blocks(queries, references, -(-size["n"] // BLOCK_ROWS), k, other_group)
        best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "ref_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "ref_id", "cosine")
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "ref_id")
    return found.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "ref_id", "cosine")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _against_broadcast(queries: DataFrame, references: DataFrame, k: int, other_group: bool) -> DataFrame:
    local = references.toPandas()  # within BROADCAST_BYTES
    held = queries.sparkSession.sparkContext.broadcast((local["vec_id"].to_numpy(), local["image_id"].to_numpy(), _unit(_matrix(local["v"]))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, groups, r = held.value
        for frame in frames:
            if len(frame):
                yield from _best(frame["vec_id"].to_numpy(), frame["image_id"].to_numpy(), _unit(_matrix(frame["v"])), ids, groups, r, k, other_group)

    return queries.mapInPandas(run, _FOUND)


def _against_blocks(queries: DataFrame, references: DataFrame, blocks: int, k: int, other_group: bool) -> DataFrame:
    """References in ``blocks`` hashed blocks; each query visits all of them."""
    dealt = references.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("side", F.lit(0))
    visits = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).cast("long")).withColumn("side", F.lit(1))
    rows = dealt.unionByName(visits).repartition("block").sortWithinPartitions("block", "side")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, ready = None, [], None
        for frame in frames:
            for (number, side), part in frame.groupby(["block", "side"], sort=True):
                if number != block:
                    block, held, ready = number, [], None
                if side == 0:
                    held.append(part)
                elif held:
                    if ready is None:
                        whole = pd.concat(held)
                        ready = whole["vec_id"].to_numpy(), whole["image_id"].to_numpy(), _unit(_matrix(whole["v"]))
                    yield from _best(part["vec_id"].to_numpy(), part["image_id"].to_numpy(), _unit(_matrix(part["v"])), *ready, k, other_group)

    return rows.mapInPandas(run, _FOUND)


def pair_cosines(queries: DataFrame, references: DataFrame, column: str = "v") -> DataFrame:
    """``query_id, query_image, ref_id, ref_image, cosine`` of pairs of different images.

    The defining form: it makes every pair, so it is for audited samples of a stated size.
    """
    from fathom.functions.vectors import l2_normalized

    q = queries.select(F.col("vec_id").alias("query_id"), F.col("image_id").alias("query_image"), l2_normalized(column).alias("a"))
    r = references.select(F.col("vec_id").alias("ref_id"), F.col("image_id").alias("ref_image"), l2_normalized(column).alias("b"))
    return q.join(r, F.col("query_image") != F.col("ref_image")).select("query_id", "query_image", "ref_id", "ref_image", dot("a", "b").alias("cosine"))


def near_far(queries: DataFrame, references: DataFrame, rank: int = 8) -> DataFrame:
    """The nearest and the ``rank``-th neighbour among other images (the farthest there is, if fewer)."""
    found = nearest(queries, references, rank, other_group=True)
    out = found.groupBy("query_id").agg(
        F.count("*").alias("found"),
        F.min_by("ref_id", "rank").alias("near_id"),
        F.max_by("ref_id", "rank").alias("far_id"),
        F.min_by("cosine", "rank").alias("near_cosine"),
        F.max_by("cosine", "rank").alias("far_cosine"),
    )
    return out


def temperature(rows: DataFrame, rank: int = 8) -> DataFrame:
    """``max(0.01, lower median of the gap between the nearest and the rank-th cosine)``."""
    gaps = near_far(rows, rows, rank).select((F.col("near_cosine") - F.col("far_cosine")).alias("gap"))
    # The lower median is an order statistic: no interpolation between the two middle values.
    return gaps.agg(F.expr("greatest(0.01D, percentile_disc(0.5) within group (order by gap))").alias("temperature"))


def image_scores(distances: DataFrame, fraction: float = 0.01) -> DataFrame:
    """Mean of each image's largest patch distances: ``image_id, score, patches``.

    ``distances`` has ``image_id, vec_id, distance``; the top ``fraction`` counts, at least one patch.
    """
    from fathom.functions.vectors import top_mean_size

    by = Window.partitionBy("image_id")
    ranked = distances.withColumn("place", F.row_number().over(by.orderBy(F.desc("distance"), "vec_id"))).withColumn("n", F.count("*").over(by))
    kept = ranked.filter(F.col("place") <= top_mean_size(F.col("n"), fraction))
    return kept.groupBy("image_id").agg(F.avg("distance").alias("score"), F.count("*").alias("patches"))


def stable_votes(queries: DataFrame, references: DataFrame, subsets: list[list[int]], k: int, votes: int) -> DataFrame:
    """Edges to the ``k`` cross-image neighbours that at least ``votes`` coordinate subsets confirm."""
    from fathom.functions.vectors import take

    base = nearest(queries, references, k, other_group=True).select("query_id", "ref_id")
    seen = None
    for number, subset in enumerate(subsets):
        part = lambda rows, subset=subset: rows.withColumn("v", take("v", subset))
        found = nearest(part(queries), part(references), k, other_group=True).select("query_id", "ref_id", F.lit(number).alias("subset"))
        seen = found if seen is None else seen.unionByName(found)
    counted = base.join(seen, ["query_id", "ref_id"]).groupBy("query_id", "ref_id").agg(F.countDistinct("subset").alias("votes"))
    return counted.filter(F.col("votes") >= votes).withColumn("weight", F.col("votes") / F.lit(float(len(subsets))))
