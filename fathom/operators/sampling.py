"""Deterministic samples: seeded index choices, hash-ordered samples, reservoirs and role splits.

Index choices need positions only, so they are drawn on the driver from a seeded generator and joined;
vectors never leave the executors.  Hash-ordered samples need no order of rows at all and merge.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASELINE_SEEDS = (42, 123, 3407, 2026, 2027)


def index_sample(n: int, k: int, seed: int) -> np.ndarray:
    """Sorted choice of ``k`` of ``n`` positions without repetition; all of them if ``k`` is 0 or too large."""
    if k <= 0 or k >= n:
        return np.arange(n)
    return np.sort(np.random.default_rng(seed).choice(n, k, replace=False))


def patch_samples(images: int, patches: int, k: int, seed: int, batch: int) -> list[np.ndarray]:
    """Patch positions for each batch of ``batch`` images: one draw a batch, seeded by its first image."""
    return [index_sample(patches, k, seed + first) for first in range(0, images, batch)]


def sampled_positions(spark: SparkSession, images: int, patches: int, k: int, seed: int, batch: int) -> DataFrame:
    """``(image_pos, patch_no)`` of :func:`patch_samples` as a table to join with."""
    rows = [(i, int(p)) for b, own in enumerate(patch_samples(images, patches, k, seed, batch)) for i in range(b * batch, min(images, (b + 1) * batch)) for p in own]
    return spark.createDataFrame(rows, "image_pos int, patch_no int")


def reservoir_positions(n: int, capacity: int, seed: int) -> np.ndarray:
    """Which of ``n`` rows, in order of arrival, a reservoir of ``capacity`` ends up with, by slot.

    After the reservoir is full, row ``t`` replaces slot ``j`` drawn from ``0..t`` if ``j`` is a slot.
    """
    slots = np.arange(min(n, capacity))
    rng = np.random.default_rng(seed)
    for row in range(capacity, n):
        j = int(rng.integers(0, row + 1))
        if j < capacity:
            slots[j] = row
    return slots


def hashed_sample(rows: DataFrame, key: str, k: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """The ``k`` rows (in each group of ``by``) whose seeded key hashes are least: a uniform sample that
    merges over partitions and repeats exactly."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    if not by:
        return rows.orderBy(order, key).limit(k)
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(order, key))).filter(F.col("_place") <= k).drop("_place")


def derived_seed(recipe: str, *parts) -> int:
    """63 bits of the SHA-256 of the colon-joined parts, little-endian."""
    digest = hashlib.sha256(":".join(map(str, (recipe, *parts))).encode()).digest()
    return int.from_bytes(digest[:8], "little") % (1 << 63)


def random_support(columns: int, k: int, seed: int) -> np.ndarray:
    return index_sample(columns, min(k, columns), seed)


def random_layers(layers: int, k: int, seed: int) -> np.ndarray:
    return index_sample(layers, k, seed)


def role_partition(images: list, sizes: dict[str, int], seed: int, forced: dict[str, list] | None = None) -> dict[str, list]:
    """Disjoint roles of given sizes over shuffled images; ``forced`` images stand in their role first."""
    forced = forced or {}
    taken = {i for own in forced.values() for i in own}
    if len(taken) != sum(map(len, forced.values())):
        raise ValueError("an image is forced into two roles")
    rest = [i for i in sorted(images) if i not in taken]
    np.random.default_rng(seed).shuffle(rest)
    out = {}
    for role, size in sizes.items():
        own = list(forced.get(role, []))
        if size < len(own) or size - len(own) > len(rest):
            raise ValueError(f"role {role} cannot have {size} images")
        out[role] = sorted(own + [rest.pop() for _ in range(size - len(own))])
    return out


def holdout_split(positions: np.ndarray, share: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shuffle image positions and hold the last ``share`` out; both parts sorted."""
    order = np.array(positions)
    np.random.default_rng(seed).shuffle(order)
    held = int(len(order) * share)
    if held < 1 or len(order) - held < 2:
        raise ValueError("the holdout leaves too few images")
    return np.sort(order[:-held]), np.sort(order[-held:])
