"""Vectors dealt out by cell: packing, bounded groups, and a streaming reader of the groups.

A cell with many residents is split into parts, and whoever visits the cell visits every part; one with
many visitors is split into lots of them, and its residents are there for every lot.  A task therefore
holds about one bounded part of one cell plus one block of visitors, and no cell is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import least_hashed, materialize

#: Vectors of a cell (or of a part of it) that one task holds at once, and visitors of a lot.
PART_ROWS, LOT_ROWS = 4096, 16_384
#: Rows in a packed block.
BLOCK_ROWS = 1024

BLOCKS = "cell long, kind int, ids binary, vectors binary, extra binary"
LOADS = "cell long, residents long, visitors long"


def usable(vector: Column) -> Column:
    """Not null, not all zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def stored_type(vectors: DataFrame) -> type:
    """The numpy type that holds the components as they are."""
    return np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64


def bounded_sample(vectors: DataFrame, rows: int, total: int, dimension: int) -> np.ndarray:
    """The vectors of the ``rows`` (of ``total``) rows whose hashed keys are least."""
    got = least_hashed(vectors.select("key", "embedding"), ["key"], rows, total).toArrow().combine_chunks()
    if not got.num_rows:
        return np.zeros((0, dimension))
    return matrix(got.column(1).combine_chunks(), dimension)


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm; at most as many centres as distinct points."""
    k = min(k, len(points))
    centres = points[np.sort(rng.choice(len(points), k, replace=False))].copy()
    for _ in range(rounds):
        own = np.concatenate([squared_distances(part, centres).argmin(1) for part in np.array_split(points, len(points) // 20_000 + 1)])
        count = np.bincount(own, minlength=k)
        for j in range(points.shape[1]):
            total = np.bincount(own, weights=points[:, j], minlength=k)
            centres[:, j] = np.where(count, total / np.maximum(count, 1), centres[:, j])
    return np.unique(centres, axis=0)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def loads(home: np.ndarray, visited: np.ndarray) -> pa.RecordBatch:
    """How often each cell is somebody's home and how often it is visited, of one batch."""
    cell, at = np.unique(np.concatenate((home, visited)), return_inverse=True)
    residents = np.bincount(at[: len(home)], minlength=len(cell))
    visitors = np.bincount(at[len(home) :], minlength=len(cell))
    return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(residents.astype(np.int64)), pa.array(visitors.astype(np.int64))], names=["cell", "residents", "visitors"])


def split_cells(counts: DataFrame, name: str) -> DataFrame:
    """From partial :data:`LOADS`: ``(cell, parts, lots)`` of the cells that are split, however many."""
    sums = counts.groupBy("cell").agg(F.sum("residents").alias("residents"), F.sum("visitors").alias("visitors"))
    parts, lots = (F.greatest(F.lit(1), F.ceil(F.col(c) / n)).cast("long") for c, n in (("residents", PART_ROWS), ("visitors", LOT_ROWS)))
    return materialize(sums.select("cell", parts.alias("parts"), lots.alias("lots")).filter("parts > 1 or lots > 1"), name)


def pack(cell: np.ndarray, kind: int, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, extra: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``BLOCK_ROWS`` entries of the same cell.

    Entry ``i`` says that row ``rows[i]`` of ``ids``, ``vectors`` and ``extra`` goes to ``cell[i]``.
    """
    if not len(cell):
        return
    order = np.lexsort((rows, cell))
    cell, rows = cell[order], rows[order]
    new = np.flatnonzero(cell[1:] != cell[:-1]) + 1
    begins = np.concatenate(([0], new))
    ends = np.concatenate((new, [len(cell)]))
    cols: list[list] = [[], [], [], []]
    size = 0
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        for at in range(a, b, BLOCK_ROWS):
            own = rows[at : min(at + BLOCK_ROWS, b)]
            for c, v in zip(cols, (int(cell[a]), ids[own].tobytes(), vectors[own].tobytes(), extra[own].tobytes()), strict=True):
                c.append(v)
            size += len(own)
            if size >= 32 * BLOCK_ROWS:
                yield _batch(cols, kind)
                cols, size = [[], [], [], []], 0
    if cols[0]:
        yield _batch(cols, kind)


def _batch(cols: list[list], kind: int) -> pa.RecordBatch:
    arrays = [pa.array(cols[0], pa.int64()), pa.array([kind] * len(cols[0]), pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])]
    return pa.RecordBatch.from_arrays(arrays, names=["cell", "kind", "ids", "vectors", "extra"])


def dealt(blocks: DataFrame, split: DataFrame, n: int) -> DataFrame:
    """Blocks brought together by cell, part and lot, residents (kind 0) before visitors (kind 1).

    ``split`` is joined as its size asks for; a block of a split cell belongs to one part (or lot) by its hash
    and goes to every lot (or part).
    """
    known = blocks.join(split, "cell", "left").withColumns({"parts": F.coalesce("parts", F.lit(1).cast("long")), "lots": F.coalesce("lots", F.lit(1).cast("long"))})
    resident = F.col("kind") == 0
    own = F.pmod(F.xxhash64("ids"), F.when(resident, F.col("parts")).otherwise(F.col("lots")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.when(resident, F.col("lots")).otherwise(F.col("parts")) - 1))
    placed = known.select("cell", own.alias("own"), every.alias("each"), "kind", "ids", "vectors", "extra")
    part, lot = (F.when(F.col("kind") == k, F.col("own")).otherwise(F.col("each")) for k in (0, 1))
    placed = placed.select("cell", part.alias("part"), lot.alias("lot"), "kind", "ids", "vectors", "extra")
    return placed.repartition(n, "cell", "part", "lot").sortWithinPartitions("cell", "part", "lot", "kind")


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def meetings(batches: Iterator[pa.RecordBatch], dimension: int, stored: type, extra_type: type) -> Iterator[tuple[int, Block, Block]]:
    """``(cell, residents, visitors)`` for every block of visitors of a :func:`dealt` partition."""

    def block(batch: pa.RecordBatch, i: int) -> Block:
        ids, vectors, extra = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype=t) for k, t in ((4, np.int64), (5, stored), (6, extra_type)))
        return ids, vectors.astype(np.float64).reshape(-1, dimension), extra.reshape(len(ids), -1)

    key: tuple[int, int, int] | None = None
    held: list[Block] = []
    residents: Block | None = None
    for batch in batches:
        for i, (cell, part, lot, kind) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
            if (cell, part, lot) != key:
                key, held, residents = (cell, part, lot), [], None
            if kind == 0:
                held.append(block(batch, i))
                continue
            if not held:
                continue
            if residents is None:
                residents = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            yield cell, residents, block(batch, i)
