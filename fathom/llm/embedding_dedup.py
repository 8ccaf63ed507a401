"""Near-duplicate embeddings through an inverted multi-index.

Vectors are scaled to unit length and cut into halves; an independent codebook for each half makes
a product grid of cells.  Every vector sits in the cell of its two nearest codewords and visits
cells in the multi-sequence order, nearest sum of squared distances first, until the excess over
its own cell passes a limit.  The limit is calibrated: sampled vectors are moved to exactly the
threshold cosine in random directions, and the limit is the excess within which the wanted share of
them stays.  A pair is found if either side visits the other, so its recall is higher still, and
closer pairs are found more often.  Everything found is verified in double precision.

The codebooks have as many words as cost the least on the sample: finer cells hold fewer rows to compare
but more of them have to be visited.

Equal vectors are folded into one weighted class first.  Cells are compared in bounded parts and lots; a
task reports counts and a spanning forest of its links, never all pairs of a group.

Defined results: every row is a vector of its own, so rows that repeat an id are compared with each other
too, and equal rows are linked; vectors that are null, zero, or hold null or non-finite components link with
nothing; vectors of different lengths never link; a null id is never a component's id unless its whole
component has none, and then the component's id is null; ties at exactly the threshold link; an empty table
gives an empty result; columns besides ``vec_id`` and ``embedding`` are not looked at.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import cells
from fathom.llm.common import connected_components, materialize, partitions, spanning_edges

#: Rows the codebooks and the calibration are fitted on.
SAMPLE_ROWS = 20_000
#: Share of pairs at exactly the threshold that one side's traversal has to reach.
TARGET_RECALL = 0.985
#: What sending a vector to a cell costs, in comparisons, and the sampled rows a codeword should rest on.
SEND_COST, WORD_ROWS = 100, 8
_SEED = 20_261


class MultiIndex:
    """Two codebooks and the traversal limit; small and of bounded size."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, recall: float = TARGET_RECALL, codewords: int | None = None):
        rng = np.random.default_rng(_SEED)
        unit = sample / np.linalg.norm(sample, axis=1)[:, None]
        self.half = max(1, unit.shape[1] // 2)
        moved = rng.standard_normal(unit.shape)
        moved -= (moved * unit).sum(1)[:, None] * unit
        length = np.linalg.norm(moved, axis=1)[:, None]
        moved = np.where(length > 0, moved / np.where(length > 0, length, 1), 0)
        at = threshold * unit + math.sqrt(1 - threshold * threshold) * moved
        best = None
        k = codewords or 2
        while True:
            self.books = [cells.kmeans(h, k, rng) for h in self._halves(unit)]
            one, two = self.excess(unit)
            i, j = self.home(at)
            row = np.arange(len(unit))
            self.limit = float(np.quantile(one[row, i] + two[row, j], recall)) + 1e-9
            cost = self._visits(one[:256], two[:256]) * (SEND_COST + rows / (len(self.books[0]) * len(self.books[1])))
            if best is None or cost < best[0]:
                best = (cost, self.books, self.limit)
            elif cost > 2 * best[0]:
                break
            k *= 2
            if codewords or k * WORD_ROWS > len(unit) or k * k > 2 * rows:
                break
        _, self.books, self.limit = best

    def _visits(self, one: np.ndarray, two: np.ndarray) -> float:
        """Cells that a row visits, on average."""
        return float(np.mean([np.searchsorted(np.sort(b), self.limit - a, side="right").sum() for a, b in zip(one, two, strict=True)]))

    def _halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = unit[:, self.half :] if unit.shape[1] > self.half else np.zeros((len(unit), 1))
        return unit[:, : self.half], rest

    def distances(self, unit: np.ndarray) -> list[np.ndarray]:
        return [cells.squared_distances(h, book) for h, book in zip(self._halves(unit), self.books, strict=True)]

    def excess(self, unit: np.ndarray) -> list[np.ndarray]:
        return [d - d.min(1)[:, None] for d in self.distances(unit)]

    def home(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = self.distances(unit)
        return one.argmin(1), two.argmin(1)

    def cell(self, i, j):
        return i * len(self.books[1]) + j


def multi_sequence(one: np.ndarray, two: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells ``(i, j)`` by ascending ``one[i] + two[j]``, as far as the sum stays within ``limit``.

    The heap holds the front of cells whose both predecessors have been visited.
    """
    first, second = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    a, b = one[first].tolist(), two[second].tolist()
    heap, depth, found = [(a[0] + b[0], 0, 0)], [0] * (len(a) + 1), []
    while heap:
        total, x, y = heapq.heappop(heap)
        if total > limit:
            break
        found.append((int(first[x]), int(second[y])))
        depth[x] = y + 1
        if x + 1 < len(a) and depth[x + 1] == y:
            heapq.heappush(heap, (a[x + 1] + b[y], x + 1, y))
        if y + 1 < len(b) and (x == 0 or depth[x - 1] > y + 1):
            heapq.heappush(heap, (a[x] + b[y + 1], x, y + 1))
    return found


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1)[:, None]
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _links_of_dimension(classes: DataFrame, dimension: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """From ``classes(key, embedding, weight)``: links counted by class, and connecting edges."""
    spark = classes.sparkSession
    rows = classes.count()
    sample = cells.bounded_sample(classes, SAMPLE_ROWS, rows, dimension)
    index = MultiIndex(_unit(sample), rows, threshold)
    shared = spark.sparkContext.broadcast(index)
    stored = cells.stored_type(classes)

    def visits(unit):
        """Home cells of the rows, and ``(row, cell)`` of what they visit."""
        index = shared.value
        home = index.cell(*index.home(unit)).astype(np.int64)
        one, two = index.excess(unit)
        row, to = [], []
        for r in range(len(unit)):
            found = multi_sequence(one[r], two[r], index.limit)
            row += [r] * len(found)
            to += [index.cell(i, j) for i, j in found]
        return home, np.array(row, dtype=np.int64), np.array(to, dtype=np.int64)

    def counted(batches):
        for batch in batches:
            if len(batch):
                home, _, to = visits(_unit(cells.matrix(batch.column(0), dimension)))
                yield cells.loads(home, to)

    split = cells.split_cells(classes.select("embedding").mapInArrow(counted, cells.LOADS), "embedding-split")

    def blocks(batches):
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(0).to_numpy()
            vectors = cells.matrix(batch.column(1), dimension)
            home, row, to = visits(_unit(vectors))
            extra = np.stack([home, batch.column(2).to_numpy()], axis=1).astype(np.int64)
            kept = vectors.astype(stored)
            yield from cells.pack(home, 0, np.arange(len(ids)), ids, kept, extra)
            yield from cells.pack(to, 1, row, ids, kept, extra)

    def verify(batches):
        index = shared.value
        counts: dict[int, int] = {}

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.nulls(len(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["u", "v", "links"])
            counts.clear()
            return batch

        for cell, (rid, rvec, rextra), (vid, vvec, vextra) in cells.meetings(batches, dimension, stored, np.int64):
            resident, visitor = _unit(rvec), _unit(vvec)
            hit = visitor @ resident.T >= threshold
            home = vextra[:, 0]
            at_home = home == cell
            hit &= np.where(at_home[:, None], vid[:, None] < rid[None, :], True)
            if not hit.any():
                continue
            # A pair that both sides find counts on the side with the smaller cell.
            late = ~at_home & (home > cell)
            if late.any() and hit[late].any():
                one, two = index.excess(resident)
                width = len(index.books[1])
                back = (one[:, home[late] // width] + two[:, home[late] % width]).T <= index.limit
                hit[late] &= ~back
            a, b = np.nonzero(hit)
            for own, total in ((vid, hit @ rextra[:, 1]), (rid, vextra[:, 1] @ hit)):
                for k in np.flatnonzero(total).tolist():
                    counts[int(own[k])] = counts.get(int(own[k]), 0) + int(total[k])
            keep = spanning_edges(vid[a], rid[b])
            yield pa.RecordBatch.from_arrays([pa.array(vid[a][keep]), pa.array(rid[b][keep]), pa.nulls(len(keep), pa.int64())], names=["u", "v", "links"])
            if len(counts) > 500_000:
                yield flush()
        yield flush()

    met = cells.dealt(classes.select("key", "embedding", "weight").mapInArrow(blocks, cells.BLOCKS), split, partitions(spark))
    found = materialize(met.mapInArrow(verify, "u long, v long, links long"), "embedding-links")
    return found.filter("links is not null").groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("links")), found.filter("v is not null").select("u", "v")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, ...)``.

    One set of jobs runs for each length of vector that there is; an embedding table has one.
    """
    rows = vectors.select("vec_id", "embedding")
    good = rows.filter(cells.usable(F.col("embedding")))
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = materialize(classes.withColumn("key", F.monotonically_increasing_id()), "embedding-classes")
    sizes = sorted(r[0] for r in classes.select(F.size("embedding")).distinct().collect())
    links, edges = None, None
    for size in sizes:
        more, ends = _links_of_dimension(classes.filter(F.size("embedding") == size), size, threshold)
        links, edges = (more, ends) if links is None else (links.unionByName(more), edges.unionByName(ends))
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    blank = rows.filter(~cells.usable(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if links is None:
        return blank
    # xxhash64 of one long loses nothing: nodes stay as distinct as the keys.
    scattered = edges.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"))
    component = connected_components(scattered, "embedding-components")
    named = classes.select("embedding", "key", "least", "weight").withColumn("node", F.xxhash64("key")).join(component, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(ids, "root").join(links, "key", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    return good.join(known, "embedding").select("vec_id", "n_links", "component_id", kept).unionByName(blank)
