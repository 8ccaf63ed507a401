"""Nearest neighbours through a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every vector is then sent down to its leaf.  A query walks
the tree with a priority queue of nodes ordered by the distance to their centres: the nearest node
leaves the queue, a leaf is visited, an inner node puts its children in.  How many vectors' worth of
leaves a query visits is calibrated: on sampled queries the visits are widened step by step until
their recall against brute force over the sample reaches the target.  Sampled neighbours lie farther
off than those among all rows, so the calibrated width errs on the safe side.

Queries go to the parts of the leaves they visit; each task keeps a running best list a query and
scores are recomputed exactly on the original vectors.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do
rows without an id; every other row is a candidate, and a query if its id says so, so rows that repeat an
id are found each and ask each (one list a row); only vectors of the same length are compared; ties go to
the smaller id; a query always visits enough leaves to fill its list if there are candidates enough; an
empty table gives an empty result; columns besides ``vec_id`` and ``embedding`` are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm import cells
from fathom.llm.common import materialize, partitions

#: Rows the tree and the calibration are fitted on: ``LEAF_SAMPLE`` a leaf, between the two bounds; sampled
#: queries of the calibration.
SAMPLE_ROWS, MAX_SAMPLE_ROWS, LEAF_SAMPLE, SAMPLE_QUERIES = 20_000, 262_144, 4, 256
TARGET_RECALL = 0.97
#: Leaves grow with the rows, as far as the sample and the tree's size in every worker allow.
BRANCHES, LEAF_ROWS, TREE_BYTES = 8, 256, 64 << 20
_SEED = 9_973


class Tree:
    """Nodes are rows of ``centres``; ``children[i]`` is empty for a leaf, whose number is ``leaf[i]``."""

    def __init__(self, sample: np.ndarray, leaves: int):
        rng = np.random.default_rng(_SEED)
        self.centres = [sample.mean(0)]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = []
        smallest = max(2, len(sample) // max(1, leaves))
        waiting = [(-len(sample), 0, np.arange(len(sample)))]
        count = 1
        while waiting and count < leaves:
            size, node, rows = heapq.heappop(waiting)
            if -size <= smallest:
                break
            books = cells.kmeans(sample[rows], min(BRANCHES, leaves - count + 1), rng)
            if len(books) < 2:
                continue
            own = cells.squared_distances(sample[rows], books).argmin(1)
            for k, centre in enumerate(books):
                child = len(self.centres)
                self.centres.append(centre)
                self.children.append([])
                self.children[node].append(child)
                heapq.heappush(waiting, (-int((own == k).sum()), child, rows[own == k]))
            count += len(books) - 1
        self.centres = np.array(self.centres)
        for kids in self.children:
            self.leaf.append(-1 if kids else max(self.leaf, default=-1) + 1)
        self.leaves = max(self.leaf) + 1
        self.visits = 1

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf each point reaches by taking the nearest child all the way down."""
        at = np.zeros(len(points), dtype=np.int64)
        open_rows = np.arange(len(points)) if self.children[0] else np.zeros(0, dtype=np.int64)
        while len(open_rows):
            moved = []
            for node in np.unique(at[open_rows]).tolist():
                rows = open_rows[at[open_rows] == node]
                kids = np.array(self.children[node])
                at[rows] = kids[cells.squared_distances(points[rows], self.centres[kids]).argmin(1)]
                moved.append(rows)
            open_rows = np.concatenate(moved)
            open_rows = open_rows[[bool(self.children[n]) for n in at[open_rows].tolist()]]
        return np.array(self.leaf)[at]

    def best_bins(self, distance: np.ndarray):
        """Leaves in best-bin-first order, given the query's distance to every node's centre."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not kids:
                yield self.leaf[node]
            for kid in kids:
                heapq.heappush(heap, (float(distance[kid]), kid))

    def calibrate(self, sample: np.ndarray, k: int, target: float) -> None:
        """Widen the visits until sampled queries find ``target`` of their ``k`` nearest."""
        step = max(1, len(sample) // SAMPLE_QUERIES)
        queries = np.arange(0, len(sample), step)
        d = cells.squared_distances(sample[queries], sample)
        d[np.arange(len(queries)), queries] = np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            self.visits = self.leaves
            return
        nearest = np.argpartition(d, k - 1, axis=1)[:, :k]
        leaf_of = self.assign(sample)
        to_nodes = cells.squared_distances(sample[queries], self.centres)
        place = np.empty((len(queries), self.leaves), dtype=np.int64)
        for r in range(len(queries)):
            for at, leaf in enumerate(self.best_bins(to_nodes[r])):
                place[r, leaf] = at
        need = np.take_along_axis(place, leaf_of[nearest], axis=1)
        self.visits = 1
        while self.visits < self.leaves and (need < self.visits).mean() < target:
            self.visits += max(1, self.visits // 16)
        self.visits = min(self.visits, self.leaves)


def leaf_count(rows: int, dimension: int) -> int:
    return max(1, min(rows // LEAF_ROWS, MAX_SAMPLE_ROWS // LEAF_SAMPLE, TREE_BYTES // (8 * dimension)))


def _search_dimension(good: DataFrame, dimension: int, every: int, k: int, target: float) -> DataFrame:
    spark = good.sparkSession
    rows = good.count()
    leaves = leaf_count(rows, dimension)
    sample = cells.bounded_sample(good, max(SAMPLE_ROWS, LEAF_SAMPLE * leaves), rows, dimension)
    tree = Tree(sample, leaves)
    tree.calibrate(sample, k, target)
    shared = spark.sparkContext.broadcast(tree)
    stored = cells.stored_type(good)

    def own_leaves(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.assign(cells.matrix(batch.column(0), dimension)), pa.int64())], names=["cell"])

    counts = good.select("embedding").mapInArrow(own_leaves, "cell long").groupBy("cell").count().collect()  # one row a leaf
    filled = np.zeros(tree.leaves, dtype=np.int64)
    for r in counts:
        filled[r["cell"]] = r["count"]

    def visits(vectors):
        """``(row, leaf)`` of the leaves that queries visit."""
        tree = shared.value
        to_nodes = cells.squared_distances(vectors, tree.centres)
        row, to = [], []
        for r, distance in enumerate(to_nodes):
            seen = visited = 0
            for cell in tree.best_bins(distance):
                if visited >= tree.visits and seen > k:
                    break
                visited += 1
                seen += int(filled[cell])
                row.append(r)
                to.append(cell)
        return np.array(row, dtype=np.int64), np.array(to, dtype=np.int64)

    def counted(batches):
        for batch in batches:
            if len(batch):
                _, to = visits(cells.matrix(batch.column(0), dimension))
                yield cells.loads(np.zeros(0, dtype=np.int64), to)

    asking = good.filter(F.col("vec_id") % every == 0)
    asked = asking.select("embedding").mapInArrow(counted, cells.LOADS)
    residents = spark.createDataFrame([(c, int(n), 0) for c, n in enumerate(filled.tolist())], cells.LOADS)
    split = cells.split_cells(asked.unionByName(residents), "search-split")

    def blocks(batches):
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(0).to_numpy()
            names = batch.column(1).to_numpy()
            vectors = cells.matrix(batch.column(2), dimension)
            kept = vectors.astype(stored)
            yield from cells.pack(shared.value.assign(vectors), 0, np.arange(len(ids)), ids, kept, names[:, None])
            asked = np.flatnonzero(names % every == 0)
            row, to = visits(vectors[asked])
            yield from cells.pack(to, 1, asked[row], ids, kept, names[:, None])

    def nearest(batches):
        best: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

        def flush():
            many = [len(v[1]) for v in best.values()]
            keys = np.repeat(np.array(list(best), dtype=np.int64), many)
            names = np.repeat(np.array([v[0] for v in best.values()], dtype=np.int64), many)
            ds = np.concatenate([v[1] for v in best.values()]) if best else np.zeros(0)
            ids = np.concatenate([v[2] for v in best.values()]) if best else np.zeros(0, dtype=np.int64)
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(names), pa.array(ids), pa.array(ds)], names=["key", "query_id", "vec_id", "score"])

        for _, (rkey, rvec, rname), (qkey, qvec, qname) in cells.meetings(batches, dimension, stored, np.int64):
            rough = cells.squared_distances(qvec, rvec)
            rough[qkey[:, None] == rkey[None, :]] = np.inf
            m = min(k, rough.shape[1])
            bound = np.partition(rough, m - 1, axis=1)[:, m - 1]
            slack = 1e-9 * ((qvec * qvec).sum(1) + (rvec * rvec).sum(1).max())
            for i, q in enumerate(qkey.tolist()):
                at = np.flatnonzero((rough[i] <= bound[i] + slack[i]) & np.isfinite(rough[i]))
                score = np.sqrt(((rvec[at] - qvec[i]) ** 2).sum(1))
                ids = rname[at, 0]
                if q in best:
                    score, ids = np.concatenate((best[q][1], score)), np.concatenate((best[q][2], ids))
                order = np.lexsort((ids, score))[:k]
                best[q] = int(qname[i, 0]), score[order], ids[order]
            if len(best) > 100_000:
                yield flush()
        yield flush()

    met = cells.dealt(good.select("key", "vec_id", "embedding").mapInArrow(blocks, cells.BLOCKS), split, partitions(spark))
    return met.mapInArrow(nearest, "key long, query_id long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, target: float = TARGET_RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row whose id ``every`` divides.

    One set of jobs runs for each length of vector that there is; an embedding table has one.
    """
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(cells.usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    good = materialize(good.withColumn("key", F.monotonically_increasing_id()), "search-rows")
    sizes = sorted(r[0] for r in good.select(F.size("embedding")).distinct().collect())
    found = None
    for size in sizes:
        part = _search_dimension(good.filter(F.size("embedding") == size), size, every, k, target)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return good.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    nearest_first = Window.partitionBy("key").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
