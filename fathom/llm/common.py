"""Shared plumbing: tables in the shared folder, ranks without a global sort task, components.

Everything that must be computed once is written as Parquet below the folder that the session
names in ``spark.checkpoint.dir``, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode (tests), where the session may name none, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="fathom-"))
    return _own_folder[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of an Arrow batch where rows are whole texts or files.
BATCH_BYTES = "4m"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile has small Arrow batches, so that long texts bound a task's memory and not their number."""
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there.  It runs with small Arrow batches."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._folder = path
    return written


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: What clears the caches that Python workers keep from task to task.
_worker_caches: list[Callable[[], None]] = []


def kept_in_worker(clear: Callable[[], None]) -> None:
    _worker_caches.append(clear)


def release_worker_memory(keep: Callable[[], None] | None = None) -> None:
    """One worker serves one operator after another, and what an earlier one has kept must not stand beside what a
    later one needs.  ``keep``: what clears the caller's own cache."""
    for clear in _worker_caches:
        if clear is not keep:
            clear()
    trim_worker_memory()


def trim_worker_memory() -> None:
    """Give back what the allocators keep of memory that nothing uses any more."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # other C libraries give memory back by themselves


#: Bytes of an Arrow batch that are worked on at a time; who runs a query sets how large the batches are.
WORK_BYTES = 4 << 20


def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows in batches of about ``WORK_BYTES``.  What earlier operators have kept goes before the first of
    them, and after each what the allocators would keep of it."""
    release_worker_memory()
    for batch in batches:
        rows = max(1, batch.num_rows * WORK_BYTES // max(batch.nbytes, WORK_BYTES))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
            trim_worker_memory()


def partitions(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def least_hashed(rows: DataFrame, key: list[str], many: int, total: int) -> DataFrame:
    """At most ``many`` of ``total`` rows: those of least hashed ``key``.

    A threshold on the hash leaves about twice as many to be sorted, so that what the partitions send to the
    merge does not grow with their number.
    """
    h = F.xxhash64(*key)
    if total > 2 * many:
        rows = rows.filter(h <= F.lit(-(1 << 63) + (1 << 64) * 2 * many // total))
    return rows.orderBy(h, *key).limit(many)


def placed_in_order(rows: DataFrame, order: list[str], name: str, stored: str) -> DataFrame:
    """``rows`` with their place from 0 in ``order``: ranges are sorted side by side, and each starts where the
    counts of the earlier ones end.  The result is a written table."""
    n = partitions(rows.sparkSession)
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    laid = laid.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    laid = materialize(laid, stored)
    sizes = {r[0]: r[1] for r in laid.groupBy("_range").count().collect()}  # one row a range
    starts, before = [], 0
    for k in range(n):
        starts.append(before)
        before += sizes.get(k, 0)
    first = F.element_at(F.array(*(F.lit(s).cast("long") for s in starts)), F.col("_range") + 1)
    return laid.withColumn(name, first + F.col("_at")).drop("_range", "_at")


SEGMENT = 1 << 16


def emit_segments(counters: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The non-empty 64 Ki stretches of a uint8 array."""
    for seg in range(0, len(counters), SEGMENT):
        part = counters[seg : seg + SEGMENT]
        if part.any():
            yield seg // SEGMENT, part.tobytes()


def fold_segments(rows: DataFrame, size: int, how: str, decode: np.ndarray | None = None) -> np.ndarray:
    """Sum (``sum``, as uint32) or unite (``or``, as uint8) partial arrays ``(seg, payload)``.

    Payloads are bytes; ``decode`` says which number a byte stands for in a sum.

    The fold runs on the executors, one running array per segment; the driver receives the
    finished array, whose ``size`` is a parameter of the caller and not of the data.
    """
    kind = np.uint32 if how == "sum" else np.uint8

    def fold(batches):
        held: dict[int, np.ndarray] = {}
        for batch in frugal(batches):
            for seg, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(payload, dtype=np.uint8)
                own = held.setdefault(seg, np.zeros(len(part), dtype=kind))
                if how == "sum":
                    own += part if decode is None else decode[part]
                else:
                    own |= part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["seg", "payload"]
        )

    n = min(max(1, size // SEGMENT), partitions(rows.sparkSession))
    out = np.zeros(size, dtype=kind)
    folded = rows.select("seg", "payload").repartition(n, "seg").mapInArrow(fold, "seg int, payload binary")
    with small_batches(rows.sparkSession):
        for seg, payload in folded.toLocalIterator():
            part = np.frombuffer(payload, dtype=kind)
            out[seg * SEGMENT : seg * SEGMENT + len(part)] = part
    return out


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(u, v)``; root: its smallest node.

    Each round every node hooks onto its smallest neighbour, follows that pointer once more, and
    the edges are rewritten between the pointers; loops and repeats go.  Node ids should be
    scattered (hashes), so that chains shrink by a constant factor and the rounds stay
    logarithmic.  Only joins and partial minima are used, so a hub is never gathered in one task.
    """
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    left = materialize(edges, f"{name}-edges")
    labels: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("to"))
        hook = materialize(hook, f"{name}-hook")
        up = hook.select(F.col("node").alias("to"), F.col("to").alias("root"))
        jump = materialize(hook.join(up, "to").select("node", "root"), f"{name}-jump")
        if labels is None:
            new_labels = jump
        else:
            step = jump.select(F.col("node").alias("root"), F.col("root").alias("next"))
            new_labels = materialize(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"{name}-labels")
        a = jump.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = jump.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        shrunk = left.join(a, "u").join(b, "v").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).filter("u <> v").distinct()
        shrunk = materialize(shrunk, f"{name}-edges")
        for old in (left, hook, *([labels, jump] if labels is not None else [])):
            discard(old)
        left, labels = shrunk, new_labels
    if labels is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # The contraction ends in one root a component, but not always in its smallest node.
    least = labels.groupBy("root").agg(F.least(F.min("node"), F.first("root")).alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))


def spanning_edges(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Positions of edges that already connect what all the edges ``u[i] - v[i]`` connect."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up] if up in parent else up
        return x

    keep = []
    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            keep.append(k)
    return np.array(keep, dtype=np.int64)


def hash_bucket_totals(df: DataFrame, group: str, bucket: str, value: str) -> DataFrame:
    """For each (group, bucket): the sum of ``value`` in the group's earlier buckets."""
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("in_bucket"))
    w = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before_bucket", F.coalesce(F.sum("in_bucket").over(w), F.lit(0)))
