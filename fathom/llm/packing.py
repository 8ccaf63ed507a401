"""Packing token sequences by minimum bin slack.

Every document is cut into full windows and one remainder.  What is left to pack is then a multiset
of remainder lengths, a histogram of fewer entries than the window has tokens, however large the
corpus.  A window starts from the longest remaining length; a bitset subset-sum program over the
remaining multiset finds the sum closest to the free space, and backtracking through its layers
gives the count of each length.  The same filling is repeated for as many windows as the histogram
has room for.  If no filling closes a window, one remainder is cut to close it and its rest goes
back into the multiset.  The last open window is cut into sequences of powers of two, so that
nothing is padded.

The plan is made of rank ranges ("the k-th remainder of length n"); ranks are running counts within
scan tasks plus offsets from a small count table, so no length is ever gathered in one task.  A filling is
repeated until some length has fewer pieces left than one more window would take of it, fewer than the window
divided by the length.  So the turns, and the rows of a plan, are bounded by the window and not by the
documents; the size is looked at all the same before the plan is sent to every task.

Defined results: a null text is empty and has the one token that ends it; repeated rows, and rows with a
null id, are packed each on their own; a text may be of any length, its full windows are sequences of
their own; remainders of one length are taken in the order of the scan; an empty table gives no piece;
other columns of any name are not looked at.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import materialize, trim_worker_memory
from fathom.llm.tokens import LOT_BYTES, encoder, lots

WINDOW, END_ID = 2048, 1
#: Plans of so many rows (nine numbers each) go to every task; a larger one is joined by remainder length.
SMALL_PLAN = 200_000


def fill(lengths: list[tuple[int, int]], space: int) -> dict[int, int]:
    """Counts by length whose sum is as close to ``space`` as it can be without passing it.

    ``lengths`` lists ``(length, available)``.  Bit ``s`` of a layer says that the sum ``s`` can be
    made from the lengths so far; counts are split into powers of two to bound the shifts.
    """
    full = (1 << (space + 1)) - 1
    reach, layers = 1, []
    for length, available in lengths:
        left = min(available, space // length) if length <= space else 0
        step = 1
        while left > 0:
            take = min(step, left)
            layers.append((reach, length, take))
            reach |= (reach << (length * take)) & full
            left -= take
            step *= 2
        if reach >> space & 1:
            break
    at = reach.bit_length() - 1
    counts: dict[int, int] = {}
    for before, length, take in reversed(layers):
        if not before >> at & 1:
            at -= length * take
            counts[length] = counts.get(length, 0) + take
    return counts


class _Lots:
    """Remainders by length, as runs of equal pieces: (original length, first rank, count, start)."""

    def __init__(self, histogram: dict[int, int]):
        self.lots = {n: deque([(n, 0, c, 0)]) for n, c in histogram.items() if c > 0}
        self.count = {n: c for n, c in histogram.items() if c > 0}

    def put(self, length: int, lot: tuple[int, int, int, int]) -> None:
        self.lots.setdefault(length, deque()).append(lot)
        self.count[length] = self.count.get(length, 0) + lot[2]

    def take(self, length: int, wanted: int):
        self.count[length] -= wanted
        if not self.count[length]:
            del self.count[length]
        lots = self.lots[length]
        while wanted:
            origin, rank, count, start = lots.popleft()
            used = min(count, wanted)
            if used < count:
                lots.appendleft((origin, rank + used, count - used, start))
            wanted -= used
            yield origin, rank, used, start


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, ...]], int]:
    """Rows ``(origin, rank_from, rank_to, start, length, k_from, per_window, sequence, offset)`` and
    the number of sequences: piece ``k`` of a row lies in sequence ``sequence + k // per_window`` at
    ``offset + k % per_window * length``."""
    left = _Lots(histogram)
    rows: list[tuple[int, ...]] = []
    sequence = 0

    def place(length: int, each: int, windows: int, offset: int, part: int | None = None) -> None:
        k = 0
        for origin, rank, used, start in left.take(length, each * windows):
            rows.append((origin, rank, rank + used, start, part or length, k, each, sequence, offset))
            if part:
                left.put(length - part, (origin, rank, used, start + part))
            k += used

    while left.count:
        first = max(left.count)
        order = sorted(left.count, reverse=True)
        counts = fill([(n, left.count[n] - (n == first)) for n in order], window - first)
        counts[first] = counts.get(first, 0) + 1
        slack = window - sum(n * m for n, m in counts.items())
        spare = [n for n in order if left.count[n] > counts.get(n, 0) and n > slack] if slack else []
        cut = min(spare, default=0)
        if slack and not cut:  # everything that is left: less than a window
            bins = [1 << b for b in range(window.bit_length() - 1, -1, -1) if (window - slack) >> b & 1]
            free, offset = bins.pop(0), 0
            while left.count:
                n = max(left.count)
                part = min(n, free)
                place(n, 1, 1, offset, part if part < n else None)
                free, offset = free - part, offset + part
                if not free:
                    sequence += 1
                    free, offset = (bins.pop(0) if bins else 0), 0
            break
        need = dict(counts)
        if cut:
            need[cut] = need.get(cut, 0) + 1
        windows = min(left.count[n] // m for n, m in need.items())
        offset = 0
        for n, m in sorted(counts.items(), reverse=True):
            place(n, m, windows, offset)
            offset += n * m
        if cut:
            place(cut, 1, windows, offset, slack)
        sequence += windows
    return rows, sequence


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _measured(docs: DataFrame, path: str, end_id: int, window: int, remembered: int | None) -> DataFrame:
    """Per document: tokens, checksums of its full windows and its remainder, and running counts."""

    def run(batches):
        encode = encoder(path, remembered).encode
        part = TaskContext.get().partitionId()
        ranks = np.zeros(window, dtype=np.int64)
        full = 0
        # An encoder with little memory gets small lots too.
        for batch in lots(batches, LOT_BYTES // 4 if remembered else LOT_BYTES):
            cols: list[list] = [[], [], [], [], [], []]
            for ids in encode(batch.column(1)):
                ids = np.append(ids, np.uint32(end_id))
                whole, rest = divmod(len(ids), window)
                crcs = [_crc(ids[k * window : (k + 1) * window]) for k in range(whole)]
                for c, v in zip(cols, (len(ids), crcs, rest, _crc(ids[whole * window :]), int(ranks[rest]), full), strict=True):
                    c.append(v)
                ranks[rest] += 1
                full += whole
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array([part] * len(batch), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "doc_tokens", "crcs", "rest", "rest_crc", "rank", "full_before", "part"])
            if remembered:
                trim_worker_memory()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>, rest long, rest_crc long, rank long, full_before long, part long")


def _cut_checksums(docs: DataFrame, cut: DataFrame, path: str, end_id: int, remembered: int | None) -> DataFrame:
    """Checksums of pieces of cut remainders; only the documents concerned are encoded again."""
    wanted = cut.groupBy(F.col("doc_id").alias("cut_id")).agg(F.collect_set(F.struct("doc_tokens", "rest_crc", "start", "length")).alias("pieces"))
    # Written first: with its size known, a small table goes to the texts and no text is shuffled.
    wanted = materialize(wanted, "packing-cut")

    def run(batches):
        encode = encoder(path, remembered).encode
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text, pieces in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids = np.append(encode([text or ""])[0], np.uint32(end_id))
                for p in pieces:
                    whole = len(ids) // WINDOW * WINDOW
                    if p["doc_tokens"] == len(ids) and p["rest_crc"] == _crc(ids[whole:]):
                        crc = _crc(ids[p["start"] : p["start"] + p["length"]])
                        for c, v in zip(out, (doc_id, p["doc_tokens"], p["rest_crc"], p["start"], p["length"], crc), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "doc_tokens", "rest_crc", "start", "length", "crc"])

    found = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("cut_id"))).select("doc_id", "text", "pieces")
    return found.mapInArrow(run, "doc_id long, doc_tokens long, rest_crc long, start long, length long, crc long").distinct()


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID, remembered: int | None = None) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``remembered`` bounds the encoder's caches in each worker.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path("word_bpe_49k.json")
    measured = materialize(_measured(docs, path, end_id, WINDOW, remembered), "packing-documents")

    counts = measured.filter("rest > 0").groupBy("rest", "part").agg(F.count("*").alias("many"))
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("many").over(earlier), F.lit(0))), "packing-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("rest").agg(F.sum("many")).collect()}  # fewer rows than a window has tokens
    rows, sequences = plan(histogram)
    names = "origin long, rank_from long, rank_to long, cut_start long, length long, k_from long, per_window long, sequence long, at long"
    planned = spark.createDataFrame(rows, names)
    if len(rows) <= SMALL_PLAN:
        planned = F.broadcast(planned)

    ranked = measured.filter("rest > 0").join(counts.select("rest", "part", "before"), ["rest", "part"])
    ranked = ranked.withColumn("place", F.col("rank") + F.col("before"))
    k = F.col("k_from") + F.col("place") - F.col("rank_from")
    rests = ranked.join(planned, (F.col("rest") == F.col("origin")) & (F.col("place") >= F.col("rank_from")) & (F.col("place") < F.col("rank_to"))).select(
        "doc_id",
        (F.col("doc_tokens") - F.col("rest") + F.col("cut_start")).alias("start"),
        "length",
        F.when(F.col("length") == F.col("rest"), F.col("rest_crc")).alias("ids_crc32"),
        "doc_tokens",
        (F.col("sequence") + F.floor(k / F.col("per_window"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(k, F.col("per_window")) * F.col("length")).cast("long").alias("offset"),
        "rest_crc",
    )
    rests = materialize(rests, "packing-rests")
    whole_rests = rests.filter("ids_crc32 is not null").drop("rest_crc")
    cut = rests.filter("ids_crc32 is null")
    if cut.isEmpty():
        closed = whole_rests
    else:
        key = ["doc_tokens", "rest_crc", "start", "length"]
        sums = _cut_checksums(docs, cut, path, end_id, remembered).withColumnRenamed("doc_id", "sum_id")
        same = [F.col("doc_id").eqNullSafe(F.col("sum_id")), *(cut[c] == sums[c] for c in key)]
        on = same[0]
        for c in same[1:]:
            on = on & c
        fixed = cut.join(sums, on).select("doc_id", cut["start"], cut["length"], F.col("crc").alias("ids_crc32"), cut["doc_tokens"], "sequence_id", "offset")
        closed = whole_rests.unionByName(fixed)

    in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a scan task
    tasks = measured.groupBy("part").agg(F.sum(F.size("crcs")).alias("full")).withColumn("tasks_before", F.coalesce(F.sum("full").over(in_order), F.lit(0)))
    full = measured.filter(F.size("crcs") > 0).join(tasks.select("part", "tasks_before"), "part")
    full = full.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("at", "ids_crc32"), (F.col("tasks_before") + F.col("full_before")).alias("first"))
    full = full.select(
        "doc_id",
        (F.col("at") * WINDOW).cast("long").alias("start"),
        F.lit(WINDOW).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.lit(sequences) + F.col("first") + F.col("at")).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return closed.unionByName(full)
