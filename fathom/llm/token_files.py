"""Token-id files in bit-shuffled blocks.

A file is one byte string::

    magic "FTK1" | blocks | document table | chunk index | footer

Ids are cut into blocks of a fixed number.  A block is transposed into planes (plane ``p`` holds byte
``p``, or bit ``p``, of every id of the block), every plane is compressed with zstandard by itself, and
the chunk index stores each plane's place and size, so that any block can be read alone.  Only as many
planes are kept as the block's largest id needs.  The document table (ids, null flags and lengths) is
shuffled into byte planes in the same way.  All integers are little-endian.

Files travel through Spark as rows of a Parquet table: the commit protocol makes a lost executor
harmless, and any store that Spark can write will do.

Defined results: a null text is empty and has its end id alone; null document ids come first; equal
document ids keep a fixed order by the hash of their text; repeated rows are written each on their own;
a document may be of any length (it may fill a file by itself); an empty table gives no file; other
columns of any name are not looked at.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import materialize, partitions
from fathom.llm.tokens import encoder, lots

MAGIC = b"FTK1"
END_ID = 2
BLOCK_IDS = 1 << 16
#: A task closes a file once it holds so many ids.
FILE_IDS = 1 << 18
_FOOTER = struct.Struct("<QQQQIB3x4s")  # index at, table at, ids, documents, ids a block, bits a plane, magic
_CHUNK = np.dtype([("block", "<u4"), ("plane", "<u4"), ("at", "<u8"), ("size", "<u4")])


def to_planes(values: np.ndarray, bits: int) -> list[bytes]:
    """Planes of ``bits`` bits (1 or 8) of unsigned integers, lowest first, without the empty top ones."""
    width = values.dtype.itemsize
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width)
    used = (int(values.max()).bit_length() if len(values) else 0) if bits == 1 else (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    if bits == 8:
        return [np.ascontiguousarray(raw[:, p]).tobytes() for p in range(used)]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, p], bitorder="little").tobytes() for p in range(used)]


def from_planes(planes: list[bytes], count: int, kind: np.dtype, bits: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if bits == 8:
        raw = np.zeros((count, width), dtype=np.uint8)
        for p, plane in enumerate(planes):
            raw[:, p] = np.frombuffer(plane, dtype=np.uint8)
    else:
        each = np.zeros((count, 8 * width), dtype=np.uint8)
        for p, plane in enumerate(planes):
            each[:, p] = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=count, bitorder="little")
        raw = np.packbits(each, axis=1, bitorder="little")
    return raw.reshape(-1).view(kind)


def write_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int = 8, block: int = BLOCK_IDS, level: int = 3) -> bytes:
    press = zstandard.ZstdCompressor(level=level)
    out, size, chunks = [MAGIC], len(MAGIC), []

    def add(number: int, planes: list[bytes]) -> None:
        nonlocal size
        for p, plane in enumerate(planes):
            data = press.compress(plane)
            chunks.append((number, p, size, len(data)))
            out.append(data)
            size += len(data)

    ids = ids.astype("<u4")
    for k in range(0, len(ids), block):
        add(k // block, to_planes(ids[k : k + block], bits))
    table_at = size
    table = [np.array([d or 0 for d in doc_ids], dtype="<i8").view("<u8"), np.array([d is None for d in doc_ids], dtype="<u8"), lengths.astype("<u8")]
    for column in table:
        planes = to_planes(column, 8)
        packed = [press.compress(p) for p in planes]
        head = struct.pack("<B", len(packed)) + b"".join(struct.pack("<I", len(p)) for p in packed)
        out.append(head + b"".join(packed))
        size += len(out[-1])
    index_at = size
    out.append(np.array(chunks, dtype=_CHUNK).tobytes())
    out.append(_FOOTER.pack(index_at, table_at, len(ids), len(doc_ids), block, bits, MAGIC))
    return b"".join(out)


class TokenFile:
    """A reader of :func:`write_file`; blocks are decompressed as they are asked for."""

    def __init__(self, data: bytes):
        index_at, table_at, self.ids, self.documents, self.block, self.bits, magic = _FOOTER.unpack(data[-_FOOTER.size :])
        if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.data = data
        self.open = zstandard.ZstdDecompressor().decompress
        self.index = np.frombuffer(data[index_at : -_FOOTER.size], dtype=_CHUNK)
        columns, at = [], table_at
        for _ in range(3):
            n = data[at]
            sizes = struct.unpack(f"<{n}I", data[at + 1 : at + 1 + 4 * n])
            at += 1 + 4 * n
            planes = []
            for s in sizes:
                planes.append(self.open(data[at : at + s]))
                at += s
            columns.append(from_planes(planes, self.documents, "<u8", 8))
        self.doc_ids = [None if null else d for d, null in zip(columns[0].view("<i8").tolist(), columns[1].tolist(), strict=True)]
        self.lengths = columns[2].astype(np.int64)

    def read_block(self, number: int) -> np.ndarray:
        first, last = np.searchsorted(self.index["block"], [number, number + 1])
        planes = [self.open(self.data[int(c["at"]) : int(c["at"]) + int(c["size"])]) for c in self.index[first:last]]
        return from_planes(planes, min(self.block, self.ids - number * self.block), "<u4", self.bits)

    def documents_in_order(self):
        """``(doc_id, ids)`` of each document, holding one document and one block at a time."""
        held, number = np.zeros(0, dtype="<u4"), 0
        for doc_id, length in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            parts = [held]
            have = len(held)
            while have < length:
                parts.append(self.read_block(number))
                have += len(parts[-1])
                number += 1
            held = np.concatenate(parts)
            yield doc_id, held[:length]
            held = held[length:]


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID, bits: int = 8) -> DataFrame:
    """``(part, file, n_ids, payload)``: the files of all documents in ascending order of their ids."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        encode = encoder(path).encode
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal number, size
            payload = write_file(doc_ids, np.array([len(h) for h in held]), np.concatenate(held), bits)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())],
                names=["part", "file", "n_ids", "payload"],
            )
            number, size = number + 1, 0
            doc_ids.clear()
            held.clear()
            return row

        for lot in lots(batches):
            for doc_id, ids in zip(lot.column(0).to_pylist(), encode(lot.column(1)), strict=True):
                doc_ids.append(doc_id)
                held.append(np.append(ids, np.uint32(end_id)))
                size += len(held[-1])
                if size >= FILE_IDS:
                    yield close()
        if held:
            yield close()

    # Rows alike in id and text may be many; their place in the scan lets them lie in several ranges.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("at"))
    ordered = keyed.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie", "at").sortWithinPartitions("doc_id", "tie")
    return materialize(ordered.select("doc_id", "text").mapInArrow(run, "part long, file long, n_ids long, payload binary"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, read from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    sizes = files.select("part", "file", "n_ids")
    of_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a writing task
    of_part = of_part.withColumn("before_part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)))
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("before_file", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(of_part, "part")
    first = first.select("part", "file", (F.col("before_part") + F.col("before_file")).alias("first"))

    def run(batches):
        for batch in batches:
            for payload, start in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                cols: list[list] = [[], [], [], []]
                for doc_id, ids in TokenFile(payload.as_py()).documents_in_order():
                    for c, v in zip(cols, (doc_id, start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                        c.append(v)
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    opened = files.join(first, ["part", "file"]).select("payload", "first")
    return materialize(opened.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"), "token-documents")
