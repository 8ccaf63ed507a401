"""Tables of files, and readers of volumes and pictures as Spark data.

Paths and contents come through Spark's ``binaryFile`` source; formats are decoded by numpy in
``mapInPandas``.  NIfTI-1 and plain (uncompressed, little-endian) DICOM are read without other packages.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.images import png_pixels

#: NIfTI data type code to numpy type; fixed values of the format.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``path, length, modified`` of everything below ``root``; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", "length", F.col("modificationTime").alias("modified"))


def digests(spark: SparkSession, root: str) -> DataFrame:
    """``key, digest``: SHA-256 of every file below ``root``, by its path there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("key"), F.sha2("content", 256).alias("digest"))


def nifti(content: bytes) -> np.ndarray:
    """The voxels of a NIfTI-1 file (gzipped or not), scaled if the header says so; axes x, y, z."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    order = "<" if struct.unpack("<i", content[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", content[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(order + "8h", content[40:56])
    kind, at = struct.unpack(order + "h", content[70:72])[0], int(struct.unpack(order + "f", content[108:112])[0])
    slope, inter = struct.unpack(order + "2f", content[112:120])
    if kind not in NIFTI_TYPES:
        raise ValueError(f"NIfTI data type {kind} is not read")
    shape = tuple(dim[1 : 1 + dim[0]])
    values = np.frombuffer(content, dtype=order + NIFTI_TYPES[kind], count=int(np.prod(shape)), offset=at).reshape(shape, order="F")
    return values * slope + inter if slope not in (0.0, 1.0) or (slope and inter) else values


def dicom(content: bytes) -> np.ndarray:
    """Pixels of a plain little-endian DICOM file; MONOCHROME1 is inverted."""
    at = 132 if content[128:132] == b"DICM" else 0
    found: dict[tuple[int, int], bytes] = {}
    explicit = True
    while at + 8 <= len(content):
        group, element = struct.unpack("<HH", content[at : at + 4])
        if group != 2 and (0x0002, 0x0010) in found:
            explicit = found[(0x0002, 0x0010)].rstrip(b"\0 ") != b"1.2.840.10008.1.2"
        if explicit or group == 2:
            vr = content[at + 4 : at + 6]
            if vr in (b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN"):
                size, head = struct.unpack("<I", content[at + 8 : at + 12])[0], 12
            else:
                size, head = struct.unpack("<H", content[at + 6 : at + 8])[0], 8
        else:
            size, head = struct.unpack("<I", content[at + 4 : at + 8])[0], 8
        if size == 0xFFFFFFFF:
            raise ValueError("compressed or nested DICOM is not read")
        found[(group, element)] = content[at + head : at + head + size]
        at += head + size
    rows, cols, bits = (struct.unpack("<H", found[(0x0028, e)][:2])[0] for e in (0x0010, 0x0011, 0x0100))
    signed = struct.unpack("<H", found.get((0x0028, 0x0103), b"\0\0")[:2])[0]
    pixels = np.frombuffer(found[(0x7FE0, 0x0010)], dtype=f"<{'i' if signed else 'u'}{bits // 8}", count=rows * cols).reshape(rows, cols)
    if found.get((0x0028, 0x0004), b"").strip(b"\0 ") == b"MONOCHROME1":
        pixels = pixels.max() - pixels
    return pixels


_DECODE = {"png": png_pixels, "nifti": nifti, "dicom": dicom}


def read_arrays(spark: SparkSession, root: str, kind: str, glob: str | None = None) -> DataFrame:
    """``path, shape, values``: every file below ``root`` as a flat row-major array of doubles."""
    decode = _DECODE[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            arrays = [decode(bytes(c)) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "shape": [list(a.shape) for a in arrays], "values": [np.ascontiguousarray(a, dtype=np.float64).ravel() for a in arrays]})

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", "content").mapInPandas(run, "path string, shape array<int>, values array<double>")


def volume_slices(volumes: DataFrame, first: int, last: int, step: int) -> DataFrame:
    """``path, z, shape, values`` of slices ``first, first + step, ..`` below ``last`` of ``x, y, z`` volumes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, shape, values in zip(frame["path"], frame["shape"], frame["values"], strict=True):
                v = np.asarray(values).reshape(tuple(shape))
                zs = [z for z in range(first, last, step) if z < v.shape[2]]
                if zs:
                    yield pd.DataFrame({"path": path, "z": zs, "shape": [list(v.shape[:2])] * len(zs), "values": [v[:, :, z].ravel() for z in zs]})

    return volumes.mapInPandas(run, "path string, z int, shape array<int>, values array<double>")


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """A headerless ``slide,x,y`` list."""
    return spark.read.csv(path, schema="slide string, x long, y long")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one a file or one a line."""
    return spark.read.option("multiLine", "true").json(path)
