"""Representations of feature rows: layers, supports, principal components, and their dispatch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.vectors import concat_layers, l2_normalized, take
from fathom.operators.statistics import gram


@dataclass
class Pca:
    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray


def fit_pca(rows: DataFrame, k: int) -> Pca:
    """Principal components of the centred rows from their Gram matrix; signs are fixed by the largest entry."""
    n = rows.count()
    sums = rows.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m")).orderBy("j").collect()  # one row a column
    mean = np.array([s["m"] for s in sums])
    covariance = gram(rows) - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[: min(k, n - 1, len(mean))]
    components = vectors[:, order].T
    sign = np.sign(components[np.arange(len(components)), np.abs(components).argmax(1)])
    return Pca(mean, components * sign[:, None], np.maximum(values[order], 0))


def project(rows: DataFrame, pca: Pca) -> DataFrame:
    """``rows`` with ``z``: the centred vector on the components, one matrix product a batch."""
    from pyspark.sql import types as T

    held = rows.sparkSession.sparkContext.broadcast(pca)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array(frame["v"].tolist(), dtype=np.float64).reshape(len(frame), -1)
            yield frame.assign(z=list((x - held.value.mean) @ held.value.components.T) if len(frame) else [])

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("z", T.ArrayType(T.DoubleType()))]))


@dataclass
class Method:
    """One row of the method table: which layers, and what is done to them."""

    name: str
    kind: str = "raw"  # raw, support, uniform, random, pca
    layers: tuple[int, ...] = ()
    mode: str = "l2"
    active: tuple[int, ...] = ()
    weights: tuple[float, ...] = ()
    pca: Pca | None = field(default=None, repr=False)


def represent(rows: DataFrame, method: Method, width: int) -> DataFrame:
    """``rows`` with ``v`` replaced by the method's unit-length representation."""
    joined = concat_layers("v", method.layers, width, method.mode)
    if method.kind == "raw":
        out = rows.withColumn("v", joined)
    elif method.kind == "support":
        out = rows.withColumn("v", take(joined, method.active, [w**0.5 for w in method.weights]))
    elif method.kind in ("uniform", "random"):
        out = rows.withColumn("v", take(joined, method.active))
    elif method.kind == "pca":
        out = project(rows.withColumn("v", joined), method.pca).drop("v").withColumnRenamed("z", "v")
    else:
        raise ValueError(f"unknown representation {method.kind!r}")
    return out.withColumn("v", l2_normalized("v"))
