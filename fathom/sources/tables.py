"""Metric and prediction tables at the edge: CSV with nan and list cells, JSON payloads, one-file output."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_metrics(spark: SparkSession, path: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """A CSV of metrics: nan becomes null, and columns of bracketed lists become arrays."""
    rows = spark.read.csv(path, header=True, inferSchema=True, nanValue="nan")
    for f in rows.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            rows = rows.withColumn(f.name, F.when(~F.isnan(f.name), F.col(f.name)))
    for name in lists:
        rows = rows.withColumn(name, F.from_json(F.regexp_replace(F.col(name).cast("string"), "nan", "null"), "array<double>"))
    return rows


def long_predictions(wide: DataFrame, keys: tuple[str, ...] = ("image_path", "label", "mask_path")) -> DataFrame:
    """``keys, method, score`` from one column a method."""
    methods = [c for c in wide.columns if c not in keys]
    return wide.unpivot([k for k in keys if k in wide.columns], methods, "method", "score")


def wide_predictions(long: DataFrame, methods: list[str], keys: tuple[str, ...] = ("image_path", "label", "mask_path")) -> DataFrame:
    return long.groupBy(*[k for k in keys if k in long.columns]).pivot("method", methods).agg(F.first("score"))


def write_csv(rows: DataFrame, path: str | Path, limit: int = 1_000_000) -> None:
    """A report table of at most ``limit`` rows as one CSV file that appears whole or not at all."""
    local = rows.limit(limit + 1).toPandas()
    if len(local) > limit:
        raise ValueError(f"more than {limit} rows are no report: write Parquet")
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    local.to_csv(part, index=False)
    os.replace(part, path)


def write_json(value, path: str | Path) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_text(json.dumps(value, indent=2, sort_keys=True, default=lambda v: v.tolist()))
    os.replace(part, path)
