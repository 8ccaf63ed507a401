"""Fingerprints, manifests and resume rules."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def config_fingerprint(config: dict) -> str:
    """SHA-256 of the compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def code_fingerprint(folder: str | Path, pattern: str = "*.py") -> str:
    """SHA-256 over sorted relative names and contents; line ends do not matter."""
    whole = hashlib.sha256()
    root = Path(folder)
    for path in sorted(root.rglob(pattern), key=lambda p: p.relative_to(root).as_posix()):
        whole.update(path.relative_to(root).as_posix().encode() + b"\0" + path.read_bytes().replace(b"\r\n", b"\n") + b"\0")
    return whole.hexdigest()


def content_digest(content: Column) -> Column:
    return F.sha2(F.regexp_replace(content, "\r\n", "\n"), 256)


def data_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``fingerprint``: SHA-256 of the sorted lines of a catalogue.  One line a file makes one string, so it is
    for catalogues; use :func:`table_digest` for tables."""
    line = F.concat_ws("|", *(F.col(c).cast("string") for c in columns))
    return rows.select(line.alias("line")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("fingerprint"))


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """An order-free digest of any number of rows: count and wrapped sum of row hashes."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count("*").alias("n"), F.sum((h / F.lit(1 << 20)).cast("long")).alias("high"), F.sum(F.pmod(h, F.lit(1 << 20))).alias("low"))


def manifest_differences(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """``key, problem`` between two tables ``(key, digest)``: added, missing or changed."""
    a, b = now.select("key", F.col("digest").alias("a")), recorded.select("key", F.col("digest").alias("b"))
    both = a.join(b, "key", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("key", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "missing").otherwise("changed").alias("problem"))


def one_version(results: DataFrame, column: str = "experiment_version") -> None:
    found = [r[0] for r in results.select(column).distinct().limit(3).collect()]
    if len(found) != 1:
        raise ValueError(f"results of several versions: {found}")


def may_resume(metrics: DataFrame, metadata: dict, progress: dict, expected: dict, methods: Iterable[str], bounded: list[str]) -> bool:
    """Whether finished results may be kept: complete, unique, of the same fingerprints and in range."""
    if progress.get("stage") != "complete" or any(metadata.get(k) != v for k, v in expected.items()):
        return False
    if not {"method", *bounded} <= set(metrics.columns):
        return False
    bad = F.lit(False)
    for c in bounded:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c) < 0) | (F.col(c) > 1)
    row = metrics.agg(F.count("*").alias("n"), F.countDistinct("method").alias("d"), F.sum(bad.cast("int")).alias("bad"), F.collect_set("method").alias("methods")).first()
    return row["n"] == row["d"] and not row["bad"] and set(row["methods"]) == set(methods)


def completed_scope(stages: DataFrame, metrics: DataFrame) -> DataFrame:
    """Datasets of which metrics exist without a finished stage, or the other way round."""
    done = stages.filter("stage = 'complete'").select("dataset", F.lit(1).alias("done")).distinct()
    have = metrics.select("dataset", F.lit(1).alias("have")).distinct()
    return done.join(have, "dataset", "full_outer").filter("done is null or have is null").select("dataset")


def merged(parts: list[DataFrame], datasets: set[str]) -> DataFrame:
    """Union of workers' results, once every dataset has exactly one worker."""
    seen: list[str] = []
    for part in parts:
        seen += [r[0] for r in part.select("dataset").distinct().collect()]
    if sorted(seen) != sorted(datasets):
        raise ValueError(f"expected each of {sorted(datasets)} once, found {sorted(seen)}")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def frozen(pool: list[dict]) -> str:
    """Digest of a candidate pool, taken before any holdout row is read."""
    plain = [{k: v.tolist() if hasattr(v, "tolist") else v for k, v in c.items()} for c in pool]
    return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def below(path: str | Path, root: str | Path, create: bool = False) -> Path:
    """``path`` resolved, if it lies below ``root`` and no link leads out of it."""
    full, base = Path(path).resolve(), Path(root).resolve()
    if full == base or base not in full.parents:
        raise ValueError(f"{path} is not below {root}")
    if create:
        full.mkdir(parents=True, exist_ok=True)
    return full
