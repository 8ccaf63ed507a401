"""Summaries of metric tables: families, paired differences, macro averages, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def family(method: Column) -> Column:
    """A method's name without a trailing ``_seed`` number."""
    return F.regexp_replace(method, r"_seed\d+$", "")


def family_summary(metrics: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """For each key and family: runs, and mean and sample SD of each value (SD 0 below two values; nan is missing)."""
    cleaned = metrics.select(*keys, family(F.col("method")).alias("family"), *(F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double")).alias(v) for v in values))
    aggregates = [F.count("*").alias("runs")]
    for v in values:
        aggregates += [F.avg(v).alias(f"{v}_mean"), F.coalesce(F.when(F.count(v) > 1, F.stddev_samp(v)), F.lit(0.0)).alias(f"{v}_sd")]
    return cleaned.groupBy(*keys, "family").agg(*aggregates)


def paired_deltas(summary: DataFrame, keys: list[str], value: str, target: str) -> DataFrame:
    """The target family's mean minus each other family's, within each key."""
    main = summary.filter(F.col("family") == target).select(*keys, F.col(value).alias("_main"))
    return summary.filter(F.col("family") != target).join(main, keys).select(*keys, "family", (F.col("_main") - F.col(value)).alias("delta"))


def macro_average(summary: DataFrame, value: str) -> DataFrame:
    """Unweighted mean over the keys, best family first."""
    return summary.groupBy("family").agg(F.avg(value).alias("macro"), F.count(value).alias("datasets")).orderBy(F.desc("macro"), "family")


def prevalence(labels: DataFrame, keys: list[str]) -> DataFrame:
    return labels.groupBy(*keys).agg(F.sum((F.col("y") == 0).cast("long")).alias("normal"), F.sum((F.col("y") == 1).cast("long")).alias("abnormal"), F.avg(F.col("y").cast("double")).alias("prevalence"))


def within_fit_spread(metrics: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """Mean, SD and count over the random members of a prefix inside one fit."""
    own = metrics.filter(F.col("method").startswith(prefix))
    return own.groupBy(*keys, family(F.col("method")).alias("family")).agg(F.avg(value).alias("mean"), F.coalesce(F.when(F.count(value) > 1, F.stddev_samp(value)), F.lit(0.0)).alias("sd"), F.count(value).alias("n"))


def directional_gate(deltas: DataFrame, keys: list[str], least: float = 0.005) -> DataFrame:
    """Whether the mean difference reaches ``least`` for every key."""
    return deltas.groupBy(*keys).agg(F.avg("delta").alias("m")).agg(F.min((F.col("m") >= least).cast("int")).alias("passes"), F.count("*").alias("comparisons"))


def layer_rows(methods: DataFrame, layers: int) -> DataFrame:
    """One row a method and layer 1..``layers`` of ``methods(method, chosen, scores)``: selected or not, and its score."""
    numbered = methods.select("method", F.explode(F.sequence(F.lit(1), F.lit(layers))).alias("layer"), "chosen", "scores")
    return numbered.select("method", "layer", F.array_contains("chosen", F.col("layer")).cast("int").alias("selected"), F.get("scores", F.col("layer") - 1).alias("score"))


def formatted(mean: Column, sd: Column) -> Column:
    """``mean ± sd`` in per cent."""
    return F.format_string("%.2f ± %.2f", mean * 100, sd * 100)


def as_pivot(summary: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    return summary.groupBy(row).pivot(column, names).agg(F.first(value))


def compression(kept: Column, candidates: Column) -> Column:
    return 1 - kept / candidates


def memory_mib(rows: Column, columns: Column, width: int = 2) -> Column:
    return rows * columns * F.lit(width) / F.lit(float(1 << 20))


# --- audits: each returns the rows that break a rule


def not_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).filter("times > 1")


def out_of_range(rows: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c).isNotNull() & (F.isnan(F.col(c).cast("double")) | (F.col(c) < low) | (F.col(c) > high)))
    return rows.filter(bad)


def missing_combinations(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of a ``left`` and a ``right`` value that have no row (both are short lists)."""
    every = rows.select(left).distinct().crossJoin(F.broadcast(rows.select(right).distinct()))
    return every.join(rows.select(left, right).distinct(), [left, right], "left_anti")


def unequal_method_sets(rows: DataFrame, key: str) -> DataFrame:
    """Methods that some value of ``key`` has and another lacks."""
    per = rows.select(key, "method").distinct()
    total = per.select(key).distinct().count()
    return per.groupBy("method").agg(F.count("*").alias("present")).filter(F.col("present") < total)


def anchor_differences(new: DataFrame, old: DataFrame, key: str, columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """Rows on which two tables differ: missing on one side, or a value off by more than the tolerance."""
    a, b = new.select(key, *(F.col(c).alias(f"a_{c}") for c in columns)), old.select(key, *(F.col(c).alias(f"b_{c}") for c in columns))
    off = F.lit(False)
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        off = off | ~F.coalesce(x.eqNullSafe(y) | (F.abs(x - y) <= tolerance), F.lit(False))
    return a.join(b, key, "full_outer").filter(off)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that stand on both sides (fit and holdout must have none in common)."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def expect_none(violations: DataFrame, message: str) -> None:
    found = violations.limit(3).collect()
    if found:
        raise ValueError(f"{message}: {[tuple(r) for r in found]}")
