"""Choice rules over candidate tables: budgets, paths, guards and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_weights(weights: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """The ``budget`` largest of ``weights(keys, j, w)`` for each key, smaller ``j`` first on ties."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("w"), "j"))
    return weights.withColumn("place", place).filter(F.col("place") <= budget).drop("place")


def path_choice(path: DataFrame, tolerance: float) -> DataFrame:
    """Of ``path(lam, retained, error)``: the feasible point with the fewest columns, then the least error; without
    a feasible point the one with the least error."""
    fine = F.col("error") <= tolerance
    rank = F.struct((~fine).alias("a"), F.when(fine, F.col("retained")).otherwise(0).alias("b"), F.col("error").alias("c"), F.col("lam").alias("d"))
    return path.agg(F.min_by(F.struct("lam", "retained", "error", fine.alias("feasible")), rank).alias("best")).select("best.*")


def fixed_budget_choice(pool: DataFrame, tolerance: float) -> DataFrame:
    """Feasible candidates by ``(objective, error, id)``, otherwise all by ``(error, objective, id)``."""
    fine = F.col("error") <= tolerance
    rank = F.struct((~fine).alias("a"), F.when(fine, F.col("objective")).otherwise(F.col("error")).alias("b"), F.when(fine, F.col("error")).otherwise(F.col("objective")).alias("c"), F.col("id").alias("d"))
    return pool.agg(F.min_by(F.struct("id", "objective", "error"), rank).alias("best")).select("best.*")


def guarded_choice(candidates: DataFrame, baseline: Column, se: Column, multiplier: float) -> DataFrame:
    """The tail-guarded candidate of ``candidates(id, mean, mse, cvar)``.

    Eligible: mean within ``multiplier`` standard errors of the baseline's, and neither squared error nor
    tail mean above it.  The least ``(cvar, mean, id)`` wins, but only a smaller tail mean unseats the baseline.
    """
    base = candidates.filter(F.col("id") == baseline).select(F.col("id").alias("b_id"), F.col("mean").alias("b_mean"), F.col("mse").alias("b_mse"), F.col("cvar").alias("b_cvar"))
    all_rows = candidates.crossJoin(F.broadcast(base))  # one row of baseline
    eligible = (F.col("mean") <= F.col("b_mean") + F.lit(multiplier) * se) & (F.col("mse") <= F.col("b_mse")) & (F.col("cvar") <= F.col("b_cvar"))
    best = all_rows.withColumn("eligible", eligible)
    winner = best.filter("eligible").agg(F.min_by(F.struct("id", "cvar", "b_id", "b_cvar"), F.struct("cvar", "mean", "id")).alias("w"), F.count("*").alias("n_eligible"))
    return winner.select(F.when(F.col("w.cvar") < F.col("w.b_cvar"), F.col("w.id")).otherwise(F.col("w.b_id")).alias("winner"), "n_eligible")


def best_supports(pool: DataFrame, count: int) -> DataFrame:
    """The best candidate of every distinct support of ``pool(id, active, loss)``, and of these the ``count`` best."""
    own = F.row_number().over(Window.partitionBy("active").orderBy("loss", "id"))
    return pool.withColumn("place", own).filter("place = 1").drop("place").orderBy("loss", "id").limit(count)


def frozen_choice(pool: DataFrame) -> DataFrame:
    """Holdout loss plus the training nuisance term, least candidate id on ties."""
    total = F.col("holdout_loss") + F.col("training_nuisance")
    return pool.agg(F.min_by(F.struct("id", total.alias("score")), F.struct(total, "id")).alias("best")).select("best.*")


def descent_violations(trace: DataFrame) -> DataFrame:
    """Steps of ``trace(run, step, value)`` whose value is not below the one before."""
    w = Window.partitionBy("run").orderBy("step")
    return trace.withColumn("previous", F.lag("value").over(w)).filter("previous is not null and not value < previous")


def feasibility_counts(pool: DataFrame, tolerance: float) -> DataFrame:
    """``candidates, feasible, least_error, least_feasible_size`` of ``pool(size, error)``."""
    fine = F.col("error") <= tolerance
    return pool.agg(F.count("*").alias("candidates"), F.sum(fine.cast("long")).alias("feasible"), F.min("error").alias("least_error"), F.min(F.when(fine, F.col("size"))).alias("least_feasible_size"))
