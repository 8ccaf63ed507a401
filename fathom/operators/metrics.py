"""Detection metrics with exact ties, resampled intervals, and pixel metrics from fixed histograms.

Every ranking metric first sums the weights at each distinct score, so the window that follows runs over
distinct scores.  Where a score has very many distinct values, :func:`ranked_sums` accumulates by range
partition instead of in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score histograms of pixel metrics: bins over [0, 2], thresholds, and the largest false positive rate.
BINS, THRESHOLDS, MAX_SCORE, MAX_FPR = 1024, 100, 2.0, 0.3
#: Draws of a bootstrap that one task resamples.
DRAWS_PER_TASK = 32


def by_score(rows: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """``keys, s, pos, neg``: weights of label 1 and label 0 at each distinct score."""
    w = F.lit(1.0) if weight is None else weight
    return rows.groupBy(*keys, "s").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0.0).otherwise(w)).alias("neg"))


#: Score ranges over which running sums are split.
RANGES = 64


def ranked_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """``by_score`` rows with ``neg_below`` (negatives at smaller scores), ``pos_from`` and ``n_from``
    (positives and all at this score or above).

    Scores fall into ranges by a bounded list of quantiles; the ranges' sums are accumulated first, so a
    running window never holds more than one range of one key.
    """
    edges = sums.groupBy(*keys).agg(F.percentile_approx("s", [k / RANGES for k in range(1, RANGES)], 1000).alias("edges"))
    placed = sums.join(edges, keys) if keys else sums.crossJoin(edges)  # one row of edges
    placed = placed.withColumn("range", F.size(F.filter("edges", lambda e: e < F.col("s")))).drop("edges")
    per = placed.groupBy(*keys, "range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    up = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "range", F.coalesce(F.sum("rn").over(up), F.lit(0.0)).alias("n0"), F.coalesce(F.sum("rp").over(down), F.lit(0.0)).alias("p1"), F.coalesce(F.sum("rn").over(down), F.lit(0.0)).alias("n1"))
    inside = Window.partitionBy(*keys, "range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys, "range").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(per, [*keys, "range"]).select(
        *keys,
        "s",
        "pos",
        "neg",
        (F.col("n0") + F.coalesce(F.sum("neg").over(inside), F.lit(0.0))).alias("neg_below"),
        (F.col("p1") + F.sum("pos").over(above)).alias("pos_from"),
        (F.col("p1") + F.col("n1") + F.sum(F.col("pos") + F.col("neg")).over(above)).alias("n_from"),
    )


def places(values: DataFrame) -> DataFrame:
    """``s, below, same, n`` for every distinct value of ``values(s)``: how many rows lie below it, share it, are there.

    Values are numbers that a double holds exactly; no window holds more than a range of them.
    """
    sums = values.groupBy(F.col("s").cast("double").alias("s")).agg(F.count("*").cast("double").alias("pos"), F.lit(0.0).alias("neg"))
    n = values.agg(F.count("*").alias("n"))
    ranked = ranked_sums(sums, []).crossJoin(F.broadcast(n))  # one row
    return ranked.select("s", (F.col("n") - F.col("pos_from")).alias("below"), F.col("pos").alias("same"), "n")


def ranking_metrics(rows: DataFrame, keys: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """``keys, positives, negatives, auroc, ap`` of ``rows(keys, y, s)``; null where one class is missing.

    AUROC counts ties as half.  AP is the step sum over distinct scores, largest first.
    """
    keys = keys or []
    ranked = ranked_sums(by_score(rows.filter("y is not null and s is not null and not isnan(s)"), keys, weight), keys)
    out = ranked.groupBy(*keys).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("wins"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("pos_from") / F.col("n_from")).otherwise(0.0)).alias("steps"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return out.select(
        *keys,
        "positives",
        "negatives",
        F.when(both, F.col("wins") / (F.col("positives") * F.col("negatives"))).alias("auroc"),
        F.when(both, F.col("steps") / F.col("positives")).alias("ap"),
    )


class Ranking:
    """Weighted AUROC and AP of fixed labels and scores for many weight vectors at once."""

    def __init__(self, labels: np.ndarray, scores: np.ndarray):
        labels, scores = np.asarray(labels), np.asarray(scores, dtype=np.float64)
        if labels.shape != scores.shape or not np.isfinite(scores).all():
            raise ValueError("labels and scores must be aligned and finite")
        if not np.isin(labels, (0, 1)).all():
            raise ValueError("labels must be binary")
        self.order = np.argsort(-scores, kind="stable")
        ranked = scores[self.order]
        self.ends = np.flatnonzero(np.append(ranked[1:] != ranked[:-1], True)) if len(ranked) else np.zeros(0, dtype=int)
        self.positive = labels[self.order] == 1

    def metrics(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """AUROC and AP for each row of ``weights`` (rows x documents); nan where a class has no weight."""
        w = np.atleast_2d(weights)[:, self.order].astype(np.float64)
        tp = np.cumsum(w * self.positive, axis=1)[:, self.ends]
        fp = np.cumsum(w * ~self.positive, axis=1)[:, self.ends]
        pos = np.diff(tp, axis=1, prepend=0)
        neg = np.diff(fp, axis=1, prepend=0)
        p, n = tp[:, -1:], fp[:, -1:]
        with np.errstate(invalid="ignore", divide="ignore"):
            auroc = (pos * (n - fp + 0.5 * neg)).sum(1) / (p * n)[:, 0]
            precision = np.where(tp + fp > 0, tp / (tp + fp), 0.0)
            ap = (pos * precision).sum(1) / p[:, 0]
        missing = ((p <= 0) | (n <= 0))[:, 0]
        return np.where(missing, np.nan, auroc), np.where(missing, np.nan, ap)


def bootstrap_interval(labels: np.ndarray, scores: np.ndarray, draws: int = 1000, seed: int = 42, batch: int = 32, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the AUROC over resamples of all rows; draws with one class are skipped."""
    ranking, rng = Ranking(labels, scores), np.random.default_rng(seed)
    n, found = len(labels), []
    for first in range(0, draws, batch):
        drawn = rng.integers(0, n, size=(min(batch, draws - first), n))
        counts = np.stack([np.bincount(row, minlength=n) for row in drawn])
        found.append(ranking.metrics(counts)[0])
    values = np.concatenate(found) if found else np.zeros(0)
    values = values[np.isfinite(values)]
    if not len(values):
        return float("nan"), float("nan")
    tail = 50 * (1 - level)
    return tuple(np.percentile(values, [tail, 100 - tail]).tolist())


def bootstrap_draws(spark, labels: np.ndarray, scores: dict[str, np.ndarray], families: dict[str, list[str]], draws: int = 2000, seed: int = 42) -> DataFrame:
    """``draw, family, auroc, ap`` under label-stratified multinomial weights.

    Every family sees the same weights in a draw, and a family's value is the mean over its members, so
    differences between families are paired.  Draws are spread over tasks; each has its own stream.
    """
    labels = np.asarray(labels)
    held = spark.sparkContext.broadcast((labels, {m: Ranking(labels, s) for m, s in scores.items()}, families))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, rankings, groups = held.value
        for frame in frames:
            for draw in frame["id"].tolist():
                rng = np.random.default_rng([seed, draw])
                w = np.zeros(len(y))
                for value in (0, 1):
                    at = np.flatnonzero(y == value)
                    if len(at):
                        w[at] = rng.multinomial(len(at), np.full(len(at), 1 / len(at)))
                values = {m: r.metrics(w) for m, r in rankings.items()}
                rows = [(draw, f, float(np.mean([values[m][0][0] for m in ms])), float(np.mean([values[m][1][0] for m in ms]))) for f, ms in groups.items()]
                yield pd.DataFrame(rows, columns=["draw", "family", "auroc", "ap"])

    return spark.range(0, draws, 1, -(-draws // DRAWS_PER_TASK)).mapInPandas(run, "draw long, family string, auroc double, ap double")


def paired_intervals(drawn: DataFrame, target: str) -> DataFrame:
    """``family, auroc_low, auroc_high, ap_low, ap_high``: the target minus each other family."""
    main = drawn.filter(F.col("family") == target).select("draw", F.col("auroc").alias("a"), F.col("ap").alias("p"))
    delta = drawn.filter(F.col("family") != target).join(main, "draw").select("family", (F.col("a") - F.col("auroc")).alias("da"), (F.col("p") - F.col("ap")).alias("dp"))
    return delta.groupBy("family").agg(*(F.percentile(c, F.lit(q)).alias(f"{n}_{e}") for c, n in (("da", "auroc"), ("dp", "ap")) for q, e in ((0.025, "low"), (0.975, "high"))))


# --- pixel metrics


def pixel_histogram(pixels: DataFrame, keys: list[str] | None = None, bins: int = BINS, top: float = MAX_SCORE) -> DataFrame:
    """``keys, bin, pos, neg`` of ``pixels(keys, y, s)``; scores are clipped to the histogram."""
    keys = keys or []
    s = F.least(F.greatest(F.col("s"), F.lit(0.0)), F.lit(top - 1e-7))
    place = F.least(F.floor(s * F.lit(bins / top)), F.lit(bins - 1)).cast("int")
    return pixels.groupBy(*keys, place.alias("bin")).agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg"))


def histogram_metrics(histogram: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, pixel_auroc, pixel_ap`` of a pixel histogram (trapezoids, and steps from the top)."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(F.desc("bin"))  # at most BINS rows a key
    tot = Window.partitionBy(*keys)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = histogram.select(*keys, "bin", F.col("pos").cast("double").alias("pos"), F.col("neg").cast("double").alias("neg"))
    rows = rows.select("*", F.sum("pos").over(run).alias("tp"), F.sum("neg").over(run).alias("fp"), F.sum("pos").over(tot).alias("p"), F.sum("neg").over(tot).alias("n"))
    ok = (F.max("p") > 0) & (F.max("n") > 0)
    return rows.groupBy(*keys).agg(
        F.when(ok, F.sum(F.col("neg") * (F.col("tp") - 0.5 * F.col("pos"))) / F.max(F.col("p") * F.col("n"))).alias("pixel_auroc"),
        F.when(ok, F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)) / F.max("p")).alias("pixel_ap"),
    )


def label_regions(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected regions of a boolean mask, numbered from 1 in row order, and their number."""
    mask = np.asarray(mask, dtype=bool)
    number = np.arange(1, mask.size + 1).reshape(mask.shape) * mask
    while True:
        low = np.where(mask, number, mask.size + 1)
        wide = np.pad(low, 1, constant_values=mask.size + 1)
        best = np.minimum.reduce([low, wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])
        best = np.where(mask, best, 0)
        # Follow each cell's pointer as well, so a winding region needs few rounds.
        flat = np.concatenate(([0], best.ravel()))
        best = np.where(mask, flat[best], 0)
        if np.array_equal(best, number):
            break
        number = best
    kept, out = np.unique(number[mask], return_inverse=True)
    result = np.zeros(mask.shape, dtype=np.int64)
    result[mask] = out + 1
    return result, len(kept)


def overlap_curve(pixels: DataFrame, keys: list[str] | None = None, thresholds: int = THRESHOLDS, top: float = MAX_SCORE) -> DataFrame:
    """``keys, step, fpr, pro`` of ``pixels(keys, image_id, region, s)``; region 0 is background.

    At each threshold: the share of background at or above it, and the mean share of a region at or
    above it.  A pixel is counted once, at the first threshold that it reaches; the rest are running sums.
    """
    keys = keys or []
    at = F.lit(top) - F.col("step") * F.lit(top / (thresholds - 1))
    steps = F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1))).alias("step")
    grid = pixels.sparkSession.range(1).select(steps).withColumn("threshold", at)
    s = F.least(F.greatest(F.col("s"), F.lit(0.0)), F.lit(top - 1e-7))
    first = F.ceil((F.lit(top) - s) * F.lit((thresholds - 1) / top) - F.lit(1e-9)).cast("int")
    counted = pixels.select(*keys, "image_id", "region", first.alias("step")).groupBy(*keys, "image_id", "region", "step").agg(F.count("*").alias("c"))
    size = counted.groupBy(*keys, "image_id", "region").agg(F.sum("c").alias("size"))
    share = counted.join(size, [*keys, "image_id", "region"])
    background = share.filter("region = 0").groupBy(*keys, "step").agg(F.sum("c").cast("double").alias("fp"), F.lit(0.0).alias("overlap"))
    regions = share.filter("region > 0").groupBy(*keys, "step").agg(F.lit(0.0).alias("fp"), F.sum(F.col("c") / F.col("size")).alias("overlap"))
    totals = size.groupBy(*keys).agg(F.sum(F.when(F.col("region") == 0, F.col("size"))).cast("double").alias("all_fp"), F.sum((F.col("region") > 0).cast("int")).cast("double").alias("all_regions"))
    moved = background.unionByName(regions).groupBy(*keys, "step").agg(F.sum("fp").alias("fp"), F.sum("overlap").alias("overlap"))
    full = (totals.select(*keys).crossJoin(grid.select("step"))).join(moved, [*keys, "step"], "left").fillna(0.0, ["fp", "overlap"])
    run = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    full = full.select(*keys, "step", F.sum("fp").over(run).alias("fp"), F.sum("overlap").over(run).alias("overlap"))
    joined = full.join(totals, keys) if keys else full.crossJoin(totals)
    return joined.select(*keys, "step", (F.col("fp") / F.col("all_fp")).alias("fpr"), (F.col("overlap") / F.col("all_regions")).alias("pro"))


def area_under_overlap(curve: DataFrame, keys: list[str] | None = None, limit: float = MAX_FPR) -> DataFrame:
    """``keys, aupro``: area under the overlap curve up to ``limit``, over ``limit``.

    The best overlap counts at each distinct rate, the curve is cut at the limit by interpolation.
    """
    keys = keys or []
    best = curve.filter("fpr is not null and pro is not null").groupBy(*keys, "fpr").agg(F.max("pro").alias("pro"))
    w = Window.partitionBy(*keys).orderBy("fpr")
    pieces = best.select(*keys, "fpr", "pro", F.lag("fpr").over(w).alias("x0"), F.lag("pro").over(w).alias("y0"))
    end = F.least(F.col("fpr"), F.lit(limit))
    height = F.col("y0") + (F.col("pro") - F.col("y0")) * (end - F.col("x0")) / (F.col("fpr") - F.col("x0"))
    area = F.when(F.col("x0") < limit, (end - F.col("x0")) * (F.col("y0") + height) / 2)
    return pieces.groupBy(*keys).agg((F.sum(area) / F.lit(limit)).alias("aupro"))


class PixelTotals:
    """Mergeable pixel state: histograms of both classes, background counts and overlap sums."""

    def __init__(self, bins: int = BINS, thresholds: int = THRESHOLDS, top: float = MAX_SCORE, limit: float = MAX_FPR):
        self.bins, self.top, self.limit = bins, top, limit
        self.thresholds = np.linspace(top, 0, thresholds)
        self.pos, self.neg = np.zeros(bins, dtype=np.int64), np.zeros(bins, dtype=np.int64)
        self.fp, self.pro = np.zeros(thresholds), np.zeros(thresholds)
        self.background = self.regions = 0

    def add(self, mask: np.ndarray, score: np.ndarray) -> PixelTotals:
        s = np.clip(np.asarray(score, dtype=np.float64), 0, self.top - 1e-7).ravel()
        labels, count = label_regions(mask)
        labels = labels.ravel()
        place = np.minimum((s * self.bins / self.top).astype(np.int64), self.bins - 1)
        self.pos += np.bincount(place[labels > 0], minlength=self.bins)
        self.neg += np.bincount(place[labels == 0], minlength=self.bins)

        def at_least(values):
            ordered = np.sort(values)
            return len(ordered) - np.searchsorted(ordered, self.thresholds, side="left")

        self.fp += at_least(s[labels == 0])
        self.background += int((labels == 0).sum())
        for region in range(1, count + 1):
            inside = s[labels == region]
            self.pro += at_least(inside) / len(inside)
        self.regions += count
        return self

    def merge(self, other: PixelTotals) -> PixelTotals:
        for name in ("pos", "neg", "fp", "pro", "background", "regions"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        return self

    def metrics(self) -> dict[str, float]:
        p, n = self.pos.sum(), self.neg.sum()
        out = dict.fromkeys(("pixel_auroc", "pixel_ap", "aupro"), float("nan"))
        if p and n:
            tp, fp = np.cumsum(self.pos[::-1]), np.cumsum(self.neg[::-1])
            out["pixel_auroc"] = float(np.trapezoid(np.append(0, tp) / p, np.append(0, fp) / n))
            seen = np.maximum(tp + fp, 1)
            out["pixel_ap"] = float((self.pos[::-1] * tp / seen).sum() / p)
        if self.regions and self.background:
            rate, best = np.unique(self.fp / self.background, return_inverse=True)
            overlap = np.zeros(len(rate))
            np.maximum.at(overlap, best, self.pro / self.regions)
            if rate[-1] >= self.limit:
                inside = rate <= self.limit
                x = np.append(rate[inside], self.limit)
                y = np.append(overlap[inside], np.interp(self.limit, rate, overlap))
                out["aupro"] = float(np.trapezoid(y, x) / self.limit)
        return out


def bilinear_matrix(source: int, target: int) -> np.ndarray:
    """Rows of weights that resample ``source`` cells to ``target`` (pixel centres, clamped ends)."""
    at = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, None)
    low = np.minimum(at.astype(int), source - 1)
    high, part = np.minimum(low + 1, source - 1), at - low
    out = np.zeros((target, source))
    np.add.at(out, (np.arange(target), low), 1 - part)
    np.add.at(out, (np.arange(target), high), part)
    return out


def upsample(grid: np.ndarray, target: int) -> np.ndarray:
    a = bilinear_matrix(grid.shape[0], target)
    return a @ grid @ bilinear_matrix(grid.shape[1], target).T
