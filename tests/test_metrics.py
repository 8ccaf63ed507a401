"""Metrics against naive counts, closed forms and golden values."""

import numpy as np
import pytest

from fathom.operators import metrics


def naive(labels, scores, weights=None):
    w = np.ones(len(labels)) if weights is None else np.asarray(weights, dtype=float)
    labels, scores = np.asarray(labels), np.asarray(scores)
    pos, neg = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    wins = sum(w[i] * w[j] * ((scores[i] > scores[j]) + 0.5 * (scores[i] == scores[j])) for i in pos for j in neg)
    ap = 0.0
    for s in sorted(set(scores), reverse=True):
        tp, n = w[(scores >= s) & (labels == 1)].sum(), w[scores >= s].sum()
        ap += w[(scores == s) & (labels == 1)].sum() * tp / n
    return wins / (w[pos].sum() * w[neg].sum()), ap / w[pos].sum()


def test_ranking_metrics_equal_pair_counts(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(y), float(s)) for g, y, s in zip(rng.integers(0, 3, 600), rng.integers(0, 2, 600), rng.integers(0, 20, 600), strict=True)]
    rows += [(9, 1, 1.0), (9, 1, 2.0)]
    got = {r["g"]: r for r in metrics.ranking_metrics(spark.createDataFrame(rows, "g int, y int, s double"), ["g"]).collect()}
    for g in range(3):
        own = [(y, s) for k, y, s in rows if k == g]
        auroc, ap = naive(*zip(*own, strict=True))
        assert got[g]["auroc"] == pytest.approx(auroc, abs=1e-12) and got[g]["ap"] == pytest.approx(ap, abs=1e-12)
    assert got[9]["auroc"] is None and got[9]["ap"] is None


def test_weighted_ranking_golden():
    labels, scores = [0, 1, 0, 1, 0, 1], [0.3, 0.3, 0.5, 0.7, 0.1, 0.5]
    weights = np.array([[1, 1, 1, 1, 1, 1], [2, 1, 3, 2, 1, 4]])
    auroc, ap = metrics.Ranking(labels, scores).metrics(weights)
    for k in range(2):
        want = naive(labels, scores, weights[k])
        assert auroc[k] == pytest.approx(want[0]) and ap[k] == pytest.approx(want[1])


@pytest.mark.parametrize("labels, scores", [([0, 2], [0.1, 0.2]), ([0, 1], [0.1, float("nan")]), ([0], [0.1, 0.2])])
def test_ranking_refuses_bad_input(labels, scores):
    with pytest.raises(ValueError):
        metrics.Ranking(np.array(labels), np.array(scores))


def test_bootstrap_degenerate_cases():
    assert metrics.bootstrap_interval(np.array([0, 1]), np.array([0.7, 0.3]), 200) == (0.0, 0.0)
    assert all(np.isnan(metrics.bootstrap_interval(np.array([0, 1]), np.array([0.7, 0.3]), 0)))
    assert all(np.isnan(metrics.bootstrap_interval(np.array([1, 1]), np.array([0.7, 0.3]), 50)))
    assert metrics.bootstrap_interval(np.array([0, 1, 0, 1]), np.ones(4), 50) == (0.5, 0.5)


def test_paired_bootstrap_golden(spark):
    labels = np.array([0, 0, 1, 1])
    main = np.array([0.0, 0.2, 0.8, 1.0])
    drawn = metrics.bootstrap_draws(spark, labels, {"main": main, "same": main, "bad": -main}, {"main": ["main"], "same": ["same"], "half": ["same", "bad"]}, draws=70)
    got = {r["family"]: r for r in metrics.paired_intervals(drawn, "main").collect()}
    assert (got["same"]["auroc_low"], got["same"]["auroc_high"]) == (0.0, 0.0)
    assert (got["half"]["auroc_low"], got["half"]["auroc_high"]) == (0.5, 0.5)


def test_area_under_overlap_golden(spark):
    curve = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.5, 0.5), (2, 1.0, 1.0)], "step int, fpr double, pro double")
    assert metrics.area_under_overlap(curve).first()["aupro"] == pytest.approx(0.15)


def test_perfect_pixels_score_one(spark):
    mask = np.zeros((16, 16), dtype=bool)
    mask[4:8, 4:8] = True
    whole = metrics.PixelTotals(64, 20).add(mask, mask.astype(float)).metrics()
    assert whole == pytest.approx({"pixel_auroc": 1.0, "pixel_ap": 1.0, "aupro": 1.0})
    labels, count = metrics.label_regions(mask)
    pixels = spark.createDataFrame([(0, int(r), float(s)) for r, s in zip(labels.ravel(), mask.ravel(), strict=True)], "image_id int, region int, s double")
    assert count == 1 and metrics.area_under_overlap(metrics.overlap_curve(pixels, thresholds=20)).first()["aupro"] == pytest.approx(1.0)


def test_pixel_totals_merge_in_any_split():
    rng = np.random.default_rng(2)
    images = [(rng.random((12, 12)) > 0.7, rng.random((12, 12)) * 2) for _ in range(6)]
    one = metrics.PixelTotals(128, 25)
    for m, s in images:
        one.add(m, s)
    parts = [metrics.PixelTotals(128, 25), metrics.PixelTotals(128, 25)]
    for k, (m, s) in enumerate(images):
        parts[k % 2].add(m, s)
    assert parts[0].merge(parts[1]).metrics() == pytest.approx(one.metrics())


def test_regions_are_four_connected():
    mask = np.array([[1, 1, 0, 0], [0, 1, 0, 1], [1, 0, 1, 1], [1, 1, 0, 0]], dtype=bool)
    labels, count = metrics.label_regions(mask)
    assert count == 3 and labels[0, 0] == labels[1, 1] and labels[1, 3] == labels[2, 2] and labels[2, 0] == labels[3, 1]
    snake = np.zeros((40, 40), dtype=bool)
    snake[::2] = True
    for k in range(1, 40, 2):
        snake[k, -1 if k % 4 == 1 else 0] = True
    assert metrics.label_regions(snake)[1] == 1


def test_upsampling_keeps_constants_and_means():
    grid = np.random.default_rng(3).random((7, 7))
    assert np.allclose(metrics.upsample(np.full((7, 7), 3.0), 20), 3.0)
    assert np.isclose(metrics.upsample(grid, 21).mean(), grid.mean())
