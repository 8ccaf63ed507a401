"""Fits and per-query loss terms against the objectives they stand for, on small feature tables."""

import numpy as np
import pytest

from fathom.operators import losses, neighbours, statistics
from fathom.plans import fitting


@pytest.fixture(scope="module")
def features():
    rng = np.random.default_rng(721)
    base = rng.standard_normal((40, 12)) + 1.5
    return base[np.arange(120) // 3] + 0.3 * rng.standard_normal((120, 12))


@pytest.fixture(scope="module")
def rows(spark, features):
    roles = ["fit"] * 75 + ["holdout"] * 30 + ["test"] * 15
    data = [(k, k // 3, roles[k], int(k % 40 == 39), features[k].tolist()) for k in range(120)]
    return spark.createDataFrame(data, "vec_id long, image_id long, role string, y int, v array<double>").repartition(3)


def sides(rows, features):
    keep = [k for k in range(120) if k % 40 != 39]
    fit, held = ([k for k in keep if a <= k < b] for a, b in ((0, 75), (75, 105)))
    frames = [rows.filter(f"role = '{r}' and y = 0") for r in ("fit", "holdout")]
    return (features[fit], np.array(fit) // 3, frames[0]), (features[held], np.array(held) // 3, frames[1])


SUPPORT, WEIGHTS = np.array([0, 3, 5, 8]), np.array([0.4, 0.3, 0.2, 0.1])


def test_matching_terms_add_up_to_the_objective(rows, features):
    (x, groups, fit), (held, held_groups, holdout) = sides(rows, features)
    objective = losses.MatchingObjective(held, x, held_groups, groups, 0.1, None, 0.0)
    parts = objective.terms(SUPPORT, WEIGHTS)[2]
    got = losses.matching_terms(holdout, fit, SUPPORT, WEIGHTS, 0.1).orderBy("query_id").toPandas()
    divergence = (objective.weights * (got["entropy"] - got["cross"])).mean() / objective.divergence_scale
    score = (objective.weights * (got["best_student"] - got["best_teacher"]) ** 2).mean() / objective.score_scale
    assert divergence == pytest.approx(parts["divergence"]) and score == pytest.approx(parts["score"])


def test_relation_terms_are_the_objective_of_each_query(rows, features):
    (x, groups, fit), (held, held_groups, holdout) = sides(rows, features)
    t = losses.weighted_cosine(held, x, np.ones(12))
    mask = held_groups[:, None] != groups[None, :]
    order = np.argsort(-np.where(mask, t, -np.inf), axis=1, kind="stable")
    votes = np.zeros_like(t)
    np.put_along_axis(votes, order[:, :4], 0.5, axis=1)
    np.put_along_axis(votes, order[:, :2], 1.0, axis=1)
    want = losses.RelationObjective(held, x, mask, votes, 0.1, None, 0.0)(SUPPORT, WEIGHTS)[0]
    got = losses.relation_terms(holdout, fit, SUPPORT, WEIGHTS, 0.1, 2, 4).agg({"loss": "avg"}).first()[0]
    assert got == pytest.approx(want)


def test_local_terms_and_gram_loss_equal_their_objectives(rows, features):
    (x, _, fit), (held, _, holdout) = sides(rows, features)
    edges = neighbours.near_far(holdout, fit, 5)
    edges = edges.join(statistics.query_weights(edges.selectExpr("query_id", "1 - near_cosine as distance")), "query_id")
    local = edges.orderBy("query_id").toPandas()
    objective = losses.LocalObjective(features[local["query_id"]], features[local["near_id"]], features[local["far_id"]], None, 1.0, 0.0)
    got = losses.local_terms(edges, rows, SUPPORT, WEIGHTS, objective.scale).first()
    assert got["representation"] + got["rank"] == pytest.approx(objective(SUPPORT, WEIGHTS)[0])
    want = losses.CosineGramObjective(held, np.zeros((12, 0)), 0.0)(SUPPORT, WEIGHTS)[0]
    assert losses.gram_loss(holdout, SUPPORT, WEIGHTS) == pytest.approx(want)


def test_memory_is_bounded_and_needs_two_references(rows, features):
    _, (_, _, holdout) = sides(rows, features)
    fit = rows.filter("role = 'fit' and y = 0")
    assert losses.against_memory(holdout, fit, lambda i, g, x, m: __import__("pandas").DataFrame({"n": [len(m[0])]}), "n long", 10).first()["n"] == 10
    with pytest.raises(ValueError):
        losses.against_memory(holdout, fit.filter("false"), None, "n long")


def test_local_support_descends_and_is_chosen_by_the_holdout(rows):
    fit = fitting.fit_local_support(rows, count=4, rank=5)
    assert len(fit.active) == 4 and fit.weights.sum() == pytest.approx(1) and len(fit.pool) == 9
    for k in range(0, 9, 3):
        uniform, refit, exchanged = (c["loss"] for c in fit.pool[k : k + 3])
        assert exchanged <= refit + 1e-12 <= uniform + 2e-12
    assert fit.chosen in range(9) and np.array_equal(fit.active, fit.pool[fit.chosen]["active"])
    with pytest.raises(ValueError):
        fitting.fit_local_support(rows, count=0)


def test_fits_go_beyond_the_rows_that_the_driver_holds(rows, monkeypatch):
    monkeypatch.setattr(fitting, "FIT_ROWS", 20)
    monkeypatch.setattr(fitting.local_rows, "__defaults__", (20,))
    for fit in (fitting.fit_support(rows, count=4, steps=10), fitting.fit_local_support(rows, count=4, rank=3, rounds=1)):
        assert len(fit.active) == 4 and fit.weights.sum() == pytest.approx(1)


def test_edge_leverage_equals_its_definition(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 2.0]), (2, [1.0, 5.0])], "vec_id long, v array<double>")
    edges = spark.createDataFrame([(0, 1, 2, 2.0), (1, 0, 2, 1.0)], "query_id long, near_id long, far_id long, weight double")
    got = [tuple(r) for r in statistics.edge_leverage(rows, edges).orderBy("place").collect()]
    assert got == [(1, pytest.approx((2 * 9 / 2 + 9 / 2) / 2), 1), (0, pytest.approx((2 * 1 / 2 + 2 / 2) / 2), 2)]


def brute_tail(rows, features, found, top, tail):
    """The table of :func:`fitting.choose_normal_tail` in plain numpy."""
    (x, groups, fit), (held, held_groups, _) = sides(rows, features)
    tau = neighbours.temperature(fit).first()["temperature"]
    objective = losses.MatchingObjective(held, x, held_groups, groups, tau, None, 0.0)
    every = np.ones(x.shape[1])

    def image_scores(distance, own):
        take = lambda d: np.sort(d)[::-1][: max(1, int(np.ceil(len(d) * top)))].mean()
        return np.array([take(distance[own == g]) for g in np.unique(own)])

    c = np.where(groups[:, None] != groups, losses.weighted_cosine(x, x, every), -np.inf)
    scale = max(float((image_scores(1 - c.max(1), groups) ** 2).mean()), 1e-4)
    dense = image_scores(1 - losses.weighted_cosine(held, x, every).max(1), held_groups)
    out = []
    for cand in found.pool:
        s = image_scores(1 - losses.weighted_cosine(held[:, cand["active"]], x[:, cand["active"]], cand["weights"]).max(1), held_groups)
        error = np.sort((s - dense) ** 2 / scale)[::-1]
        mass = tail * len(error)
        weight = np.clip(mass - np.arange(len(error)), 0, 1)
        out.append((cand["id"], objective(cand["active"], cand["weights"])[0] + found.beta * cand["nuisance"], error.mean(), (weight * error).sum() / mass))
    return out


def test_the_tail_choice_equals_plain_numpy(rows, features):
    found = fitting.fit_support(rows, count=4, steps=20, rounds=0, contrasts=True)
    winner, table = fitting.choose_normal_tail(rows, found, 0.5, 0.25, 1.0)
    got, want = [tuple(r) for r in table.orderBy("id").collect()], brute_tail(rows, features, found, 0.5, 0.25)
    assert [g[0] for g in got] == [w[0] for w in want]
    np.testing.assert_allclose([g[1:] for g in got], [w[1:] for w in want], rtol=1e-7, atol=1e-10)
    base = want[found.chosen]
    assert winner == found.chosen or (want[winner][3] < base[3] and want[winner][2] <= base[2])
    found.pool[0]["loss"] += 1
    with pytest.raises(ValueError, match="frozen"):
        fitting.choose_normal_tail(rows, found)


def test_contrast_starts_are_supports(features):
    groups = np.arange(120) // 3
    found = fitting.contrast_starts(features, groups, np.zeros(12), 4)
    assert 1 <= len(found) <= 2 and all(len(set(a.tolist())) == 4 for a in found)  # without nuisance the last two are one
    with pytest.raises(ValueError):
        fitting.contrast_starts(features, np.zeros(120), np.zeros(12), 4)


def test_relation_fit_beats_its_starts_and_is_frozen(rows):
    found = fitting.fit_relation_support(rows, count=4, beta=0.0, k=4, subsets=4, votes=2, rounds=1)
    assert len(found.active) == 4 and found.weights.sum() == pytest.approx(1)
    assert found.digest == fitting.frozen(found.pool)
    assert [c["loss"] for c in found.pool] == sorted(c["loss"] for c in found.pool)


def test_cosine_path_falls_in_size_and_takes_the_fewest_columns(rows):
    fit = rows.filter("role = 'fit' and y = 0")
    best, path = fitting.fit_cosine_path(fit, np.zeros((12, 0)), [12, 8, 4], tolerance=0.2, rounds=1, first=np.arange(12.0))
    assert [p["size"] for p in path] == [12, 8, 4] * 2 and all(len(p["active"]) == p["size"] for p in path)
    assert path[0]["error"] < 0.2
    assert best["feasible"] and best["size"] == min(p["size"] for p in path if p["feasible"])
    none, _ = fitting.fit_cosine_path(fit, np.zeros((12, 0)), [2, 1], tolerance=0.0, rounds=0)
    assert not none["feasible"]
