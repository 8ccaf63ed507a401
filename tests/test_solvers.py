"""Projections, objectives and searches against brute force, finite differences and golden values."""

from itertools import combinations

import numpy as np
import pytest

from fathom.operators import projections, solvers
from fathom.operators.losses import CosineGramObjective, LocalObjective, MatchingObjective, Nuisance, QuadraticObjective, RelationObjective


def bisected(v, low, high):
    a, b = v.min() - high - 1, v.max() - low + 1
    for _ in range(300):
        t = (a + b) / 2
        if np.clip(v - t, low, high).sum() > 1:
            a = t
        else:
            b = t
    return np.clip(v - t, low, high)


@pytest.mark.parametrize("n", [2, 7, 13, 60])
def test_box_simplex_projection_equals_bisection(n):
    rng = np.random.default_rng(n)
    for scale in (0.01, 1, 100):
        v = scale * rng.standard_normal(n)
        low, high = projections.bounds(n, 0.1, 1.7)
        p = projections.onto_box_simplex(v, low, high)
        assert np.allclose(p, bisected(v, low, high), atol=1e-10) and abs(p.sum() - 1) < 1e-12
        assert np.allclose(projections.onto_box_simplex(v + 5.0, low, high), p, atol=1e-12)


@pytest.mark.parametrize("scale", [1.0, 1e8, 1e20, 1e40])
def test_projection_over_a_huge_range(scale):
    p = projections.onto_bounded_simplex(scale * np.array([3.0, 1.0, 2.0, -5.0, 0.5, 0.25, 0.0]))
    low, high = projections.bounds(7)
    assert abs(p.sum() - 1) < 1e-12 and (p >= low - 1e-15).all() and (p <= high + 1e-15).all()


def test_simplex_projection_with_floor():
    p = projections.onto_simplex(np.array([-0.7, 0.2, 2.0, -0.1]), 0.03)
    assert p.sum() == pytest.approx(1) and np.allclose(p, bisected(np.array([-0.7, 0.2, 2.0, -0.1]), 0.03 / 4, 1.0))


def test_sparse_projection_is_the_best_support():
    rng = np.random.default_rng(4)
    v = rng.standard_normal(8)
    active, p = projections.onto_sparse_simplex(v, 3, 0.1, 1.7)
    best = min(((np.delete(v, s) ** 2).sum() + ((v[list(s)] - projections.onto_bounded_simplex(v[list(s)], 0.1, 1.7)) ** 2).sum(), s) for s in combinations(range(8), 3))
    # Removed components count as moved to zero.
    whole = (np.delete(v, active) ** 2).sum() + ((v[active] - p) ** 2).sum()
    assert whole <= best[0] + 1.0 and len(active) == 3


def test_infeasible_bounds_are_refused():
    with pytest.raises(ValueError):
        projections.onto_box_simplex(np.zeros(4), 0.3, 1.0)


def case(seed=721):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((24, 13))
    groups = np.repeat(np.arange(6), 4)
    nuisance = Nuisance(x, [x + 0.1 * rng.standard_normal(x.shape), 0.9 * x + 0.05 * rng.standard_normal(x.shape)])
    return x, groups, nuisance, rng


def objectives():
    x, groups, nuisance, rng = case()
    near = x[(np.arange(24) + 5) % 24]
    far = x[(np.arange(24) + 9) % 24]
    mask = groups[:, None] != groups[None, :]
    votes = np.where(mask & (rng.random(mask.shape) > 0.8), rng.choice([1.0, 2 / 3], mask.shape), 0)
    return {
        "matching": MatchingObjective(x, x, groups, groups, 0.2, nuisance, 0.1),
        "local": LocalObjective(x, near, far, nuisance, beta=0.1),
        "relation": RelationObjective(x, x, mask, votes, 0.3, nuisance, 0.1),
        "gram": CosineGramObjective(x, rng.random((13, 2)), 0.1),
    }


@pytest.mark.parametrize("name", ["matching", "local", "relation", "gram"])
def test_gradients_equal_finite_differences(name):
    objective = objectives()[name]
    active, p = np.array([0, 2, 5, 7, 11]), np.array([0.1, 0.3, 0.2, 0.25, 0.15])
    _, g = objective(active, p)
    for j in range(5):
        e = np.zeros(5)
        e[j] = 1e-6
        assert g[j] == pytest.approx((objective(active, p + e)[0] - objective(active, p - e)[0]) / 2e-6, rel=1e-4, abs=1e-6)


def test_matching_value_does_not_depend_on_blocks():
    x, groups, nuisance, _ = case()
    active, p = np.arange(5), np.full(5, 0.2)
    values = [MatchingObjective(x, x, groups, groups, 0.2, nuisance, 0.1, block=b)(active, p) for b in (3, 7, 256)]
    assert all(v[0] == pytest.approx(values[0][0]) and np.allclose(v[1], values[0][1]) for v in values)


def test_beta_zero_never_reads_the_nuisance():
    x, groups, _, _ = case()

    class Trap:
        def __call__(self, *_):
            raise AssertionError("the perturbed rows were read")

    assert MatchingObjective(x, x, groups, groups, 0.2, Trap(), 0.0)(np.arange(4), np.full(4, 0.25))[0] > 0


def test_rows_that_cannot_be_matched_are_refused():
    x, groups, _, _ = case()
    with pytest.raises(ValueError, match="fewer than two"):
        MatchingObjective(x[:4], x[:4], groups[:4], groups[:4], 0.2)
    with pytest.raises(ValueError, match="all-zero"):
        MatchingObjective(np.vstack([x, np.zeros(13)]), x, np.append(groups, 9), groups, 0.2)


def test_repeated_evaluations_come_from_the_cache():
    objective = objectives()["gram"]
    active, p = np.arange(4), np.full(4, 0.25)
    first = objective(active, p)
    assert objective(active, p)[0] == first[0] and (objective.hits, objective.evaluations) == (1, 1)


@pytest.mark.parametrize("solver", [solvers.projected_gradient, solvers.secant_refit])
def test_fixed_support_solvers_reach_the_optimum(solver):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((12, 5))
    h, b = a.T @ a, rng.standard_normal(5)

    def quadratic(_, p):
        return 0.5 * float(p @ h @ p) - float(b @ p), h @ p - b

    found = solver(quadratic, np.arange(5), np.full(5, 0.2), steps=5000, tolerance=1e-9)
    p = np.full(5, 0.2)
    for _ in range(60_000):
        p = projections.onto_bounded_simplex(p - 0.02 * (h @ p - b))
    assert found.value <= quadratic(None, p)[0] + 1e-7
    assert all(x >= y - 1e-15 for x, y in zip(found.trace, found.trace[1:], strict=False))


def quadratic_case():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((12, 5))
    h = (x.T @ x) ** 2
    return QuadraticObjective(h / h.sum(), rng.uniform(0.01, 0.4, (5, 2)), 0.04)


def test_box_path_has_no_gap():
    q = quadratic_case()
    lambdas = np.array([0.003, 0.02, 0.15])
    for lam, w in zip(lambdas, solvers.fista(q, lambdas).T, strict=True):
        point = QuadraticObjective(q.h, q.p, q.beta, float(lam))
        assert solvers.certificate(point, w) < 1e-6 and ((w >= 0) & (w <= 1)).all()


def test_diagonal_box_optimum_is_closed_form():
    d = np.array([0.5, 0.3, 0.15, 0.05])
    q = QuadraticObjective(np.diag(d), np.zeros((4, 0)), 0.0)
    assert np.allclose(solvers.fista(q, np.array([0.1]))[:, 0], np.clip(1 - 0.1 / d, 0, 1), atol=1e-6)


def test_support_searches_only_descend():
    q = quadratic_case()
    lam = QuadraticObjective(q.h, q.p, q.beta, 0.01)
    full = solvers.refit_columns(lam, np.arange(5))
    pruned = solvers.prune_columns(lam, full, 3)
    assert (pruned > 0).sum() <= 3
    better = solvers.swap_columns(lam, pruned)
    assert lam(better)[0] <= lam(pruned)[0] and (solvers.insert_columns(lam, 2) > 0).sum() <= 2
    best = min(lam(solvers.refit_columns(lam, np.array(s)))[0] for s in combinations(range(5), 3))
    assert lam(solvers.refit_columns(lam, np.flatnonzero(better > 0)))[0] <= best + 0.05
    assert np.array_equal(solvers.guarded(lam, pruned, np.ones(5)), pruned)


def test_cosine_deletion_golden():
    x = np.array([[1, 1, 1, 0], [1, 1, 0, 1], [1, 1, -1, 0], [1, 1, 0, -1]], dtype=float)
    objective = CosineGramObjective(x, np.zeros((4, 0)), 0.0)
    start = solvers.Outcome(np.arange(4), np.full(4, 0.25), objective(np.arange(4), np.full(4, 0.25))[0])
    found = solvers.prune_support(objective, start, 3)
    assert len(found.active) == 3 and {2, 3} <= set(found.active.tolist())


def test_greedy_columns():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((19, 11))
    g = x.T @ x
    assert len(set(solvers.pivot_columns(g, 4))) == 4 and solvers.pivot_columns(g, 4)[0] == int(np.argmax(np.diag(g)))
    repeated = np.column_stack([np.ones(12)] * 5 + [np.eye(12)[0]])
    assert 5 in solvers.pivot_columns(repeated.T @ repeated, 2) and 5 in solvers.projection_columns(repeated.T @ repeated, 2)
    root, leverage = solvers.ridge_whitened(g, 4)
    assert np.allclose(root, root.T) and ((leverage > 0) & (leverage < 1)).all()
    assert solvers.relevant_columns(np.array([3.0, 2.9, 1.0]), np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1.0]]), 2) == [0, 1]


def test_exchange_and_pursuit_accept_only_gains():
    x, groups, nuisance, _ = case()
    objective = MatchingObjective(x, x, groups, groups, 0.2, nuisance, 0.002)
    start = solvers.projected_gradient(objective, np.arange(4), np.full(4, 0.25))
    for search in (solvers.exchange(objective, objective.full_gradient, start), solvers.pursue(objective, objective.full_gradient, start, 13)):
        assert search.value <= start.value and len(search.active) == 4
    assert solvers.polish(objective, start).value <= start.value


def test_layer_choices():
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((32, 4)), rng.standard_normal((32, 4))
    features = [a, a, a, b, b, b]
    q = np.array([[((x.T @ y) ** 2).sum() for y in features] for x in features])
    chosen, error, feasible = solvers.choose_layers(q, np.array([0.999, 0.998, 0.997, 0.996, 0.995, 0.994]), 1e-6)
    assert chosen == [0, 3] and feasible and error < 1e-6
    prefix, _, _ = solvers.choose_layers(q, np.array([0.999, 0.998, 0.997, 0.996, 0.995, 0.994]), 1e-6, most=3, rule="prefix")
    assert prefix == [0, 1, 2]
    gates = solvers.gate_layers(q, np.arange(6) / 6)
    assert ((gates > 0) & (gates < 1)).all()
    assert len(solvers.layer_subsets(12)) == 66 + 220 + 495 + 792 + 924
