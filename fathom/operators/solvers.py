"""Solvers over small sufficient statistics: box and simplex minimisers, and support searches.

Everything here runs on the driver over at most a few hundred columns; the statistics come from Spark.
Every search accepts only strict improvements, so its steps descend.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

from fathom.operators.losses import QuadraticObjective
from fathom.operators.projections import first_breakpoint, onto_bounded_simplex, onto_sparse_simplex

Objective = Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]]
Project = Callable[[np.ndarray], np.ndarray]


@dataclass
class Outcome:
    active: np.ndarray
    weights: np.ndarray
    value: float
    iterations: int = 0
    reason: str = ""
    trace: list[float] = field(default_factory=list)


def projected_gradient(objective: Objective, active, start, project: Project = onto_bounded_simplex, steps: int = 150, tolerance: float = 1e-5, halvings: int = 18, spectral: bool = True) -> Outcome:
    """Projected gradient with sufficient decrease; ``spectral`` sets the trial step from the last change
    (Barzilai and Borwein), otherwise every iteration starts from step one."""
    p = project(np.asarray(start, dtype=np.float64))
    value, g = objective(active, p)
    step, trace, reason, done = 1.0, [value], "iteration limit", 0
    for done in range(1, steps + 1):
        if np.abs(project(p - g) - p).max() <= tolerance:
            reason = "stationary"
            break
        if not spectral:
            step = 1.0
        for _ in range(halvings + 1):
            q = project(p - step * g)
            moved = q - p
            new, h = objective(active, q)
            if new <= value + 1e-4 * float(g @ moved):
                break
            step /= 2
        else:
            reason = "no decrease"
            break
        if not moved.any():
            reason = "no movement"
            break
        change = h - g
        curved = float(moved @ change)
        p, g, value = q, h, new
        trace.append(value)
        if spectral:
            step = float(np.clip(float(moved @ moved) / curved, 1e-7, 10.0)) if curved > 0 else 10.0
    return Outcome(np.asarray(active), p, value, done, reason, trace)


def secant_refit(objective: Objective, active, start, project: Project = onto_bounded_simplex, steps: int = 3000, tolerance: float = 1e-10, memory: int = 12) -> Outcome:
    """Feasible limited-memory secant method on a fixed support.

    The two-loop recursion proposes a direction on the coordinates that are not held at a bound; the
    projected step must decrease enough, otherwise the plain gradient is tried.  The reason for stopping is
    reported as it is.
    """
    p = project(np.asarray(start, dtype=np.float64))
    value, g = objective(active, p)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    trace, reason, done = [value], "iteration limit", 0

    def direction(grad):
        q, coefficients = grad.copy(), []
        for s, y in reversed(pairs):
            a = float(s @ q) / float(s @ y)
            coefficients.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(pairs, reversed(coefficients), strict=True):
            q += s * (a - float(y @ q) / float(s @ y))
        return q

    for done in range(1, steps + 1):
        residual = project(p - g) - p
        if np.abs(residual).max() <= tolerance:
            reason = "stationary"
            break
        held = residual == 0
        accepted = False
        for use_pairs in (True, False) if pairs else (False,):
            centred = np.where(held, 0.0, g)
            free = ~held
            centred[free] -= centred[free].mean() if free.any() else 0.0
            d = direction(centred) if use_pairs else g
            step = 1.0
            for _ in range(30):
                q = project(p - step * d)
                moved = q - p
                slope = float(g @ moved)
                if slope < 0:
                    new, h = objective(active, q)
                    if new <= value + 1e-4 * slope:
                        accepted = True
                        break
                step /= 2
            if accepted:
                break
            pairs.clear()
        if not accepted:
            reason = "no decrease"
            break
        change = h - g
        if float(moved @ change) > 1e-14 * float(moved @ moved):
            pairs = [*pairs, (moved, change)][-memory:]
        stalled = value - new <= 1e-16 * max(1.0, abs(value))
        p, g, value = q, h, new
        trace.append(value)
        if stalled:
            reason = "stalled"
            break
    return Outcome(np.asarray(active), p, value, done, reason, trace)


def polish(objective: Objective, found: Outcome, project: Project = onto_bounded_simplex) -> Outcome:
    """A secant refit, kept only if it is strictly better."""
    new = secant_refit(objective, found.active, found.weights, project)
    return new if new.value < found.value else found


def fista(quadratic: QuadraticObjective, lambdas: np.ndarray, steps: int = 5000, tolerance: float = 1e-7) -> np.ndarray:
    """Box minimisers for all ``lambdas`` at once, as columns, by accelerated projected gradient.

    The step comes from a guaranteed bound on the curvature (a norm of the matrix); momentum restarts for
    each column on its own when it points uphill.
    """
    a = quadratic.curvature()
    bound = min(float(np.abs(a).sum(1).max()), float(np.linalg.norm(a)))
    target = quadratic.h.sum(1)
    w = np.ones((len(a), len(lambdas)))
    y, t = w.copy(), np.ones(len(lambdas))
    for _ in range(steps):
        grad = a @ y - target[:, None] + lambdas[None, :]
        new = np.clip(y - grad / bound, 0, 1)
        uphill = ((y - new) * (new - w)).sum(0) > 0
        t = np.where(uphill, 1.0, t)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.where(uphill, new, new + ((t - 1) / t_new) * (new - w))
        change = np.abs(new - w).max()
        w, t = new, t_new
        if change < tolerance and np.abs(w - np.clip(w - (a @ w - target[:, None] + lambdas), 0, 1)).max() < tolerance * 10:
            break
    return w


def certificate(quadratic: QuadraticObjective, w: np.ndarray) -> float:
    return quadratic.gap(w)


# --- greedy column choices on a Gram matrix


def pivot_columns(g: np.ndarray, k: int) -> list[int]:
    """Pivoted Cholesky: the column with the most remaining energy each time, as column-pivoted QR chooses.

    When nothing remains, the columns of the most original energy fill up.
    """
    rest, energy, chosen = g.astype(np.float64).copy(), np.diag(g).copy(), []
    floor = 1e-12 * max(float(energy.max(initial=0.0)), 1e-300)
    while len(chosen) < k:
        left = np.diag(rest).copy()
        left[chosen] = -np.inf
        j = int(np.argmax(left))
        if left[j] <= floor:
            break
        chosen.append(j)
        rest -= np.outer(rest[:, j], rest[j]) / rest[j, j]
    others = [int(j) for j in np.argsort(-energy, kind="stable") if j not in chosen]
    return chosen + others[: k - len(chosen)]


def projection_columns(g: np.ndarray, k: int) -> list[int]:
    """Each time the column that explains the most of all: the largest ``Σ_i g_ij² / g_jj`` of what remains."""
    rest, chosen = g.astype(np.float64).copy(), []
    floor = 1e-12 * max(float(np.diag(g).max(initial=0.0)), 1e-300)
    while len(chosen) < k:
        diagonal = np.diag(rest).copy()
        score = np.where(diagonal > floor, (rest * rest).sum(0) / np.where(diagonal > floor, diagonal, 1), -np.inf)
        score[chosen] = -np.inf
        j = int(np.argmax(score))
        if not np.isfinite(score[j]):
            break
        chosen.append(j)
        rest -= np.outer(rest[:, j], rest[j]) / rest[j, j]
    others = [int(j) for j in np.argsort(-np.diag(g), kind="stable") if j not in chosen]
    return chosen + others[: k - len(chosen)]


def ridge_whitened(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(G + λI)^(-1/2)`` and the leverages ``diag G (G + λI)^(-1)``, with λ the mean tail eigenvalue."""
    values, vectors = np.linalg.eigh(g)
    values = np.maximum(values[::-1], 0.0)
    vectors = vectors[:, ::-1]
    lam = max(float(values[k:].sum()) / k, 1e-12 * float(values.max(initial=0.0)), 1e-300)
    root = vectors @ np.diag(1 / np.sqrt(values + lam)) @ vectors.T
    leverage = ((vectors**2) * (values / (values + lam))).sum(1)
    return root, leverage


def relevant_columns(relevance: np.ndarray, correlation: np.ndarray, k: int) -> list[int]:
    """Greedy relevance minus half the largest squared correlation with what is already chosen."""
    chosen: list[int] = []
    worst = np.zeros(len(relevance))
    for _ in range(min(k, len(relevance))):
        score = relevance - 0.5 * worst
        score[chosen] = -np.inf
        j = int(np.argmax(score))
        chosen.append(j)
        worst = np.maximum(worst, correlation[:, j] ** 2)
    return chosen


# --- support searches


def exchange(objective: Objective, full_gradient: Callable, found: Outcome, rounds: int = 2, entering: int = 4, project: Project = onto_bounded_simplex, margin: float = 1e-8) -> Outcome:
    """Swap out the active column with the largest ``p·g``; try the outside columns with the least gradient."""
    best = found
    for _ in range(rounds):
        g = full_gradient(best.active, best.weights)
        drop = int(best.active[np.argmax(best.weights * g[best.active])])
        outside = [int(j) for j in np.argsort(g, kind="stable") if j not in best.active][:entering]
        tried = []
        for j in outside:
            active = np.sort(np.append(best.active[best.active != drop], j))
            old = dict(zip(best.active.tolist(), best.weights.tolist(), strict=True))
            start = np.array([old.get(int(c), old[drop]) for c in active])
            tried.append(projected_gradient(objective, active, start, project))
        if not tried:
            break
        new = min(tried, key=lambda o: (o.value, o.active.tolist()))
        if new.value >= best.value - margin:
            break
        best = new
    return best


def pursue(objective: Objective, full_gradient: Callable, found: Outcome, width: int, rounds: int = 4, quantiles=(0.0, 0.25, 0.5, 0.75), margin: float = 1e-8) -> Outcome:
    """Projected support pursuit: step just past breakpoints, keep the ``K`` largest, refit, accept if better."""
    best = found
    for _ in range(rounds):
        g = full_gradient(best.active, best.weights)
        tried: dict[tuple[int, ...], Outcome] = {}
        for q in quantiles:
            step = 1.05 * first_breakpoint(best.active, best.weights, g, q)
            if not np.isfinite(step):
                continue
            whole = np.zeros(width)
            whole[best.active] = best.weights
            active, weights = onto_sparse_simplex(whole - step * g, len(best.active))
            key = tuple(active.tolist())
            if key in tried or key == tuple(best.active.tolist()):
                continue
            uniform = np.full(len(active), 1 / len(active))
            start = min((weights, uniform), key=lambda p, active=active: objective(active, p)[0])
            tried[key] = projected_gradient(objective, active, start)
        if not tried:
            break
        new = min(tried.values(), key=lambda o: (o.value, o.active.tolist()))
        if new.value >= best.value - margin:
            break
        best = new
    return best


def prune_columns(quadratic: QuadraticObjective, w: np.ndarray, keep: int, refresh: int = 64) -> np.ndarray:
    """Drop one column at a time, always the one whose removal costs the objective least.

    Setting ``w_j`` to zero changes the value by ``-g_j w_j + A_jj w_j² / 2``; the gradient is carried along
    and recomputed every ``refresh`` deletions.
    """
    a, w = quadratic.curvature(), w.copy()
    g = quadratic(w)[1]
    dropped = 0
    while (w > 0).sum() > keep:
        cost = np.where(w > 0, -g * w + 0.5 * np.diag(a) * w * w, np.inf)
        j = int(np.argmin(cost))
        g = g - a[:, j] * w[j]
        w[j] = 0.0
        dropped += 1
        if dropped % refresh == 0:
            g = quadratic(w)[1]
    return w


def refit_columns(quadratic: QuadraticObjective, active: np.ndarray, steps: int = 3000, tolerance: float = 1e-10) -> np.ndarray:
    """Box minimiser with all other columns at zero."""
    a, full = quadratic.curvature(), np.zeros(len(quadratic.h))
    own, target = a[np.ix_(active, active)], quadratic.h.sum(1)[active] - quadratic.lam
    bound = max(float(np.abs(own).sum(1).max()), 1e-300)
    w = y = np.ones(len(active))
    t = 1.0
    for _ in range(steps):
        new = np.clip(y - (own @ y - target) / bound, 0, 1)
        if float((y - new) @ (new - w)) > 0:
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - w)
        change, w, t = np.abs(new - w).max(), new, t_new
        if change < tolerance:
            break
    full[active] = w
    return full


def swap_columns(quadratic: QuadraticObjective, w: np.ndarray, steps: int = 8) -> np.ndarray:
    """Best one-out one-in exchanges with the entering coefficient in closed form, while they help."""
    a = quadratic.curvature()
    for _ in range(steps):
        value, g = quadratic(w)
        best = (value - 1e-12, None)
        for j in np.flatnonzero(w > 0):
            out = value - g[j] * w[j] + 0.5 * a[j, j] * w[j] ** 2
            after = g - a[:, j] * w[j]
            for k in np.flatnonzero(w == 0):
                c = float(np.clip(-after[k] / a[k, k], 0, 1)) if a[k, k] > 0 else 0.0
                new = out + after[k] * c + 0.5 * a[k, k] * c * c
                if c > 0 and new < best[0]:
                    best = (new, (j, k, c))
        if best[1] is None:
            break
        j, k, c = best[1]
        w = w.copy()
        w[j], w[k] = 0.0, c
    return w


def insert_columns(quadratic: QuadraticObjective, count: int) -> np.ndarray:
    """From nothing, add the column whose best coefficient gains most, ``count`` times."""
    a, w = quadratic.curvature(), np.zeros(len(quadratic.h))
    for _ in range(count):
        g = quadratic(w)[1]
        c = np.clip(-g / np.maximum(np.diag(a), 1e-300), 0, 1)
        gain = np.where(w == 0, -(g * c + 0.5 * np.diag(a) * c * c), -np.inf)
        j = int(np.argmax(gain))
        if gain[j] <= 0:
            break
        w[j] = c[j]
    return w


def guarded(quadratic: QuadraticObjective, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``new`` if neither objective, error nor size got worse, else ``old``."""
    fine = quadratic(new)[0] <= quadratic(old)[0] and quadratic.error(new) <= quadratic.error(old) and (new > 0).sum() <= (old > 0).sum()
    return new if fine else old


def prune_support(objective: Objective, found: Outcome, count: int, project: Project = onto_bounded_simplex) -> Outcome:
    """Reduce a support one column at a time: the cheapest exact deletion and the gradient's proposal compete."""
    best = found
    while len(best.active) > count:
        g = objective(best.active, best.weights)[1]
        proposals = {int(np.argmax(best.weights * (g - g @ best.weights)))}
        costs = []
        for k in range(len(best.active)):
            p = np.delete(best.weights, k)
            costs.append(objective(np.delete(best.active, k), p / p.sum())[0])
        proposals.add(int(np.argmin(costs)))
        tried = []
        for k in sorted(proposals):
            active, p = np.delete(best.active, k), np.delete(best.weights, k)
            tried.append(projected_gradient(objective, active, p / p.sum(), project))
        best = min(tried, key=lambda o: (o.value, o.active.tolist()))
    return best


# --- layer choices


def layer_subsets(layers: int, least: int = 2, most: int = 6) -> list[tuple[int, ...]]:
    return [s for k in range(least, min(most, layers) + 1) for s in combinations(range(layers), k)]


def gate_layers(q: np.ndarray, variability: np.ndarray, steps: int = 300, rate: float = 0.05, stability: float = 0.15, sparsity: float = 0.02) -> np.ndarray:
    """Layer probabilities by gradient descent on sigmoid gates.

    Loss: relative Gram error of the gates' mean, plus ``stability`` times the gates' mean variability (scaled
    to 0..1), plus ``sparsity`` times their mean.
    """
    n = len(q)
    v = variability - variability.min()
    v = v / v.max() if v.max() > 0 else v
    base = float(np.sqrt(np.full(n, 1 / n) @ q @ np.full(n, 1 / n)))
    theta, first, second = np.zeros(n), np.zeros(n), np.zeros(n)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-theta))
        d = (p - 1) / n
        err = float(np.sqrt(max(d @ q @ d, 1e-300)))
        g = (q @ d) / err / base / n + stability * (v / p.sum() - (p @ v) / p.sum() ** 2) + sparsity / n
        g = g * p * (1 - p)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return 1 / (1 + np.exp(-theta))


def choose_layers(q: np.ndarray, gates: np.ndarray, tolerance: float, most: int = 6, rule: str = "search") -> tuple[list[int], float, bool]:
    """Layers, their Gram error, and whether it is within ``tolerance``.

    ``prefix``: the fewest layers in order of their gates that reach the tolerance.  ``search``: among all
    subsets of the smallest feasible size the one with the largest gates, then the smallest error.
    """
    n = len(q)
    r = np.full(n, 1 / n)
    whole = float(np.sqrt(r @ q @ r))

    def error(subset) -> float:
        d = -r.copy()
        d[list(subset)] += 1 / len(subset)
        return float(np.sqrt(max(d @ q @ d, 0.0))) / whole

    order = np.argsort(-gates, kind="stable")
    if rule == "prefix":
        for k in range(1, min(most, n) + 1):
            chosen = order[:k].tolist()
            if error(chosen) <= tolerance:
                return chosen, error(chosen), True
        return chosen, error(chosen), False
    fallback = None
    for k in range(1, min(most, n) + 1):
        ranked = sorted((-float(gates[list(s)].sum()), error(s), s) for s in combinations(range(n), k))
        fine = [x for x in ranked if x[1] <= tolerance]
        if fine:
            return list(fine[0][2]), fine[0][1], True
        least = min(ranked, key=lambda x: (x[1], x[0], x[2]))
        if fallback is None or least[1] < fallback[1]:
            fallback = (list(least[2]), least[1], False)
    return fallback
