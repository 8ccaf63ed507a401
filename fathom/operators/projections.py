"""Euclidean projections onto simplices with floors, caps and cardinality, and breakpoint rules.

The feasible set of support weights: they sum to one, each at least ``floor / K`` and at most
``min(1, cap / K)``.
"""

from __future__ import annotations

import numpy as np


def bounds(k: int, floor: float = 1e-4, cap: float = 4.0) -> tuple[float, float]:
    low, high = floor / k, min(1.0, cap / k)
    if not 0 <= low <= 1 / k <= high:
        raise ValueError("the bounds leave no feasible weights")
    return low, high


def onto_box_simplex(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """The nearest point with sum one and every component in ``[low, high]``.

    It is ``clip(v - t, low, high)`` for one shift ``t``.  The sum falls piecewise linearly in ``t`` with
    breakpoints ``v - high`` and ``v - low``; the piece that holds sum one is found by bisection over the
    sorted breakpoints and solved in closed form.  Values are centred first, so a common offset of any
    size costs no precision.
    """
    v = np.asarray(values, dtype=np.float64)
    if v.ndim != 1 or not len(v) or not np.isfinite(v).all():
        raise ValueError("values must be a finite vector")
    n = len(v)
    if n * low > 1 + 1e-12 or n * high < 1 - 1e-12:
        raise ValueError("the bounds leave no feasible point")
    v = v - v.max()
    points = np.unique(np.concatenate([v - high, v - low]))
    a, b = 0, len(points) - 1

    def total(t: float) -> float:
        return float(np.clip(v - t, low, high).sum())

    while b - a > 1:
        mid = (a + b) // 2
        if total(points[mid]) >= 1:
            a = mid
        else:
            b = mid
    middle = (points[a] + points[b]) / 2 if b > a else points[a]
    at_high, at_low = v - middle >= high, v - middle <= low
    free = ~(at_high | at_low)
    if free.any():
        t = (v[free].sum() - (1 - high * at_high.sum() - low * at_low.sum())) / free.sum()
    else:
        t = middle
    out = np.clip(v - t, low, high)
    # What rounding leaves over goes to the free components.
    for _ in range(3):
        gap = 1 - out.sum()
        room = (out < high) if gap > 0 else (out > low)
        if gap == 0 or not room.any():
            break
        out[room] = np.clip(out[room] + gap / room.sum(), low, high)
    return out


def onto_simplex(values: np.ndarray, floor: float = 1e-4) -> np.ndarray:
    """Sum one, each component at least ``floor / K``."""
    return onto_box_simplex(values, floor / len(values), 1.0)


def onto_bounded_simplex(values: np.ndarray, floor: float = 1e-4, cap: float = 4.0) -> np.ndarray:
    return onto_box_simplex(values, *bounds(len(values), floor, cap))


def onto_sparse_simplex(values: np.ndarray, k: int, floor: float = 1e-4, cap: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest components (smaller index first on ties), projected; returns ``(active, weights)``."""
    values = np.asarray(values, dtype=np.float64)
    active = np.sort(np.argsort(-values, kind="stable")[:k])
    return active, onto_bounded_simplex(values[active], floor, cap)


def first_breakpoint(active: np.ndarray, weights: np.ndarray, gradient: np.ndarray, quantile: float = 0.0) -> float:
    """Step at which a gradient step lets an outside coordinate overtake an active one.

    The best outside coordinate gains on active ``j`` at the rate ``g_j - min g`` and meets it after
    ``w_j / rate``; the ``quantile`` of these times over the coordinates that are met, infinite if none is.
    """
    outside = np.setdiff1d(np.arange(len(gradient)), active)
    if not len(outside):
        return float("inf")
    rate = gradient[active] - gradient[outside].min()
    met = rate > 0
    return float(np.quantile(weights[met] / rate[met], quantile)) if met.any() else float("inf")
