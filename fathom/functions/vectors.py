"""Column expressions on feature vectors (arrays of doubles).

These stay inside the JVM and define the semantics; blocked numpy kernels elsewhere are faster ways to
the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as this in a denominator.
TINY = 1e-12


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalized(v: Column | str) -> Column:
    """The vector over its length; a zero vector stays zero."""
    v = _col(v)
    length = F.greatest(norm(v), F.lit(TINY))
    return F.transform(v, lambda x: x / length)


def layer(v: Column | str, number: int | Column, width: int, mode: str = "none") -> Column:
    """Stretch ``number`` (from 0) of ``width`` components, raw (``none``) or normalised (``l2``)."""
    start = (F.lit(number) if isinstance(number, int) else number) * width + 1
    part = F.slice(_col(v), start, F.lit(width))
    if mode == "none":
        return part
    if mode == "l2":
        return l2_normalized(part)
    raise ValueError(f"unknown normalisation {mode!r}")


def concat_layers(v: Column | str, numbers: Sequence[int], width: int, mode: str = "none") -> Column:
    """The chosen layers one after the other, in the order given."""
    return F.concat(*(layer(v, n, width, mode) for n in numbers))


def take(v: Column | str, active: Sequence[int], scales: Sequence[float] | None = None) -> Column:
    """Components ``active`` (from 0), each times its scale."""
    v = _col(v)
    picked = [F.get(v, F.lit(int(j))) for j in active]
    if scales is not None:
        picked = [p * F.lit(float(s)) for p, s in zip(picked, scales, strict=True)]
    return F.array(*picked)


def top_mean_size(n: Column, fraction: float) -> Column:
    """How many of ``n`` scores make the top ``fraction``: at least one, rounded up."""
    return F.greatest(F.lit(1), F.ceil(n * F.lit(fraction))).cast("int")
