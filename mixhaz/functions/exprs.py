"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_2PI = math.log(2.0 * math.pi)


def col(name: str) -> Column:
    """Reference a column by its verbatim name (dots, pipes and spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def hash_uniform(seed, *ids) -> Column:
    """Uniform in (0, 1) from md5(seed|id|...): equal on every engine and on every retry."""
    parts = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    parts += [(col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def hash_normal(seed, *ids) -> Column:
    """Standard normal by Box-Muller from two hashed uniforms."""
    u1 = hash_uniform(f"{seed}a", *ids)
    u2 = hash_uniform(f"{seed}b", *ids)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def clamp(x: Column, cap: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(cap))), F.lit(-float(cap)))


def total(terms: Sequence[Column]) -> Column:
    """Sum of columns as a balanced tree, so long sums do not nest deeply."""
    terms = list(terms)
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i]
                 for i in range(0, len(terms), 2)]
    return terms[0]


def dot(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    """Sum of columns times constants. Wide products use one array expression."""
    weights = [float(w) for w in weights]
    if len(weights) <= 48:
        return total([c * F.lit(w) for c, w in zip(columns, weights)])
    pairs = F.zip_with(F.array(*columns), F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def log_sum_exp(parts: Sequence[Column]) -> Column:
    """max + log(sum(exp(x - max))), the sum floored at 1e-300."""
    if len(parts) == 1:
        return parts[0]
    top = F.greatest(*parts)
    return top + F.log(F.greatest(total([F.exp(p - top) for p in parts]), F.lit(1e-300)))


def replace_bad(x: Column, value: float = -700.0) -> Column:
    """Non-finite evidence becomes a very small log value."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(value)).otherwise(x)


def softmax(parts: Sequence[Column], temp: float = 1.0, floor: float = 1e-12) -> list[Column]:
    """Tempered softmax, floored and renormalised."""
    scaled = [p / F.lit(float(temp)) for p in parts]
    lse = log_sum_exp(scaled)
    raw = [F.greatest(F.exp(s - lse), F.lit(floor)) for s in scaled]
    mass = total(raw)
    return [r / mass for r in raw]


def gaussian_log(columns: Sequence[Column], mean: Sequence[float], inv_chol) -> Column:
    """log N(x; mean, S) given the inverse of the lower Cholesky factor of S."""
    d = len(mean)
    logdet = -2.0 * sum(math.log(inv_chol[j][j]) for j in range(d))
    centred = [c - F.lit(float(m)) for c, m in zip(columns, mean)]
    squares = []
    for j in range(d):
        row = [(i, float(inv_chol[j][i])) for i in range(j + 1) if inv_chol[j][i] != 0.0]
        squares.append(F.pow(dot([centred[i] for i, _ in row], [w for _, w in row]), 2))
    return F.lit(-0.5) * (F.lit(d * LOG_2PI + logdet) + total(squares))


def signif(x: Column, digits: int = 4) -> Column:
    """Round to significant digits."""
    mag = F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - mag)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def first_argmax(parts: Sequence[Column]) -> Column:
    """1-based position of the largest value, the first on ties."""
    arr = F.array(*parts)
    return F.array_position(arr, F.array_max(arr)).cast("int")
