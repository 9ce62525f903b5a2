"""Column expressions: exact sums, distances, scores, hashed uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def q6(c: str | Column) -> Column:
    """Rounded half up to six digits, the same in any engine."""
    return F.floor(col(c) * 1e6 + 0.5) / 1e6


def exact(c: str | Column) -> Column:
    """As a decimal of 24 digits after the point: sums of these don't depend on order, and are exact up to 10^14."""
    return col(c).cast("decimal(38,24)")


def exact_sum(c: str | Column) -> Column:
    return F.sum(exact(c)).cast("double")


def exact_mean(c: str | Column) -> Column:
    return exact_sum(c) / F.count(col(c))


def sum_sql(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(38, 24))) AS DOUBLE)"


def mean_sql(c: str) -> str:
    return f"{sum_sql(c)} / count({c})"


def squared(p: str, q: str, axes: tuple[str, ...] = ("x", "y", "z")) -> Column:
    x, y, z = ((F.col(p + a) - F.col(q + a)) * (F.col(p + a) - F.col(q + a)) for a in axes)
    return x + y + z


def score(predicted: Column, noisy: Column) -> Column:
    """100 clip(1 - predicted / noisy), and for a baseline of nothing 100 or 0."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1.0 - predicted / noisy)))
    return F.when(noisy < 1e-15, F.when(predicted < 1e-15, 100.0).otherwise(0.0)).otherwise(clipped)


def uniform(*parts: Column | str) -> Column:
    """A uniform in (0, 1) from the SHA-256 of the parts' text: 13 hexadecimal digits of it."""
    key = F.concat_ws(":", *[col(p).cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
