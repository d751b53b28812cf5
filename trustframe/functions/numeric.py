"""Numeric Column helpers (all JVM-side expressions, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(a, b) -> Column:
    """``a / b`` with a divisor equal to 0 replaced by 1 (so the result is ``a``).

    The guard also keeps ANSI mode from raising on a zero divisor.
    """
    b = col(b)
    return col(a) / F.when(b == 0, F.lit(1.0)).otherwise(b)


def clean_nonfinite(x) -> Column:
    """NaN and +-inf become NULL (the pandas ``replace(inf, nan)`` step)."""
    x = col(x)
    return F.when(F.isnan(x) | (x == F.lit(INF)) | (x == F.lit(-INF)), F.lit(None)).otherwise(x)


def clip(x, lo: float, hi: float) -> Column:
    """Clip into [lo, hi]; NULL stays NULL (``least``/``greatest`` would skip it)."""
    x = col(x)
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def clamp01(x) -> Column:
    """``max(0, min(1, x))`` as in the reference's clamp helpers."""
    return clip(x, 0.0, 1.0)


def js_round(x) -> Column:
    """JavaScript ``Math.round``: floor(x + 0.5)."""
    return F.floor(col(x) + F.lit(0.5))


def py_num(x, default: float = 0.0) -> Column:
    """``value or default`` for a numeric field: NULL and 0 give the default."""
    return F.coalesce(col(x), F.lit(default))


def gt(x, v) -> Column:
    """Python comparison ``x > v``: false for NaN (Spark orders NaN above all)."""
    x = col(x)
    return (x > v) & ~F.isnan(x)


def lt(x, v) -> Column:
    x = col(x)
    return (x < v) & ~F.isnan(x)


def truthy_num(x) -> Column:
    """Python ``bool(x or 0)`` for a numeric flag: non-zero (NaN too) is true."""
    x = col(x)
    return F.coalesce(x != 0, F.lit(False))
