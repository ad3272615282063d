"""Aggregate functions by name, with missing-value rules of a data-frame library:
missing values never count, a sum of nothing is 0, spread uses n - 1."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_double, col

AggFunc = str | Callable[[str], Column]


def adjusted_skewness(n: Column, g1: Column) -> Column:
    """Sample skewness from the population moment g1; NULL below three values."""
    m = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(m * (m - 1)) / (m - 2))


def adjusted_kurtosis(n: Column, g2: Column) -> Column:
    """Sample excess kurtosis from the population value g2; NULL below four values."""
    m = n.cast("double")
    return F.when(n >= 4, (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * g2 + 6))


def _skew(c: str) -> Column:
    x = as_double(c)
    g1 = F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(F.skewness(x))
    return adjusted_skewness(F.count(x), g1)


def _sem(c: str) -> Column:
    x = as_double(c)
    return F.stddev_samp(x) / F.sqrt(F.nullif(F.count(x), F.lit(0)).cast("double"))


def _sum(c: str, x: Column, is_whole: bool) -> Column:
    """Whole numbers add up as decimals, which 38 digits keep from overflowing."""
    zero = F.lit(0)
    return F.coalesce(F.sum(x.cast("decimal(19,0)")).cast("decimal(38,0)"), zero.cast(
        "decimal(38,0)")) if is_whole else F.coalesce(F.sum(x), zero)


def _not_nan(c: str, is_float: bool) -> Column:
    return F.nanvl(col(c), F.lit(None)) if is_float else col(c)


def aggregate(
    func: AggFunc,
    c: str,
    *,
    is_float: bool = False,
    is_whole: bool = False,
    order_by: Sequence[str] | None = None,
) -> Column:
    """Aggregate expression for column ``c``, named ``c``."""
    if callable(func):
        return func(c).alias(c)
    x = _not_nan(c, is_float)
    if func in ("first", "last"):
        if not order_by:
            raise ValueError(f"'{func}' needs order_by: rows of a DataFrame have no order.")
        rank = F.when(x.isNotNull(), F.struct(*[col(o) for o in order_by], x))  # ties by value
        return (F.min_by if func == "first" else F.max_by)(x, rank).alias(c)
    table: dict[str, Callable[[], Column]] = {
        "sum": lambda: _sum(c, x, is_whole),
        "mean": lambda: F.avg(x),
        "median": lambda: F.median(as_double(c)),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "count": lambda: F.count(x),
        "nunique": lambda: F.count_distinct(x),
        "std": lambda: F.stddev_samp(as_double(c)),
        "var": lambda: F.var_samp(as_double(c)),
        "size": lambda: F.count(F.lit(1)),
        "prod": lambda: F.coalesce(F.product(as_double(c)), F.lit(1.0)),
        "sem": lambda: _sem(c),
        "skew": lambda: _skew(c),
    }
    if func not in table:
        raise ValueError(f"Unknown aggregate '{func}'. Known: {', '.join(sorted(table))}.")
    return table[func]().alias(c)
