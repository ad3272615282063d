"""Descriptive statistics of numeric columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.aggregates import adjusted_kurtosis, adjusted_skewness
from ..functions.columns import as_double
from ..functions.quantiles import (
    CENTRES_PER_PASS,
    Centre,
    centres_of,
    quantiles_and_centres,
)

# Aggregates with more than about 90 buffers leave whole-stage code generation.
_COLUMNS_PER_PASS = 14
QUARTILES = (0.25, 0.5, 0.75)
DESCRIBE_COLUMNS = (
    "column string, count bigint, mean double, median double, std double, variance double, "
    "skewness double, kurtosis double, q1 double, q3 double, iqr double, "
    "outlier_count bigint, outlier_ratio double"
)


def centres(df: DataFrame, columns: Sequence[str]) -> dict[str, Centre]:
    """Row count, non-null count, mean and range of each column, collected."""
    out: dict[str, Centre] = {}
    for part in C.chunks(list(columns), CENTRES_PER_PASS):
        keys = [f"c{i}" for i in range(len(part))]
        values = df.select(*[as_double(c).alias(k) for c, k in zip(part, keys)])
        found = centres_of(values, keys)
        out.update({c: found[k] for c, k in zip(part, keys)})
    return out


@dataclass(frozen=True)
class Profile:
    """Quartiles and centres of columns, collected once and reused."""

    quartiles: dict[str, dict[float, float | None]] = field(default_factory=dict)
    centres: dict[str, Centre] = field(default_factory=dict)

    def only(self, columns: Iterable[str]) -> Profile:
        kept = [c for c in columns if c in self.centres]
        return Profile({c: self.quartiles[c] for c in kept}, {c: self.centres[c] for c in kept})


def numeric_profile(
    df: DataFrame, columns: Sequence[str], known: Profile | None = None
) -> Profile:
    """Quartiles and centres of the columns; those already ``known`` are not computed again."""
    known = (known or Profile()).only(columns)
    todo = [c for c in columns if c not in known.centres]
    if not todo:
        return known
    quartiles, centre = quantiles_and_centres(df, todo, QUARTILES)
    return Profile({**known.quartiles, **quartiles}, {**known.centres, **centre})


def describe_numerical(
    df: DataFrame,
    numeric_cols: Sequence[str] | None = None,
    *,
    known: Profile | None = None,
) -> DataFrame:
    """One row per numeric column: moments, quartiles and IQR outliers, most outliers first.

    Spread is over n; skewness and kurtosis are bias-adjusted; outliers lie strictly outside
    1.5 interquartile ranges from the quartiles. ``known`` may pass a profile of ``df``."""
    chosen = C.pick_numeric(df, numeric_cols)
    if not chosen:
        return df.sparkSession.createDataFrame([], DESCRIBE_COLUMNS)
    profile = numeric_profile(df, chosen, known)
    quartiles, centre = profile.quartiles, profile.centres
    parts = [
        _describe(df, part, centre, quartiles) for part in C.chunks(chosen, _COLUMNS_PER_PASS)
    ]
    return C.union_all(parts).orderBy(F.desc("outlier_ratio"), "column")


def _describe(df, part, centre, quartiles) -> DataFrame:
    sums, structs = [], []
    for i, c in enumerate(part):
        x, m, q = as_double(c), centre[c], quartiles[c]
        q1, q3 = q[0.25], q[0.75]
        d = x - _number(m.mean)
        if q1 is None:
            outside = F.lit(0)
        else:
            low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            outside = F.count(F.when((x < low) | (x > high), 1))
        sums += [
            F.sum(d * d).alias(f"s2_{i}"), F.sum(d * d * d).alias(f"s3_{i}"),
            F.sum(d * d * d * d).alias(f"s4_{i}"), F.count(x).alias(f"n_{i}"),
            outside.cast("long").alias(f"out_{i}"),
        ]
        structs.append(_stats_row(c, i, m, q))
    return C.one_row_to_rows(df.agg(*sums), structs)


def _number(value: float | None) -> Column:
    return F.lit(value).cast("double")


def _stats_row(c: str, i: int, m: Centre, q: dict) -> Column:
    n = F.col(f"n_{i}")
    some = F.nullif(n, F.lit(0)).cast("double")
    variance = F.lit(0.0) if m.constant and m.count else F.col(f"s2_{i}") / some
    if m.constant:
        g1 = g2 = F.lit(0.0)
        skew, kurt = F.when(n >= 3, g1), F.when(n >= 4, g2)
    else:
        spread = F.nullif(variance, F.lit(0.0))
        skew = adjusted_skewness(n, F.col(f"s3_{i}") / some / spread / F.sqrt(spread))
        kurt = adjusted_kurtosis(n, F.col(f"s4_{i}") / some / spread / spread - 3)
    iqr = None if q[0.25] is None else q[0.75] - q[0.25]
    return F.struct(
        F.lit(c).alias("column"), n.alias("count"), _number(m.mean).alias("mean"),
        _number(q[0.5]).alias("median"), F.sqrt(variance).alias("std"),
        variance.alias("variance"), skew.cast("double").alias("skewness"),
        kurt.cast("double").alias("kurtosis"), _number(q[0.25]).alias("q1"),
        _number(q[0.75]).alias("q3"), _number(iqr).alias("iqr"),
        F.col(f"out_{i}").alias("outlier_count"),
        F.coalesce(F.col(f"out_{i}") / some, F.lit(0.0)).alias("outlier_ratio"),
    )


def iqr_outlier_summary(
    df: DataFrame, numeric_cols: Sequence[str] | None = None
) -> DataFrame:
    """(column, outlier_count, outlier_ratio)."""
    return describe_numerical(df, numeric_cols).select(
        "column", "outlier_count", "outlier_ratio")


def describe_numerical_dict(
    df: DataFrame, numeric_cols: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """The statistics table and its outlier columns, as two views of one frame."""
    summary = describe_numerical(df, numeric_cols)
    return {
        "summary": summary,
        "outliers": summary.select("column", "outlier_count", "outlier_ratio"),
    }
