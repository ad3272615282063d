"""Filters, key figures and chart data on an analysed table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import as_double, col
from ..functions.counts import value_counts
from ..functions.quantiles import exact_quantiles
from .correlation import correlation_matrix
from .olap import pivot_analysis
from .roles import ColumnRoles
from .schema import ensure_datetime
from .temporal import aggregate_time

MAX_FACET_VALUES = 50
PRIMARY_FACETS = 7
TOP_CATEGORIES = 20
HISTOGRAM_BINS = 30
SAMPLE_ROWS = 10
# Names of the levels of detail, and how many rows each shows.
DRILL_ROWS = {"Summary": 5, "Top 10": 10, "Detailed": None}
_FACET = (
    "position int, column string, kind string, primary boolean, importance double, "
    "low double, high double, first timestamp_ntz, last timestamp_ntz"
)


# -- filters ---------------------------------------------------------------------------------

def filter_facets(
    df: DataFrame,
    roles: ColumnRoles,
    importance: Mapping[str, float] | None = None,
) -> DataFrame:
    """What a table can be filtered by: dimensions with 2..50 values (their sorted values), the
    range of each metric, the span of the first time column. Dimensions come by importance, the
    first seven as primary."""
    importance = dict(importance or {})
    spark = df.sparkSession
    dims = sorted(C.existing(df, roles.dimensions), key=lambda c: -importance.get(c, 0.0))
    metrics = C.pick_numeric(df, roles.metrics)
    times = C.existing(df, roles.temporal)[:1]
    dated = ensure_datetime(df, times[0]) if times else df
    ranges = dated.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.struct(F.min(as_double(c)).alias("lo"), F.max(as_double(c)).alias("hi")).alias(f"m{i}")
          for i, c in enumerate(metrics)],
        *[F.struct(F.min(col(c)).alias("lo"), F.max(col(c)).alias("hi")).alias("t")
          for c in times],
    ).first()
    rows: list[tuple] = [
        (i, c, "dimension", i < PRIMARY_FACETS, importance.get(c, 0.0), None, None, None, None)
        for i, c in enumerate(dims)
    ]
    for i, c in enumerate(metrics):
        r = ranges[f"m{i}"]
        rows.append((len(rows), c, "metric", True, importance.get(c, 0.0), r["lo"], r["hi"],
                     None, None))
    for c in times:
        if ranges["t"]["lo"] is not None:
            rows.append((len(rows), c, "time", True, None, None, None,
                         ranges["t"]["lo"], ranges["t"]["hi"]))
    facets = spark.createDataFrame(rows, _FACET)
    if not dims:
        return facets.withColumn("values", F.lit(None).cast("array<string>"))
    counted = value_counts(df, dims)
    fitting = counted.groupBy("column").agg(F.count(F.lit(1)).alias("k")).where(
        F.col("k").between(2, MAX_FACET_VALUES)).select("column")
    values = counted.join(F.broadcast(fitting), "column").groupBy("column").agg(
        F.sort_array(F.collect_list("value")).alias("values"))  # at most 50 each
    return facets.join(F.broadcast(values), "column", "left").where(
        (F.col("kind") != "dimension") | F.col("values").isNotNull()
    ).orderBy("position")


def filter_values(df: DataFrame, column: str, selected: Sequence[Any]) -> DataFrame:
    return df.where(col(column).isin(*selected)) if selected else df


def filter_range(df: DataFrame, column: str, low: Any, high: Any) -> DataFrame:
    """Both ends included."""
    return df.where(col(column).between(low, high))


def filter_dates(df: DataFrame, column: str, start: date, end: date) -> DataFrame:
    """Calendar dates, both ends included. Written on the column itself where it is a timestamp,
    so that the range reaches the file scan."""
    if C.type_class(df.schema[column].dataType) == C.DATETIME:
        return df.where(
            (col(column) >= F.lit(start)) & (col(column) < F.date_add(F.lit(end), 1)))
    dated = ensure_datetime(df.withColumn("_date", col(column)), "_date")
    return dated.where(F.to_date("_date").between(start, end)).drop("_date")


def apply_filters(
    df: DataFrame,
    values: Mapping[str, Sequence[Any]] | None = None,
    ranges: Mapping[str, tuple] | None = None,
    dates: Mapping[str, tuple[date, date]] | None = None,
) -> DataFrame:
    """All filters together; when nothing is left, the unfiltered table comes back."""
    out = df
    for c, selected in (values or {}).items():
        out = filter_values(out, c, selected)
    for c, (low, high) in (ranges or {}).items():
        out = filter_range(out, c, low, high)
    for c, (start, end) in (dates or {}).items():
        out = filter_dates(out, c, start, end)
    return df if out.isEmpty() else out


# -- key figures and tables ------------------------------------------------------------------

def primary_metric(
    df: DataFrame, roles: ColumnRoles, importance: Mapping[str, float] | None = None
) -> str | None:
    """The most important numeric column, else the first metric, else the first number."""
    if importance:
        return max(importance, key=lambda c: importance[c])
    return next(iter([*roles.metrics, *C.numeric_columns(df)]), None)


def kpis(df: DataFrame, metric: str | None) -> DataFrame:
    """One row: records, total and average of the metric."""
    if metric is None or metric not in df.columns:
        return df.agg(F.count(F.lit(1)).alias("records"), F.lit(None).cast("double").alias("total"),
                      F.lit(None).cast("double").alias("average"))
    x = as_double(metric)
    return df.agg(F.count(F.lit(1)).alias("records"),
                  F.coalesce(F.sum(x), F.lit(0.0)).alias("total"), F.avg(x).alias("average"))


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    return df.limit(n)


def top_categories(
    df: DataFrame, dimension: str, metric: str, n: int = TOP_CATEGORIES
) -> DataFrame:
    """Sum of the metric per value, missing value included, the largest n."""
    return (
        df.groupBy(col(dimension)).agg(
            F.coalesce(F.sum(as_double(metric)), F.lit(0.0)).alias(metric))
        .orderBy(col(metric).desc(), col(dimension)).limit(n)
    )


# -- time ------------------------------------------------------------------------------------

def monthly_trend(df: DataFrame, date_col: str, metric: str) -> DataFrame:
    """Monthly sums labelled by month end, months without rows as 0."""
    monthly = aggregate_time(
        df.select(col(date_col), as_double(metric).alias(metric)), date_col, "M", [metric])
    months = monthly.agg(F.min(col(date_col)).alias("a"), F.max(col(date_col)).alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("_month"))
    return months.join(monthly, F.col("_month") == col(date_col), "left").select(
        F.last_day("_month").cast("timestamp_ntz").alias(date_col),
        F.coalesce(col(metric), F.lit(0.0)).alias(metric),
    )


def monthly_rolling(df: DataFrame, date_col: str, metric: str, window: int = 3) -> DataFrame:
    """``monthly_trend`` with the mean of the last months; nothing below three months. The
    window runs over one row per month."""
    monthly = monthly_trend(df, date_col, metric)
    last = Window.orderBy(col(date_col)).rowsBetween(1 - window, 0)
    every = Window.partitionBy()
    return monthly.select(
        col(date_col), col(metric), F.avg(col(metric)).over(last).alias("rolling_avg"),
        F.count(F.lit(1)).over(every).alias("_months"),
    ).where("_months >= 3").drop("_months")


# -- distributions ---------------------------------------------------------------------------

def histogram(
    df: DataFrame, metric: str, bins: int = HISTOGRAM_BINS, log: bool = False
) -> DataFrame:
    """(bin, low, high, count) over equal-width bins, empty bins left out; ``log`` bins
    log(1 + x). One pass for the range, one for the counts."""
    x = F.log1p(as_double(metric)) if log else as_double(metric)
    values = df.select(x.alias("x")).where(F.col("x").isNotNull())
    r = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    if lo is None or lo == hi:
        return values.groupBy(F.lit(1).alias("bin"), F.col("x").alias("low"),
                              F.col("x").alias("high")).agg(F.count(F.lit(1)).alias("count"))
    number = F.least(
        F.width_bucket(F.col("x"), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)).cast("int")
    width = (hi - lo) / bins
    return values.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("count")).select(
        "bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("low"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("high"), "count",
    )


def box_plot(df: DataFrame, metric: str) -> DataFrame:
    """One row: quartiles, whisker ends (outermost values within 1.5 IQR), outlier count."""
    q = exact_quantiles(df, [metric], (0.25, 0.5, 0.75))[metric]
    if q[0.25] is None:
        return df.sparkSession.createDataFrame(
            [], "q1 double, median double, q3 double, lower_whisker double, "
            "upper_whisker double, outlier_count bigint")
    reach = 1.5 * (q[0.75] - q[0.25])
    x = as_double(metric)
    inside = x.between(q[0.25] - reach, q[0.75] + reach)
    return df.agg(
        F.lit(q[0.25]).alias("q1"), F.lit(q[0.5]).alias("median"), F.lit(q[0.75]).alias("q3"),
        F.min(F.when(inside, x)).alias("lower_whisker"),
        F.max(F.when(inside, x)).alias("upper_whisker"),
        F.count(F.when(~inside, 1)).alias("outlier_count"),
    )


# -- interactive OLAP ------------------------------------------------------------------------

def pivot_matrix(pivot: DataFrame) -> DataFrame:
    """First column and the numeric ones of a pivot, missing cells 0."""
    index, *rest = pivot.columns
    numbers = [c for c in C.numeric_columns(pivot) if c in rest]
    return pivot.select(
        col(index), *[F.coalesce(col(c), F.lit(0)).alias(c) for c in numbers])


def olap_view(
    df: DataFrame, row_dim: str, metric: str, col_dim: str | None = None
) -> DataFrame:
    """Total, Average and Count per row value, or the sums against a second dimension; rows
    without a dimension value are left out."""
    df = df.where(col(row_dim).isNotNull())
    if col_dim is not None:
        df = df.where(col(col_dim).isNotNull())
        return pivot_analysis(df, [row_dim], [col_dim], metric)
    x = as_double(metric)
    return df.groupBy(col(row_dim)).agg(
        F.coalesce(F.sum(x), F.lit(0.0)).alias("Total"), F.avg(x).alias("Average"),
        F.count(x).alias("Count"))


def drill_level(view: DataFrame, level: str = "Detailed") -> DataFrame:
    """The first rows in key order: 5 for Summary, 10 for Top 10, all for Detailed."""
    if level not in DRILL_ROWS:
        raise ValueError(f"Unknown level '{level}'; use one of {', '.join(DRILL_ROWS)}.")
    rows = DRILL_ROWS[level]
    return view if rows is None else view.orderBy(col(view.columns[0])).limit(rows)


def correlation_heatmap(corr: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The wide matrix behind a heat map."""
    return correlation_matrix(corr, columns)
