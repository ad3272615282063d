"""Time buckets, rolling means, trend, seasonality and anomalies."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.columns import as_double, col
from ..functions.ordered import RANGE, split_by_order, total_order
from .olap import AggFunc, group_aggregate
from .schema import ensure_datetime, find_datetime_column

# Names of calendar buckets.
UNITS = {
    "s": "second", "S": "second", "min": "minute", "T": "minute", "h": "hour", "H": "hour",
    "D": "day", "W": "week", "M": "month", "ME": "month", "MS": "month",
    "Q": "quarter", "QE": "quarter", "QS": "quarter",
    "Y": "year", "YE": "year", "YS": "year", "A": "year",
}
SMOOTHING = 7
MIN_SEASONAL_POINTS = 12
TREND = (
    "date_column string, value_column string, trend string, slope double, "
    "seasonality_index double, points bigint"
)
ANOMALY_COUNT = "count bigint, z_threshold double"


_PARTS = {"hour": F.hour, "minute": F.minute, "second": F.second}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
# Names of weekdays and months in anchored frequencies.
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def _unit(freq: str) -> tuple[int, str, str]:
    """(multiple, unit, anchor) of a frequency such as 15min, 2D, W-WED or QE-MAR."""
    found = re.fullmatch(r"(\d*)([A-Za-z]+)(?:-([A-Z]{3}))?", freq)
    unit = UNITS.get(found[2]) if found else None
    known = {"week": WEEKDAYS, "quarter": MONTHS, "year": MONTHS}.get(unit, ())
    if unit is None or found[1] == "0" or (found[3] and found[3] not in known):
        raise ValueError(f"Unknown frequency '{freq}'; use one of {', '.join(UNITS)}, "
                         "with a number before it or a weekday or month after it.")
    return int(found[1] or 1), unit, found[3] or ""


def time_bucket(date_col: str, freq: str) -> Column:
    """Start of the bucket, by the clock as written: the session's zone plays no part.

    Several units form a bucket from 1970 on, weeks from the first week of 1970, units below a
    day from midnight. An anchor names the last day of a week, or the last month of a quarter or
    year."""
    times, unit, anchor = _unit(freq)
    at = col(date_col).cast("timestamp_ntz")
    day = at.cast("date")
    if unit in _PARTS:
        seconds = {"hour": 3600, "minute": 60, "second": 1}[unit] * times
        passed = F.hour(at) * 3600 + F.minute(at) * 60 + F.floor(F.second(at)).cast("int")
        return F.timestamp_add("SECOND", passed - passed % seconds, day.cast("timestamp_ntz"))
    if unit in _MONTHS:
        months = _MONTHS[unit] * times
        shift = (MONTHS.index(anchor) + 1) % _MONTHS[unit] if anchor else 0
        passed = (F.year(day) - 1970) * 12 + F.month(day) - 1
        start = F.add_months(F.lit("1970-01-01").cast("date"),
                             passed - F.pmod(passed - shift, F.lit(months)))
        return start.cast("timestamp_ntz")
    days = times * (7 if unit == "week" else 1)
    # 1970-01-05 was a Monday; a week ends on its anchor.
    first = (4 + (WEEKDAYS.index(anchor) + 1 if anchor else 0) % 7) if unit == "week" else 0
    passed = F.unix_date(day)
    return F.date_sub(day, F.pmod(passed - first, F.lit(days))).cast("timestamp_ntz")


def _nothing(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], T.StructType([]))


def aggregate_time(
    df: DataFrame,
    date_col: str | None = None,
    freq: str = "ME",
    values: Sequence[str] | None = None,
    aggfunc: AggFunc = "sum",
    *,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """One row per calendar bucket that has rows, labelled by its start; rows without a date are
    left out. ``first`` and ``last`` go by the date unless ``order_by`` says otherwise, rows of one
    time by their value. No date column or no value column gives a frame without columns."""
    date_col = date_col or find_datetime_column(df)
    if date_col is None or date_col not in df.columns:
        return _nothing(df)
    order_by = order_by or [date_col]
    if values is None:
        values = C.numeric_columns(df)
    chosen = [c for c in C.existing(df, values) if c != date_col]
    if not chosen:
        return _nothing(df)
    dated = ensure_datetime(df, date_col).where(col(date_col).isNotNull())
    bucketed = dated.select(
        time_bucket(date_col, freq).alias("_bucket"),
        *[col(c) for c in dict.fromkeys([*chosen, *(order_by or ())])],
    )
    return group_aggregate(
        bucketed, ["_bucket"], chosen, aggfunc, order_by=order_by
    ).withColumnRenamed("_bucket", date_col)


def rolling_average(
    df: DataFrame,
    date_col: str | None = None,
    value_cols: Sequence[str] | None = None,
    window: int = SMOOTHING,
    min_periods: int = 1,
) -> DataFrame:
    """Mean of the last ``window`` monthly sums. The window runs over one row per month, a
    number the calendar bounds, so it needs no partitioning."""
    monthly = aggregate_time(df, date_col, "ME", value_cols, "sum")
    if not monthly.columns:
        return monthly
    label, *chosen = monthly.columns
    last = Window.orderBy(col(label)).rowsBetween(1 - window, 0)
    return monthly.select(col(label), *[
        F.when(F.count(col(c)).over(last) >= min_periods, F.avg(col(c)).over(last)).alias(c)
        for c in chosen
    ])


def _series(
    df: DataFrame, date_col: str | None, value_col: str | None, ties: Sequence[str]
) -> tuple[DataFrame | None, str | None, str | None]:
    """(date, value as double, tie-breaks) of rows that have both; or the reason there is none."""
    date_col = date_col or find_datetime_column(df)
    if date_col is None or date_col not in df.columns:
        return None, None, "no_date_column"
    numeric = [c for c in C.numeric_columns(df) if c != date_col]
    if not numeric:
        return None, date_col, "no_numeric_values"
    value_col = value_col if value_col in numeric else numeric[0]
    extra = [t for t in C.existing(df, ties) if t not in (date_col, value_col)]
    series = ensure_datetime(df, date_col).select(
        col(date_col), as_double(value_col).alias(value_col), *[col(t) for t in extra]
    ).where(col(date_col).isNotNull() & col(value_col).isNotNull())
    return series, date_col, value_col


def detect_trend(
    df: DataFrame,
    date_col: str | None = None,
    value_col: str | None = None,
    window: int = SMOOTHING,
    *,
    tie_breaks: Sequence[str] = (),
    rows_per_range: int | None = None,
) -> DataFrame:
    """One row: slope of the least-squares line over the row number in time order, its direction,
    and from 12 points on a seasonality index. ``window`` is accepted and has no effect: the index
    always smooths over seven rows.

    Rows are never numbered globally. Each range of the time order reports its row count and
    sums over its local row number; shifting those by the rows before the range gives the exact
    global sums."""
    spark = df.sparkSession
    series, date_col, value_col = _series(df, date_col, value_col, tie_breaks)
    if series is None:
        return spark.createDataFrame([(date_col, None, value_col, None, None, None)], TREND)
    total = series.agg(F.count(F.lit(1)).alias("n"), F.avg(col(value_col)).alias("mean")).first()
    n = total["n"]
    if n < 3:
        return spark.createDataFrame(
            [(date_col, value_col, "insufficient_points", None, None, n)], TREND)

    ties = [c for c in series.columns if c not in (date_col, value_col)]
    ranged = split_by_order(series, date_col, ties, rows=n, rows_per_range=rows_per_range)
    w = ranged.window()
    y = col(value_col) - F.lit(total["mean"])
    local = ranged.df.select(
        RANGE, y.alias("y"), (F.row_number().over(w) - 1).cast("double").alias("at"),
        F.abs(y - F.lag(y).over(w)).alias("step"),
    )
    per_range = local.groupBy(RANGE).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y").alias("sy"),
        F.sum(F.col("at") * F.col("y")).alias("sxy"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("steps"),
        F.min_by("y", "at").alias("y_first"), F.max_by("y", "at").alias("y_last"),
    )
    by_range = Window.orderBy(RANGE)  # one row per range
    before = F.coalesce(
        F.sum("rows").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = per_range.select(
        (F.col("sxy") + (before - F.lit((n - 1) / 2)) * F.col("sy")).alias("sxy"),
        (F.col("steps") + F.coalesce(
            F.abs(F.col("y_first") - F.lag("y_last").over(by_range)), F.lit(0.0))).alias("steps"),
    )
    slope = F.sum("sxy") / F.lit(n * (n * n - 1.0) / 12)
    if n >= MIN_SEASONAL_POINTS:
        ends = _end_corrections(series, ranged.order, value_col, n)
        season = (F.sum("steps") + F.lit(ends)) / F.lit(float(n - 1)) / F.lit(total["mean"] or 1.0)
    else:
        season = F.lit(None).cast("double")
    return shifted.agg(slope.alias("slope"), season.alias("seasonality_index")).select(
        F.lit(date_col).alias("date_column"), F.lit(value_col).alias("value_column"),
        F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing")
        .otherwise("flat").alias("trend"),
        "slope", "seasonality_index", F.lit(n).cast("long").alias("points"),
    )


def _end_corrections(series: DataFrame, order, value_col: str, n: int) -> float:
    """The seasonality index averages 7-row rolling means of the absolute steps. In that average
    every step counts once, except the first and last few; their excess weight times their size
    is what this returns, from the first and last rows alone."""
    k = min(n, SMOOTHING)
    y = col(value_col).alias("y")
    first = [r["y"] for r in series.orderBy(*order).select(y).limit(k).collect()]
    last = [r["y"] for r in series.orderBy(*[o.desc() for o in order]).select(y).limit(k).collect()]
    last.reverse()

    def weight(j: int) -> float:
        """How much step j (from row j-1 to row j) counts: over the rows that see it."""
        return sum(1.0 / min(SMOOTHING, i) for i in range(j, min(j + SMOOTHING, n)))

    steps = {j: abs(first[j] - first[j - 1]) for j in range(1, k)}
    steps.update({n - k + j: abs(last[j] - last[j - 1]) for j in range(1, k)})
    return sum((weight(j) - 1.0) * size for j, size in steps.items())


def temporal_anomalies(
    df: DataFrame,
    date_col: str | None = None,
    value_col: str | None = None,
    window: int = SMOOTHING,
    z_threshold: float = 2.0,
    *,
    tie_breaks: Sequence[str] = (),
) -> DataFrame | None:
    """All rows (date, value, tie-breaks, z_score) whose distance from the mean exceeds
    ``z_threshold`` standard deviations; None below ``window`` rows. Two passes, no shuffle."""
    series, _, value_col = _series(df, date_col, value_col, tie_breaks)
    if series is None:
        return None
    x = col(value_col)
    stats = series.agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    if stats["n"] < window or stats["s"] is None:
        return None
    z = F.abs((x - F.lit(stats["m"])) / F.lit(stats["s"] + 1e-8))
    return series.withColumn("z_score", z).where(F.col("z_score") > z_threshold)


def detect_temporal_anomalies(
    df: DataFrame,
    date_col: str | None = None,
    value_col: str | None = None,
    window: int = SMOOTHING,
    z_threshold: float = 2.0,
    *,
    tie_breaks: Sequence[str] = (),
    show: int = 5,
) -> dict[str, DataFrame]:
    """``count`` (one row) and the first ``anomalies`` in time order (a distributed top-k)."""
    found = temporal_anomalies(
        df, date_col, value_col, window, z_threshold, tie_breaks=tie_breaks)
    if found is None:
        spark = df.sparkSession
        return {"count": spark.createDataFrame([(0, z_threshold)], ANOMALY_COUNT),
                "anomalies": _nothing(df)}
    date = found.columns[0]
    return {
        "count": found.agg(F.count(F.lit(1)).alias("count"),
                           F.lit(float(z_threshold)).alias("z_threshold")),
        "anomalies": found.orderBy(*total_order(found, date, tie_breaks)).limit(show),
    }
