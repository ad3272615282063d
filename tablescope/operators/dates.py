"""Calendar features of a date column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .schema import ensure_datetime, find_datetime_column_heuristic


def auto_extract_date_features(df: DataFrame, date_column: str | None = None) -> DataFrame:
    """Add year, month, day, weekday name and quarter of the date column, in one projection.
    Without a usable date the frame comes back unchanged."""
    if date_column is None:
        date_column = find_datetime_column_heuristic(df)
    if date_column is None or date_column not in df.columns:
        return df
    dated = ensure_datetime(df, date_column)
    d = col(date_column)
    if dated.where(d.isNotNull()).select(d).isEmpty():
        return dated
    return dated.withColumns({
        f"{date_column}_year": F.year(d),
        f"{date_column}_month": F.month(d),
        f"{date_column}_day": F.dayofmonth(d),
        f"{date_column}_weekday": F.date_format(d, "EEEE"),
        f"{date_column}_quarter": F.quarter(d),
    })
