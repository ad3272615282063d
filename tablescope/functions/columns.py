"""Column helpers shared by every operator: naming, type classes, null handling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOLEAN, NUMERIC, DATETIME, STRING, OTHER = "boolean", "numeric", "datetime", "string", "other"

_TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
_FLOATING = (T.FloatType, T.DoubleType)


def col(name: str) -> Column:
    """Column by exact name, safe for dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_class(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, _TEMPORAL):
        return DATETIME
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, T.StringType):
        return STRING
    return OTHER


def columns_of_class(df: DataFrame, *classes: str) -> list[str]:
    return [f.name for f in df.schema.fields if type_class(f.dataType) in classes]


def numeric_columns(df: DataFrame) -> list[str]:
    """Number-typed columns; booleans are not numbers."""
    return columns_of_class(df, NUMERIC)


def pick_numeric(df: DataFrame, requested: Sequence[str] | None) -> list[str]:
    """Requested columns that exist and are numeric, or every numeric column."""
    available = numeric_columns(df)
    if requested is None:
        return available
    return [c for c in requested if c in available]


def existing(df: DataFrame, names: Iterable[str] | None) -> list[str]:
    return [n for n in (names or []) if n in df.columns]


def as_double(name: str) -> Column:
    """The column as double with NaN turned into NULL, so that missing has one form."""
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def nan_to_null(df: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    wanted = set(df.columns if only is None else only)
    floats = [
        f for f in df.schema.fields if isinstance(f.dataType, _FLOATING) and f.name in wanted
    ]
    if not floats:
        return df
    return df.withColumns(
        {f.name: F.nanvl(col(f.name), F.lit(None).cast(f.dataType)) for f in floats}
    )


def one_row_to_rows(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct (per column or per pair)."""
    return df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def chunks(items: Sequence, size: int) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
