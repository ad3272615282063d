"""Counts of distinct values of many columns.

Cells are tagged with the number of their column and counted by (column, value), all columns of a
type together: a table of hundreds of columns takes as many scans and shuffles as it has types, and
each scan reads the columns of its type only. Copies of a value are folded before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import as_double, chunks, col, union_all


_LONG_TEXT = 64
_TOP_TEXT, _LONGER = 256, 4     # top values need the order of long texts, too
_COLUMNS_PER_SCAN = 1000


def _short(value: Column, start: int = _LONG_TEXT) -> Column:
    """Long text stands in the shuffle as its start and its SHA-256, which tell texts apart just
    as well. The result is longer than any text that stands for itself, so the two never meet."""
    digest = F.concat(F.substring(value, 1, start), F.sha2(value, 256))
    return F.when(F.length(value) > start, digest).otherwise(value)


def _typed_cell(df: DataFrame, column: str, short: int | None) -> tuple[str, Column]:
    """A type that holds the column's values exactly, and the column in it."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double", as_double(column)
    if isinstance(kind, T.IntegralType):
        return "bigint", col(column).cast("bigint")
    if isinstance(kind, T.StringType):
        return "string", _short(col(column), short) if short else col(column)
    return kind.simpleString(), col(column)


def _tagged_counts(df: DataFrame, columns: Sequence[str], short: int | None) -> list[DataFrame]:
    """(column, value, n), a frame for each type and _COLUMNS_PER_SCAN columns of it."""
    of_type: dict[str, list[Column]] = {}
    for c in columns:
        kind, cell = _typed_cell(df, c, short)
        of_type.setdefault(kind, []).append(
            F.struct(F.lit(c).alias("column"), cell.alias("value")))
    return [
        df.select(F.inline(F.array(*part))).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        for cells in of_type.values() for part in chunks(cells, _COLUMNS_PER_SCAN)
    ]


def value_counts(
    df: DataFrame, columns: Sequence[str], *, short: bool = False, start: int = _LONG_TEXT
) -> DataFrame:
    """(column, value as text, n) for every distinct non-null value. With ``short`` texts longer
    than ``start`` are represented by start and digest, for uses that need the counts only."""
    return union_all([
        part.select("column", F.col("value").cast("string").alias("value"), "n")
        for part in _tagged_counts(df, columns, start if short else None)
    ])


def distinct_counts(
    df: DataFrame, columns: Sequence[str], *, approx: bool = False
) -> DataFrame:
    """(column, unique) over non-null values; exact unless ``approx``."""
    if approx:
        row = df.agg(*[F.approx_count_distinct(col(c)).alias(c) for c in columns])
        return row.unpivot([], [col(c) for c in columns], "column", "unique")
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    found = union_all([
        part.groupBy("column").agg(F.count(F.lit(1)).alias("found"))
        for part in _tagged_counts(df, columns, short=_LONG_TEXT)
    ])
    return names.join(found, "column", "left").select(
        "column", F.coalesce("found", F.lit(0)).cast("long").alias("unique"))


class Top(NamedTuple):
    """The most frequent value of a column as text, its count, and the number of values."""

    value: str
    n: int
    unique: int


def top_values(df: DataFrame, columns: Sequence[str]) -> dict[str, Top]:
    """Collected per column; columns without a value are left out. Equally frequent values go by
    text order. One count of short forms decides, unless the first of the most frequent is a long
    text: then the texts that start like it are counted by longer starts, until one is told whole."""
    if not columns:
        return {}
    counts = value_counts(df, columns, short=True, start=_TOP_TEXT)
    best = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("less"), "value")).alias("top"),
        F.count(F.lit(1)).alias("unique"),
    ).collect()  # one row per column
    found = {r["column"]: Top(r["top"]["value"], -r["top"]["less"], r["unique"]) for r in best}
    for c, top in found.items():
        length, value = _TOP_TEXT, top.value
        while isinstance(df.schema[c].dataType, T.StringType) and len(value) > length:
            alike = df.where(F.substring(col(c), 1, length) == F.lit(value[:length]))
            length *= _LONGER
            value = value_counts(alike, [c], short=True, start=length).where(
                F.col("n") == top.n).agg(F.min("value")).first()[0]
        found[c] = top._replace(value=value)
    return found
