"""Equi-join of two tables with join statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import col
from ..functions.skew import skew_join

JOIN_TYPES = ("inner", "left", "right", "outer")


def _join_keys(left: DataFrame, right: DataFrame, on: str | Sequence[str] | None) -> list[str]:
    if on is not None:
        return [on] if isinstance(on, str) else list(on)
    common = sorted(set(left.columns) & set(right.columns))
    if not common:
        raise ValueError("The tables share no column to join on.")
    return common


def merge_tables(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | None = None,
    how: str = "inner",
    suffixes: tuple[str, str] = ("_left", "_right"),
    **options,
) -> DataFrame:
    """Join on equal keys (all common columns by default). A missing key matches a missing key;
    other columns of the same name get the suffixes."""
    if how not in JOIN_TYPES:
        raise ValueError(f"Unknown join type '{how}'; use one of {', '.join(JOIN_TYPES)}.")
    keys = _join_keys(left, right, on)
    shared = (set(left.columns) & set(right.columns)) - set(keys)

    def suffixed(df: DataFrame, suffix: str) -> DataFrame:
        return df.toDF(*[c + suffix if c in shared else c for c in df.columns])

    merged = skew_join(
        C.nan_to_null(suffixed(left, suffixes[0]), keys),
        C.nan_to_null(suffixed(right, suffixes[1]), keys),
        keys, how, **options,
    )
    order = [c + suffixes[0] if c in shared else c for c in left.columns]
    order += [c + suffixes[1] if c in shared else c for c in right.columns if c not in keys]
    return merged.select(*[col(c) for c in order])


def merge_statistics(
    left: DataFrame, right: DataFrame, merged: DataFrame, keys: Sequence[str], how: str
) -> DataFrame:
    """One row: left_rows, right_rows, merged_rows, nulls_after_merge, join_type, keys."""
    missing = sum(
        (F.when(col(c).isNull(), 1).otherwise(0) for c in merged.columns),
        start=F.lit(0),
    )

    def rows(df: DataFrame):
        return df.agg(F.count(F.lit(1))).scalar()

    return C.nan_to_null(merged).agg(
        F.count(F.lit(1)).alias("merged_rows"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("nulls_after_merge"),
    ).select(
        rows(left).alias("left_rows"), rows(right).alias("right_rows"),
        "merged_rows", "nulls_after_merge", F.lit(how).alias("join_type"),
        F.array(*[F.lit(k) for k in keys]).alias("keys"),
    )


def safe_merge_tables(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | None = None,
    how: str = "inner",
    suffixes: tuple[str, str] = ("_left", "_right"),
    **options,
) -> tuple[DataFrame, DataFrame]:
    """The joined frame and its statistics (both lazy)."""
    merged = merge_tables(left, right, on, how, suffixes, **options)
    keys = _join_keys(left, right, on)
    return merged, merge_statistics(left, right, merged, keys, how)
