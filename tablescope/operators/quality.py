"""Quality profile: nulls, distinct values, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.columns import col
from ..functions.counts import distinct_counts
from ..functions.skew import JOIN_SHARE, LARGE_TABLE_BYTES, estimated_bytes, hot_keys


def _null_counts(df: DataFrame) -> DataFrame:
    """(position, column, dtype, rows, non_null), one aggregate for all columns."""
    agg = C.nan_to_null(df).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    return C.one_row_to_rows(agg, [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("rows"), F.col(f"n{i}").alias("non_null"),
        )
        for i, f in enumerate(df.schema.fields)
    ]).where("rows > 0")


def summarize_schema(
    df: DataFrame, *, approx: bool = False, known: Mapping[str, int] | None = None
) -> DataFrame:
    """(column, dtype, non_null, null_ratio, unique), most missing first. Nested and binary
    columns have no distinct count. ``approx`` replaces exact distinct counts by a sketch;
    ``known`` may pass distinct counts of columns of ``df``."""
    flat = [f.name for f in df.schema.fields if C.type_class(f.dataType) != C.OTHER]
    counts = [
        df.sparkSession.createDataFrame(list((known or {}).items()), "column string, unique bigint")
    ]
    todo = [c for c in flat if c not in (known or {})]
    if todo:
        counts.append(distinct_counts(df, todo, approx=approx))
    return _null_counts(df).join(C.union_all(counts), "column", "left").select(
        "column", "dtype", "non_null",
        (1 - F.col("non_null") / F.col("rows")).alias("null_ratio"), "unique", "position",
    ).orderBy(F.desc("null_ratio"), "unique", "position").drop("position")


def detect_missing_values(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_ratio), most missing first."""
    missing = F.col("rows") - F.col("non_null")
    return (
        _null_counts(df)
        .select("column", missing.alias("missing_count"),
                (missing / F.col("rows")).alias("missing_ratio"), "position")
        .orderBy(F.desc("missing_ratio"), "position").drop("position")
    )


def detect_duplicates(
    df: DataFrame, subset: Sequence[str] | None = None, *, large_bytes: int | None = None
) -> DataFrame:
    """Every row that shares its key (all columns by default) with another row; missing values
    count as equal.

    Keys are counted with a map-side aggregate and the repeated ones looked up again; no window,
    which would gather all copies of a key in one task. On large tables rows of hot keys stay where
    they are read, and get the repeated ones of these few keys by broadcast; of the others only
    rows whose key hash repeats are looked at."""
    keys = list(subset) if subset else list(df.columns)
    limit = LARGE_TABLE_BYTES if large_bytes is None else large_bytes
    if estimated_bytes(df) < limit:
        return _sharing(df, keys)
    hot = _hot(df, keys)
    if hot is None:
        return _sharing(_suspects(df, keys), keys)
    return _sharing(df.where(hot), keys, few=True).union(
        _sharing(_suspects(df.where(~hot), keys), keys))


def _sharing(df: DataFrame, keys: Sequence[str], few: bool = False) -> DataFrame:
    """Rows whose key other rows have, too; ``few`` keys are sent to the rows."""
    repeated = (
        df.select(*[_key(df, k).alias(k) for k in keys]).groupBy(*[col(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("_copies"))
        .where("_copies > 1").drop("_copies")
        .toDF(*[f"_d{i}" for i in range(len(keys))])
    )
    condition = None
    for i, k in enumerate(keys):
        part = _key(df, k).eqNullSafe(F.col(f"_d{i}"))
        condition = part if condition is None else condition & part
    return df.join(F.broadcast(repeated) if few else repeated, condition, "left_semi")


def _has_map(df: DataFrame, keys: Sequence[str]) -> bool:
    return any(isinstance(df.schema[k].dataType, T.MapType) for k in keys)


def _hot(df: DataFrame, keys: Sequence[str]) -> Column | None:
    """Whether the 64-bit hash of a row's key is one of the at most 1/JOIN_SHARE hot ones, judged
    on a sample; None without any. Rows of one key are all hot or none is."""
    if _has_map(df, keys):
        return None
    hashed = F.xxhash64(*[_key(df, k) for k in keys])
    hot = hot_keys(df.select(hashed.alias("_hash")), ["_hash"], share=JOIN_SHARE)
    return None if hot is None else hashed.isin([r["_hash"] for r in hot.collect()])


def _suspects(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose 64-bit key hash occurs more than once. Every repeated key is among them, and
    the count shuffled hashes, not rows."""
    if _has_map(df, keys):
        return df
    hashed = F.xxhash64(*[_key(df, k) for k in keys])
    found = (
        df.select(hashed.alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("_hash")
    )
    return df.join(found, hashed == found["_hash"], "left_semi")


def _key(df: DataFrame, name: str) -> Column:
    """The column with NaN as missing, which as a key equals any other missing value."""
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return F.nanvl(col(name), F.lit(None)) if floating else col(name)


def duplicate_count(
    df: DataFrame, subset: Sequence[str] | None = None, *, large_bytes: int | None = None
) -> DataFrame:
    """One row: how many rows ``detect_duplicates`` would return."""
    keys = list(subset) if subset else list(df.columns)
    limit = LARGE_TABLE_BYTES if large_bytes is None else large_bytes
    if estimated_bytes(df) >= limit:
        hot = _hot(df, keys)
        df = _suspects(df, keys) if hot is None else df.where(hot).union(
            _suspects(df.where(~hot), keys))
    return (
        df.select(*[_key(df, k).alias(k) for k in keys]).groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("duplicates"))
    )
