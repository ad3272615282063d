"""Filling missing values: along time, by a typical number, by the most frequent category."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.aggregates import adjusted_skewness
from ..functions.columns import as_double, col
from ..functions.counts import Top, distinct_counts, top_values
from ..functions.ordered import RANGE, split_by_order
from ..functions.quantiles import exact_quantiles
from ..functions.skew import plain_join
from ..storage import materialize, together
from .inference import TableSchema, detect_column_types

NOTES = "column string, fill_value string, rationale string"
UNKNOWN = "Unknown"
SKEWED = 0.5


@dataclass(frozen=True)
class Known:
    """What earlier passes already tell about a frame; everything is optional."""

    schema: TableSchema | None = None
    medians: Mapping[str, float | None] = field(default_factory=dict)
    unique: Mapping[str, int] = field(default_factory=dict)
    top: Mapping[str, Top] = field(default_factory=dict)

    def only(self, columns: set[str]) -> Known:
        def kept(found: Mapping) -> dict:
            return {c: v for c, v in found.items() if c in columns}
        return Known(self.schema, kept(self.medians), kept(self.unique), kept(self.top))


def _flat(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if C.type_class(f.dataType) != C.OTHER]


def _filled_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    names = _flat(df)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
    ).first()
    return row["rows"], {c: row[f"n{i}"] for i, c in enumerate(names)}


def fill_along_time(
    df: DataFrame,
    time_column: str,
    tie_breaks: Sequence[str] = (),
    *,
    partition_by: str | Sequence[str] = (),
    rows_per_range: int | None = None,
) -> DataFrame:
    """Give every missing value the last known one in time order (missing times last), and the
    first known one where nothing came before. Columns with no value at all stay empty.

    With ``partition_by`` every entity (a combination of these columns; missing ones are an entity
    too) is filled from its own rows only, and what an entity has no value for stays empty.

    Only columns with gaps are touched. Inside a range of the order the last value is a window;
    what enters a range from earlier ones is one row per range."""
    entity = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    df = C.nan_to_null(df)
    rows, filled = _filled_counts(df)
    return _fill_along_time(df, time_column, tie_breaks, rows, filled, rows_per_range, entity)


def _fill_along_time(df, time_column, tie_breaks, rows, filled, rows_per_range, entity=()):
    gaps = [c for c, n in filled.items() if 0 < n < rows and c not in entity]
    if not gaps:
        return df
    if entity:
        return _fill_by_entity(df, time_column, tie_breaks, rows, gaps, rows_per_range, entity)
    ranged = split_by_order(
        df, time_column, tie_breaks, rows=rows, rows_per_range=rows_per_range)
    order = ranged.order_struct()
    ends = ranged.df.groupBy(RANGE).agg(*[
        e for i, c in enumerate(gaps) for e in (
            F.max_by(col(c), F.when(col(c).isNotNull(), order)).alias(f"_last{i}"),
            F.min_by(col(c), F.when(col(c).isNotNull(), order)).alias(f"_first{i}"),
        )
    ])
    # Every range gets a row: copies split by source partition may fall into other ranges here
    # than below, which is harmless as long as no range is missing.
    every = df.sparkSession.range(ranged.ranges).select(F.col("id").cast("int").alias(RANGE))
    ends = every.join(ends, RANGE, "left")
    by_range = Window.orderBy(RANGE)  # over one row per range
    earlier = by_range.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entering = ends.select(F.col(RANGE).alias("_into"), *[
        F.coalesce(
            F.last(f"_last{i}", ignorenulls=True).over(earlier),
            F.first(f"_first{i}", ignorenulls=True).over(whole),
        ).alias(f"_in{i}")
        for i in range(len(gaps))
    ])
    upto = ranged.window().rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.df.withColumns({
        f"_local{i}": F.last(col(c), ignorenulls=True).over(upto) for i, c in enumerate(gaps)})
    place = {c: i for i, c in enumerate(gaps)}
    return inside.join(entering, F.col(RANGE) == F.col("_into")).select(*[
        F.coalesce(F.col(f"_local{place[c]}"), F.col(f"_in{place[c]}")).alias(c)
        if c in place else col(c)
        for c in df.columns
    ])


def _fill_by_entity(df, time_column, tie_breaks, rows, gaps, rows_per_range, entity):
    """The rows of an entity follow each other in the order, so that an entity lies in one range or
    in several neighbouring ones. The first kind is filled by windows alone; for the second, of
    which there are at most two per range, values are carried from range to range of the entity."""
    ranged = split_by_order(
        df, time_column, tie_breaks, rows=rows, rows_per_range=rows_per_range, within=entity)
    order, keys = ranged.order_struct(), [f"_entity{i}" for i in range(len(entity))]
    named = [col(c).alias(k) for c, k in zip(entity, keys)]
    ends = ranged.df.groupBy(RANGE, *named).agg(*[
        e for i, c in enumerate(gaps) for e in (
            F.max_by(col(c), F.when(col(c).isNotNull(), order)).alias(f"_last{i}"),
            F.min_by(col(c), F.when(col(c).isNotNull(), order)).alias(f"_first{i}"),
        )
    ])
    # Only ends of entities that cross a border are kept before rows of an entity meet.
    spans = ends.groupBy(*keys).agg(F.min(RANGE).alias("_from"), F.max(RANGE).alias("_to")).where(
        "_from < _to")
    every = spans.select(*keys, F.explode(F.sequence("_from", "_to")).alias(RANGE))
    crossing = plain_join(every, ends, [*keys, RANGE], "left")
    own = Window.partitionBy(*keys).orderBy(RANGE)  # as many rows as the entity has ranges
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entering = crossing.select(*keys, F.col(RANGE).alias("_into"), *[
        F.coalesce(
            F.last(f"_last{i}", ignorenulls=True).over(earlier),
            F.first(f"_first{i}", ignorenulls=True).over(whole),
        ).alias(f"_in{i}")
        for i in range(len(gaps))
    ])
    inner = Window.partitionBy(RANGE, *map(col, entity)).orderBy(*ranged.order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    # Where nothing came before, the first value of all is the next one. A frame that starts at each
    # row would be read to its end for each row.
    all_of = inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = ranged.df.withColumns({
        f"_{side}{i}": find(col(c), ignorenulls=True).over(window)
        for i, c in enumerate(gaps)
        for side, find, window in (("local", F.last, upto), ("next", F.first, all_of))})
    met = (F.col(RANGE) == F.col("_into"))
    for c, k in zip(entity, keys):
        met = met & col(c).eqNullSafe(F.col(k))
    place = {c: i for i, c in enumerate(gaps)}
    return inside.join(entering, met, "left").select(*[
        F.coalesce(*[F.col(f"_{x}{place[c]}") for x in ("local", "in", "next")]).alias(c)
        if c in place else col(c)
        for c in df.columns
    ])


def _typical_numbers(df, columns, strategy, medians) -> dict[str, tuple[float, str]]:
    """column -> (fill value, why) for numeric columns that have a value."""
    if not columns:
        return {}
    skew: dict[str, float] = {}
    if strategy == "auto":
        row = df.agg(*[
            F.when(F.min(as_double(c)) == F.max(as_double(c)), F.lit(0.0)).otherwise(
                adjusted_skewness(F.count(as_double(c)), F.skewness(as_double(c)))
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]).first()
        skew = {c: abs(row[f"s{i}"] or 0.0) for i, c in enumerate(columns)}
    by_median = [
        c for c in columns
        if strategy == "median" or (strategy == "auto" and skew[c] > SKEWED)
    ]
    by_mean = [c for c in columns if c not in by_median]
    out: dict[str, tuple[float, str]] = {}
    if by_median:
        middle = {c: medians[c] for c in by_median if c in medians}
        todo = [c for c in by_median if c not in middle]
        if todo:
            middle.update({c: q[0.5] for c, q in exact_quantiles(df, todo, (0.5,)).items()})
        why = "median: values are skewed" if strategy == "auto" else "median: as requested"
        out.update({c: (middle[c], why) for c in by_median})
    if by_mean:
        row = df.agg(*[F.avg(as_double(c)).alias(f"m{i}") for i, c in enumerate(by_mean)]).first()
        why = "mean: values are roughly symmetric" if strategy == "auto" else "mean: as requested"
        out.update({c: (row[f"m{i}"], why) for i, c in enumerate(by_mean)})
    return out


def _typical_categories(df, columns, rows, known) -> dict[str, str | None]:
    """column -> most frequent value as text, ties to the smallest; None when more than half of
    the rows differ. Such columns are told by their distinct counts first, so that their values
    (often long text) are never shuffled."""
    if not columns:
        return {}
    distinct = dict(known.unique)
    todo = [c for c in columns if c not in distinct]
    if todo:
        distinct.update({r["column"]: r["unique"] for r in distinct_counts(df, todo).collect()})
    few = [c for c in columns if distinct[c] <= rows * 0.5]
    out: dict[str, str | None] = dict.fromkeys(columns)
    top = {c: known.top[c] for c in few if c in known.top}
    top.update(top_values(df, [c for c in few if c not in top]))
    out.update({c: t.value for c, t in top.items()})
    return out


def impute_missing_values(
    df: DataFrame,
    time_column: str | None = None,
    numeric_strategy: str = "auto",
    categorical_strategy: str = "mode",
    *,
    tie_breaks: Sequence[str] = (),
    partition_by: str | Sequence[str] = (),
    rows_per_range: int | None = None,
    known: Known | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(frame without gaps, notes (column, fill_value, rationale)).

    With a time column all columns are first filled along time, each entity of ``partition_by``
    for itself. Then numbers get the median or
    mean (``auto``: the median when skewed), categories and flags the most frequent value, or
    "Unknown" when more than half of the rows differ. A flag column that must hold "Unknown"
    becomes text, and an integer column that had gaps becomes double. What is ``known`` of ``df`` is
    not computed again; a time fill makes that of the columns it touched obsolete."""
    df = C.nan_to_null(df)
    known = known or Known()
    looks = together({
        "counts": lambda: _filled_counts(df),
        "schema": lambda: known.schema or detect_column_types(df),
    })
    (rows, filled), schema = looks["counts"], looks["schema"]
    if not rows:
        return df, df.sparkSession.createDataFrame(
            [("warning", None, "empty table: nothing to fill")], NOTES)
    notes: list[tuple[str, str | None, str]] = []

    if time_column and time_column in df.columns:
        if any(0 < n < rows for n in filled.values()):
            entity = [partition_by] if isinstance(partition_by, str) else list(partition_by)
            df = materialize(
                _fill_along_time(
                    df, time_column, tie_breaks, rows, filled, rows_per_range, entity),
                "time-filled",
            )
            notes.append(("time_series", None, "last known value in time order, first one ahead"
                          + (f", per {', '.join(entity)}" if entity else "")))
        else:
            notes.append(("time_series", None, "no gaps to fill along time"))
        known = known.only({c for c, n in filled.items() if n == rows})
        if partition_by:        # an entity may have no value at all
            rows, filled = _filled_counts(df)
        else:
            filled = {c: rows if n else 0 for c, n in filled.items()}

    fills: dict[str, Column] = {}
    numbers = C.pick_numeric(df, schema.numeric)
    for c in numbers:
        if not filled[c]:
            notes.append((c, None, "left empty: no value to learn from"))
    text = set(C.columns_of_class(df, C.STRING, C.BOOLEAN))
    groups = [c for c in schema.categorical + schema.boolean if c in text]
    wanted = [c for c in groups if filled[c] and categorical_strategy != "unknown"]
    looks = together({
        "numbers": lambda: _typical_numbers(
            df, [c for c in numbers if filled[c]], numeric_strategy, known.medians),
        "groups": lambda: _typical_categories(df, wanted, rows, known),
    })
    typical, modes = looks["numbers"], looks["groups"]
    for c, (value, why) in typical.items():
        if filled[c] < rows:
            fills[c] = F.coalesce(as_double(c), F.lit(value))
        notes.append((c, f"{value:.4g}", why))

    for c in groups:
        if not filled[c]:
            value, why = UNKNOWN, "no value to learn from"
        elif categorical_strategy == "unknown":
            value, why = UNKNOWN, "as requested"
        elif modes[c] is None:
            value, why = UNKNOWN, "too many distinct values for a mode"
        else:
            value, why = modes[c], "most frequent value"
        if filled[c] < rows:
            is_flag = c in C.columns_of_class(df, C.BOOLEAN)
            if is_flag and value != UNKNOWN:
                fills[c] = F.coalesce(col(c), F.lit(value == "true"))
            else:
                fills[c] = F.coalesce(col(c).cast("string"), F.lit(value))
        notes.append((c, value, why))

    out = df.withColumns(fills) if fills else df
    return out, df.sparkSession.createDataFrame(notes, NOTES)


def handle_missing_values(
    df: DataFrame,
    time_column: str | None = None,
    numeric_strategy: str = "median",
    categorical_strategy: str = "mode",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """``impute_missing_values`` with the median by default."""
    return impute_missing_values(
        df, time_column, numeric_strategy, categorical_strategy, **options)
