"""Group-by views: roll-up, drill-down, slice, dice, pivot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from math import prod
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.aggregates import AggFunc, aggregate
from ..functions.columns import col
from ..functions.ordered import VALUES_PER_RANGE
from ..functions.quantiles import grouped_medians
from ..sources.names import unique_names

AggSpec = AggFunc | Mapping[str, AggFunc]


def _expression(
    df: DataFrame, name: str, func: AggFunc, order_by: Sequence[str] | None
) -> Column:
    kind = df.schema[name].dataType
    return aggregate(
        func, name, is_float=isinstance(kind, (T.FloatType, T.DoubleType)),
        is_whole=isinstance(kind, T.IntegralType), order_by=order_by)


def _func_for(aggfunc: AggSpec, name: str) -> AggFunc | None:
    return aggfunc.get(name) if isinstance(aggfunc, Mapping) else aggfunc


def _flags_as_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    flags = [c for c in names if c in C.columns_of_class(df, C.BOOLEAN)]
    return df.withColumns({c: col(c).cast("int") for c in flags}) if flags else df


def group_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    aggfunc: AggSpec,
    *,
    order_by: Sequence[str] | None = None,
    median_limit: int = VALUES_PER_RANGE,
) -> DataFrame:
    """keys + one aggregate per metric, missing keys kept as a group.

    All functions but the median combine map-side, so a hot key is no hot task. Medians of all
    metrics come from one plan that ranks values in ranges of about ``median_limit`` rows."""
    df = _flags_as_numbers(C.nan_to_null(df, keys), metrics)
    funcs = {m: _func_for(aggfunc, m) for m in metrics}
    funcs = {m: f for m, f in funcs.items() if f is not None}
    medians = [m for m, f in funcs.items() if f == "median"]
    direct = [m for m in funcs if m not in medians]
    found = []
    if direct or not medians:
        found.append(df.groupBy(*[col(k) for k in keys]).agg(
            *([_expression(df, m, funcs[m], order_by) for m in direct] or [F.count(F.lit(1))])
        ).select(*[col(k) for k in keys], *[col(m) for m in direct]))
    if medians:
        found.append(grouped_medians(
            df, keys, medians, rows=df.count(), rows_per_range=median_limit))
    # Both hold every group.
    out = found[0] if len(found) == 1 else _join_on_keys(*found, keys)
    return out.select(*[col(k) for k in keys], *[col(m) for m in funcs])


def _join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys, missing equal to missing. The right keys get names of their own, as both
    sides may come from the same table."""
    other = right.select(
        *[col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        *[col(c) for c in right.columns if c not in keys])
    condition = None
    for i, k in enumerate(keys):
        part = col(k).eqNullSafe(F.col(f"_key{i}"))
        condition = part if condition is None else condition & part
    return left.join(other, condition, "left").drop(*[f"_key{i}" for i in range(len(keys))])


def rollup(
    df: DataFrame,
    group_cols: Sequence[str],
    metrics: Sequence[str],
    aggfunc: AggSpec = "sum",
    *,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Group by the given columns and aggregate the metrics. Unknown columns are left out."""
    keys, chosen = C.existing(df, group_cols), C.existing(df, metrics)
    if not keys or not chosen:
        raise ValueError("A roll-up needs a group column and a metric that exist.")
    return group_aggregate(df, keys, chosen, aggfunc, order_by=order_by)


def drilldown(
    df: DataFrame,
    hierarchy: Sequence[str],
    metrics: Sequence[str],
    aggfunc: AggSpec = "sum",
    *,
    all_levels: bool = False,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """The finest level of a hierarchy; ``all_levels`` adds every coarser level, with the number
    of used hierarchy columns as ``level``."""
    if not all_levels:
        return rollup(df, hierarchy, metrics, aggfunc, order_by=order_by)
    keys, chosen = C.existing(df, hierarchy), C.existing(df, metrics)
    if not keys or not chosen:
        raise ValueError("A drill-down needs a hierarchy column and a metric that exist.")
    funcs = {m: f for m in chosen if (f := _func_for(aggfunc, m)) is not None}
    if "median" in funcs.values():
        return _levels_apart(df, keys, list(funcs), funcs, order_by)
    df = _flags_as_numbers(C.nan_to_null(df, keys), chosen)
    used = sum(
        (F.lit(1) - F.grouping(col(k)).cast("int") for k in keys), start=F.lit(0)
    ).alias("level")
    return df.rollup(*[col(k) for k in keys]).agg(
        used, *[_expression(df, m, f, order_by) for m, f in funcs.items()])


def _levels_apart(df, keys, metrics, funcs, order_by) -> DataFrame:
    """All levels of a hierarchy, each grouped on its own: medians of a coarse level do not
    follow from those of a finer one, and a group may be the whole table."""
    parts = []
    for used in range(len(keys), -1, -1):
        some = keys[:used]
        # The grand total is the one group of a constant.
        whole = df if some else df.withColumn("_all", F.lit(1))
        found = group_aggregate(whole, some or ["_all"], metrics, funcs, order_by=order_by)
        parts.append(found.select(
            *[col(k) if k in some else F.lit(None).cast(df.schema[k].dataType).alias(k)
              for k in keys],
            F.lit(used).alias("level"), *[col(m) for m in metrics]))
    return C.union_all(parts)


def _matches(name: str, wanted: Any) -> Column:
    if isinstance(wanted, tuple) and len(wanted) == 2:
        return col(name).between(*wanted)
    if isinstance(wanted, (list, set, frozenset)):
        return col(name).isin(*wanted)
    return col(name) == F.lit(wanted)


def slice_olap(
    df: DataFrame,
    filters: Mapping[str, Any],
    metrics: Sequence[str],
    aggfunc: AggSpec = "sum",
    *,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Keep rows with the given values and aggregate them by the filter columns."""
    for name in C.existing(df, filters):
        df = df.where(col(name) == F.lit(filters[name]))
    return rollup(df, list(filters), metrics, aggfunc, order_by=order_by)


def dice(
    df: DataFrame,
    conditions: Mapping[str, Any],
    metrics: Sequence[str],
    aggfunc: AggSpec = "sum",
    *,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """As a slice over several columns; a list means any of these, a pair (low, high) a range."""
    for name in C.existing(df, conditions):
        df = df.where(_matches(name, conditions[name]))
    return rollup(df, list(conditions), metrics, aggfunc, order_by=order_by)


def _levels(df: DataFrame, name: str) -> list:
    """Distinct values, missing last. The result gets a column or a dense row per value, so
    their number is limited as for any Spark pivot."""
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    rows = df.select(col(name)).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(
            f"'{name}' has more than {limit} values (spark.sql.pivotMaxValues). "
            "Group by it instead, or pass dense=False for an index column.")
    return sorted((r[0] for r in rows), key=lambda v: (v is None, v if v is not None else 0))


def _label(value: Any) -> str:
    return "nan" if value is None else str(value)


def pivot_analysis(
    df: DataFrame,
    index: Sequence[str],
    columns: Sequence[str] | None = None,
    values: str | Sequence[str] | None = None,
    aggfunc: AggFunc = "sum",
    fill_value: Any = 0,
    *,
    dense: bool = False,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Cross-tabulation: one row per index value, one column ``value_columnvalue`` per value and
    combination of column values; empty cells get ``fill_value``; missing keys are kept.

    ``dense`` gives every combination of the values of several index columns. Two columns that
    would have one name are told apart by a number."""
    keys, across = C.existing(df, index), C.existing(df, columns)
    if values is None:
        values = [c for c in C.numeric_columns(df) if c not in keys and c not in across]
    chosen = sorted(C.existing(df, [values] if isinstance(values, str) else values))
    if not keys or not chosen:
        raise ValueError("A pivot needs an index column and a value column that exist.")

    df = _flags_as_numbers(C.nan_to_null(df, [*keys, *across]), chosen)
    exprs = [_expression(df, v, aggfunc, order_by) for v in chosen]
    if across:
        levels = [_levels(df, c) for c in across]
        limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        if prod(len(vs) for vs in levels) > limit:
            raise ValueError(
                f"{' x '.join(across)} has more than {limit} combinations "
                "(spark.sql.pivotMaxValues). Group by them instead.")
        combos = list(product(*levels))
        part = [F.create_map(*[F.lit(x) for i, v in enumerate(vs) if v is not None
                               for x in (v, str(i))])
                if any(v is not None for v in vs) else None for vs in levels]
        code = F.concat_ws("|", *[
            F.coalesce(p[col(c)], F.lit(str(len(vs) - 1))) if p is not None else F.lit("0")
            for p, c, vs in zip(part, across, levels)
        ])
        codes = ["|".join(str(i) for i in at)
                 for at in product(*[range(len(vs)) for vs in levels])]
        coded = df.withColumn("_cell", code)
        if aggfunc == "median":
            # one row per cell by the grouped median, which the pivot only has to move
            coded = group_aggregate(coded, [*keys, "_cell"], chosen, aggfunc)
            exprs = [F.first(col(v), ignorenulls=True).alias(v) for v in chosen]
        wide = coded.groupBy(*[col(k) for k in keys]).pivot("_cell", codes).agg(*exprs)
        labels = ["_".join(_label(x) for x in combo) for combo in combos]
        # Spark lists the pivot value first, then the aggregate
        wanted = [f"{v}_{label}".strip("_") for v in chosen for label in labels]
        shown = unique_names([*keys, *wanted])[len(keys):]
        at = {(v, i): shown[k * len(labels) + i] for k, v in enumerate(chosen)
              for i in range(len(labels))}
        wide = wide.toDF(*keys, *[at[v, i] for i in range(len(labels)) for v in chosen])
    else:
        wide = group_aggregate(df, keys, chosen, aggfunc, order_by=order_by)
        shown = chosen
    if dense and len(keys) > 1:
        wide = _every_combination(df, keys, wide)

    def cell(name: str) -> Column:
        if fill_value is None:
            return col(name)
        return F.coalesce(col(name), F.lit(fill_value)).alias(name)

    return wide.select(*[col(k) for k in keys], *[cell(n) for n in shown])


def _every_combination(df: DataFrame, keys: Sequence[str], wide: DataFrame) -> DataFrame:
    """All combinations of the index values: the first column's values as a distributed frame,
    each row exploded by the collected values of the others."""
    grid = df.select(col(keys[0])).distinct()
    for k in keys[1:]:
        kind = df.schema[k].dataType
        grid = grid.withColumn(
            k, F.explode(F.array(*[F.lit(v).cast(kind) for v in _levels(df, k)])))
    return _join_on_keys(grid, wide, keys)
