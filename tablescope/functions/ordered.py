"""Order-dependent work without a one-task sort.

A window without PARTITION BY would send every row to one task. Instead the order key is cut
into ranges at boundaries sampled from the data; each range is one window partition, and what
a range needs from the ranges before it (a count, a sum, a last value) is a one-row-per-range
table joined back by range number.

Boundaries hold the order column *and* its tie-breaks, so a single timestamp (or NULL) that
fills a third of the table is still cut into many ranges, and so are copies of one row. Text
enters a boundary as a prefix first; where texts agree on the prefix and their range is too full,
the boundaries inside that range are taken anew with a longer one, up to MAX_TEXT characters. They
are collected once and put into the plan as a constant: every branch of a query, and every retry of a
lost task, sees the same boundaries. They influence balance only, never results.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import OTHER, STRING, col, type_class

ROWS_PER_RANGE = 500_000        # whole rows, of any width
VALUES_PER_RANGE = 2_000_000    # a value and a count each
MAX_RANGES = 65_536
SAMPLES_PER_RANGE = 10
RANGE = "_range"
FIRST_TEXT, MAX_TEXT, LONGER = 32, 8192, 4    # characters of a text in a boundary, per level
BOUND_BYTES = 64 << 20                          # boundaries as text; no further level beyond
_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


@dataclass(frozen=True)
class Ranged:
    """A frame with its range number, and the full order inside a range. `number` gives the range
    of any row that has the columns."""

    df: DataFrame
    order: tuple[Column, ...]
    ranges: int
    number: Column

    def window(self) -> WindowSpec:
        return Window.partitionBy(RANGE).orderBy(*self.order)

    def order_struct(self) -> Column:
        """The order as one comparable value, for min_by / max_by."""
        return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.order)])


def total_order(
    df: DataFrame, by: str, ties: Sequence[str] = (), within: Sequence[str] = ()
) -> tuple[Column, ...]:
    """Missing last, then by value, by the given tie-breaks, and by a hash of the row, so that
    the order does not depend on how rows are spread; only exact copies stay tied. ``within``
    comes before all of these: the rows of an entity follow each other."""
    flat = [f.name for f in df.schema.fields if type_class(f.dataType) != OTHER]
    rest = [t for t in ties if t != by]
    return (*map(col, within), col(by).isNull(), col(by), *map(col, rest),
            F.xxhash64(*map(col, flat)))


def split_by_order(
    df: DataFrame,
    by: str,
    ties: Sequence[str] = (),
    *,
    rows: int,
    rows_per_range: int | None = None,
    within: Sequence[str] = (),
) -> Ranged:
    """Ranges along ``total_order``. ``rows`` is the (approximate) row count of ``df``.

    Exact copies of one row are interchangeable, so a large group of them is cut further by the
    partition it was read from."""
    order = total_order(df, by, ties, within)
    names = [*within, None, by, *[t for t in ties if t != by], None]
    texts = {i for i, name in enumerate(names)
             if name is not None and type_class(df.schema[name].dataType) == STRING}
    return _split(df, [*order, F.spark_partition_id()], order, rows,
                  rows_per_range or ROWS_PER_RANGE, texts)


def split_by_value(
    df: DataFrame, value: str, *, rows: int, rows_per_range: int | None = None
) -> Ranged:
    """Ranges of values: all copies of one value share a range."""
    return _split(df, [col(value)], (col(value),), rows, rows_per_range or VALUES_PER_RANGE)


def _split(df, bound, order, rows, rows_per_range, texts: Collection[int] = ()) -> Ranged:
    """``texts`` are the places in ``bound`` that hold text."""
    wanted = min(MAX_RANGES, ceil(rows / rows_per_range)) if rows else 1
    single = Ranged(df.withColumn(RANGE, F.lit(0)), order, 1, F.lit(0))
    if wanted <= 1:
        return single

    fields = [c.alias(f"k{i}") for i, c in enumerate(bound)]
    kinds = df.select(*fields).schema
    fraction = min(1.0, wanted * SAMPLES_PER_RANGE / rows)
    step = None
    chosen: list[str] = []
    part, length = df.withColumn(RANGE, F.lit(0)), FIRST_TEXT
    while True:
        found = _sampled_keys(part, fields, texts, length, fraction)
        step = step or max(1.0, len(found) / wanted)
        chosen, full = _with_picks(chosen, found, step)
        if not chosen:
            return single
        used = 1 + max(_last_used(c) for c in chosen)
        at = bounds_not_above(*_as_key(chosen, kinds, fields[:used], bound[:used]))
        length *= LONGER
        if not full or length > MAX_TEXT or sum(map(len, chosen)) > BOUND_BYTES:
            return Ranged(df.withColumn(RANGE, at), order, len(chosen) + 1, at)
        part = df.withColumn(RANGE, at).where(F.col(RANGE).isin(full))


def _sampled_keys(df, fields, texts, length, fraction) -> list[tuple[int, str, bool]]:
    """(range, key as JSON, whether a text in it was cut) in order, from a sample of the rows.

    What follows a cut text is left out: it says nothing on the order of longer texts."""
    sample = df.sample(fraction=fraction, seed=11) if fraction < 1.0 else df
    rows = sample.select(RANGE, *fields)
    cut = F.lit(False)
    keys, names = [], [f"k{i}" for i in range(len(fields))]
    for i, name in enumerate(names):
        value = F.substring(F.col(name), 1, length) if i in texts else F.col(name)
        keys.append(F.when(~cut, value).alias(name))
        if i in texts:
            cut = cut | F.coalesce(F.length(F.col(name)) > length, F.lit(False))
    picked = rows.select(RANGE, *keys, cut.alias("cut")).orderBy(RANGE, *names)
    # About SAMPLES_PER_RANGE * MAX_RANGES short keys at most.
    return [tuple(r) for r in picked.select(
        RANGE, F.to_json(F.struct(*names), _JSON), "cut").collect()]


def _with_picks(chosen: list[str], found: list[tuple[int, str, bool]], step: float
                ) -> tuple[list[str], list[int]]:
    """The boundaries with one more after every ``step`` sampled keys of a range, and the numbers
    of ranges that hold two steps or more of keys that were cut alike."""
    out: list[str] = []
    full: list[int] = []
    of_range: dict[int, list[tuple[str, bool]]] = {}
    for number, key, cut in found:
        of_range.setdefault(number, []).append((key, cut))
    for number in range(len(chosen) + 1):
        if number:
            out.append(chosen[number - 1])
        own = of_range.get(number, ())
        picks = [own[int(step * i)] for i in range(1, ceil(len(own) / step))
                 if int(step * i) < len(own)]
        for (key, cut), again in zip(picks, [None, *picks]):
            if not out or key != out[-1]:
                out.append(key)
            if cut and again == (key, cut) and full[-1:] != [len(out)]:
                full.append(len(out))
    return out, full


def _last_used(key: str) -> int:
    """Place of the last field that a boundary names; missing ones sort first anyway."""
    return max((int(k[1:]) for k in json.loads(key)), default=0)


def _as_key(chosen, kinds, fields, bound) -> tuple[Column, int, Column]:
    kept = T.StructType(kinds.fields[:len(fields)])
    bounds = F.from_json(F.lit("[" + ",".join(chosen) + "]"), T.ArrayType(kept), _JSON)
    if len(fields) == 1:  # a bare value compares faster than a struct
        return bounds["k0"], len(chosen), bound[0]
    return bounds, len(chosen), F.struct(*fields)


def bounds_not_above(bounds: Column, count: int, key: Column) -> Column:
    """How many of the sorted boundaries are <= key, found by halving.

    The key enters through ``transform``, so that it is an argument of the expression and not a
    column captured inside a lambda: the optimizer loses track of captured columns when it copies
    the expression into filters on the other side of a join. The result is never NULL, which
    spares such filters altogether."""
    jumps = F.array(*[F.lit(1 << i) for i in reversed(range(count.bit_length()))])

    def search(k: Column) -> Column:
        return F.aggregate(
            jumps, F.lit(0),
            lambda at, jump: F.when(F.get(bounds, at + jump - 1) <= k, at + jump).otherwise(at),
        )

    return F.coalesce(F.get(F.transform(F.array(key), search), 0), F.lit(0))


def running_counts(
    df: DataFrame,
    value: str,
    *,
    rows: int,
    positions: bool = True,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Per distinct non-null value: ``n`` rows, rows ``before`` it, and (unless switched off) its
    ``position`` 0..m-1.

    Copies are folded map-side before the shuffle, so a value that fills a third of the table is
    one row; ranges therefore hold distinct values only. The rows of a range are counted without
    any such shuffle; only positions need the distinct values of a range counted as well."""
    ranged = split_by_value(
        df.where(col(value).isNotNull()).select(col(value)),
        value, rows=rows, rows_per_range=rows_per_range,
    )
    counts = ranged.df.groupBy(RANGE, col(value)).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy(RANGE).orderBy(col(value))
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    found = {"before": F.coalesce(F.sum("n").over(upto), F.lit(0))}
    if positions:
        found["position"] = (F.row_number().over(within) - 1).cast("long")
    out = counts.withColumns(found)
    if ranged.ranges > 1:
        totals = ranged.df.groupBy(RANGE).agg(
            F.count(F.lit(1)).alias("c_before"),
            *([F.count_distinct(col(value)).alias("c_position")] if positions else []),
        )
        carried = carried_sums(totals, {f"c_{k}": f"in_{k}" for k in found})
        out = out.join(carried, RANGE).withColumns(
            {k: F.col(k) + F.col(f"in_{k}") for k in found})
    return out.select(col(value), "n", *found)


def running_counts_beside(
    df: DataFrame,
    value: str,
    others: Sequence[str],
    *,
    rows: int,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Per distinct non-null value, for each of the other columns: ``n0``, ``n1``, ... rows that have
    both, and ``before0``, ... rows with a smaller value that have the other column, too.

    One table serves all the other columns: copies are folded map-side with a count for each."""
    ranged = split_by_value(
        df.where(col(value).isNotNull()).select(col(value), *[
            col(o).isNotNull().alias(f"_has{i}") for i, o in enumerate(others)]),
        value, rows=rows, rows_per_range=rows_per_range,
    )
    names = range(len(others))
    counts = ranged.df.groupBy(RANGE, col(value)).agg(
        *[F.count_if(f"_has{i}").alias(f"n{i}") for i in names])
    upto = Window.partitionBy(RANGE).orderBy(col(value)).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.withColumns(
        {f"before{i}": F.coalesce(F.sum(f"n{i}").over(upto), F.lit(0)) for i in names})
    if ranged.ranges > 1:
        totals = ranged.df.groupBy(RANGE).agg(
            *[F.count_if(f"_has{i}").alias(f"t{i}") for i in names])
        carried = carried_sums(totals, {f"t{i}": f"in{i}" for i in names})
        out = out.join(carried, RANGE).withColumns(
            {f"before{i}": F.col(f"before{i}") + F.col(f"in{i}") for i in names})
    return out.drop(RANGE, *[f"in{i}" for i in names])


def carried_sums(per_range: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums over the one-row-per-range table (at most MAX_RANGES rows)."""
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select(
        RANGE,
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(t) for s, t in sums.items()],
    )
