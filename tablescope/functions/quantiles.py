"""Exact quantiles that never hold a column in one task.

``percentile`` keeps every distinct value of a column in one reducer. Here a mergeable sketch
first brackets each wanted rank, one counting pass proves the bracket, brackets that are still
wide are narrowed by a histogram, and only the few values left inside are ranked exactly.
Only counts and bounds reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, floor, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import as_double, chunks, col
from .ordered import (
    MAX_RANGES,
    RANGE,
    SAMPLES_PER_RANGE,
    VALUES_PER_RANGE,
    bounds_not_above,
)
from .skew import plain_join

SKETCH_ACCURACY = 2_000
SKETCH_ROWS = 1_000_000
MAX_IN_BRACKET = 500_000
SMALL_ROWS = 50_000  # up to here the whole column is the bracket
BINS = 1024
CENTRES_PER_PASS = 16  # five buffers each; code generation ends at a hundred
_COLUMNS_PER_PASS = 40


@dataclass
class _Target:
    """One wanted rank of one column, known to lie among the values in [low, high]."""

    column: str
    prob: float
    rank: int
    low: float
    high: float
    below: int = 0
    inside: int = 0

    def holds(self) -> bool:
        return self.below <= self.rank < self.below + self.inside

    def open(self, limit: int) -> bool:
        return self.low < self.high and self.inside > limit


@dataclass(frozen=True)
class Centre:
    """What the first pass tells about a column; later passes work on deviations from ``mean``."""

    rows: int
    count: int
    mean: float | None
    low: float | None
    high: float | None

    @property
    def constant(self) -> bool:
        return self.low == self.high

    @property
    def complete(self) -> bool:
        return self.count == self.rows


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    max_in_bracket: int = MAX_IN_BRACKET,
    sketch_accuracy: int = SKETCH_ACCURACY,
) -> dict[str, dict[float, float | None]]:
    """Linear-interpolation quantiles of numeric columns, missing values ignored."""
    return quantiles_and_centres(
        df, columns, probs, max_in_bracket=max_in_bracket, sketch_accuracy=sketch_accuracy)[0]


def quantiles_and_centres(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    max_in_bracket: int = MAX_IN_BRACKET,
    sketch_accuracy: int = SKETCH_ACCURACY,
) -> tuple[dict[str, dict[float, float | None]], dict[str, Centre]]:
    """The quantiles, and the counts, means and ranges the first pass saw on the way."""
    quantiles: dict[str, dict[float, float | None]] = {}
    centres: dict[str, Centre] = {}
    for part in chunks(list(columns), _COLUMNS_PER_PASS):
        q, c = _exact_quantiles(df, part, probs, max_in_bracket, sketch_accuracy)
        quantiles.update(q)
        centres.update(c)
    return quantiles, centres


def _exact_quantiles(df, columns, probs, limit, accuracy):
    values = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(columns)])
    names = {f"c{i}": c for i, c in enumerate(columns)}
    centres = {
        c: m for part in chunks(list(names), CENTRES_PER_PASS)
        for c, m in centres_of(values, part).items()
    }
    if max((m.rows for m in centres.values()), default=0) <= min(SMALL_ROWS, limit):
        targets = _targets(centres, probs, {})
    else:
        targets = _targets(centres, probs, _brackets(values, centres, probs, accuracy))
        _count_brackets(values, targets)
    for t in targets:
        if not t.holds():  # the sketch missed: start over from the whole range
            whole = centres[t.column]
            t.low, t.high, t.below, t.inside = whole.low, whole.high, 0, whole.count
    while any(t.open(limit) for t in targets):
        _narrow(values, [t for t in targets if t.open(limit)])
    found = _rank_exactly(values, targets)

    out: dict[str, dict[float, float | None]] = {}
    for c, name in names.items():
        out[name] = {}
        n = centres[c].count
        for p in probs:
            if n == 0:
                out[name][p] = None
                continue
            at = (n - 1) * p
            lo, hi = found[(c, floor(at))], found[(c, ceil(at))]
            out[name][p] = lo if lo == hi else lo + (hi - lo) * (at - floor(at))
    return out, {name: centres[c] for c, name in names.items()}


def centres_of(values: DataFrame, cols: Sequence[str]) -> dict[str, Centre]:
    """Row count, non-null count, mean and range of double columns: plain sums in one pass."""
    row = values.agg(
        F.count(F.lit(1)).alias("rows"),
        *[e for c in cols for e in (
            F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"),
            F.min(c).alias(f"l_{c}"), F.max(c).alias(f"h_{c}"),
        )],
    ).first()
    return {
        c: Centre(row["rows"], *[row[f"{k}_{c}"] for k in "nmlh"]) for c in cols
    }


def _brackets(values, centres, probs, accuracy) -> dict[tuple[str, float], tuple[float, float]]:
    """A sketch of a bounded sample brackets each rank. How good it is decides only how many
    values the later passes look at: every bracket is counted, and replaced if it missed."""
    live = [c for c, m in centres.items() if m.count and not m.constant]
    if not live:
        return {}
    fraction = min(1.0, SKETCH_ROWS / centres[live[0]].rows)
    sample = values.where(F.rand(seed=7) < fraction) if fraction < 1.0 else values
    margin = {
        c: 2.0 / accuracy + (
            2.5 / sqrt(max(1.0, fraction * centres[c].count)) if fraction < 1.0 else 0.0)
        for c in live
    }
    sketches = sample.agg(*[
        F.percentile_approx(c, F.array(*[
            F.lit(min(1.0, max(0.0, p + s * margin[c]))) for p in probs for s in (-1, 1)
        ]), accuracy).alias(c)
        for c in live
    ]).first()
    out = {}
    for c in live:
        if sketches[c] is None:
            continue
        for k, p in enumerate(probs):
            low = sketches[c][2 * k] if p - margin[c] > 0 else centres[c].low
            high = sketches[c][2 * k + 1] if p + margin[c] < 1 else centres[c].high
            out[(c, p)] = (low, high)
    return out


def _targets(centres, probs, brackets) -> list[_Target]:
    """The ranks each quantile lies between; without a bracket, anywhere in the column."""
    targets = []
    for c, m in centres.items():
        if not m.count:
            continue
        for p in probs:
            low, high = brackets.get((c, p), (m.low, m.high))
            at = (m.count - 1) * p
            targets += [
                _Target(c, p, r, low, high, 0, m.count) for r in sorted({floor(at), ceil(at)})
            ]
    return targets


def _count_brackets(values, targets):
    seen = _numbered(targets)
    counted: dict[int, tuple[int, int]] = {}
    for part in chunks(list(seen.items()), _COLUMNS_PER_PASS):
        row = values.agg(*[
            e for (c, low, high), i in part for e in (
                F.count(F.when(F.col(c) < low, 1)).alias(f"b{i}"),
                F.count(F.when(F.col(c).between(low, high), 1)).alias(f"i{i}"),
            )
        ]).first()
        counted.update({i: (row[f"b{i}"], row[f"i{i}"]) for _, i in part})
    for t in targets:
        t.below, t.inside = counted[seen[(t.column, t.low, t.high)]]


def _numbered(targets) -> dict[tuple[str, float, float], int]:
    """Number the distinct brackets; several ranks may share one."""
    brackets = dict.fromkeys((t.column, t.low, t.high) for t in targets)
    return {b: i for i, b in enumerate(brackets)}


def _inside(values, brackets: dict[tuple[str, float, float], int], mark) -> DataFrame:
    """Rows (t, v, x) for each value that falls into bracket t; most rows yield nothing."""
    any_bracket = F.lit(False)  # spares most rows the array below
    for c, low, high in brackets:
        any_bracket = any_bracket | F.col(c).between(low, high)
    entries = [
        F.when(
            F.col(c).between(low, high),
            F.struct(F.lit(i).alias("t"), F.col(c).alias("v"),
                     mark(F.col(c), low, high).alias("x")),
        )
        for (c, low, high), i in brackets.items()
    ]
    return (
        values.where(any_bracket).select(F.explode(F.array(*entries)).alias("e"))
        .where(F.col("e").isNotNull()).select("e.*")
    )


def _narrow(values, targets):
    """Cut each bracket into equal-width bins and keep the bin that holds the rank."""
    index = _numbered(targets)
    rows = _inside(values, index, _bin).groupBy("t", "x").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    ).collect()  # at most (BINS + 2) rows per bracket
    by_target: dict[int, list] = {}
    for r in rows:
        by_target.setdefault(r["t"], []).append(r)
    for t in targets:
        before = t.below
        for r in sorted(by_target[index[(t.column, t.low, t.high)]], key=lambda r: r["x"]):
            if t.rank < before + r["n"]:
                t.low, t.high, t.below, t.inside = r["lo"], r["hi"], before, r["n"]
                break
            before += r["n"]


def _bin(x: Column, low: float, high: float) -> Column:
    """Bin number, never decreasing in x. The two ends get bins of their own, so that every
    pass shrinks the bracket even when all but one value sit in the same bin."""
    width = high / BINS - low / BINS  # the difference itself could overflow
    inner = (
        F.least(F.lit(BINS), F.greatest(F.lit(1), F.floor((x - low) / width).cast("int") + 1))
        if 0 < width < float("inf") and high - low < float("inf")
        else F.when(x < low / 2 + high / 2, 1).otherwise(2)
    )
    return F.when(x == low, 0).when(x == high, BINS + 1).otherwise(inner)


def _rank_exactly(values, targets):
    found = {(t.column, t.rank): t.low for t in targets if t.low == t.high}
    rest = [t for t in targets if t.low < t.high]
    if not rest:
        return found
    index = _numbered(rest)
    wanted = F.array(*[
        F.struct(F.lit(index[(t.column, t.low, t.high)]).alias("t"),
                 F.lit(t.rank - t.below).cast("long").alias("r"))
        for t in rest
    ])
    upto = Window.partitionBy("t").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        _inside(values, index, lambda *_: F.lit(0))
        .groupBy("t", "v").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
        .withColumn("ranks", F.filter(wanted, lambda w: (w["t"] == F.col("t"))
                                      & (w["r"] < F.col("upto"))
                                      & (w["r"] >= F.col("upto") - F.col("n"))))
        .select("v", F.explode("ranks").alias("w")).select("v", "w.t", "w.r")
        .collect()  # one row per wanted rank
    )
    value = {(h["t"], h["r"]): h["v"] for h in hits}
    for t in rest:
        key = index[(t.column, t.low, t.high)]
        found[(t.column, t.rank)] = value[(key, t.rank - t.below)]
    return found


def grouped_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    rows: int,
    rows_per_range: int | None = None,
) -> DataFrame:
    """``grouped_medians`` of one column."""
    return grouped_medians(df, keys, [value], rows=rows, rows_per_range=rows_per_range)


def grouped_medians(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    *,
    rows: int,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Exact medians per group as (keys, values), for groups of any size; NULL for a group without
    values. The input is read once (and once more, in part, for boundaries of a large table).

    Cells carry the number of their column. Values of a column are cut into ranges common to all
    groups; counts per (group, column, range) tell which range holds the middle ranks, and only
    inside that range values are ranked. Missing values form a range of their own, so that no
    group is lost."""
    names = [f"_k{i}" for i in range(len(keys))]
    cells = df.select(*[col(k).alias(n) for k, n in zip(keys, names)], F.inline(F.array(*[
        F.struct(F.lit(i).alias("_m"), as_double(v).alias("_v")) for i, v in enumerate(values)])))
    cells = cells.withColumn(RANGE, _common_ranges(df, values, rows, rows_per_range))
    group = [*names, "_m"]
    counts = cells.groupBy(*group, RANGE, "_v").agg(F.count(F.lit(1)).alias("_n"))
    per_range = counts.where("_v IS NOT NULL").groupBy(*group, RANGE).agg(
        F.sum("_n").alias("_inside"))
    over_ranges = Window.partitionBy(*group).orderBy(RANGE)
    middle = (
        per_range.withColumns({
            "_below": F.sum("_inside").over(
                over_ranges.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inside"),
            "_total": F.sum("_inside").over(Window.partitionBy(*group)),
        })
        .withColumns({
            "_first": F.floor((F.col("_total") - 1) / 2),
            "_second": F.ceil((F.col("_total") - 1) / 2),
        })
        .where((F.col("_second") >= F.col("_below"))
               & (F.col("_first") < F.col("_below") + F.col("_inside")))
        .select(*group, RANGE, "_below", "_first", "_second")
    )
    inside = plain_join(counts.where("_v IS NOT NULL"), middle, [*group, RANGE], "inner")
    upto = Window.partitionBy(*group, RANGE).orderBy("_v").rowsBetween(
        Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_upto", F.col("_below") + F.sum("_n").over(upto))

    def held(rank: str) -> Column:
        return F.when((F.col(rank) < F.col("_upto"))
                      & (F.col(rank) >= F.col("_upto") - F.col("_n")), F.col("_v"))

    middles = ranked.select(*group, held("_first").alias("_a"), held("_second").alias("_b")).where(
        "_a IS NOT NULL OR _b IS NOT NULL")
    nothing = F.lit(None).cast("double")
    empty = counts.where("_v IS NULL").select(
        *group, nothing.alias("_a"), nothing.alias("_b")).union(middles)
    both = [(F.max(F.when(F.col("_m") == i, F.col("_a")))
             + F.max(F.when(F.col("_m") == i, F.col("_b")))) / 2 for i in range(len(values))]
    return empty.groupBy(*names).agg(*[b.alias(v) for b, v in zip(both, values)]).select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)], *[col(v) for v in values])


def _common_ranges(df: DataFrame, values: Sequence[str], rows: int, rows_per_range: int | None
                   ) -> Column:
    """The range number of a cell (_m, _v), from boundaries of all columns taken in one sample."""
    wanted = min(MAX_RANGES, ceil(rows / (rows_per_range or VALUES_PER_RANGE)))
    if wanted <= 1:
        return F.lit(0)
    fraction = min(1.0, wanted * SAMPLES_PER_RANGE / rows)
    sample = df.sample(fraction=fraction, seed=11) if fraction < 1.0 else df
    picked = sample.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("m"), as_double(v).alias("v")) for i, v in enumerate(values)
    ]))).where("v IS NOT NULL").orderBy("m", "v").collect()  # about SAMPLES_PER_RANGE a range
    number = F.lit(0)
    for i in range(len(values)):
        own = [r["v"] for r in picked if r["m"] == i]
        step = len(own) / wanted
        chosen = dict.fromkeys(own[int(step * k)] for k in range(1, wanted)) if own else {}
        if chosen:
            text = json.dumps([repr(v).replace("inf", "Infinity") for v in chosen])
            bounds = F.from_json(F.lit(text), "array<string>").cast("array<double>")
            number = F.when(F.col("_m") == i, bounds_not_above(
                bounds, len(chosen), F.col("_v"))).otherwise(number)
    return number
