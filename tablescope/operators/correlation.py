"""Pairwise correlation in long form (col_a, col_b, corr), and readings of it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from itertools import combinations
from math import sqrt

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import as_double
from ..functions.ordered import RANGE, running_counts, running_counts_beside, split_by_value
from ..functions.quantiles import Centre
from ..functions.skew import attach
from ..storage import materialize, new_folder, remove, tidy
from .stats import centres

CORRELATION = "col_a string, col_b string, corr double"
RANK_BLOCK = 1_000_000
_COMPLETE_PAIRS_PER_PASS = 45
_GAPPY_PAIRS_PER_PASS = 10
_GAPPY_MEANS_PER_PASS = 40
_SHARED_PER_PASS = 200
_FEW_PASSES = 2
_FEW_VALUES = 20_000    # tables of so many ranks are sent to the rows
_MANY_BESIDE, _FEW_BESIDE = 2, 6    # columns that rows take along to the ranks of another


def compute_correlation(
    df: DataFrame,
    numeric_cols: Sequence[str] | None = None,
    method: str = "pearson",
    *,
    known: Mapping[str, Centre] | None = None,
    rows_per_range: int | None = None,
    rank_block: int = RANK_BLOCK,
) -> DataFrame:
    """Full symmetric matrix over rows where both columns have a value. A column without spread
    has no correlation, not even with itself. ``known`` may pass centres of columns of ``df``."""
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError(f"Unknown correlation method '{method}'.")
    chosen = C.pick_numeric(df, numeric_cols)
    if not chosen:
        return df.sparkSession.createDataFrame([], CORRELATION)
    names = {f"c{i}": c for i, c in enumerate(chosen)}
    values = df.select(*[as_double(c).alias(k) for k, c in names.items()])
    centre = {k: known[c] for k, c in names.items() if known and c in known}
    centre.update(centres(values, [k for k in names if k not in centre]))
    live = [k for k in names if not centre[k].constant]
    pairs = list(combinations(live, 2))

    if method == "pearson":
        parts = _pearson(values, pairs, centre)
    elif method == "spearman":
        parts = _spearman(values, live, pairs, centre, rows_per_range)
    else:
        parts = _kendall(values, pairs, centre, rows_per_range, rank_block)

    fixed = [(k, k, 1.0) for k in live]
    dead = [k for k in names if k not in live]
    fixed += [(a, b, None) for a in dead for b in names]
    fixed += [(a, b, None) for a in live for b in dead]
    known = df.sparkSession.createDataFrame(
        [(names[a], names[b], r) for a, b, r in fixed], CORRELATION)
    if not parts:
        return known
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    upper = C.union_all(parts).select(
        label[F.col("a")].alias("col_a"), label[F.col("b")].alias("col_b"), F.col("corr"))
    both = upper.select(F.explode(F.array(
        F.struct("col_a", "col_b", "corr"),
        F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), F.col("corr")),
    )).alias("r")).select("r.*")
    return known.unionByName(both)


def _cosine(product: Column, square_a: Column, square_b: Column) -> Column:
    length = F.nullif(F.sqrt(square_a) * F.sqrt(square_b), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product / length))


def _pair_row(a: str, b: str, r: Column) -> Column:
    return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.cast("double").alias("corr"))


def _pearson(values: DataFrame, pairs, centre: dict[str, Centre]) -> list[DataFrame]:
    """Sums of products of deviations from the column means: one buffer per pair, in one pass
    over the columns concerned."""
    def dev(c: str) -> Column:
        return F.col(c) - F.lit(centre[c].mean)

    complete = [p for p in pairs if centre[p[0]].complete and centre[p[1]].complete]
    gappy = [p for p in pairs if p not in set(complete)]
    parts = []
    if len(complete) / _COMPLETE_PAIRS_PER_PASS > _FEW_PASSES:
        parts.append(_pearson_of_many(values, complete, centre))
        complete = []
    for part in C.chunks(complete, _COMPLETE_PAIRS_PER_PASS):
        used = sorted({c for p in part for c in p})
        agg = values.agg(
            *[F.sum(dev(c) * dev(c)).alias(f"v_{c}") for c in used],
            *[F.sum(dev(a) * dev(b)).alias(f"p_{a}_{b}") for a, b in part],
        )
        parts.append(C.one_row_to_rows(agg, [
            _pair_row(a, b, _cosine(F.col(f"p_{a}_{b}"), F.col(f"v_{a}"), F.col(f"v_{b}")))
            for a, b in part
        ]))
    # The rows a pair shares may lie far from the columns' means, so each pair has means of its
    # own, found in a pass before.
    means = {}
    for part in C.chunks(gappy, _GAPPY_MEANS_PER_PASS):
        row = values.agg(*[
            F.struct(F.avg(F.when(F.col(b).isNotNull(), F.col(a))),
                     F.avg(F.when(F.col(a).isNotNull(), F.col(b)))).alias(f"{a}_{b}")
            for a, b in part]).first()
        means.update({p: tuple(row[f"{p[0]}_{p[1]}"]) for p in part})
    for part in C.chunks(gappy, _GAPPY_PAIRS_PER_PASS):
        sums = []
        for a, b in part:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            da, db = (F.when(both, F.col(c) - F.lit(m).cast("double"))
                      for c, m in zip((a, b), means[a, b]))
            sums.append(F.struct(
                F.count(da).alias("n"), F.sum(da).alias("sa"), F.sum(db).alias("sb"),
                F.sum(da * da).alias("saa"), F.sum(db * db).alias("sbb"),
                F.sum(da * db).alias("sab"),
                (F.min(da) < F.max(da)).alias("va"), (F.min(db) < F.max(db)).alias("vb"),
            ).alias(f"{a}_{b}"))
        parts.append(C.one_row_to_rows(values.agg(*sums), [
            _pair_row(a, b, _from_sums(F.col(f"{a}_{b}"))) for a, b in part
        ]))
    return parts


def _pearson_of_many(values: DataFrame, pairs, centre: dict[str, Centre]) -> DataFrame:
    """The same sums for many columns without gaps in a single pass: all are inner products of
    deviations from the means, cells of one Gram matrix, whose size depends on the number of
    columns only."""
    live = sorted({c for p in pairs for c in p})
    at = {c: i for i, c in enumerate(live)}
    cells = [F.col(c) - F.lit(centre[c].mean) for c in live]
    vectors = values.select(array_to_vector(F.array(*cells)).alias("v"))
    gram = RowMatrix(
        MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()
    found = []
    for a, b in pairs:
        i, j = at[a], at[b]
        length = sqrt(float(gram[i, i])) * sqrt(float(gram[j, j]))
        r = max(-1.0, min(1.0, float(gram[i, j]) / length)) if length else None
        found.append((a, b, r))
    return values.sparkSession.createDataFrame(found, "a string, b string, corr double")


def _from_sums(s: Column) -> Column:
    n = s["n"].cast("double")
    cov = s["sab"] - s["sa"] * s["sb"] / n
    va = s["saa"] - s["sa"] * s["sa"] / n
    vb = s["sbb"] - s["sb"] * s["sb"] / n
    return F.when(s["va"] & s["vb"], _cosine(cov, va, vb))


def _ranked(values: DataFrame, columns, rows: int, rows_per_range) -> DataFrame:
    """Replace each column (none has missing values) by its average rank. Every rank table comes
    from the values themselves; only the lookups are chained."""
    out = values.select(*columns)
    for c in columns:
        table = running_counts(
            values, c, rows=rows, positions=False, rows_per_range=rows_per_range
        ).select(c, (F.col("before") + (F.col("n") + 1) / 2).alias("_rank"))
        others = [k for k in columns if k != c]
        out = attach(out, table, c, rows=rows, like=values).select(
            *others, F.col("_rank").alias(c))
    return out


def _spearman(values, live, pairs, centre, rows_per_range) -> list[DataFrame]:
    """Pearson of average ranks. Columns without gaps are ranked once; the ranks of a pair with
    gaps count the rows it shares."""
    whole = [k for k in live if centre[k].complete]
    parts = []
    if len(whole) > 1:
        rows = centre[whole[0]].rows
        ranks = _ranked(values, whole, rows, rows_per_range)
        middle = Centre(rows, rows, (rows + 1) / 2, 1.0, float(rows))
        parts += _pearson(ranks, list(combinations(whole, 2)), {c: middle for c in whole})
    gappy = [p for p in pairs if not (centre[p[0]].complete and centre[p[1]].complete)]
    return parts + (_spearman_with_gaps(values, gappy, centre, rows_per_range) if gappy else [])


def _spearman_with_gaps(values, pairs, centre, rows_per_range) -> list[DataFrame]:
    """A pair's ranks count only the rows that have both columns.

    Columns of few values get theirs from broadcast tables, all pairs of them in a few passes. Of any
    other pair the column with more values is ranked first, beside a few others at a time
    (`_cross_sums`): rows are sent with the values of these only, never with ranks. Each step
    is a job of its own, whose shuffle files go when it ends."""
    used = sorted({c for p in pairs for c in p})
    rows = centre[used[0]].rows
    shared = _shared_rows(values, used)
    sizes = values.agg(*[F.approx_count_distinct(a).alias(a) for a in used]).first()
    few = {a for a in used if sizes[a] <= _FEW_VALUES}
    many = sorted((a for a in used if a not in few), key=lambda a: (-sizes[a], a))
    wanted = {frozenset(p): p for p in pairs}
    splits = {a: split_by_value(values.where(F.col(a).isNotNull()).select(a), a, rows=rows,
                                rows_per_range=rows_per_range) for a in used} if many else {}
    found = []
    for i, a in enumerate(many):
        found += _spearman_with(values, a, [
            [b for b in others if frozenset((a, b)) in wanted]
            for others in (many[i + 1:], sorted(few))], wanted, splits, shared, rows, rows_per_range)
    parts = [values.sparkSession.createDataFrame(found, "a string, b string, corr double")] if found else []
    pairs = [p for p in pairs if few.issuperset(p)]
    return parts + (_spearman_of_few(values, pairs, rows, shared, rows_per_range) if pairs else [])


@contextmanager
def _written(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """The frame as a table that is deleted afterwards; made within `tidy`."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove(df.sparkSession, path)


def _spearman_with(values, a, others, wanted, splits, shared, rows, rows_per_range) -> list[tuple]:
    """(column, column, correlation) of a column with the others, of which there are those of many
    and those of few values. One table holds the ranks of the values beside each of the others."""
    every = [*others[0], *others[1]]
    if not every:
        return []
    whole = "int" if rows < 1 << 30 else "bigint"
    found = []
    with tidy(values.sparkSession):
        counts = running_counts_beside(values, a, every, rows=rows, rows_per_range=rows_per_range)
        table = counts.select(a, *[
            (2 * F.col(f"before{i}") + F.col(f"n{i}") + 1).cast(whole).alias(f"rank_{b}")
            for i, b in enumerate(every)])
        with _written(table, "ranks") as table:
            for some, at_once in zip(others, (_MANY_BESIDE, _FEW_BESIDE)):
                for part in C.chunks(some, at_once):
                    corr = _cross_sums(values, a, part, table, splits, shared, rows)
                    found += [(*wanted[frozenset((a, b))], corr.get(b)) for b in part]
    return found


def _cross_sums(values, a, others, table, splits, shared, rows) -> dict[str, float]:
    """The correlation of the ranks of a column with those of each of the others.

    A row looks up the ranks of its value of `a` beside each of the others. Their deviations from the
    mean are summed per value of the other column, copies folded before the shuffle; how many there are
    gives the ranks of that one."""
    middle = [(shared[a, b] + 1) / 2 for b in others]
    has = F.col(a).isNotNull() & F.coalesce(*others).isNotNull()
    ranked = attach(values.where(has).select(a, *others), table.select(a, *[f"rank_{b}" for b in others]),
                    a, rows=rows, like=values.where(has).select(a))
    lone = ranked.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("other"), F.col(b).alias("v"), (F.col(f"rank_{b}") / 2 - F.lit(m)).alias("x"))
        for i, (b, m) in enumerate(zip(others, middle))]))).where("v IS NOT NULL")
    sums = lone.groupBy("other", "v").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    with _written(sums, "sums") as sums:
        at = F.lit(0)
        for i, b in enumerate(others):
            at = F.when(F.col("other") == i, splits[b].number).otherwise(at)
        placed = sums.select("*", *[F.col("v").alias(b) for b in others]).select(*sums.columns, at.alias(RANGE))
        upto = Window.partitionBy("other", RANGE).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        earlier = Window.partitionBy("other").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        carried = placed.groupBy("other", RANGE).agg(F.sum("n").alias("n")).select(
            "other", RANGE, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried"))
        within = placed.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        own = F.col("before") + F.col("carried") + (F.col("n") + 1) / 2 - F.get(
            F.array(*map(F.lit, middle)), F.col("other"))
        cross = within.join(carried, ["other", RANGE]).groupBy("other").agg(
            F.sum("q").alias("aa"), F.sum(F.col("n") * own * own).alias("bb"),
            F.sum(F.col("s") * own).alias("ab"))
        corr = F.when((F.col("aa") > 0) & (F.col("bb") > 0),
                      _cosine(F.col("ab"), F.col("aa"), F.col("bb")))
        return {others[r["other"]]: r["corr"] for r in cross.select("other", corr.alias("corr")).collect()}


def _spearman_of_few(values, pairs, rows, shared, rows_per_range) -> list[DataFrame]:
    """One table per column holds the ranks of its values beside every other column, or beside one of
    those that are missing in the same rows; it is sent to the rows."""
    used = sorted({c for p in pairs for c in p})
    beside: dict[str, list[str]] = {}
    place: dict[tuple[str, str], int] = {}
    for a in used:
        kinds = beside.setdefault(a, [])
        for b in sorted({y for x, y in [*pairs, *[p[::-1] for p in pairs]] if x == a}):
            same = next((k for k in kinds if shared[b, b] == shared[k, k] == shared[b, k]), None)
            if same is None:
                kinds.append(b)
            place[a, b] = kinds.index(same or b)
    whole = "int" if rows < 1 << 30 else "bigint"
    ranks = values.select(*used)
    for a in used:
        counts = running_counts_beside(
            values, a, beside[a], rows=rows, rows_per_range=rows_per_range)
        table = counts.select(a, F.array(*[
            (2 * F.col(f"before{i}") + F.col(f"n{i}") + 1).cast(whole)
            for i in range(len(beside[a]))]).alias(f"rank_{a}"))
        ranks = attach(ranks, table, a, rows=rows, few=True).drop(a)
    parts = []
    for part in C.chunks(pairs, _GAPPY_PAIRS_PER_PASS):
        sums = []
        for a, b in part:
            both = F.col(f"rank_{a}").isNotNull() & F.col(f"rank_{b}").isNotNull()
            middle = F.lit((shared[a, b] + 1) / 2)
            da, db = (F.when(both, F.get(F.col(f"rank_{x}"), F.lit(place[x, y])) / 2 - middle)
                      for x, y in ((a, b), (b, a)))
            sums.append(F.struct(F.sum(da * da).alias("aa"), F.sum(db * db).alias("bb"),
                                 F.sum(da * db).alias("ab")).alias(f"{a}_{b}"))
        found = [F.col(f"{a}_{b}") for a, b in part]
        parts.append(C.one_row_to_rows(ranks.agg(*sums), [
            _pair_row(a, b, F.when((s["aa"] > 0) & (s["bb"] > 0), _cosine(s["ab"], s["aa"], s["bb"])))
            for (a, b), s in zip(part, found)]))
    return parts


def _shared_rows(values: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], int]:
    """Number of rows that have both columns, for all pairs, both ways and with themselves."""
    found: dict[tuple[str, str], int] = {}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    for part in C.chunks(pairs, _SHARED_PER_PASS):
        row = values.agg(*[
            F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"{a}_{b}")
            for a, b in part]).first()
        for a, b in part:
            found[a, b] = found[b, a] = row[f"{a}_{b}"]
    return found


def _kendall(values, pairs, centre, rows_per_range, block) -> list[DataFrame]:
    """Values are replaced by their positions among the distinct values of their column, once per
    column; all pairs then go through one plan, told apart by their number."""
    if not pairs:
        return []
    used = sorted({c for p in pairs for c in p})
    rows = centre[used[0]].rows
    placed = values.select(*used)
    for c in used:
        table = running_counts(values, c, rows=rows, rows_per_range=rows_per_range).select(
            c, F.col("position").alias(f"place_{c}"))
        placed = attach(placed, table, c, rows=rows, like=values.where(F.col(c).isNotNull()),
                        missing=not centre[c].complete)
    placed = placed.select(*[f"place_{c}" for c in used])
    if len(pairs) > 1:
        placed = materialize(placed, "places")
    distinct = placed.agg(*[F.max(f"place_{c}").alias(c) for c in used]).first()
    # The column with fewer distinct values is cut by bits: fewer levels.
    ordered = [p if distinct[p[0]] >= distinct[p[1]] else p[::-1] for p in pairs]
    levels = [max(1, distinct[y].bit_length()) for _, y in ordered]
    wide = max(distinct[x] for x, _ in ordered) >= block
    tau = _tau_b(placed.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(f"place_{x}").alias("x"), F.col(f"place_{y}").alias("y"))
        for i, (x, y) in enumerate(ordered)]))).where("x IS NOT NULL AND y IS NOT NULL"),
        levels, block, wide)
    names = values.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    return [names.join(tau, "pair", "left").select("a", "b", "corr")]


def _pairs_of(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def _tau_b(rows: DataFrame, levels: Sequence[int], block: int, wide: bool) -> DataFrame:
    """(pair, corr): Kendall's tau-b of the rows (pair, x, y) in n log n rows.

    x and y are positions among distinct values. Two rows differ first, from the top, in exactly
    one bit of y: at that level they share the bits above it. So concordant pairs are, per (level,
    bits above), the rows with bit 1 times the rows with bit 0 at a smaller x, which is a running
    sum along x. Blocks of a fixed width of x bound every window partition, and blocks are linked
    by their sums where a column is ``wide`` enough for several."""
    grid = rows.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    top = F.get(F.array(*[F.lit(n - 1) for n in levels]), F.col("pair"))
    leveled = grid.select(
        "pair", "x", "y", "w", F.explode(F.sequence(F.lit(0), top)).alias("level")
    ).select(
        "pair", "x", "w", "level",
        F.expr("shiftright(y, level + 1)").alias("above"),
        F.expr("shiftright(y, level) % 2 = 1").alias("bit"),
    )
    cells = leveled.groupBy("pair", "level", "above", "x").agg(
        F.sum(F.when(F.col("bit"), 0).otherwise(F.col("w"))).alias("zeros"),
        F.sum(F.when(F.col("bit"), F.col("w")).otherwise(0)).alias("ones"),
    ).withColumn("block", F.floor(F.col("x") / block))
    group = ["pair", "level", "above"]
    earlier = Window.partitionBy(*group, "block").orderBy("x").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = cells.withColumn("smaller", F.coalesce(F.sum("zeros").over(earlier), F.lit(0)))
    if wide:
        before = Window.partitionBy(*group).orderBy("block").rowsBetween(
            Window.unboundedPreceding, -1)
        carried = cells.groupBy(*group, "block").agg(F.sum("zeros").alias("z")).select(
            *group, "block", F.coalesce(F.sum("z").over(before), F.lit(0)).alias("carried"))
        sums = sums.join(carried, [*group, "block"]).withColumn(
            "smaller", F.col("smaller") + F.col("carried"))
    found = sums.groupBy("pair").agg(F.coalesce(
        F.sum(F.col("ones").cast("double") * F.col("smaller")), F.lit(0.0)).alias("c"))

    def tied(*keys: str) -> DataFrame:
        return grid.groupBy("pair", *keys).agg(F.sum("w").alias("w")).groupBy("pair").agg(
            F.sum(_pairs_of(F.col("w"))).alias("t" + "".join(keys)))

    for table in (tied("x"), tied("y"), tied("x", "y"), tied()):
        found = found.join(table, "pair")
    pairs = F.col("t")
    return found.select("pair", (
        (2 * F.col("c") - (pairs - F.col("tx") - F.col("ty") + F.col("txy")))
        / F.nullif(F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty"))), F.lit(0.0))
    ).alias("corr"))


def identify_strong_relationships(corr: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(column, related): for each column the others correlated at least that strongly."""
    return (
        corr.where((F.col("col_a") != F.col("col_b")) & (F.abs("corr") >= threshold))
        .groupBy(F.col("col_a").alias("column"))
        .agg(F.sort_array(F.collect_list("col_b")).alias("related"))
    )


def signed_pairs(corr: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(col_a, col_b, corr, sign), each pair once in name order."""
    return corr.where(
        (F.col("col_a") < F.col("col_b")) & (F.abs("corr") >= threshold)
    ).select(
        "col_a", "col_b", "corr",
        F.when(F.col("corr") > 0, "positive").otherwise("negative").alias("sign"),
    )


def correlation_matrix(corr: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide form: one row per column, one value column per column."""
    return (
        corr.withColumnRenamed("col_a", "column").groupBy("column")
        .pivot("col_b", list(columns)).agg(F.first("corr"))
    )
