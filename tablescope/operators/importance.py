"""Which columns carry the most information."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import as_double
from ..functions.counts import Top, top_values, value_counts
from .correlation import compute_correlation

SCORES = "column string, score double"
NEAR_ZERO = 1e-6


def calculate_feature_importance(
    df: DataFrame, numeric_cols: Sequence[str] | None = None, top_k: int = 3
) -> DataFrame:
    """(column, importance): variance times share of non-missing rows, the top_k largest."""
    chosen = C.pick_numeric(df, numeric_cols)
    if not chosen:
        return df.sparkSession.createDataFrame([], "column string, importance double")
    agg = df.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        *[F.struct(F.var_pop(as_double(c)).alias("var"),
                   F.count(as_double(c)).alias("n")).alias(f"c{i}")
          for i, c in enumerate(chosen)],
    ).where("rows > 0")
    rows = C.one_row_to_rows(agg, [
        F.struct(F.lit(c).alias("column"),
                 (F.col(f"c{i}.var") * F.col(f"c{i}.n") / F.col("rows")).alias("importance"))
        for i, c in enumerate(chosen)
    ])
    return rows.orderBy(F.desc_nulls_last("importance"), "column").limit(top_k)


def spread_and_completeness(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """column -> (population variance, share of non-missing rows), collected."""
    out = {}
    for part in C.chunks(list(columns), 20):
        row = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.struct(F.var_pop(as_double(c)).alias("var"),
                       F.count(as_double(c)).alias("n")).alias(f"c{i}")
              for i, c in enumerate(part)],
        ).first()
        for i, c in enumerate(part):
            r = row[f"c{i}"]
            out[c] = (r["var"], r["n"] / (row["rows"] or 1))
    return out


def numeric_importance(
    df: DataFrame,
    numeric_cols: Sequence[str] | None = None,
    exclude_cols: Sequence[str] | None = None,
    top_k: int = 5,
    *,
    corr: DataFrame | None = None,
) -> DataFrame:
    """(column, score): variance relative to the largest, times completeness, times one plus the
    strongest correlation with another kept column. Columns with next to no variance are left
    out. ``corr`` may pass a correlation that is already computed."""
    chosen = [c for c in C.pick_numeric(df, numeric_cols) if c not in set(exclude_cols or ())]
    info = spread_and_completeness(df, chosen) if chosen else {}
    known = {c: v for c, v in info.items() if v[0] is not None}
    top = max((v for v, _ in known.values()), default=0.0)
    kept = [c for c, (v, _) in known.items() if v > top * NEAR_ZERO]
    scale = max((known[c][0] for c in kept), default=0.0) + 1e-8
    signal = dict.fromkeys(kept, 0.0)
    if len(kept) > 1:
        found = compute_correlation(df, kept) if corr is None else corr
        for r in found.where(
            F.col("col_a").isin(kept) & F.col("col_b").isin(kept)
            & (F.col("col_a") != F.col("col_b"))
        ).groupBy("col_a").agg(F.max(F.abs("corr")).alias("best")).collect():
            signal[r["col_a"]] = r["best"] or 0.0
    scores = [(c, known[c][0] / scale * known[c][1] * (1 + signal[c])) for c in kept]
    best = sorted(scores, key=lambda s: -s[1])[:top_k]
    return df.sparkSession.createDataFrame(best, SCORES)


def categorical_importance(
    df: DataFrame,
    categorical_cols: Sequence[str],
    exclude_cols: Sequence[str] | None = None,
    top_k: int = 5,
) -> DataFrame:
    """(column, score): share of distinct values, times how evenly they are spread (entropy over
    its maximum), times completeness. Shares are of all rows, missing ones included."""
    flat = [f.name for f in df.schema.fields if C.type_class(f.dataType) != C.OTHER]
    chosen = [c for c in categorical_cols if c in flat and c not in set(exclude_cols or ())]
    if not chosen:
        return df.sparkSession.createDataFrame([], SCORES)
    rows = df.count()
    p = F.col("n") / F.lit(float(rows or 1))
    per_column = value_counts(df, chosen, short=True).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique"), F.sum("n").alias("filled"),
        F.sum(-p * F.ln(p)).alias("entropy"),
    )
    balance = F.when(
        F.col("unique") > 1, F.col("entropy") / F.ln(F.col("unique").cast("double"))
    ).otherwise(0.0)
    order = F.create_map(*[x for i, c in enumerate(chosen) for x in (F.lit(c), F.lit(i))])
    names = df.sparkSession.createDataFrame([(c,) for c in chosen], "column string")
    return (
        names.join(per_column, "column", "left")
        .select("column", F.coalesce(
            F.col("unique") / float(rows or 1) * balance * F.col("filled") / float(rows or 1),
            F.lit(0.0)).alias("score"))
        .orderBy(F.desc("score"), order[F.col("column")]).limit(top_k)
    )


def calculate_advanced_feature_importance(
    df: DataFrame,
    numeric_cols: Sequence[str] | None = None,
    categorical_cols: Sequence[str] | None = None,
    exclude_cols: Sequence[str] | None = None,
    top_k: int = 5,
    *,
    corr: DataFrame | None = None,
) -> dict[str, object]:
    """Scores of numeric and of categorical columns, identifiers left out of both."""
    return {
        "numeric": numeric_importance(df, numeric_cols, exclude_cols, top_k, corr=corr),
        "categorical": categorical_importance(df, categorical_cols or (), exclude_cols, top_k),
        "excluded_identifiers": list(exclude_cols or ()),
    }


def dominant_categories(
    df: DataFrame,
    columns: Sequence[str],
    *,
    known: Mapping[str, Top] | None = None,
) -> DataFrame:
    """(column, value, ratio): the most frequent value and its share of all rows; among equally
    frequent values the smallest text. ``known`` may pass top values of columns of ``df``."""
    flat = [f.name for f in df.schema.fields if C.type_class(f.dataType) != C.OTHER]
    chosen = [c for c in columns if c in flat]
    found = {c: known[c] for c in chosen if known and c in known}
    found.update(top_values(df, [c for c in chosen if c not in found]))
    rows = df.count() if found else 0
    return df.sparkSession.createDataFrame(
        [(c, t.value, t.n / rows) for c, t in found.items()],
        "column string, value string, ratio double")
