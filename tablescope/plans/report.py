"""One call from an unknown table to a cleaned table and a report of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import col
from ..functions.counts import distinct_counts, top_values
from ..operators.correlation import CORRELATION, compute_correlation, signed_pairs
from ..operators.importance import (
    calculate_advanced_feature_importance,
    dominant_categories,
)
from ..operators.impute import Known, handle_missing_values
from ..operators.inference import (
    LOSSES,
    TableSchema,
    conversion_losses,
    declared_types,
    text_shares,
    validate_and_convert_types,
)
from ..operators.olap import dice, pivot_analysis, rollup, slice_olap
from ..operators.quality import detect_missing_values, duplicate_count, summarize_schema
from ..operators.roles import ColumnRoles, classify_dataset, infer_column_semantics
from ..operators.schema import detect_schema
from ..operators.stats import describe_numerical, numeric_profile
from ..operators.temporal import (
    ANOMALY_COUNT,
    aggregate_time,
    detect_temporal_anomalies,
    detect_trend,
    rolling_average,
)
from ..sources.names import normalize_columns
from ..storage import materialize, together
from .insights import INSIGHTS, generate_insights, insight_rows


@dataclass(frozen=True)
class Report:
    """``sections`` maps a name to a DataFrame; the rest is what the driver decided on the way."""

    sections: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    schema: TableSchema = field(default_factory=TableSchema)
    roles: ColumnRoles = field(default_factory=ColumnRoles)
    dataset_type: str = "unknown"
    datetime_column: str | None = None
    duplicates: int = 0

    def __getitem__(self, section: str) -> DataFrame:
        return self.sections[section]

    def keys(self):
        return self.sections.keys()

    def items(self):
        return self.sections.items()


def _settled(df: DataFrame) -> DataFrame:
    """Compute a section that has a row per column or pair once, instead of at every use."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def run_pipeline(
    df: DataFrame, *, approx_distinct: bool = False
) -> tuple[DataFrame, Report]:
    """(clean table, report). Whatever the table cannot support is a warning, not an error. The
    table is read many times: unless it is a projection of parquet or ORC files, it is written
    once to the shared folder first.

    The typed table (if text was parsed) and the table filled along time (if it had gaps) are
    written once to the shared folder, so that the many column-wise passes read only their own
    columns and never repeat that work; other fills are constants in a projection. Sections with
    a row per column are settled; sections with a row per group or period stay lazy on the clean
    table."""
    spark = df.sparkSession
    if df.isEmpty():
        return df, _empty_report(df)
    sections: dict[str, DataFrame] = {}
    warnings: list[str] = []

    source = normalize_columns(df)
    if not _is_columnar(source):
        source = materialize(source, "source")
    shares = text_shares(source, C.columns_of_class(source, C.STRING))
    typed = validate_and_convert_types(source, shares=shares)
    sections["conversion"] = conversion_losses(source, shares=shares)
    if _is_derived(source, typed):
        typed = materialize(typed, "typed")
    by_value = declared_types(typed)
    schema = detect_schema(typed, verify=True, by_value=by_value)
    numbers = C.numeric_columns(typed)
    flat = {f.name for f in typed.schema.fields if C.type_class(f.dataType) != C.OTHER}
    grouping = [c for c in schema.categorical if c in flat]
    others = [c for c in typed.columns if c in flat and c not in grouping]
    first = together({
        "top": lambda: top_values(typed, grouping),
        "distinct": lambda: _distinct(typed, others, approx_distinct),
        "missing": lambda: _settled(detect_missing_values(typed)),
        "duplicates": lambda: _settled(duplicate_count(typed)),
        "profile": lambda: numeric_profile(typed, numbers),
    })
    profile, top, distinct = (first.pop(k) for k in ("profile", "top", "distinct"))
    counted = {**dict.fromkeys(flat, 0), **distinct, **{c: t.unique for c, t in top.items()}}
    sections["summary"] = _settled(summarize_schema(typed, known=counted))
    sections["schema"] = schema.to_frame(typed)
    sections.update(first)
    duplicates = sections["duplicates"].first()["duplicates"]

    missing = {r["column"]: r["missing_count"] for r in sections["missing"].collect()}
    whole = [c for c, n in missing.items() if not n]
    unique = {
        r["column"]: r["unique"]
        for r in sections["summary"].collect()
        if r["column"] in whole and r["unique"] is not None
        and (r["column"] in top or not approx_distinct)
    }
    date_col = schema.datetime[0] if schema.datetime else None
    clean, notes = handle_missing_values(
        typed, date_col, "median", "mode",
        known=Known(by_value, {c: q[0.5] for c, q in profile.quartiles.items()}, unique, top))
    sections["cleaning"] = notes

    # columns without gaps are the same in the clean table, so what is known of them holds
    numbers = C.numeric_columns(clean)
    profile = numeric_profile(clean, numbers, profile.only(whole))
    second = together({
        "stats": lambda: _settled(describe_numerical(clean, known=profile)),
        "correlation": lambda: _correlation(clean, numbers, profile),
        "dominant_categories": lambda: dominant_categories(
            clean, schema.categorical, known={c: v for c, v in top.items() if c in whole}),
        "roles": lambda: infer_column_semantics(clean, schema, unique=unique),
        "rows": clean.count,
    })
    roles, rows = second.pop("roles"), second.pop("rows")
    sections.update(second)
    stats, corr = sections["stats"], sections["correlation"]
    sections["outliers"] = stats.select("column", "outlier_count", "outlier_ratio")
    sections["roles"] = roles.to_frame(clean)
    metric = next(iter([*roles.metrics, *numbers]), None)
    third = together({
        "pairs": lambda: _settled(signed_pairs(corr)),
        "scores": lambda: calculate_advanced_feature_importance(
            clean, schema.numeric, schema.categorical, roles.identifiers, corr=corr),
        "kind": lambda: classify_dataset(clean, schema, roles, unique=unique),
        "temporal": lambda: _temporal(clean, date_col, metric, numbers, roles.identifiers),
        "olap": lambda: _olap(clean, schema, roles),
    })
    sections["correlation_pairs"] = pairs = third["pairs"]
    sections["importance_numeric"] = third["scores"]["numeric"]
    sections["importance_categorical"] = third["scores"]["categorical"]
    for part in ("temporal", "olap"):
        found, said = third[part]
        sections.update(found)
        warnings += said

    insights = generate_insights(
        rows=rows, duplicates=duplicates,
        missing=sections["missing"].collect(), stats=stats.collect(), pairs=pairs.collect(),
        identifiers=roles.identifiers, identifier_reasons=roles.identifier_reasons,
        dominant=sections["dominant_categories"].collect(), dataset_type=third["kind"],
    )
    sections["insights"] = spark.createDataFrame(insight_rows(insights), INSIGHTS)
    return clean, Report(
        sections, warnings, schema, roles, third["kind"], date_col, duplicates)


def _distinct(typed, columns, approx) -> dict[str, int]:
    if not columns:
        return {}
    found = distinct_counts(typed, columns, approx=approx).collect()
    return {r["column"]: r["unique"] for r in found}


def _correlation(clean, numbers, profile) -> DataFrame:
    if not numbers:
        return clean.sparkSession.createDataFrame([], CORRELATION)
    return _settled(compute_correlation(clean, numbers, known=profile.centres))


def _is_derived(source: DataFrame, typed: DataFrame) -> bool:
    """Whether conversion changed any type, so that every later pass would parse text again."""
    return [f.dataType for f in source.schema] != [f.dataType for f in typed.schema]


def _is_columnar(source: DataFrame) -> bool:
    """Whether a pass over some columns reads only these: a projection of parquet or ORC files, or
    of rows that Spark holds. Anything else (text files, joins, other sources) would be parsed or
    computed again in every pass."""
    node = source._jdf.queryExecution().sparkPlan()
    while node.nodeName() in ("Project", "Filter", "ColumnarToRow"):
        node = node.children().apply(0)
    return node.nodeName().startswith(
        ("Scan parquet", "Scan orc", "LocalTableScan", "InMemoryTableScan"))


def _empty_report(df: DataFrame) -> Report:
    """The sections that need no values, all without rows but those that count them."""
    spark = df.sparkSession
    source = normalize_columns(df)
    kinds = declared_types(source)
    return Report({
        "schema": kinds.to_frame(source), "summary": summarize_schema(source),
        "missing": detect_missing_values(source), "duplicates": duplicate_count(source),
        "conversion": spark.createDataFrame([], LOSSES),
        "correlation": spark.createDataFrame([], CORRELATION),
        "anomalies": source, "insights": spark.createDataFrame([], INSIGHTS),
        "anomaly_count": spark.createDataFrame([(0, 2.0)], ANOMALY_COUNT),
    }, ["The table is empty."], kinds)


def _temporal(clean, date_col, metric, numbers, identifiers
              ) -> tuple[dict[str, DataFrame], list[str]]:
    spark = clean.sparkSession
    nothing = {"anomalies": clean.limit(0),
               "anomaly_count": spark.createDataFrame([(0, 2.0)], ANOMALY_COUNT)}
    if date_col is None:
        return nothing, ["No date column: no time series."]
    # sums of identifiers tell nothing
    added = [c for c in numbers if c not in identifiers] or numbers
    out = nothing | {
        "time_series": aggregate_time(clean, date_col, values=added),
        "time_rolling": rolling_average(clean, date_col),
    }
    if metric is None:
        return out, ["No numeric column: no trend."]
    found = detect_temporal_anomalies(clean, date_col, metric)
    out["anomalies"] = found["anomalies"]
    out.update(together({
        "anomaly_count": lambda: _settled(found["count"]),
        "trend": lambda: _settled(detect_trend(clean, date_col, metric)),
    }))
    return out, []


def _olap(clean, schema, roles) -> tuple[dict[str, DataFrame], list[str]]:
    flat = [f.name for f in clean.schema.fields if C.type_class(f.dataType) != C.OTHER]
    dims = [c for c in schema.categorical if c in flat]
    dims = [c for c in dims if c not in roles.identifiers] or dims  # groups of one tell nothing
    numbers = C.pick_numeric(clean, schema.numeric)
    if not dims or not numbers:
        return {}, ["No category and number to group: no OLAP views."]
    first, metric = dims[0], numbers[0]
    second = dims[1] if len(dims) > 1 else None
    out, warnings = {"olap_rollup": rollup(clean, [first], [metric])}, []
    try:
        out["olap_pivot"] = pivot_analysis(clean, [first], [second] if second else None, metric)
    except ValueError as error:
        # too many columns for a wide table: the same cells, one per row
        out["olap_pivot"] = rollup(clean, [first, second] if second else [first], [metric])
        warnings.append(f"The pivot is in long form: {error}")
    low = clean.agg(*[F.min(col(c)).alias(f"v{i}") for i, c in enumerate(dims[:2])]).first()
    if low["v0"] is not None:
        out["olap_slice"] = slice_olap(clean, {first: low["v0"]}, [metric])
        if second and low["v1"] is not None:
            out["olap_dice"] = dice(clean, {first: low["v0"], second: low["v1"]}, [metric])
    return out, warnings
