"""Roles of columns (identifier, metric, dimension, time, target) and the class of a table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import as_double, col
from ..functions.counts import distinct_counts
from .inference import TableSchema, text_shares

# How a report names the reasons for calling a column an identifier.
BY_NAME, BY_SHARE, BY_SHARE_OF_TEXT = (
    "name_contains_id", "high_cardinality_{:.1%}", "high_cardinality_categorical")

# Parts of a name that mark a numeric identifier.
IDENTIFIER_WORDS = ("id", "postal", "code")
IDENTIFIER_SHARE = 0.9
MAX_DIMENSION_VALUES = 50


@dataclass(frozen=True)
class ColumnRoles:
    target_like: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    dimensions: list[str] = field(default_factory=list)
    metrics: list[str] = field(default_factory=list)
    temporal: list[str] = field(default_factory=list)
    identifier_reasons: dict[str, list[str]] = field(default_factory=dict)

    def to_frame(self, df: DataFrame) -> DataFrame:
        """(column, role, reason); a target-like column also appears as a metric."""
        rows = [
            (c, role, ", ".join(self.identifier_reasons.get(c, ())) if role == "identifier" else "")
            for role, names in (
                ("identifier", self.identifiers), ("metric", self.metrics),
                ("dimension", self.dimensions), ("temporal", self.temporal),
                ("target_like", self.target_like),
            )
            for c in names
        ]
        return df.sparkSession.createDataFrame(rows, "column string, role string, reason string")


def infer_column_semantics(
    df: DataFrame, schema: TableSchema, *, unique: Mapping[str, int] | None = None
) -> ColumnRoles:
    """Roles from distinct counts, variances and completeness, all aggregated by Spark.
    ``unique`` may pass distinct counts that are already known."""
    flat = {f.name for f in df.schema.fields if C.type_class(f.dataType) != C.OTHER}
    numeric = [c for c in schema.numeric if c in flat]
    categorical = [c for c in schema.categorical if c in flat]
    known = dict(unique or {})
    missing = [c for c in dict.fromkeys(numeric + categorical) if c not in known]
    if missing:
        known.update({r["column"]: r["unique"] for r in distinct_counts(df, missing).collect()})
    typed = C.pick_numeric(df, numeric)
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.struct(F.var_samp(as_double(c)).alias("var"),
                   F.count(as_double(c)).alias("n")).alias(f"c{i}")
          for i, c in enumerate(typed)],
    ).first()
    rows = stats["rows"] or 1

    identifiers, reasons, metrics, dimensions = [], {}, [], []
    for c in numeric:
        share = known[c] / rows
        why = []
        if any(w in c.lower() for w in IDENTIFIER_WORDS):
            why.append(BY_NAME)
        if share > IDENTIFIER_SHARE:
            why.append(BY_SHARE.format(share))
        if why:
            identifiers.append(c)
            reasons[c] = why
        else:
            metrics.append(c)
    for c in categorical:
        share = known[c] / rows
        if share > IDENTIFIER_SHARE:
            identifiers.append(c)
            reasons[c] = [BY_SHARE_OF_TEXT, f"{share:.1%}"]
        elif known[c] < MAX_DIMENSION_VALUES:
            dimensions.append(c)

    spread = {c: stats[f"c{i}"] for i, c in enumerate(typed) if c in metrics}
    variances = [s["var"] for s in spread.values() if s["var"] is not None]
    middle = median(variances) if variances else 0.0
    target = [
        c for c, s in spread.items()
        if s["var"] is not None and s["var"] > middle and s["n"] / rows > 0.8
    ][:1]
    return ColumnRoles(target, identifiers, dimensions, metrics, list(schema.datetime), reasons)


def classify_dataset(
    df: DataFrame, schema: TableSchema, roles: ColumnRoles,
    *, unique: Mapping[str, int] | None = None,
) -> str:
    """feature_dataset, temporal_dataset, analytical_dataset or unknown."""
    dims = C.existing(df, roles.dimensions)
    known = dict(unique or {})
    todo = [c for c in dims if c not in known]
    if todo:
        known.update({r["column"]: r["unique"] for r in distinct_counts(df, todo).collect()})
    dims = [c for c in dims if known[c] < MAX_DIMENSION_VALUES]
    times = valid_time_columns(df, roles.temporal)
    if roles.metrics and not dims and not times:
        return "feature_dataset"
    if roles.metrics and times:
        return "temporal_dataset"
    if roles.metrics and dims:
        return "analytical_dataset"
    return "unknown"


def valid_time_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those that hold a timestamp in more than half of the rows."""
    columns = C.existing(df, columns)
    typed = [c for c in columns if c in C.columns_of_class(df, C.DATETIME)]
    text = [c for c in columns if c in C.columns_of_class(df, C.STRING)]
    share = {
        c: s.datetime for c, s in text_shares(df, text, of_all_rows=True).items()
    }
    if typed:
        row = df.agg(F.count(F.lit(1)), *[F.count(col(c)) for c in typed]).first()
        share.update({c: row[i] / (row[0] or 1) for i, c in enumerate(typed, start=1)})
    return [c for c in columns if share.get(c, 0.0) > 0.5]
