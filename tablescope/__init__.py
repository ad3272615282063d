"""Exploratory analytics on Spark DataFrames."""

from .operators.correlation import (
    compute_correlation,
    correlation_matrix,
    identify_strong_relationships,
    signed_pairs,
)
from .operators.dates import auto_extract_date_features
from .operators.importance import (
    calculate_advanced_feature_importance,
    calculate_feature_importance,
    dominant_categories,
)
from .operators.impute import fill_along_time, handle_missing_values, impute_missing_values
from .operators.inference import (
    TableSchema,
    conversion_losses,
    detect_column_types,
    detect_mixed_types,
    validate_and_convert_types,
)
from .operators.joins import merge_statistics, merge_tables, safe_merge_tables
from .operators.olap import dice, drilldown, pivot_analysis, rollup, slice_olap
from .operators.quality import (
    detect_duplicates,
    detect_missing_values,
    duplicate_count,
    summarize_schema,
)
from .operators.roles import ColumnRoles, classify_dataset, infer_column_semantics
from .operators.schema import (
    detect_schema,
    ensure_datetime,
    find_columns_by_keywords,
    find_datetime_column,
    find_datetime_column_heuristic,
)
from .operators.stats import (
    describe_numerical,
    describe_numerical_dict,
    iqr_outlier_summary,
)
from .operators.temporal import (
    aggregate_time,
    detect_temporal_anomalies,
    detect_trend,
    rolling_average,
)
from .plans.insights import generate_insights
from .plans.report import Report, run_pipeline
from .sources.names import normalize_column_name, normalize_columns
from .sources.tables import load_dataframe, safe_load_dataframe, save_report

__all__ = [name for name in dir() if not name.startswith("_")]
