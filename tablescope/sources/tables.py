"""Reading tables and writing result sections."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import PurePath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..functions.skew import estimated_bytes
from .records import cells_of, quoted_records

# Cell texts that mean "missing" in a CSV file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


LARGE_CSV_BYTES = 256 << 20


def load_dataframe(
    spark: SparkSession, source: str | PurePath | DataFrame, *,
    large_bytes: int = LARGE_CSV_BYTES, **options
) -> DataFrame:
    """Read a table: .parquet / .parq typed, anything else as CSV with every column text.

    A DataFrame passes through. ``options`` go to the Spark reader. A CSV row shorter than the
    header misses its last cells; one that is longer is an error. Large files are read in splits,
    also where quoted cells hold line breaks (unless options change how CSV is written); CSV of
    less than ``large_bytes`` is left to Spark's own reader, a file a task."""
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, (str, PurePath)):
        raise ValueError(f"Cannot load a table from {type(source).__name__}.")
    path = str(source)
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix in (".xls", ".xlsx"):
        raise ValueError("Excel files are not supported; save the sheet as CSV or parquet.")
    try:
        if suffix in (".parquet", ".parq"):
            return spark.read.options(**options).parquet(path)
        return _read_csv(spark, path, options, large_bytes)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            raise FileNotFoundError(f"No table at {path}") from error
        raise


def _read_csv(
    spark: SparkSession, path: str, options: Mapping, large_bytes: int = LARGE_CSV_BYTES
) -> DataFrame:
    settings = {"header": True, "quote": '"', "escape": '"', **options}
    large = estimated_bytes(spark.read.text(path)) >= large_bytes
    broken = "multiLine" not in settings and (not large or _breaks_lines(spark, path))
    if "multiLine" not in settings:
        settings["multiLine"] = broken
    names = spark.read.options(**settings).csv(path).columns
    # Spark drops cells beyond the header without a word; with one column more they are seen.
    more = "more_cells"
    while more in names:
        more += "_"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, more]])
    if large and broken and not options:
        raw = cells_of(quoted_records(spark, path), len(schema)).toDF(*schema.names)
    else:
        raw = spark.read.schema(schema).options(**{**settings, "enforceSchema": True}).csv(path)
    told = F.raise_error(F.concat(
        F.lit("A row has more cells than the header; the first is: "), col(more)))
    whole = raw.where(F.when(col(more).isNotNull(), told.cast("boolean")).otherwise(F.lit(True)))
    return whole.select(*[
        F.when(~col(c).isin(*MISSING_TOKENS), col(c)).alias(c) for c in names
    ])


def _breaks_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell may hold a line break: a cell is open at the end of a line only after
    an odd number of quotes, hence if every line has an even number, none breaks."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.where(quotes % 2 == 1).isEmpty()


safe_load_dataframe = load_dataframe


def save_report(report: Mapping[str, object], path: str, mode: str = "errorifexists") -> list[str]:
    """Write every DataFrame section as parquet under ``path``/<section>; returns the names."""
    written = []
    for name, section in report.items():
        if isinstance(section, DataFrame) and section.columns:
            section.write.mode(mode).parquet(os.path.join(path, name))
            written.append(name)
    return written
