"""What each column holds, judged from values; conversion of text columns accordingly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.coerce import (
    DATETIME_FORMATS,
    layout_mask,
    number_shape,
    text_to_number,
    text_to_timestamp,
    value_kind,
)
from ..functions.columns import col

NUMERIC_SHARE = 0.75
DATETIME_SHARE = 0.5


@dataclass(frozen=True)
class TableSchema:
    """Column names by kind, in table order."""

    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)
    rules: dict[str, str] = field(default_factory=dict)

    def kind_of(self, column: str) -> str | None:
        for kind in ("numeric", "categorical", "datetime", "boolean", "other"):
            if column in getattr(self, kind):
                return kind
        return None

    def to_frame(self, df: DataFrame) -> DataFrame:
        """(column, kind, rule) as a DataFrame."""
        rows = [(c, self.kind_of(c), self.rules.get(c, "values")) for c in df.columns]
        return df.sparkSession.createDataFrame(rows, "column string, kind string, rule string")


@dataclass(frozen=True)
class TextShares:
    """How much of a text column parses: as numbers, and as timestamps in its best layout."""

    values: int
    numeric: float
    datetime: float
    layout: str
    numbers: int
    dates: int


def text_shares(
    df: DataFrame,
    columns: Sequence[str],
    *,
    formats: Sequence[str] | None = None,
    of_all_rows: bool = False,
) -> dict[str, TextShares]:
    """Parse shares of text columns over all their values, in one pass over any number of them.
    ``of_all_rows`` counts missing values as not parsing.

    A cell becomes a code: whether it reads as a number, and which layouts read it. Cells of all
    columns pass through one expression, and codes are counted per column before the shuffle, so
    a column costs as many rows there as it has kinds of cells."""
    layouts = list(formats or DATETIME_FORMATS)
    if not columns:
        return {}
    counted = _cell_codes(df, columns, layouts).groupBy("column", "code").count()
    found: dict[int, dict[int | None, int]] = {i: {} for i in range(len(columns))}
    for r in counted.collect():
        found[r["column"]][r["code"]] = r["count"]
    out = {}
    for i, c in enumerate(columns):
        of_code = {code: n for code, n in found[i].items() if code is not None}
        values = sum(of_code.values())
        numbers = sum(n for code, n in of_code.items() if code & 1)
        dates = [sum(n for code, n in of_code.items() if code >> 1 & 1 << k)
                 for k in range(len(layouts))]
        base = (sum(found[i].values()) if of_all_rows else values) or 1
        best = max(range(len(layouts)), key=lambda k: (dates[k], -k))
        out[c] = TextShares(values, numbers / base, dates[best] / base, layouts[best], numbers,
                            dates[best])
    return out


def _cell_codes(df: DataFrame, columns: Sequence[str], layouts: Sequence[str]) -> DataFrame:
    """(column, code) of every cell; bit 0 of a code is a number, bit k + 1 is layout k.

    With the default layouts, none of which reads a number, numbers skip the layouts."""
    cells = df.select(F.posexplode(F.array(*[col(c) for c in columns])).alias("column", "cell"))
    cell = F.col("cell")
    number = text_to_number(cell).isNotNull()
    dates = layout_mask(cell, layouts).cast("long") * 2
    if tuple(layouts) == DATETIME_FORMATS:
        code = F.when(number_shape(cell), F.when(number, 1).otherwise(0)).otherwise(dates)
    else:
        code = dates + F.when(number, 1).otherwise(0)
    return cells.select("column", F.when(cell.isNotNull(), code.cast("long")).alias("code"))


def detect_column_types(
    df: DataFrame,
    datetime_formats: Sequence[str] | None = None,
) -> TableSchema:
    """Kind of every column: typed columns by type, text columns by what their values parse as."""
    if df.isEmpty():
        return TableSchema()
    text = C.columns_of_class(df, C.STRING)
    shares = text_shares(df, text, formats=datetime_formats)
    return _by_kind(df, {c: text_kind(shares[c]) for c in text})


def declared_types(df: DataFrame) -> TableSchema:
    """Kinds by type alone, text as categorical: what ``detect_column_types`` finds once
    ``validate_and_convert_types`` has been applied, without looking at values again."""
    return _by_kind(df, dict.fromkeys(C.columns_of_class(df, C.STRING), "categorical"))


def _by_kind(df: DataFrame, text_kinds: Mapping[str, str]) -> TableSchema:
    names: dict[str, list[str]] = {
        k: [] for k in ("numeric", "categorical", "datetime", "boolean", "other")
    }
    for f in df.schema.fields:
        names[text_kinds.get(f.name) or C.type_class(f.dataType)].append(f.name)
    return TableSchema(**names)


def text_kind(share: TextShares, numeric_share: float = NUMERIC_SHARE) -> str:
    if share.values == 0:
        return "categorical"
    if share.numeric >= numeric_share:
        return "numeric"
    return "datetime" if share.datetime >= DATETIME_SHARE else "categorical"


def validate_and_convert_types(
    df: DataFrame,
    datetime_formats: Sequence[str] | None = None,
    numeric_threshold: float = NUMERIC_SHARE,
    *,
    shares: Mapping[str, TextShares] | None = None,
) -> DataFrame:
    """Cast text columns that mostly hold numbers or dates; values that do not parse go missing,
    and ``conversion_losses`` says how many. One projection; NaN becomes NULL on the way.
    ``shares`` may pass what ``text_shares`` found."""
    text = C.columns_of_class(df, C.STRING)
    if shares is None:
        shares = text_shares(df, text, formats=datetime_formats)
    casts: dict[str, Column] = {}
    for c in text:
        kind = text_kind(shares[c], numeric_threshold)
        if kind == "numeric":
            casts[c] = text_to_number(col(c))
        elif kind == "datetime":
            casts[c] = text_to_timestamp(col(c), shares[c].layout)
    return C.nan_to_null(df.withColumns(casts) if casts else df)


LOSSES = "column string, kind string, values bigint, lost bigint"


def conversion_losses(
    df: DataFrame,
    datetime_formats: Sequence[str] | None = None,
    numeric_threshold: float = NUMERIC_SHARE,
    *,
    shares: Mapping[str, TextShares] | None = None,
) -> DataFrame:
    """(column, kind, values, lost) for each text column: how many of its values
    ``validate_and_convert_types`` turns into missing ones."""
    text = C.columns_of_class(df, C.STRING)
    if shares is None:
        shares = text_shares(df, text, formats=datetime_formats)
    rows = []
    for c in text:
        s, kind = shares[c], text_kind(shares[c], numeric_threshold)
        parsed = {"numeric": s.numbers, "datetime": s.dates}.get(kind, s.values)
        rows.append((c, kind, s.values, s.values - parsed))
    return df.sparkSession.createDataFrame(rows, LOSSES)


def detect_mixed_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, kind, n, share) for columns whose values are of more than one kind: text columns
    by what their values look like, variant columns by the type each value has."""
    chosen = [
        f.name for f in df.schema.fields
        if (columns is None or f.name in columns)
        and isinstance(f.dataType, (T.StringType, T.VariantType))
    ]
    if not chosen:
        return df.sparkSession.createDataFrame(
            [], "column string, kind string, n bigint, share double")
    kinds = df.select(*[
        (F.schema_of_variant(col(c)) if isinstance(df.schema[c].dataType, T.VariantType)
         else value_kind(col(c))).alias(c)
        for c in chosen
    ])
    counted = kinds.unpivot([], [col(c) for c in chosen], "column", "kind").where(
        F.col("kind").isNotNull() & (F.col("kind") != "VOID")
    ).groupBy("column", "kind").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("column")  # as many rows as there are kinds
    return counted.select(
        "column", "kind", "n", (F.col("n") / F.sum("n").over(whole)).alias("share"),
        F.count(F.lit(1)).over(whole).alias("_kinds"),
    ).where("_kinds > 1").drop("_kinds")
