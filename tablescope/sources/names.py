"""Column-name normalisation."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame


def normalize_column_name(name: str) -> str:
    """Lower case, every run of other characters one underscore; an empty result keeps the name."""
    words = re.findall(r"[0-9a-z]+", str(name).strip().lower())
    return "_".join(words) or str(name)


def unique_names(names: Sequence[str]) -> list[str]:
    """Names that collide, whatever their case, get _2, _3, ... so that each stays addressable."""
    taken: set[str] = set()
    out = []
    for base in names:
        name, n = base, 1
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename all columns; names that collide are numbered."""
    return df.toDF(*unique_names([normalize_column_name(c) for c in df.columns]))
