"""Text to number and text to timestamp, with unparsable text becoming NULL."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spelling of a number. Spark's own cast also takes '12d' and '12f', hence the guard.
_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"
_BOOLEAN = r"(?i)^\s*(true|false)\s*$"
_OFFSET = r"(Z|[+-]\d{2}(:?\d{2}){0,2})$"
_DATE = r"^\s*\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$"

# The date layouts understood by default, earlier ones preferred. One-letter day
# and month read one or two digits.
DATETIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd HH:mm",
    "yyyy-M-d",
    "d-M-yyyy",
    "M/d/yyyy",
    "yyyy/M/d",
    "MMM d yyyy",
    "d MMM yyyy",
    "d/M/yyyy",
    "M/d/yyyy H:mm[:ss]",
    "yyyy/M/d H:mm[:ss]",
    "d-M-yyyy H:mm[:ss]",
)


def text_to_number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def from_micros(micros: Column) -> Column:
    """Microseconds since 1970 as a timestamp without zone, whatever zone the session has."""
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))


def number_shape(text: Column) -> Column:
    """Whether a text is spelled like a number."""
    return text.rlike(_NUMBER)


def text_to_timestamp(text: Column, layout: str) -> Column:
    """Clock time as written, or in UTC where the text names an offset. Text without an offset is
    read as UTC, so the session's zone plays no part.

    The parser raises and catches an exception on text it cannot read, so text of another
    shape is kept away from it."""
    clean = F.trim(text)
    if "X" in layout:
        clean = F.when(clean.rlike(_OFFSET), clean).otherwise(F.concat(clean, F.lit("Z")))
    else:
        clean, layout = F.concat(clean, F.lit("Z")), layout + "XXX"
    parsed = from_micros(F.unix_micros(F.try_to_timestamp(clean, F.lit(layout))))
    shape = layout_shape(layout.removesuffix("XXX"))
    return parsed if shape is None else F.when(text.rlike(shape), parsed)


def layout_mask(text: Column, layouts: Sequence[str]) -> Column:
    """Which layouts read the text, as bits; 0 for none. Text that has the shape of no layout is
    told by one expression, and only layouts of the text's shape parse it."""
    bits = [F.when(text_to_timestamp(text, f).isNotNull(), 1 << k).otherwise(0)
            for k, f in enumerate(layouts)]
    mask = reduce(lambda a, b: a.bitwiseOR(b), bits)
    like = date_like(text, layouts)
    return F.when(like.isNotNull(), mask).otherwise(0)


def date_like(text: Column, layouts: Sequence[str]) -> Column:
    """The text if it has the shape of one of the layouts, so that other text is looked at once
    and not once per layout."""
    shapes = [layout_shape(x) for x in layouts]
    if None in shapes:
        return text
    return F.when(text.rlike("|".join(shapes)), text)


# What a run of one pattern letter can look like; anything longer or other is not guarded.
_RUNS = {
    "y": r"[+]?\d{4,}", "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "m": r"\d{1,2}",
    "s": r"\d{1,2}", "S": r"\d{1,9}", "X": r"(Z|[+-]\d{2}(:?\d{2}){0,2})",
}


def layout_shape(layout: str) -> str | None:
    """A regular expression matching at least every text the layout can read."""
    out = ""
    for token in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", layout):
        run, letter = token.group(0), token.group(1)
        if run == "MMM":
            out += r"[A-Za-z.]{3,5}"
        elif letter:
            if letter not in _RUNS or (letter == "M" and len(run) > 2):
                return None
            out += _RUNS[letter]
        elif run in "[]":
            out += "(" if run == "[" else ")?"
        else:
            out += re.escape(run.strip("'"))
    return r"^\s*" + out + r"\s*$"


def value_kind(text: Column) -> Column:
    """Kind of one text value: int, float, bool, date or text; NULL stays NULL."""
    return (
        F.when(text.rlike(_INTEGER), "int")
        .when(text.rlike(_NUMBER), "float")
        .when(text.rlike(_BOOLEAN), "bool")
        .when(text.rlike(_DATE), "date")
        .when(text.isNotNull(), "text")
    )
