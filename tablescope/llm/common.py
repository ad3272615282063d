"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, new_folder

__all__ = ["BLANKS", "for_python", "free_name", "let", "materialize", "new_folder", "text_bytes", "word_count"]

#: Space and the control characters 0x09 to 0x0D separate words.
BLANKS = " \t\n\x0b\f\r"
_BLANK_RUN = "[ \\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for several uses inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for a text without any."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, _BLANK_RUN))


def blanks_removed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _BLANK_RUN, "")


def word_count(text: Column) -> Column:
    """Number of words, without building them: every run of blanks ends at most one."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    one_each = F.regexp_replace(trimmed, _BLANK_RUN, " ")
    return F.when(trimmed == "", F.lit(0)).otherwise(
        F.length(one_each) - F.length(F.replace(one_each, F.lit(" "), F.lit(""))) + 1
    ).cast("long")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


#: Rows and bytes of texts that Python gets at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def for_python(df: DataFrame) -> DataFrame:
    """The frame, with Arrow batches bounded as long texts need it.

    Spark's default of 10,000 rows a batch, copied several times between the JVM and Python, can
    fill an executor. The setting is the session's; one that is lower already stays."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(conf.get(name)).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name the frame does not use, compared without case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
