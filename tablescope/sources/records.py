"""CSV records whose quoted cells hold line breaks, from files that are read in splits.

Spark reads a file with such cells in one task. Here lines are read in splits, as of any text file.
A line maps the state at its start (inside a quoted cell or not) to the state at its end; the maps
of the lines of a split, then those of the splits of a file, are composed, which tells for each
line whether a record starts there. A map either ignores the state, keeps it or swaps it, so a
composition is the last map that ignores it and the parity of the swaps since: two running values,
kept by windows over a split and over one row per split. Lines of a record are joined again, across
splits, too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'
_OUTSIDE, _INSIDE, _CLOSED = 0, 1, 2
SPLIT = ["_file", "_block"]


def end_state(line: Column, inside: bool, sep: str = ",") -> Column:
    """1 if the line, begun inside a quoted cell or not, ends inside one, else 0.

    A quote opens a cell only at its start, a quote after a closing quote is an escaped one, and
    any other quote outside is a character like others."""
    parts = F.split(line, QUOTE)
    start = _INSIDE if inside else _OUTSIDE

    def step(state: Column, i: Column) -> Column:
        text = F.get(parts, i)
        opens = text.endswith(sep) | ((i == 0) & (text == ""))
        return (
            F.when(state == _INSIDE, _CLOSED)
            .when((state == _CLOSED) & (text == ""), _INSIDE)
            .when(opens, _INSIDE).otherwise(_OUTSIDE))

    quotes = F.sequence(F.lit(0), F.size(parts) - 2)
    walked = F.aggregate(quotes, F.lit(start), step)
    return F.when(~line.contains(QUOTE), start).otherwise((walked == _INSIDE).cast("int"))


def _states(lines: DataFrame) -> DataFrame:
    """Lines with `_start`, whether a record starts there, and `_whole`, whether it also ends."""
    kept, swapped = end_state(F.col("value"), False), end_state(F.col("value"), True)
    mapped = lines.withColumns({"_to0": kept, "_to1": swapped}).withColumns({
        "_swap": ((F.col("_to0") == 1) & (F.col("_to1") == 0)).cast("int"),
        "_fixed": F.when(F.col("_to0") == F.col("_to1"), F.col("_to0"))})
    rows = Window.partitionBy(*SPLIT).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    parity = F.coalesce(F.sum("_swap").over(rows), F.lit(0)) % 2
    walked = mapped.withColumn("_parity", parity).withColumn(
        "_last", F.last((F.col("_fixed") + F.col("_parity")) % 2, ignorenulls=True).over(rows))
    ends = walked.groupBy(*SPLIT).agg(
        F.max_by("_parity", "_id").alias("_swap"), F.max_by("_last", "_id").alias("_last")).select(
            *SPLIT, F.when(F.col("_last").isNull(), F.col("_swap")).otherwise(0).alias("_swap"),
            ((F.col("_last") + F.col("_swap")) % 2).alias("_fixed"))
    splits = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_file").orderBy("_block")
    walked_splits = ends.withColumn("_sum", F.sum("_swap").over(splits) % 2).withColumn(
        "_known", F.last((F.col("_fixed") + F.col("_sum")) % 2, ignorenulls=True).over(splits))
    entering = walked_splits.select(*SPLIT, F.coalesce(F.lag(
        (F.coalesce("_known", F.lit(0)) + F.col("_sum")) % 2).over(earlier), F.lit(0)).alias("_enter"))
    after = (F.coalesce("_last", "_enter") + F.col("_parity")) % 2
    before = F.coalesce(F.lag("_after").over(Window.partitionBy(*SPLIT).orderBy("_id")), F.col("_enter"))
    return walked.join(entering, SPLIT).withColumn("_after", after).withColumn(
        "_start", before == 0).withColumn("_whole", F.col("_start") & (F.col("_after") == 0))


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(record) of all CSV files at the path, without the header that begins each file.

    A record is as long as its text; no task holds more than a split besides."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"))
    states = _states(lines)
    rows = Window.partitionBy(*SPLIT).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    own = states.withColumn(
        "_record", F.last(F.when(F.col("_start"), F.col("_id")), ignorenulls=True).over(rows))
    begun = own.groupBy(*SPLIT).agg(F.max("_record").alias("_begun"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    before = begun.select(*SPLIT, F.last("_begun", ignorenulls=True).over(earlier).alias("_before"))
    first = begun.groupBy("_file").agg(F.min("_block").alias("_block"))
    placed = own.join(before, SPLIT).withColumn("_record", F.coalesce("_record", "_before"))
    whole = placed.where("_whole").select("_file", "_record", "value")
    joined = placed.where(~F.col("_whole")).groupBy("_file", "_record").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_id", "value"))).alias("lines")).select(
            "_file", "_record", F.array_join(F.col("lines.value"), "\n").alias("value"))
    header = own.join(first, SPLIT).groupBy("_file").agg(F.min("_record").alias("_header"))
    both = whole.union(joined).join(header, "_file")
    text = F.regexp_replace("value", "\r$", "")
    return both.where((F.col("_record") != F.col("_header")) & (F.trim(text) != "")).select(
        text.alias("record"))


def cells_of(records: DataFrame, columns: int) -> DataFrame:
    """The cells of records as text columns c0, c1, ..."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(columns)])
    return records.select(F.from_csv(
        "record", schema.simpleString()[len("struct<"):-1].replace(":", " "),
        {"quote": QUOTE, "escape": QUOTE}).alias("cells")).select("cells.*")
