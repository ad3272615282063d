"""Joins and semi-joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import OTHER, STRING, col, type_class

SAMPLE_ROWS = 100_000
HOT_SHARE = 0.01            # a key is hot from 1 % of the rows on, so at most 100 keys are hot
LARGE_TABLE_BYTES = 1 << 30
JOIN_BYTES = 16 << 20       # joins look for hot keys from here on: two make the product of their rows
BROADCAST_BYTES = 8 << 20   # Spark broadcasts up to 10 MB by its own estimate
JOIN_SHARE = 0.0005         # at most 2000 hot keys a side
PART_ROWS = 1_000           # rows of either side of a hot key that meet, at least
COPIES = 4                  # of a row of a hot key, on average, for which parts grow up to these limits
MOST_ROWS, MOST_BYTES = 65_536, 16 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """All keys equal, missing equal to missing; still a hash-joinable condition."""
    condition = None
    for k in keys:
        quoted = "`" + k.replace("`", "``") + "`"
        part = left[quoted].eqNullSafe(right[quoted])
        condition = part if condition is None else condition & part
    return condition


def hot_keys(
    df: DataFrame, keys: Sequence[str], rows: int | None = None, share: float = HOT_SHARE
) -> DataFrame | None:
    """Keys that hold at least ``share`` of the rows, judged on a bounded sample.

    Returns a driver-built table of at most 1/share rows, or None. Only the strategy depends on
    the sample, never the result."""
    projected = df.select(*[col(k) for k in keys])
    rows = df.count() if rows is None else rows
    fraction = min(1.0, SAMPLE_ROWS / max(rows, 1))
    counted = projected.sample(fraction=fraction, seed=23) if fraction < 1.0 else projected
    floor = max(2, int(min(rows, SAMPLE_ROWS) * share))
    found = (
        counted.groupBy(*[col(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("_copies"))
        .where(F.col("_copies") >= floor)
        .drop("_copies")
        .collect()
    )
    return df.sparkSession.createDataFrame(found, projected.schema) if found else None


def hot_part(df: DataFrame, hot: DataFrame, keys: Sequence[str], *, keep: bool) -> DataFrame:
    """Rows whose key is hot (keep=True) or is not (keep=False); ``hot`` is at most 1/share rows."""
    how = "left_semi" if keep else "left_anti"
    return df.join(F.broadcast(hot), same_key(df, hot, keys), how)


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes of memory a row takes."""
    sizes = [F.lit(100.0)]
    for f in df.schema.fields:
        kind = type_class(f.dataType)
        if kind in (STRING, OTHER):
            value = col(f.name).cast("string") if kind == OTHER else col(f.name)
            sizes.append(F.coalesce(F.octet_length(value), F.lit(0)))
        sizes.append(F.lit(16.0))
    return sum(sizes[1:], start=sizes[0])


def _hot_parts(
    left: DataFrame, right: DataFrame, keys: Sequence[str], share: float, part_rows: int
) -> DataFrame | None:
    """(keys, _skew_left, _skew_right, _skew_both): into how many parts each side of a key that is
    hot on either side is cut, from exact counts of these keys. At most 2/share rows; None if no
    key is cut.

    n and m rows in parts of s rows are sent about 2nm/s times. So s grows with the key."""
    found = [hot for hot in (hot_keys(t, keys, share=share) for t in (left, right))
             if hot is not None]
    if not found:
        return None
    hot = found[0] if len(found) == 1 else found[0].union(found[1]).distinct()

    def counted(df: DataFrame, name: str) -> DataFrame:
        return hot_part(df, hot, keys, keep=True).groupBy(*[col(k) for k in keys]).agg(
            F.count(F.lit(1)).alias(name), F.avg(_row_bytes(df)).alias(f"{name}_bytes"))

    def parts(name: str) -> Column:
        n, m = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("_skew_left", "_skew_right"))
        size = F.greatest(F.lit(float(part_rows)), F.least(
            2 * n * m / (COPIES * (n + m)), F.lit(float(MOST_ROWS)),
            *[MOST_BYTES / F.coalesce(F.col(f"{c}_bytes"), F.lit(1.0))
              for c in ("_skew_left", "_skew_right")]))
        return F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(name), F.lit(0)) / size)).cast("int")

    table = plain_join(counted(left, "_skew_left"), counted(right, "_skew_right"), keys, "outer")
    table = table.select(
        *[col(k) for k in keys], parts("_skew_left").alias("_skew_left"),
        parts("_skew_right").alias("_skew_right"),
        (F.col("_skew_left").isNotNull() & F.col("_skew_right").isNotNull()).alias("_skew_both"))
    cut = table.where("_skew_left > 1 OR _skew_right > 1").collect()
    return table.sparkSession.createDataFrame(cut, table.schema) if cut else None


def deal_hot(
    df: DataFrame, table: DataFrame, keys: Sequence[str], own: str, other: str
) -> DataFrame:
    """Rows with the places ``_skew_own`` and ``_skew_other`` of the grid of their key: a row of a
    hot key lies in one part of its own side and once in every part of the other side. The own
    part follows from the row and the partition it was read from, so a retry deals it alike."""
    marked = df.join(F.broadcast(table), same_key(df, table, keys), "left").select(
        *[df["`" + c.replace("`", "``") + "`"] for c in df.columns],
        *[table[c] for c in ("_skew_left", "_skew_right", "_skew_both")])
    flat = [f.name for f in df.schema.fields if type_class(f.dataType) != OTHER]
    spread = F.pmod(F.xxhash64(*map(col, flat)) + F.spark_partition_id(), F.col(own)).cast("int")
    rest = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
    return marked.select(
        *[col(c) for c in df.columns], F.coalesce("_skew_both", F.lit(False)).alias("_skew_both"),
        F.coalesce(spread, F.lit(0)).alias("_skew_own"), F.explode(rest).alias("_skew_other"))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    *,
    large_bytes: int | None = None,
    share: float = JOIN_SHARE,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Null-safe equi-join on same-named keys; result has keys (merged) then both sides' columns,
    which must not overlap otherwise.

    Small inputs go to Spark as one join. On large inputs, a key that is hot on either side is cut
    into a grid: its left rows into parts of ``part_rows`` or more, its right rows likewise, and
    every pair of parts is a join key of its own. So a hot key is spread over many tasks, a side is
    copied only as often as the other has parts, which are larger the more rows a key has, and both
    inputs are read by one join whatever its kind. A full join holds the rows of two parts but not
    what they make together (see `_uncompiled`). A hot key without any row on the other side has one part there, hence one
    owner for each unmatched row; a hot key with rows on both sides has no unmatched rows, and what
    an empty part leaves unmatched is dropped. Nothing is broadcast but the table of hot keys."""
    limit = JOIN_BYTES if large_bytes is None else large_bytes
    sizes = estimated_bytes(left), estimated_bytes(right)
    if min(sizes) < limit // 100 or max(sizes) < limit:
        return plain_join(left, right, keys, how)
    # What Spark broadcasts leaves the rows of a key where they are read.
    sent = {"inner": min(sizes), "left": sizes[1], "right": sizes[0]}.get(how)
    if large_bytes is None and sent is not None and sent < BROADCAST_BYTES:
        return plain_join(left, right, keys, how)
    table = _hot_parts(left, right, keys, share, part_rows)
    if table is None:
        return plain_join(left, right, keys, how)
    names = {"_skew_both": "_skew_left_both", "_skew_own": "_skew_i", "_skew_other": "_skew_j"}
    grid = plain_join(
        deal_hot(left, table, keys, "_skew_left", "_skew_right").withColumnsRenamed(names),
        deal_hot(right, table, keys, "_skew_right", "_skew_left").withColumnsRenamed(
            {"_skew_both": "_skew_right_both", "_skew_own": "_skew_j", "_skew_other": "_skew_i"}),
        [*keys, "_skew_i", "_skew_j"], how, uncompiled=("_skew_i",) if how == "outer" else ())
    here, there = F.col("_skew_left_both"), F.col("_skew_right_both")
    alone = F.coalesce(here, there) & (here.isNull() | there.isNull())
    return grid.where(~alone).select(*[
        col(c) for c in [*keys, *[c for t in (left, right) for c in t.columns if c not in keys]]])


def _uncompiled(value: Column) -> Column:
    """The value, by an expression for which Spark generates no code, nor for a join on it. A full
    join in generated code puts all results of a join key into memory before it passes on the first."""
    return F.get(F.transform(F.array(value), lambda x: x), F.lit(0))


def plain_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, *,
    uncompiled: Sequence[str] = (),
) -> DataFrame:
    l, r = left.alias("l"), right.alias("r")

    def of(side: str, name: str) -> Column:
        return F.col(f"{side}.`" + name.replace("`", "``") + "`")

    condition = None
    for k in keys:
        l_key, r_key = (of(s, k) if k not in uncompiled else _uncompiled(of(s, k)) for s in "lr")
        part = l_key.eqNullSafe(r_key)
        condition = part if condition is None else condition & part

    def key(k: str) -> Column:
        if how == "right":
            return of("r", k).alias(k)
        if how == "outer":
            return F.coalesce(of("l", k), of("r", k)).alias(k)
        return of("l", k).alias(k)

    return l.join(r, condition, "full" if how == "outer" else how).select(
        *[key(k) for k in keys],
        *[of("l", c).alias(c) for c in left.columns if c not in keys],
        *[of("r", c).alias(c) for c in right.columns if c not in keys],
    )


def attach(
    df: DataFrame,
    table: DataFrame,
    key: str,
    *,
    rows: int,
    like: DataFrame | None = None,
    large_rows: int = 50 * SAMPLE_ROWS,
    missing: bool = False,
    few: bool = False,
) -> DataFrame:
    """Add the columns of a table that is unique on ``key`` and holds every key of ``df``. With
    ``missing`` the key may be NULL: such rows get NULLs, and are spread like those of hot keys.
    A table of ``few`` rows is sent to the rows, which stay where they are.

    Rows of hot keys get theirs from a broadcast of the hot keys' table rows. They still pass the
    main join, as its other rows do, but under a key of their own per source partition, which
    spreads them and matches nothing; so the input is read once, however many lookups are
    chained. ``like`` is a cheaper frame with the same keys, to look for hot ones in."""
    if few:
        return df.join(F.broadcast(table), key, "left").select(
            *[col(c) for c in [*df.columns, *[c for c in table.columns if c != key]]])
    hot = hot_keys(df if like is None else like, [key], rows) if rows > large_rows else None
    if hot is None and not missing:
        return df.join(table, key)
    if hot is None:
        spread = F.when(col(key).isNull(), 1 + F.spark_partition_id()).otherwise(0)
        return df.withColumn("_spread", spread).join(
            table.withColumn("_spread", F.lit(0)), [key, "_spread"], "left").select(
                *[col(c) for c in [*df.columns, *[c for c in table.columns if c != key]]])
    added = [c for c in table.columns if c != key]
    sent = hot_part(table, hot, [key], keep=True).select(
        col(key).alias("_hot"), *[col(c).alias(f"_hot_{c}") for c in added])
    marked = df.join(F.broadcast(sent), col(key) == F.col("_hot"), "left").withColumn(
        "_spread", F.when(F.col("_hot").isNull() & col(key).isNotNull(), 0)
        .otherwise(1 + F.spark_partition_id()))
    looked_up = marked.join(table.withColumn("_spread", F.lit(0)), [key, "_spread"], "left")
    return looked_up.select(
        *[col(c) for c in df.columns],
        *[F.coalesce(F.col(f"_hot_{c}"), col(c)).alias(c) for c in added])
