"""Sharding by jump consistent hashing.

The shard of a row follows from its key and the number of shards alone; there is no ring or
table to keep. When shards are appended, a row either stays or moves into a new shard, and the
share that moves is the least possible. Numbering the rows inside a shard needs their order, so
a shard's rows are cut by hash into groups of bounded size: the groups are counted, and a row's
slot is the count of all earlier groups plus its place in its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import free_name, materialize, text_bytes

SHARDS = 40
GROUP_ROWS = 50_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard numbers from 0 of unsigned 64-bit keys."""
    key, at = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    moving, jumps = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    with np.errstate(over="ignore"):
        while len(moving):
            at[moving] = jumps[moving]
            key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((key[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
            jumps[moving] = ((at[moving] + 1) * step).astype(np.int64)
            moving = moving[jumps[moving] < shards]
    return at.astype(np.int32)


def stable_key(key: Column) -> Column:
    """64 bits of a key of any type that has a text; null has a value of its own."""
    return F.xxhash64(key.cast("string"))


def shard_of(key: Column, shards: int) -> Column:
    if shards < 1:
        raise ValueError("There must be one shard at least.")

    @F.pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(jump(part.to_numpy(np.int64).view(np.uint64), shards))

    return run(stable_key(key))


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def with_slots(rows: DataFrame, key: str, shard: str = "shard", slot: str = "slot",
               group_rows: int = GROUP_ROWS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Rows go by a hash of all their columns, so that a key with a third of all rows is spread
    over many groups too; only rows that are equal in every column share a group for certain.
    The table is read twice: once to count the groups, once to number the rows."""
    total = rows.count()
    groups = max(1, -(-total // group_rows))
    names = {n: free_name(rows, n) for n in ("_group", "_hash", "_before")}
    group, mark, before = names.values()
    whole = F.xxhash64(*[F.col(f.name) for f in rows.schema if _hashable(f.dataType)])
    cut = (rows.withColumn(mark, whole)
           .withColumn(group, F.pmod(F.xxhash64(mark), F.lit(groups)).cast("long")))
    sizes = cut.groupBy(shard, group).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(shard, group, (F.sum("n").over(
        Window.partitionBy(shard).orderBy(group)) - F.col("n")).alias(before))
    place = F.row_number().over(
        Window.partitionBy(shard, group).orderBy(stable_key(F.col(key)), F.col(key), mark))
    return (cut.withColumn(slot, place - 1).join(offsets, [shard, group])
            .withColumn(slot, F.col(slot) + F.col(before))
            .select(*rows.columns, F.col(slot).cast("long").alias(slot)))


def deal(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, shard: str = "shard",
         slot: str = "slot") -> DataFrame:
    """All rows and columns plus their shard and their place in it.

    Null keys count as one key, repeated rows get slots of their own, and columns already named
    like the new ones are replaced."""
    kept = [c for c in docs.columns if c.lower() not in (shard.lower(), slot.lower())]
    placed = docs.select(*kept).withColumn(shard, shard_of(F.col(key), shards))
    return with_slots(placed, key, shard, slot)


def shard_report(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 shards: int = SHARDS) -> DataFrame:
    """Per document its size, the checksum of its text, its shard and slot, and its shard when
    one more is appended. A null text has no bytes."""
    data = text_bytes(F.col(text))
    narrow = materialize(docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(data) + 16).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(F.col(key), shards).alias("shard"),
        shard_of(F.col(key), shards + 1).alias("grown_shard")), "sharded")
    return with_slots(narrow, "doc_id").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
