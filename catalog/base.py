"""Registering a query together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


# Seven significant digits on both sides: sums of doubles depend on the order of addition.
# The factor lifts decimal ties, which the two formatters would round differently.
_LIFT = "1.00000000001"


def sig(x: Column | str) -> Column:
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    lifted = x * F.lit(float(_LIFT)) + 0.0
    return F.when(x.isNotNull(), F.format_string("%.6e", lifted).cast("double"))


def sig_sql(x: str) -> str:
    return (f"CAST(printf('%.6e', CAST(({x}) AS DOUBLE) * CAST('{_LIFT}' AS DOUBLE) + 0.0) "
            "AS DOUBLE)")


def rnd(x: Column | str, digits: int = 6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, digits) + 0.0


def rnd_sql(x: str, digits: int = 6) -> str:
    return f"(round(CAST(({x}) AS DOUBLE), {digits}) + 0.0)"


def sigs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: sig(n) for n in names})


# The tables hold no missing values, so both sides derive the same gaps.
def lineitem_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.nullif("l_quantity", F.lit(25.0)).alias("l_quantity"),
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("l_extendedprice"),
        F.nullif("l_discount", F.lit(0.05)).alias("l_discount"),
        F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"),
        "l_linestatus",
        F.when(F.col("l_linenumber") != 4, F.col("l_shipdate")).alias("l_shipdate"),
    )


LINEITEM_GAPS = """(SELECT l_orderkey, l_linenumber,
    nullif(l_quantity, 25.0) AS l_quantity,
    CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS l_extendedprice,
    nullif(l_discount, 0.05) AS l_discount,
    nullif(l_returnflag, 'R') AS l_returnflag, l_linestatus,
    CASE WHEN l_linenumber <> 4 THEN l_shipdate END AS l_shipdate FROM lineitem)"""


def part_gaps(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return read(spark, folder, "part").select(
        "p_partkey",
        F.nullif("p_size", F.lit(10)).alias("p_size"),
        F.when(key % 3 != 0, F.col("p_retailprice")).alias("p_retailprice"),
        F.when(key % 4 != 0, F.col("p_type")).alias("p_type"),
        F.when(key % 5 != 0, F.concat("p_name", F.lit(" "), key)).alias("p_label"),
        F.when(key % 6 != 0, F.col("p_size") > 20).alias("p_large"),
    )


PART_GAPS = """(SELECT p_partkey, nullif(p_size, 10) AS p_size,
    CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS p_retailprice,
    CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS p_type,
    CASE WHEN p_partkey % 5 <> 0 THEN p_name || ' ' || p_partkey END AS p_label,
    CASE WHEN p_partkey % 6 <> 0 THEN p_size > 20 END AS p_large FROM part)"""


def events_gaps(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id")
    return read(spark, folder, "events").select(
        "event_id",
        F.when(key % 11 != 0, F.col("ts")).alias("ts"),
        F.when(key % 5 != 0, F.col("value")).alias("value"),
        F.when(key % 7 > 2, F.col("event_type")).alias("event_type"),
    )


EVENTS_GAPS = """(SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS ts,
    CASE WHEN event_id % 5 <> 0 THEN value END AS value,
    CASE WHEN event_id % 7 > 2 THEN event_type END AS event_type FROM events)"""
