"""Every registered query against its SQL on the smallest tables."""

import math
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

import tablescope as ts

from __spark_entry__ import entry, oracle_sql, queries
from catalog import QUERIES, SQL

from .conftest import SMALL
from .test_operators import TABLES


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SMALL)
    got = rows_of(df.columns, df.collect())
    if name not in SQL:
        assert got
        return
    cursor = sql.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cursor.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 6
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York"])
def test_session_zone_plays_no_part(spark, sql, zone):
    """Buckets and parsed times under other session zones, nights of clock changes included."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for name in ("i1_aggregate_month", "i1_aggregate_hour_gaps", "i1_aggregate_15min",
                     "b10_ensure_datetime", "b10_mixed_layouts"):
            test_query(spark, sql, name)
        df = spark.createDataFrame(
            [("2024-03-31 02:30:00", 1), ("2024-03-31 03:10:00", 2), ("2024-10-27 02:30:00", 4)],
            "t string, v long")
        hours = ts.aggregate_time(df, "t", "h", ["v"]).collect()
        assert sorted((str(r["t"]), int(r["v"])) for r in hours) == [
            ("2024-03-31 02:00:00", 1), ("2024-03-31 03:00:00", 2), ("2024-10-27 02:00:00", 4)]
        epoch = ts.ensure_datetime(spark.createDataFrame([(0.0,)], "t double"), "t").first()
        assert str(epoch["t"]) == "1970-01-01 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_late_text_numbers_its_rows(spark, tmp_path):
    """The first 500 rows by key stay numbers, whatever share of the keys they hold."""
    from catalog import QUERIES

    spark.range(1, 1301).selectExpr("9 * id AS o_orderkey").repartition(3).write.parquet(
        str(tmp_path / "orders.parquet"))
    got = QUERIES["b4_convert_late_text"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [
        (9 * i, f"{9 * i}" if i <= 500 else f"code-{9 * i}") for i in range(1, 1301)]
