"""C: quality. D: imputation. E: date features. F: join."""

from __future__ import annotations

from pyspark.sql import functions as F

import tablescope as ts

from .base import (
    EVENTS_GAPS,
    LINEITEM_GAPS,
    PART_GAPS,
    events_gaps,
    lineitem_gaps,
    part_gaps,
    query,
    read,
    sig,
    sig_sql,
)

_GAP_TYPES = {
    "l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
_ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
    "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


def _summary_sql(source, types):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null,
        round(1 - count({c}) / count(*), 9) AS null_ratio, count(DISTINCT {c}) AS "unique"
        FROM {source} AS s""" for c, t in types.items())


@query("c1_schema_summary", _summary_sql(LINEITEM_GAPS, _GAP_TYPES))
def c1(spark, folder):
    return ts.summarize_schema(lineitem_gaps(spark, folder)).withColumn(
        "null_ratio", F.round("null_ratio", 9))


@query("c1_schema_summary_orders", _summary_sql("orders", _ORDER_TYPES))
def c1_orders(spark, folder):
    return ts.summarize_schema(read(spark, folder, "orders")).withColumn(
        "null_ratio", F.round("null_ratio", 9))


@query("c1_schema_summary_approx", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(DISTINCT {c}) AS "unique",
    true AS close FROM orders""" for c in _ORDER_TYPES))
def c1_approx(spark, folder):
    """The sketch is within a tenth of the true count (its standard error is 5 %, and less on
    few values)."""
    orders = read(spark, folder, "orders")
    true = ts.summarize_schema(orders).select(
        F.col("column").alias("named"), F.col("unique").alias("true_unique"))
    off = F.abs(F.col("unique") - F.col("true_unique")) <= 0.1 * F.col("true_unique")
    return ts.summarize_schema(orders, approx=True).join(true, F.col("column") == F.col("named")
        ).select("column", "non_null", F.col("true_unique").alias("unique"), off.alias("close"))


_NAN_KEYS = """(SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN NULL
    ELSE l_discount END AS l_discount FROM lineitem)"""


def nan_keys(spark, folder):
    number = F.col("l_linenumber")
    return read(spark, folder, "lineitem").select(
        "l_linenumber", F.when(number == 2, F.lit(float("nan"))).when(
            number > 2, F.col("l_discount")).alias("l_discount"))


@query("c3_duplicates_nan", f"""SELECT l_linenumber, count(*) AS n FROM {_NAN_KEYS} AS s
    WHERE l_discount IS NULL GROUP BY 1""")
def c3_nan(spark, folder):
    """Rows whose only key is missing, as NaN or NULL, are each other's duplicates."""
    found = ts.detect_duplicates(nan_keys(spark, folder), ["l_discount"], large_bytes=0)
    return found.where(F.col("l_discount").isNull() | F.isnan("l_discount")).groupBy(
        "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("c2_missing", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
    round((count(*) - count({c})) / count(*), 9) AS missing_ratio FROM {LINEITEM_GAPS} AS s"""
    for c in _GAP_TYPES))
def c2(spark, folder):
    return ts.detect_missing_values(lineitem_gaps(spark, folder)).withColumn(
        "missing_ratio", F.round("missing_ratio", 9))


@query("c3_duplicates_by_key", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (
    SELECT *, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS k FROM lineitem) WHERE k > 1""")
def c3(spark, folder):
    found = ts.detect_duplicates(read(spark, folder, "lineitem"), ["l_partkey", "l_suppkey"])
    return found.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


_REPEATED = f"""(SELECT l_quantity, l_discount, l_returnflag, l_shipdate FROM {LINEITEM_GAPS})"""


def _repeated(spark, folder):
    return lineitem_gaps(spark, folder).select(
        "l_quantity", "l_discount", "l_returnflag", "l_shipdate")


@query("c3_duplicates_all_columns", f"""SELECT * EXCLUDE (k) FROM (SELECT *, count(*) OVER (
    PARTITION BY l_quantity, l_discount, l_returnflag, l_shipdate) AS k
    FROM {_REPEATED} AS s) WHERE k > 1""")
def c3_all(spark, folder):
    return ts.detect_duplicates(_repeated(spark, folder))


@query("c3_duplicates_hot_keys", """SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber
    FROM (SELECT *, count(*) OVER (PARTITION BY l_returnflag,
        CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END) AS k
    FROM lineitem) WHERE k > 1""")
def c3_hot(spark, folder):
    df = read(spark, folder, "lineitem").withColumn(
        "g", F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_orderkey")))
    return ts.detect_duplicates(df, ["l_returnflag", "g"], large_bytes=1).select(
        "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")


@query("c4_duplicate_count", f"""SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS duplicates FROM (
    SELECT count(*) AS k FROM {_REPEATED} AS s
    GROUP BY l_quantity, l_discount, l_returnflag, l_shipdate) WHERE k > 1""")
def c4(spark, folder):
    return ts.duplicate_count(_repeated(spark, folder))


def _fill_sql(c):
    return f"""coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY ts NULLS LAST, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value({c} IGNORE NULLS) OVER (ORDER BY ts NULLS LAST, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS {c}"""


_FILL_SQL = (f"SELECT event_id, {_fill_sql('ts')}, {_fill_sql('value')}, "
             f"{_fill_sql('event_type')} FROM {EVENTS_GAPS} AS s")


@query("d2_fill_along_time", _FILL_SQL)
def d2(spark, folder):
    return ts.fill_along_time(events_gaps(spark, folder), "ts", ["event_id"])


@query("d2_fill_along_time_ranges", _FILL_SQL)
def d2_ranges(spark, folder):
    return ts.fill_along_time(
        events_gaps(spark, folder), "ts", ["event_id"], rows_per_range=700)


# Events of user 0 stand for an entity with a third of the rows; every 13th user is unknown.
_ENTITY = "CASE WHEN user_id % 3 = 0 THEN 0 WHEN user_id % 13 <> 1 THEN user_id END"


def _entity_fill_sql(c: str) -> str:
    upto = ("PARTITION BY entity ORDER BY ts NULLS LAST, event_id "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND {}")
    return f"""coalesce(
        last_value({c} IGNORE NULLS) OVER ({upto.format("CURRENT ROW")}),
        first_value({c} IGNORE NULLS) OVER ({upto.format("UNBOUNDED FOLLOWING")})) AS {c}"""


_ENTITY_SQL = f"""SELECT event_id, entity, {_entity_fill_sql('ts')}, {_entity_fill_sql('value')},
    {_entity_fill_sql('event_type')} FROM (
        SELECT s.*, {_ENTITY} AS entity FROM {EVENTS_GAPS} AS s JOIN events USING (event_id))"""


def events_by_entity(spark, folder):
    user = read(spark, folder, "events").select("event_id", F.expr(_ENTITY).alias("entity"))
    return events_gaps(spark, folder).join(user, "event_id")


@query("d2_fill_by_entity", _ENTITY_SQL)
def d2_entity(spark, folder):
    return ts.fill_along_time(
        events_by_entity(spark, folder), "ts", ["event_id"], partition_by="entity")


@query("d2_fill_by_entity_ranges", _ENTITY_SQL)
def d2_entity_ranges(spark, folder):
    return ts.fill_along_time(
        events_by_entity(spark, folder), "ts", ["event_id"], partition_by="entity",
        rows_per_range=300)


@query("d1_d7_handle_with_time", _FILL_SQL)
def d7(spark, folder):
    clean, _ = ts.handle_missing_values(
        events_gaps(spark, folder), "ts", tie_breaks=["event_id"])
    return clean


@query("d3_median", f"""SELECT p_partkey,
    coalesce(p_size, (SELECT median(p_size) FROM {PART_GAPS} AS a)) AS p_size,
    coalesce(p_retailprice, (SELECT median(p_retailprice) FROM {PART_GAPS} AS a))
        AS p_retailprice FROM {PART_GAPS} AS s""")
def d3(spark, folder):
    clean, _ = ts.handle_missing_values(part_gaps(spark, folder))
    return clean.select("p_partkey", "p_size", "p_retailprice")


@query("d4_mean", f"""SELECT p_partkey,
    {sig_sql(f"coalesce(p_size, (SELECT avg(p_size) FROM {PART_GAPS} AS a))")} AS p_size,
    {sig_sql(f"coalesce(p_retailprice, (SELECT avg(p_retailprice) FROM {PART_GAPS} AS a))")}
        AS p_retailprice FROM {PART_GAPS} AS s""")
def d4(spark, folder):
    clean, _ = ts.handle_missing_values(part_gaps(spark, folder), numeric_strategy="mean")
    return clean.select("p_partkey", sig("p_size").alias("p_size"),
                        sig("p_retailprice").alias("p_retailprice"))


_BALANCES = """(SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS even,
    CASE WHEN c_custkey % 4 <> 0 THEN exp(c_acctbal / 2000.0) END AS skewed FROM customer)"""


def _auto_sql(c):
    return sig_sql(f"""coalesce({c}, (SELECT CASE WHEN abs(skewness({c})) > 0.5
        THEN median({c}) ELSE avg({c}) END FROM {_BALANCES} AS a))""")


@query("d5_auto", f"SELECT c_custkey, {_auto_sql('even')} AS even, {_auto_sql('skewed')} AS skewed "
                  f"FROM {_BALANCES} AS s")
def d5(spark, folder):
    key = F.col("c_custkey")
    df = read(spark, folder, "customer").select(
        key, F.when(key % 3 != 0, F.col("c_acctbal")).alias("even"),
        F.when(key % 4 != 0, F.exp(F.col("c_acctbal") / 2000.0)).alias("skewed"))
    clean, _ = ts.impute_missing_values(df)
    return clean.select(key, sig("even").alias("even"), sig("skewed").alias("skewed"))


def _mode_sql(c):
    return (f"(SELECT {c} FROM {PART_GAPS} AS a WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


@query("d6_mode", f"""SELECT p_partkey, coalesce(p_type, {_mode_sql('p_type')}) AS p_type,
    coalesce(p_label, 'Unknown') AS p_label, coalesce(p_large, {_mode_sql('p_large')}) AS p_large
    FROM {PART_GAPS} AS s""")
def d6(spark, folder):
    clean, _ = ts.handle_missing_values(part_gaps(spark, folder))
    return clean.select("p_partkey", "p_type", "p_label", "p_large")


@query("d6_unknown", f"""SELECT p_partkey, coalesce(p_type, 'Unknown') AS p_type,
    coalesce(CAST(p_large AS VARCHAR), 'Unknown') AS p_large FROM {PART_GAPS} AS s""")
def d6_unknown(spark, folder):
    clean, _ = ts.handle_missing_values(
        part_gaps(spark, folder), categorical_strategy="unknown")
    return clean.select("p_partkey", "p_type", "p_large")


@query("d8_notes", f"""SELECT 'p_partkey' AS "column", printf('%.4g', median(p_partkey)) AS fill_value
        FROM {PART_GAPS} AS s
    UNION ALL SELECT 'p_size', printf('%.4g', median(p_size)) FROM {PART_GAPS} AS s
    UNION ALL SELECT 'p_retailprice', printf('%.4g', median(p_retailprice)) FROM {PART_GAPS} AS s
    UNION ALL SELECT 'p_type', {_mode_sql('p_type')}
    UNION ALL SELECT 'p_label', 'Unknown'
    UNION ALL SELECT 'p_large', CAST({_mode_sql('p_large')} AS VARCHAR)""")
def d8(spark, folder):
    _, notes = ts.handle_missing_values(part_gaps(spark, folder))
    return notes.select("column", "fill_value")


@query("e1_date_features", """SELECT o_orderkey, o_orderdate,
    CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
    CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
    CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day,
    strftime(o_orderdate, '%A') AS o_orderdate_weekday,
    CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter FROM orders""")
def e1(spark, folder):
    df = read(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return ts.auto_extract_date_features(df)


_LEFT = """(SELECT CASE WHEN o_orderkey % 200 <> 0 THEN o_custkey END AS custkey, o_orderkey,
    o_orderstatus AS label FROM orders)"""
_RIGHT = """(SELECT CASE WHEN c_custkey % 500 <> 0 THEN c_custkey + 100 END AS custkey,
    c_name, c_mktsegment AS label FROM customer)"""


def _sides(spark, folder):
    left = read(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 200 != 0, F.col("o_custkey")).alias("custkey"),
        "o_orderkey", F.col("o_orderstatus").alias("label"))
    right = read(spark, folder, "customer").select(
        F.when(F.col("c_custkey") % 500 != 0, F.col("c_custkey") + 100).alias("custkey"),
        "c_name", F.col("c_mktsegment").alias("label"))
    return left, right


def _join_sql(how):
    word = "FULL" if how == "outer" else how.upper()
    return f"""SELECT coalesce(l.custkey, r.custkey) AS custkey, o_orderkey,
        l.label AS label_left, c_name, r.label AS label_right FROM {_LEFT} AS l
        {word} JOIN {_RIGHT} AS r ON l.custkey IS NOT DISTINCT FROM r.custkey"""


def _register_join(how):
    @query(f"f1_join_{how}", _join_sql(how))
    def f1(spark, folder):
        return ts.merge_tables(*_sides(spark, folder), on="custkey", how=how)

    @query(f"f2_join_statistics_{how}", f"""WITH j AS ({_join_sql(how)})
        SELECT (SELECT count(*) FROM orders) AS left_rows,
            (SELECT count(*) FROM customer) AS right_rows, count(*) AS merged_rows,
            5 * count(*) - count(custkey) - count(o_orderkey) - count(label_left)
                - count(c_name) - count(label_right) AS nulls_after_merge,
            '{how}' AS join_type FROM j""")
    def f2(spark, folder):
        _, stats = ts.safe_merge_tables(*_sides(spark, folder), on="custkey", how=how)
        return stats.drop("keys")


for _how in ("inner", "left", "right", "outer"):
    _register_join(_how)


# A few nations' customers and suppliers share one key, all others have a key of their own.
_NATION_LEFT = """(SELECT CASE WHEN c_nationkey < 8 THEN 0 WHEN c_nationkey < 12 THEN NULL
    ELSE c_custkey END AS k, c_custkey FROM customer)"""
_NATION_RIGHT = """(SELECT CASE WHEN s_nationkey < 8 THEN 0 WHEN s_nationkey < 12 THEN NULL
    WHEN s_nationkey < 16 THEN s_suppkey ELSE -s_suppkey END AS k, s_suppkey FROM supplier)"""


@query("f1_join_hot_both_outer", f"""SELECT coalesce(l.k, r.k) AS k, c_custkey, s_suppkey
    FROM {_NATION_LEFT} AS l FULL JOIN {_NATION_RIGHT} AS r ON l.k IS NOT DISTINCT FROM r.k""")
def f1_hot_both(spark, folder):
    """Keys that are hot on both sides, NULL among them, with unmatched rows on both sides."""
    nation = F.col("c_nationkey")
    left = read(spark, folder, "customer").select(
        F.when(nation < 8, 0).when(nation < 12, None).otherwise(F.col("c_custkey"))
        .cast("long").alias("k"), "c_custkey")
    nation, own = F.col("s_nationkey"), F.col("s_suppkey")
    right = read(spark, folder, "supplier").select(
        F.when(nation < 8, 0).when(nation < 12, None).when(nation < 16, own).otherwise(-own)
        .cast("long").alias("k"), "s_suppkey")
    return ts.merge_tables(left, right, on="k", how="outer", large_bytes=1, part_rows=50)


@query("f1_join_hot_keys", _join_sql("outer"))
def f1_hot(spark, folder):
    """The split for hot keys, forced on by a size limit of one byte."""
    return ts.merge_tables(*_sides(spark, folder), on="custkey", how="outer",
                           large_bytes=1, share=0.001)
