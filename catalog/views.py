"""H: OLAP. I: time series."""

from __future__ import annotations

from pyspark.sql import functions as F

import tablescope as ts

from .base import (
    EVENTS_GAPS,
    LINEITEM_GAPS,
    events_gaps,
    lineitem_gaps,
    query,
    read,
    rnd,
    rnd_sql,
    sig_sql,
    sigs,
)


def _money(df, *names):
    return df.withColumns({n: F.round(n, 2) for n in names})


@query("h1_rollup", """SELECT l_returnflag, l_linestatus,
    round(sum(l_extendedprice), 2) AS l_extendedprice, sum(l_quantity) AS l_quantity
    FROM lineitem GROUP BY ALL""")
def h1(spark, folder):
    df = read(spark, folder, "lineitem")
    return _money(ts.rollup(df, ["l_returnflag", "l_linestatus", "absent"],
                            ["l_extendedprice", "l_quantity"]), "l_extendedprice")


@query("h1_rollup_gaps", f"""SELECT l_returnflag, coalesce(sum(l_quantity), 0) AS l_quantity
    FROM {LINEITEM_GAPS} AS s GROUP BY ALL""")
def h1_gaps(spark, folder):
    return ts.rollup(lineitem_gaps(spark, folder), ["l_returnflag"], ["l_quantity"])


@query("h1_rollup_nan_key", """SELECT CASE WHEN l_linenumber > 2 THEN l_discount END AS l_discount,
    sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1""")
def h1_nan(spark, folder):
    number = F.col("l_linenumber")
    df = read(spark, folder, "lineitem").select("l_quantity", F.when(
        number == 2, F.lit(float("nan"))).when(number > 2, F.col("l_discount")).alias("l_discount"))
    return ts.rollup(df, ["l_discount"], ["l_quantity"])


@query("h2_levels_median", """SELECT l_returnflag, l_linestatus,
    CAST(2 - grouping(l_returnflag) - grouping(l_linestatus) AS INTEGER) AS level,
    median(l_extendedprice) AS l_extendedprice, max(l_quantity) AS l_quantity
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def h2_median(spark, folder):
    """A metric the mapping leaves out is left out of the result."""
    return ts.drilldown(read(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"],
                        ["l_extendedprice", "l_quantity", "l_tax"],
                        {"l_extendedprice": "median", "l_quantity": "max"}, all_levels=True)


@query("h5_pivot_median", """SELECT l_returnflag,
    coalesce(median(l_quantity) FILTER (l_linestatus = 'F'), 0) AS l_quantity_F,
    coalesce(median(l_quantity) FILTER (l_linestatus = 'O'), 0) AS l_quantity_O
    FROM lineitem GROUP BY 1""")
def h5_median(spark, folder):
    return ts.pivot_analysis(read(spark, folder, "lineitem"), ["l_returnflag"], ["l_linestatus"],
                             "l_quantity", "median")


@query("h5_pivot_nan_label", """SELECT l_linenumber,
    coalesce(sum(l_tax) FILTER (l_returnflag = 'A'), 0) > 0 AS named_a,
    count(*) FILTER (l_returnflag = 'N') AS named_nan, count(*) FILTER (l_returnflag = 'R') AS missing
    FROM lineitem GROUP BY 1""")
def h5_nan(spark, folder):
    """The text 'nan' and a missing value are two columns."""
    flag = F.col("l_returnflag")
    df = read(spark, folder, "lineitem").select("l_linenumber", F.lit(1).alias("v"), F.when(
        flag == "N", "nan").when(flag != "R", flag).alias("label"))
    wide = ts.pivot_analysis(df, ["l_linenumber"], ["label"], "v", "count")
    return wide.select("l_linenumber", (F.col("v_A") > 0).alias("named_a"),
                       F.col("v_nan").alias("named_nan"), F.col("v_nan_2").alias("missing"))


@query("h6_sum_large_keys", """SELECT l_returnflag,
    CAST(sum(CAST(l_orderkey AS HUGEINT) + 9000000000000000000) AS VARCHAR) AS total
    FROM lineitem GROUP BY 1""")
def h6_large(spark, folder):
    """Sums far beyond what a long holds."""
    df = read(spark, folder, "lineitem").select("l_returnflag", (
        F.col("l_orderkey") + F.lit(9_000_000_000_000_000_000)).alias("total"))
    return ts.rollup(df, ["l_returnflag"], ["total"]).withColumn(
        "total", F.col("total").cast("string"))


@query("h2_drilldown", """SELECT l_returnflag, l_linestatus, l_linenumber,
    sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL""")
def h2(spark, folder):
    return ts.drilldown(read(spark, folder, "lineitem"),
                        ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_quantity"])


@query("h2_drilldown_all_levels", """SELECT l_returnflag, l_linestatus, l_linenumber,
    CAST(3 - grouping(l_returnflag) - grouping(l_linestatus) - grouping(l_linenumber) AS INTEGER)
        AS level, sum(l_quantity) AS l_quantity
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)""")
def h2_levels(spark, folder):
    return ts.drilldown(read(spark, folder, "lineitem"),
                        ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_quantity"],
                        all_levels=True)


@query("h3_slice", """SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice
    FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL""")
def h3(spark, folder):
    df = read(spark, folder, "lineitem")
    return _money(ts.slice_olap(df, {"l_returnflag": "A", "absent": 1}, ["l_extendedprice"]),
                  "l_extendedprice")


@query("h4_dice", """SELECT l_returnflag, l_linestatus, avg(l_quantity) AS l_quantity
    FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem)
    WHERE l_returnflag = 'N' AND l_linestatus = 'O' GROUP BY ALL""".replace(
    "avg(l_quantity)", sig_sql("avg(l_quantity)")))
def h4(spark, folder):
    return sigs(ts.dice(read(spark, folder, "lineitem"),
                        {"l_returnflag": "N", "l_linestatus": "O"}, ["l_quantity"], "mean"),
                "l_quantity")


@query("h4_dice_list_and_range", """SELECT l_returnflag, l_linenumber, count(l_tax) AS l_tax
    FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber BETWEEN 2 AND 4
    GROUP BY ALL""")
def h4_ranges(spark, folder):
    return ts.dice(read(spark, folder, "lineitem"),
                   {"l_returnflag": ["A", "R"], "l_linenumber": (2, 4)}, ["l_tax"], "count")


@query("h5_pivot", f"""SELECT l_linestatus,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS l_quantity_A,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS l_quantity_N,
    coalesce(sum(l_quantity) FILTER (l_returnflag IS NULL), 0) AS l_quantity_nan
    FROM {LINEITEM_GAPS} AS s GROUP BY ALL""")
def h5(spark, folder):
    return ts.pivot_analysis(
        lineitem_gaps(spark, folder), ["l_linestatus"], ["l_returnflag"], "l_quantity")


_SPARSE = f"(SELECT * FROM {LINEITEM_GAPS} AS g WHERE l_linenumber <> 2 OR l_returnflag = 'A')"


@query("h5_pivot_product", f"""WITH s AS {_SPARSE},
    a AS (SELECT DISTINCT l_returnflag FROM s), b AS (SELECT DISTINCT l_linenumber FROM s)
    SELECT a.l_returnflag, b.l_linenumber,
        coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS l_quantity_F,
        coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS l_quantity_O,
        CAST(coalesce(sum(l_orderkey) FILTER (l_linestatus = 'F'), 0) AS BIGINT) AS l_orderkey_F,
        CAST(coalesce(sum(l_orderkey) FILTER (l_linestatus = 'O'), 0) AS BIGINT) AS l_orderkey_O
    FROM a CROSS JOIN b LEFT JOIN s ON s.l_returnflag IS NOT DISTINCT FROM a.l_returnflag
        AND s.l_linenumber = b.l_linenumber GROUP BY ALL""")
def h5_product(spark, folder):
    sparse = F.col("l_linenumber") != 2
    df = lineitem_gaps(spark, folder).withColumns({
        c: F.when(sparse | (F.col("l_returnflag") == "A"), F.col(c))
        for c in ("l_quantity", "l_orderkey")})
    wide = ts.pivot_analysis(df, ["l_returnflag", "l_linenumber"], ["l_linestatus"],
                             ["l_quantity", "l_orderkey"], dense=True)
    return wide.withColumns({c: F.col(c).cast("bigint") for c in ("l_orderkey_F", "l_orderkey_O")})


@query("h5_pivot_two_columns", """SELECT l_linenumber,
    count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS l_tax_A_F,
    count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS l_tax_A_O,
    count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS l_tax_N_F,
    count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS l_tax_N_O,
    count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS l_tax_R_F,
    count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS l_tax_R_O
    FROM lineitem GROUP BY ALL""")
def h5_two(spark, folder):
    return ts.pivot_analysis(read(spark, folder, "lineitem"), ["l_linenumber"],
                             ["l_returnflag", "l_linestatus"], "l_tax", "count")


@query("h5_pivot_no_columns", f"""SELECT l_returnflag, {sig_sql('coalesce(avg(l_discount), 0)')}
    AS l_discount, {sig_sql('coalesce(avg(l_quantity), 0)')} AS l_quantity
    FROM {LINEITEM_GAPS} AS s GROUP BY ALL""")
def h5_plain(spark, folder):
    return sigs(ts.pivot_analysis(
        lineitem_gaps(spark, folder), ["l_returnflag"], values=["l_quantity", "l_discount"],
        aggfunc="mean"), "l_discount", "l_quantity")


# name -> SQL over x; every aggregate is taken of the same column, with gaps
_AGGREGATES = {
    "sum": "coalesce(sum(x), 0)", "mean": "avg(x)", "median": "median(x)", "min": "min(x)",
    "max": "max(x)", "count": "count(x)", "nunique": "count(DISTINCT x)",
    "std": "stddev_samp(x)", "var": "var_samp(x)", "size": "count(*)",
    "sem": "stddev_samp(x) / sqrt(count(x))",
    "skew": "CASE WHEN min(x) = max(x) THEN 0.0 ELSE skewness(x) END",
}


@query("h6_aggregates", "SELECT l_linenumber, l_returnflag, " + ", ".join(
    f"{sig_sql(e)} AS \"{n}\"" for n, e in _AGGREGATES.items())
    + f" FROM (SELECT *, l_quantity AS x FROM {LINEITEM_GAPS} AS s) GROUP BY ALL")
def h6(spark, folder):
    df = lineitem_gaps(spark, folder)
    df = df.select("l_linenumber", "l_returnflag",
                   *[F.col("l_quantity").alias(n) for n in _AGGREGATES])
    names = list(_AGGREGATES)
    return sigs(ts.rollup(df, ["l_linenumber", "l_returnflag"], names,
                          {n: n for n in names}), *names)


@query("h6_product", f"""SELECT l_linenumber, {sig_sql('coalesce(product(1 + l_discount / 1000), 1)')}
    AS growth FROM {LINEITEM_GAPS} AS s GROUP BY ALL""")
def h6_product(spark, folder):
    df = lineitem_gaps(spark, folder).withColumn("growth", 1 + F.col("l_discount") / 1000)
    return sigs(ts.rollup(df, ["l_linenumber"], ["growth"], "prod"), "growth")


@query("h6_first_last", f"""SELECT event_type,
    arg_min(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value,
    arg_max(amount, (ts, event_id)) FILTER (amount IS NOT NULL) AS amount
    FROM (SELECT *, value AS amount FROM {EVENTS_GAPS} AS s WHERE ts IS NOT NULL) GROUP BY ALL""")
def h6_first(spark, folder):
    known = F.when(F.col("ts").isNotNull(), F.col("value"))     # values at an unknown time count for nothing
    df = events_gaps(spark, folder).withColumns({"value": known, "amount": known})
    return ts.rollup(df, ["event_type"], ["value", "amount"],
                     {"value": "first", "amount": "last"}, order_by=["ts", "event_id"])


@query("h6_median_of_large_groups", f"""SELECT l_returnflag, median(l_extendedprice)
    AS l_extendedprice, median(l_discount) AS l_discount, max(l_quantity) AS l_quantity
    FROM {LINEITEM_GAPS} AS s GROUP BY ALL""")
def h6_median(spark, folder):
    from tablescope.operators.olap import group_aggregate

    return group_aggregate(
        lineitem_gaps(spark, folder), ["l_returnflag"],
        ["l_extendedprice", "l_discount", "l_quantity"],
        {"l_extendedprice": "median", "l_discount": "median", "l_quantity": "max"},
        median_limit=2_000)


@query("h6_own_function", """SELECT l_returnflag, max(l_quantity) - min(l_quantity)
    AS l_quantity FROM lineitem GROUP BY ALL""")
def h6_own(spark, folder):
    return ts.rollup(read(spark, folder, "lineitem"), ["l_returnflag"], ["l_quantity"],
                     lambda c: F.max(c) - F.min(c))


# -- I ---------------------------------------------------------------------------------------

_BUCKETS = {"ME": "month", "W": "week", "Q": "quarter", "Y": "year", "D": "day"}


def _register_bucket(freq, unit):
    @query(f"i1_aggregate_{unit}", f"""SELECT date_trunc('{unit}', o_orderdate)::TIMESTAMP
        AS o_orderdate, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1""")
    def i1(spark, folder):
        df = read(spark, folder, "orders")
        return _money(ts.aggregate_time(df, "o_orderdate", freq, ["o_totalprice"]),
                      "o_totalprice")


for _freq, _unit in _BUCKETS.items():
    _register_bucket(_freq, _unit)


@query("i1_first_last_of_month", """SELECT date_trunc('month', o_orderdate)::TIMESTAMP
    AS o_orderdate, arg_min(o_totalprice, (o_orderdate, o_totalprice)) AS first_price,
    arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS last_price FROM orders GROUP BY 1""")
def i1_first_last(spark, folder):
    """No order given: by the date, orders of one time by their price."""
    df = read(spark, folder, "orders").select("o_orderdate", "o_totalprice")
    first, last = (ts.aggregate_time(df, "o_orderdate", "M", ["o_totalprice"], f).toDF(
        "o_orderdate", f"{f}_price") for f in ("first", "last"))
    return first.join(last, "o_orderdate")


@query("i1_aggregate_hour_gaps", f"""SELECT date_trunc('hour', ts)::TIMESTAMP AS ts,
    {sig_sql('avg(value)')} AS value FROM {EVENTS_GAPS} AS s WHERE ts IS NOT NULL GROUP BY 1""")
def i1_hour(spark, folder):
    return sigs(ts.aggregate_time(events_gaps(spark, folder), "ts", "h", ["value"], "mean"),
                "value")


@query("i1_aggregate_15min", f"""SELECT time_bucket(INTERVAL 15 MINUTE, ts)::TIMESTAMP AS ts,
    {sig_sql('sum(value)')} AS value FROM events GROUP BY 1""")
def i1_quarters_of_an_hour(spark, folder):
    return sigs(ts.aggregate_time(read(spark, folder, "events"), "ts", "15min", ["value"]), "value")


@query("i1_aggregate_anchored", f"""SELECT (date_trunc('week', o_orderdate - INTERVAL 2 DAY)
    + INTERVAL 2 DAY)::TIMESTAMP AS o_orderdate, {sig_sql('sum(o_totalprice)')} AS o_totalprice
    FROM orders GROUP BY 1""")
def i1_anchored(spark, folder):
    """Weeks that end on a Tuesday."""
    return sigs(ts.aggregate_time(read(spark, folder, "orders"), "o_orderdate", "W-TUE",
                                  ["o_totalprice"]), "o_totalprice")


@query("i2_rolling_average", f"""SELECT m AS o_orderdate,
    {sig_sql('avg(v) OVER (ORDER BY m ROWS 6 PRECEDING)')} AS o_totalprice
    FROM (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, sum(o_totalprice) AS v
        FROM orders GROUP BY 1)""")
def i2(spark, folder):
    return sigs(ts.rolling_average(read(spark, folder, "orders"), "o_orderdate",
                                   ["o_totalprice"]), "o_totalprice")


@query("i2_rolling_min_periods", f"""SELECT m AS o_orderdate,
    {sig_sql('CASE WHEN count(v) OVER w >= 3 THEN avg(v) OVER w END')} AS o_totalprice
    FROM (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, sum(o_totalprice) AS v
        FROM orders GROUP BY 1) WINDOW w AS (ORDER BY m ROWS 3 PRECEDING)""")
def i2_strict(spark, folder):
    return sigs(ts.rolling_average(read(spark, folder, "orders"), "o_orderdate",
                                   ["o_totalprice"], window=4, min_periods=3), "o_totalprice")


def _trend_sql(source, date, value, tie):
    return f"""WITH s AS (SELECT {value} AS y, row_number() OVER w - 1 AS x,
            abs({value} - lag({value}) OVER w) AS d FROM {source} AS s
            WHERE {date} IS NOT NULL AND {value} IS NOT NULL
            WINDOW w AS (ORDER BY {date}, {tie})),
        r AS (SELECT *, avg(d) OVER (ORDER BY x ROWS 6 PRECEDING) AS rolled FROM s)
        SELECT '{date}' AS date_column, '{value}' AS value_column,
            CASE WHEN regr_slope(y, x) > 0 THEN 'increasing' WHEN regr_slope(y, x) < 0
                THEN 'decreasing' ELSE 'flat' END AS trend,
            {sig_sql('regr_slope(y, x)')} AS slope,
            {sig_sql('avg(rolled) / avg(y)')} AS seasonality_index, count(*) AS points FROM r"""


@query("i3_i4_trend", _trend_sql("orders", "o_orderdate", "o_totalprice", "o_orderkey"))
def i3(spark, folder):
    return sigs(ts.detect_trend(read(spark, folder, "orders"), "o_orderdate", "o_totalprice",
                                tie_breaks=["o_orderkey"]), "slope", "seasonality_index")


@query("i3_i4_trend_ranges", _trend_sql(EVENTS_GAPS, "ts", "value", "event_id"))
def i3_ranges(spark, folder):
    return sigs(ts.detect_trend(events_gaps(spark, folder), "ts", "value",
                                tie_breaks=["event_id"], rows_per_range=500),
                "slope", "seasonality_index")


_Z = """WITH s AS (SELECT o_orderdate, o_totalprice, o_orderkey, abs(o_totalprice - (SELECT
    avg(o_totalprice) FROM orders)) / ((SELECT stddev_samp(o_totalprice) FROM orders) + 1e-8)
    AS z_score FROM orders)"""


@query("i5_anomaly_count", f"""{_Z} SELECT count(*) AS "count", CAST(1.5 AS DOUBLE) AS z_threshold
    FROM s WHERE z_score > 1.5""")
def i5_count(spark, folder):
    return ts.detect_temporal_anomalies(
        read(spark, folder, "orders"), "o_orderdate", "o_totalprice", z_threshold=1.5,
        tie_breaks=["o_orderkey"])["count"]


@query("i5_anomalies", f"""{_Z} SELECT o_orderdate, o_totalprice, o_orderkey,
    {rnd_sql('z_score')} AS z_score FROM s WHERE z_score > 1.5
    ORDER BY o_orderdate, o_orderkey LIMIT 5""")
def i5(spark, folder):
    found = ts.detect_temporal_anomalies(
        read(spark, folder, "orders"), "o_orderdate", "o_totalprice", z_threshold=1.5,
        tie_breaks=["o_orderkey"])["anomalies"]
    return found.withColumn("z_score", rnd("z_score"))
