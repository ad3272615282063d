"""J: insights and the full report. K: filters, key figures, chart data."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

import tablescope as ts
from tablescope.operators import facets
from tablescope.operators.importance import categorical_importance
from tablescope.plans.insights import INSIGHTS, insight_rows

from .base import (
    LINEITEM_GAPS,
    lineitem_gaps,
    query,
    read,
    rnd,
    rnd_sql,
    sig,
    sig_sql,
    sigs,
)

# -- J ---------------------------------------------------------------------------------------

_J = """(SELECT exp(c_acctbal / 2000.0) AS heavy, -exp(c_acctbal / 2100.0) AS mirrored,
    CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS sparse,
    CASE WHEN c_custkey % 10 < 8 THEN 'home' ELSE 'abroad' END AS market FROM customer)"""


def _signals(spark, folder):
    key = F.col("c_custkey")
    return read(spark, folder, "customer").select(
        F.exp(F.col("c_acctbal") / 2000.0).alias("heavy"),
        (-F.exp(F.col("c_acctbal") / 2100.0)).alias("mirrored"),
        F.when(key % 2 == 0, F.col("c_acctbal")).alias("sparse"),
        F.when(key % 10 < 8, "home").otherwise("abroad").alias("market"),
    )


def _found(df, **extra):
    """Insights straight from the sections, without the cleaning step."""
    numbers = [c for c in ("heavy", "mirrored", "sparse") if c in df.columns]
    corr = ts.compute_correlation(df, numbers)
    return ts.generate_insights(
        rows=df.count(), duplicates=ts.duplicate_count(df).first()["duplicates"],
        missing=ts.detect_missing_values(df).collect(),
        stats=ts.describe_numerical(df, numbers).collect(),
        pairs=ts.signed_pairs(corr).collect(),
        dominant=ts.dominant_categories(df, ["market"]).collect(), **extra)


def _frame(spark, insights):
    rows = spark.createDataFrame(insight_rows(insights), INSIGHTS)
    return rows.select("rank", "kind", sig("score").alias("score"))


@query("j1_j4_j8_insights", f"""WITH s AS (SELECT * FROM {_J} AS s),
    n AS (SELECT least(1.0, count(*) / 1000.0) AS size, count(*) AS rows FROM s),
    q AS (SELECT quantile_cont(heavy, 0.25) AS a, quantile_cont(heavy, 0.75) AS b,
        quantile_cont(mirrored, 0.25) AS c, quantile_cont(mirrored, 0.75) AS d,
        greatest(abs(skewness(heavy)), abs(skewness(mirrored))) AS skew,
        corr(heavy, mirrored) AS r FROM s),
    o AS (SELECT greatest(
        count(*) FILTER (heavy < a - 1.5 * (b - a) OR heavy > b + 1.5 * (b - a)) / count(*),
        count(*) FILTER (mirrored < c - 1.5 * (d - c) OR mirrored > d + 1.5 * (d - c))
            / count(*)) AS ratio FROM s, q),
    f AS (SELECT 'quality' AS kind, 0.6 * least(1, 0.9 * size) AS score FROM n
        UNION ALL SELECT 'outliers', 0.8 * least(1, 0.8 * size * ratio) FROM n, o
            WHERE ratio > 0.05
        UNION ALL SELECT 'skewness', 0.8 * least(1, 0.9 * size * least(1, skew / 5)) FROM n, q
            WHERE skew > 1
        UNION ALL SELECT 'correlation', 0.8 * least(1, 0.85 * size * abs(r)) FROM n, q
            WHERE abs(r) >= 0.6)
    SELECT CAST(row_number() OVER (ORDER BY score DESC) AS INTEGER) AS rank, kind,
        {sig_sql('score')} AS score FROM f ORDER BY score DESC LIMIT 3""")
def j8(spark, folder):
    return _frame(spark, _found(_signals(spark, folder)))


@query("j5_j6_identifiers_and_concentration", f"""SELECT CAST(row_number() OVER (
        ORDER BY score DESC) AS INTEGER) AS rank, kind, {sig_sql('score')} AS score FROM (
    SELECT 'identifiers' AS kind, 0.4 * least(1, 0.95 * least(1, count(*) / 1000.0)) AS score
        FROM customer
    UNION ALL SELECT 'concentration', 0.5 * least(1, 0.8 * least(1, count(*) / 1000.0)
        * count(*) FILTER (market = 'home') / count(*)) FROM {_J} AS s)""")
def j6(spark, folder):
    df = read(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 10 < 8, "home").otherwise("abroad")
        .alias("market"))
    found = ts.generate_insights(
        rows=df.count(), duplicates=ts.duplicate_count(df).first()["duplicates"],
        missing=ts.detect_missing_values(df).collect(), identifiers=["c_custkey"],
        identifier_reasons={"c_custkey": ["unique"]},
        dominant=ts.dominant_categories(df, ["market"]).collect())
    return _frame(spark, found)


@query("j7_feature_table_and_clean_table", """SELECT 'clean' AS kind, count(*) AS row_count
    FROM customer UNION ALL SELECT 'features', count(*) FROM customer""")
def j7(spark, folder):
    customer = read(spark, folder, "customer")
    missing = ts.detect_missing_values(customer).collect()
    out = None
    for dataset_type in ("unknown", "feature_dataset"):
        found = ts.generate_insights(
            rows=customer.count(), missing=missing, dataset_type=dataset_type)
        row = customer.agg(F.lit(found[0].kind).alias("kind"),
                         F.count(F.lit(1)).alias("row_count"))
        out = row if out is None else out.unionByName(row)
    return out


@query("j9_report_overview", """SELECT 'temporal_dataset' AS dataset_type,
    'o_orderdate' AS datetime_column, count(*) AS row_count, CAST(0 AS BIGINT) AS duplicates,
    CASE WHEN count(DISTINCT o_totalprice) / count(*) > 0.9 THEN 'o_orderkey,o_totalprice'
        ELSE 'o_orderkey' END AS identifiers,
    'o_orderstatus,o_orderpriority' AS dimensions FROM orders""")
def j9(spark, folder):
    clean, report = ts.run_pipeline(read(spark, folder, "orders"))
    return clean.agg(
        F.lit(report.dataset_type).alias("dataset_type"),
        F.lit(report.datetime_column).alias("datetime_column"),
        F.count(F.lit(1)).alias("row_count"),
        F.lit(report.duplicates).cast("long").alias("duplicates"),
        F.lit(",".join(sorted(report.roles.identifiers))).alias("identifiers"),
        F.lit(",".join(report.roles.dimensions)).alias("dimensions"),
    )


@query("j9_report_clean_table", """SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey,
    coalesce(o_orderstatus, (SELECT o_orderstatus FROM orders WHERE o_orderkey % 13 <> 0
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus,
    coalesce(o_totalprice, (SELECT median(o_totalprice) FROM orders WHERE o_orderkey % 7 <> 0))
        AS o_totalprice
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END
            AS o_orderstatus,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice FROM orders)""")
def j9_clean(spark, folder):
    """Text in, typed and filled out; without a date column, so by mode and median."""
    key = F.col("o_orderkey")
    text = read(spark, folder, "orders").select(
        key.cast("string").alias("O OrderKey"),
        F.when(key % 13 != 0, F.col("o_orderstatus")).alias("O OrderStatus"),
        F.when(key % 7 != 0, F.col("o_totalprice").cast("string")).alias("O TotalPrice"))
    clean, _ = ts.run_pipeline(text)
    return clean


@query("j9_report_rollup", """SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice
    FROM orders GROUP BY ALL""")
def j9_rollup(spark, folder):
    _, report = ts.run_pipeline(read(spark, folder, "orders").drop("o_orderkey", "o_custkey"))
    return report["olap_rollup"].withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("j9_report_insights", f"""WITH n AS (
        SELECT least(1.0, count(*) / 1000.0) AS size, count(*)::DOUBLE AS rows FROM events),
    v AS (UNPIVOT (SELECT event_id::DOUBLE AS event_id, user_id::DOUBLE AS user_id, value
        FROM events) ON event_id, user_id, value INTO NAME c VALUE x),
    q AS (SELECT c, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b, skewness(x) AS k
        FROM v GROUP BY c),
    o AS (SELECT max(r) AS r FROM (SELECT count(*) FILTER (
        x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) / count(*) AS r
        FROM v JOIN q USING (c) GROUP BY c)),
    p AS (SELECT unnest([corr(event_id, user_id), corr(event_id, value), corr(user_id, value)])
        AS r FROM events),
    g AS (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM events GROUP BY event_type
        UNION ALL SELECT count(*) FROM events GROUP BY user_id
        UNION ALL SELECT count(*) FROM events GROUP BY props)),
    f AS (SELECT 'outliers' AS kind, 0.8 * least(1, 0.8 * size * r) AS score FROM n, o
            WHERE r > 0.05
        UNION ALL SELECT 'skewness', 0.8 * least(1, 0.9 * size
            * least(1, (SELECT max(abs(k)) FROM q) / 5)) FROM n
            WHERE (SELECT max(abs(k)) FROM q) > 1
        UNION ALL SELECT 'correlation', 0.8 * least(1, 0.85 * size * coalesce(
            (SELECT abs(min(r)) FROM p WHERE r <= -0.6), (SELECT max(r) FROM p WHERE r >= 0.6)))
            FROM n WHERE EXISTS (SELECT 1 FROM p WHERE abs(r) >= 0.6)),
    i AS (SELECT * FROM f UNION ALL SELECT 'identifiers', 0.4 * least(1, 0.95 * size) FROM n
        WHERE (SELECT count(*) FROM f) < 3),
    t AS (SELECT * FROM i UNION ALL SELECT 'concentration', 0.5 * least(1, 0.8 * size
        * top / rows) FROM n, g WHERE (SELECT count(*) FROM i) < 3 AND top / rows > 0.5)
    SELECT CAST(row_number() OVER (ORDER BY score DESC) AS INTEGER) AS rank, kind,
        {sig_sql('score')} AS score FROM t ORDER BY score DESC LIMIT 3""")
def j9_insights(spark, folder):
    """On events nothing repeats and nothing is missing, so no quality finding."""
    _, report = ts.run_pipeline(read(spark, folder, "events"))
    return report["insights"].select("rank", "kind", sig("score").alias("score"))


# -- K ---------------------------------------------------------------------------------------

@query("k1_filter_facets", f"""WITH s AS (SELECT * FROM {LINEITEM_GAPS} AS s)
    SELECT 'l_returnflag' AS "column", 'dimension' AS kind, NULL::DOUBLE AS low,
        NULL::DOUBLE AS high, NULL::TIMESTAMP AS first, NULL::TIMESTAMP AS last,
        string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS "values" FROM s
    UNION ALL SELECT 'l_linestatus', 'dimension', NULL, NULL, NULL, NULL,
        string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) FROM s
    UNION ALL SELECT 'l_discount', 'metric', min(l_discount), max(l_discount), NULL, NULL, NULL
        FROM s
    UNION ALL SELECT 'l_shipdate', 'time', NULL, NULL, min(l_shipdate), max(l_shipdate), NULL
        FROM s""")
def k1(spark, folder):
    df = lineitem_gaps(spark, folder).withColumn("one", F.lit("same"))
    roles = ts.ColumnRoles(dimensions=["l_linestatus", "one", "l_returnflag"],
                           metrics=["l_discount"], temporal=["l_shipdate"])
    scores = {r["column"]: r["score"] for r in categorical_importance(
        df, roles.dimensions).collect()}
    found = facets.filter_facets(df, roles, scores)
    return found.select("column", "kind", "low", "high", "first", "last",
                        F.array_join("values", "|").alias("values"))


@query("k2_value_filter", """SELECT o_orderkey, o_orderstatus FROM orders
    WHERE o_orderstatus IN ('F', 'P')""")
def k2(spark, folder):
    return facets.filter_values(read(spark, folder, "orders"), "o_orderstatus", ["F", "P"]).select(
        "o_orderkey", "o_orderstatus")


@query("k3_range_filter", """SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_totalprice BETWEEN 50000 AND 150000.5""")
def k3(spark, folder):
    return facets.filter_range(
        read(spark, folder, "orders"), "o_totalprice", 50000, 150000.5).select(
        "o_orderkey", "o_totalprice")


@query("k4_date_filter", """SELECT event_id, ts FROM events
    WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'""")
def k4(spark, folder):
    return facets.filter_dates(
        read(spark, folder, "events"), "ts", date(2024, 1, 5), date(2024, 1, 9)).select(
        "event_id", "ts")


@query("k5_all_filters", """SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O')
    AND o_totalprice BETWEEN 1000 AND 90000
    AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def k5(spark, folder):
    return facets.apply_filters(
        read(spark, folder, "orders"), {"o_orderstatus": ["O"]}, {"o_totalprice": (1000, 90000)},
        {"o_orderdate": (date(1996, 1, 1), date(1998, 12, 31))}).select("o_orderkey")


@query("k5_empty_result_resets", "SELECT o_orderkey FROM orders")
def k5_empty(spark, folder):
    return facets.apply_filters(
        read(spark, folder, "orders"), {"o_orderstatus": ["none such"]}).select("o_orderkey")


@query("k6_kpis", f"""SELECT count(*) AS records, round(sum(o_totalprice), 2) AS total,
    {sig_sql('avg(o_totalprice)')} AS average FROM orders""")
def k6(spark, folder):
    df = read(spark, folder, "orders")
    roles = ts.ColumnRoles(metrics=["o_custkey", "o_totalprice"])
    metric = facets.primary_metric(df, roles, {"o_custkey": 0.1, "o_totalprice": 1.0})
    return facets.kpis(df, metric).select(
        "records", F.round("total", 2).alias("total"), sig("average").alias("average"))


_MONTHS = """m AS (SELECT date_trunc('month', o_orderdate) AS d, sum(o_totalprice) AS v
        FROM orders WHERE month(o_orderdate) <> 4 GROUP BY 1),
    g AS (SELECT last_day(unnest(generate_series((SELECT min(d) FROM m)::TIMESTAMP,
        (SELECT max(d) FROM m)::TIMESTAMP, INTERVAL 1 MONTH))::DATE) AS e),
    f AS (SELECT e::TIMESTAMP AS o_orderdate, coalesce(v, 0) AS o_totalprice
        FROM g LEFT JOIN m ON last_day(d::DATE) = e)"""


def _without_april(spark, folder):
    """All orders; those of April have no date."""
    return read(spark, folder, "orders").withColumn(
        "o_orderdate", F.when(F.month("o_orderdate") != 4, F.col("o_orderdate")))


@query("k7_monthly_trend",
       f"WITH {_MONTHS} SELECT o_orderdate, round(o_totalprice, 2) AS o_totalprice FROM f")
def k7(spark, folder):
    return facets.monthly_trend(
        _without_april(spark, folder), "o_orderdate", "o_totalprice").withColumn(
        "o_totalprice", F.round("o_totalprice", 2))


@query("k8_monthly_rolling", f"""WITH {_MONTHS} SELECT o_orderdate,
    round(o_totalprice, 2) AS o_totalprice,
    {sig_sql('avg(o_totalprice) OVER (ORDER BY o_orderdate ROWS 2 PRECEDING)')} AS rolling_avg
    FROM f""")
def k8(spark, folder):
    rolled = facets.monthly_rolling(
        _without_april(spark, folder), "o_orderdate", "o_totalprice")
    return rolled.select("o_orderdate", F.round("o_totalprice", 2).alias("o_totalprice"),
                         sig("rolling_avg").alias("rolling_avg"))


@query("k9_top_categories", """SELECT p_name, round(sum(p_retailprice), 2) AS p_retailprice
    FROM (SELECT nullif(p_name, (SELECT min(p_name) FROM part)) AS p_name, p_retailprice
        FROM part) GROUP BY 1 ORDER BY sum(p_retailprice) DESC, p_name NULLS FIRST LIMIT 20""")
def k9(spark, folder):
    part = read(spark, folder, "part")
    smallest = part.agg(F.min("p_name")).first()[0]
    part = part.withColumn("p_name", F.nullif("p_name", F.lit(smallest)))
    return facets.top_categories(part, "p_name", "p_retailprice").withColumn(
        "p_retailprice", F.round("p_retailprice", 2))


@query("k10_pivot_matrix", """SELECT o_orderpriority,
    coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2), 0) AS o_totalprice_F,
    coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2), 0) AS o_totalprice_O,
    coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2), 0) AS o_totalprice_P
    FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderstatus <> 'F' GROUP BY ALL""")
def k10(spark, folder):
    df = read(spark, folder, "orders").withColumn("o_totalprice", F.expr(
        "CASE WHEN o_orderpriority != '1-URGENT' OR o_orderstatus != 'F' THEN o_totalprice END"))
    pivot = ts.pivot_analysis(df, ["o_orderpriority"], ["o_orderstatus"], "o_totalprice",
                              fill_value=None)
    matrix = facets.pivot_matrix(pivot)
    return matrix.withColumns({c: F.round(c, 2) for c in matrix.columns[1:]})


def _histogram_sql(x, table):
    return f"""WITH v AS (SELECT {x} AS x FROM {table}),
        r AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
        SELECT CAST(least(30, floor(30 * (x - lo) / (hi - lo)) + 1) AS INTEGER) AS bin,
            {rnd_sql('any_value(lo) + (least(30, floor(30 * (x - lo) / (hi - lo)) + 1) - 1) * (any_value(hi) - any_value(lo)) / 30')} AS low,
            {rnd_sql('any_value(lo) + least(30, floor(30 * (x - lo) / (hi - lo)) + 1) * (any_value(hi) - any_value(lo)) / 30')} AS high,
            count(*) AS "count"
        FROM v, r GROUP BY least(30, floor(30 * (x - lo) / (hi - lo)) + 1)"""


@query("k11_histogram", _histogram_sql("o_totalprice", "orders"))
def k11(spark, folder):
    bins = facets.histogram(read(spark, folder, "orders"), "o_totalprice")
    return bins.withColumns({"low": rnd("low"), "high": rnd("high")})


@query("k11_histogram_log", _histogram_sql("ln(1 + exp(c_acctbal / 2000.0))", "customer"))
def k11_log(spark, folder):
    df = read(spark, folder, "customer").select(
        F.exp(F.col("c_acctbal") / 2000.0).alias("heavy"))
    bins = facets.histogram(df, "heavy", log=True)
    return bins.withColumns({"low": rnd("low"), "high": rnd("high")})


@query("k12_box_plot", f"""WITH v AS (SELECT exp(c_acctbal / 2000.0) AS x FROM customer),
    q AS (SELECT quantile_cont(x, 0.25) AS q1, median(x) AS q2, quantile_cont(x, 0.75) AS q3
        FROM v),
    f AS (SELECT *, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM v, q)
    SELECT {sig_sql('any_value(q1)')} AS q1, {sig_sql('any_value(q2)')} AS median,
        {sig_sql('any_value(q3)')} AS q3, {sig_sql('min(x) FILTER (inside)')} AS lower_whisker,
        {sig_sql('max(x) FILTER (inside)')} AS upper_whisker,
        count(*) FILTER (NOT inside) AS outlier_count FROM f""")
def k12(spark, folder):
    df = read(spark, folder, "customer").select(
        F.exp(F.col("c_acctbal") / 2000.0).alias("heavy"))
    return sigs(facets.box_plot(df, "heavy"), "q1", "median", "q3", "lower_whisker",
                "upper_whisker")


@query("k13_olap_view", f"""SELECT l_returnflag, sum(l_quantity) AS "Total",
    {sig_sql('avg(l_quantity)')} AS "Average", count(l_quantity) AS "Count"
    FROM {LINEITEM_GAPS} AS s WHERE l_returnflag IS NOT NULL GROUP BY ALL""")
def k13(spark, folder):
    view = facets.olap_view(lineitem_gaps(spark, folder), "l_returnflag", "l_quantity")
    return sigs(view, "Average")


@query("k14_olap_cross_view", f"""SELECT l_linenumber,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS "l_quantity_A",
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS "l_quantity_N"
    FROM {LINEITEM_GAPS} AS s WHERE l_returnflag IS NOT NULL GROUP BY ALL""")
def k14(spark, folder):
    return facets.olap_view(
        lineitem_gaps(spark, folder), "l_linenumber", "l_quantity", "l_returnflag")


def _register_level(level, rows):
    limit = f"ORDER BY p_name LIMIT {rows}" if rows else ""

    @query(f"k15_level_{level.lower().replace(' ', '_')}", f"""SELECT p_name,
        round(sum(p_retailprice), 2) AS "Total", count(*) AS "Count" FROM part GROUP BY 1 {limit}""")
    def k15(spark, folder):
        view = facets.olap_view(read(spark, folder, "part"), "p_name", "p_retailprice")
        return facets.drill_level(view, level).select(
            "p_name", F.round("Total", 2).alias("Total"), "Count")


for _level, _rows in facets.DRILL_ROWS.items():
    _register_level(_level, _rows)


@query("k16_sample_rows", "SELECT least(10, count(*)) AS n, true AS members FROM orders")
def k16(spark, folder):
    """Which rows come is open; that they are as many as asked for and all of the table is not."""
    orders = read(spark, folder, "orders")
    some = facets.sample_rows(orders)
    known = some.join(orders.select(F.col("o_orderkey").alias("key"), F.lit(True).alias("known")),
                      F.col("o_orderkey") == F.col("key"), "left")
    return known.agg(F.count(F.lit(1)).alias("n"),
                     F.coalesce(F.bool_and(F.coalesce("known", F.lit(False))), F.lit(True))
                     .alias("members"))


_HEAT = ["l_quantity", "l_extendedprice", "l_tax"]


@query("k17_correlation_heatmap", " UNION ALL ".join(
    f"SELECT '{a}' AS \"column\", " + ", ".join(
        (f"1.0 AS {b}" if a == b else f"{rnd_sql(f'corr({a}, {b})')} AS {b}") for b in _HEAT)
    + " FROM lineitem" for a in _HEAT))
def k17(spark, folder):
    corr = ts.compute_correlation(read(spark, folder, "lineitem"), _HEAT)
    wide = facets.correlation_heatmap(corr, _HEAT)
    return wide.withColumns({c: rnd(c) for c in _HEAT})
