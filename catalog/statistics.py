"""G: descriptive statistics, correlation, importance."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

import tablescope as ts
from tablescope.operators.importance import categorical_importance, numeric_importance

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

_LINEITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


def _describe_sql(source, columns):
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{c}' AS "column", count(x) AS "count",
            {sig_sql('avg(x)')} AS mean, {sig_sql('any_value(q2)')} AS median,
            {sig_sql('stddev_pop(x)')} AS std, {sig_sql('var_pop(x)')} AS variance,
            {sig_sql('any_value(sk)')} AS skewness, {sig_sql('any_value(ku)')} AS kurtosis,
            {sig_sql('any_value(q1)')} AS q1, {sig_sql('any_value(q3)')} AS q3,
            {sig_sql('any_value(q3 - q1)')} AS iqr,
            count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))
                AS outlier_count,
            {sig_sql('count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) / count(x)')}
                AS outlier_ratio
        FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {source} AS s) AS t,
            (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2,
                quantile_cont(x, 0.75) AS q3, skewness(x) AS sk, kurtosis(x) AS ku
             FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {source} AS s)) AS u""")
    return " UNION ALL ".join(parts)


_DESCRIBED = ("mean", "median", "std", "variance", "skewness", "kurtosis", "q1", "q3", "iqr",
              "outlier_ratio")


@query("g1_describe", _describe_sql(LINEITEM_GAPS, _LINEITEM_NUMBERS))
def g1(spark, folder):
    return sigs(ts.describe_numerical(lineitem_gaps(spark, folder), _LINEITEM_NUMBERS), *_DESCRIBED)


_HEAVY = ("(SELECT exp(c_acctbal / 2000.0) AS heavy, c_acctbal, "
          "CAST(c_nationkey AS DOUBLE) AS nation FROM customer)")


def _heavy(spark, folder):
    return read(spark, folder, "customer").select(
        F.exp(F.col("c_acctbal") / 2000.0).alias("heavy"), "c_acctbal",
        F.col("c_nationkey").cast("double").alias("nation"))


@query("g1_describe_skewed", _describe_sql(_HEAVY, ["heavy", "c_acctbal", "nation"]))
def g1_skewed(spark, folder):
    return sigs(ts.describe_numerical(_heavy(spark, folder)), *_DESCRIBED)


def _outlier_sql(source, columns):
    return (f"SELECT \"column\", outlier_count, outlier_ratio "
            f"FROM ({_describe_sql(source, columns)})")


@query("g6_g8_outliers", _outlier_sql(_HEAVY, ["heavy", "c_acctbal", "nation"]))
def g8(spark, folder):
    return sigs(ts.iqr_outlier_summary(_heavy(spark, folder)), "outlier_ratio")


@query("g7_describe_views", _outlier_sql("lineitem", ["l_tax", "l_extendedprice"]))
def g7(spark, folder):
    views = ts.describe_numerical_dict(
        read(spark, folder, "lineitem"), ["l_tax", "l_extendedprice"])
    return sigs(views["outliers"], "outlier_ratio")


def _both_ways(upper, columns):
    diagonal = " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0" for c in columns)
    return f"""WITH u AS ({upper}) SELECT a AS col_a, b AS col_b, corr FROM u
        UNION ALL SELECT b, a, corr FROM u UNION ALL {diagonal}"""


def _pearson_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {rnd_sql(f'corr({a}, {b})')} AS corr FROM {source} AS s"
        for a, b in combinations(columns, 2))


_WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
         "l_tax"]


@query("g9_pearson", _both_ways(_pearson_sql("lineitem", _WIDE), _WIDE))
def g9(spark, folder):
    corr = ts.compute_correlation(read(spark, folder, "lineitem"), _WIDE)
    return corr.withColumn("corr", rnd("corr"))


_GAPPY = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]


@query("g9_pearson_gaps", _both_ways(_pearson_sql(LINEITEM_GAPS, _GAPPY), _GAPPY)
       + " UNION ALL SELECT 'fixed', c, NULL FROM (VALUES ('fixed'), "
       + ", ".join(f"('{c}')" for c in _GAPPY) + ") AS t(c) UNION ALL SELECT c, 'fixed', NULL "
       "FROM (VALUES " + ", ".join(f"('{c}')" for c in _GAPPY) + ") AS t(c)")
def g9_gaps(spark, folder):
    df = lineitem_gaps(spark, folder).withColumn("fixed", F.lit(0.1))
    corr = ts.compute_correlation(df, [*_GAPPY, "fixed"])
    return corr.withColumn("corr", rnd("corr"))


_SHIFTS = [f"x{i}" for i in range(8)]
# One value far out, where no other column has one: it must not cost the pairs their digits.
_MANY = f"""(SELECT CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 1000000000.0
        ELSE o_totalprice END AS x0,
    {', '.join(f"""CASE WHEN o_orderkey <> (SELECT min(o_orderkey) FROM orders)
        AND o_orderkey % {i + 2} <> 0
        THEN o_custkey + o_totalprice / {1000 * i} END AS x{i}""" for i in range(1, 8))}
    FROM orders)"""


@query("g9_pearson_many_gaps", _both_ways(_pearson_sql(_MANY, _SHIFTS), _SHIFTS))
def g9_many(spark, folder):
    """Twenty-eight pairs, each on the rows it shares."""
    orders = read(spark, folder, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    first = orders.agg(F.min("o_orderkey")).first()[0]
    df = orders.select(
        F.when(key == first, F.lit(1e9)).otherwise(price).alias("x0"),
        *[F.when((key != first) & (key % (i + 2) != 0), F.col("o_custkey") + price / (1000 * i))
          .alias(f"x{i}") for i in range(1, 8)])
    corr = ts.compute_correlation(df, _SHIFTS)
    return corr.withColumn("corr", rnd("corr"))


def _spearman_sql(source, columns):
    parts = []
    for a, b in combinations(columns, 2):
        parts.append(f"""SELECT '{a}' AS a, '{b}' AS b, {rnd_sql('corr(ra, rb)')} AS corr FROM (
            SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
                rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
            FROM {source} AS s WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""")
    return " UNION ALL ".join(parts)


_RANKED = ["l_partkey", "l_quantity", "l_extendedprice", "l_discount"]


@query("g10_spearman", _both_ways(_spearman_sql("lineitem", _RANKED), _RANKED))
def g10(spark, folder):
    corr = ts.compute_correlation(read(spark, folder, "lineitem"), _RANKED, "spearman")
    return corr.withColumn("corr", rnd("corr"))


@query("g10_spearman_ranges", _both_ways(_spearman_sql("lineitem", _RANKED), _RANKED))
def g10_ranges(spark, folder):
    corr = ts.compute_correlation(
        read(spark, folder, "lineitem"), _RANKED, "spearman", rows_per_range=5_000)
    return corr.withColumn("corr", rnd("corr"))


@query("g10_spearman_gaps", _both_ways(_spearman_sql(LINEITEM_GAPS, _GAPPY), _GAPPY))
def g10_gaps(spark, folder):
    corr = ts.compute_correlation(lineitem_gaps(spark, folder), _GAPPY, "spearman")
    return corr.withColumn("corr", rnd("corr"))


# Eight columns, each with gaps; two of them in the same rows.
_MANY = {
    "quantity": ("l_quantity", 3), "price": ("l_extendedprice", 4), "discount": ("l_discount", 5),
    "tax": ("l_tax", 5), "part": ("l_partkey", 7), "supplier": ("l_suppkey", 11),
    "line": ("l_linenumber", 2), "order_no": ("l_orderkey", 13)}
_MANY_GAPS = "(SELECT " + ", ".join(
    f"CASE WHEN (l_orderkey + l_linenumber) % {m} <> 0 THEN {c} END AS {name}"
    for name, (c, m) in _MANY.items()) + " FROM lineitem)"


@query("g10_spearman_many_gaps", _both_ways(_spearman_sql(_MANY_GAPS, list(_MANY)), list(_MANY)))
def g10_many_gaps(spark, folder):
    at = F.col("l_orderkey") + F.col("l_linenumber")
    df = read(spark, folder, "lineitem").select(*[
        F.when(at % m != 0, F.col(c)).alias(name) for name, (c, m) in _MANY.items()])
    corr = ts.compute_correlation(df, list(_MANY), "spearman", rows_per_range=20_000)
    return corr.withColumn("corr", rnd("corr"))


def _kendall_sql(source, columns):
    """Tau-b from counts of distinct value pairs, by brute force."""
    parts = []
    for a, b in combinations(columns, 2):
        parts.append(f"""SELECT '{a}' AS a, '{b}' AS b, {rnd_sql('''
            sum(p.w * q.w * sign(p.x - q.x) * sign(p.y - q.y))
            / (sqrt(sum(p.w * q.w * abs(sign(p.x - q.x)))) * sqrt(sum(p.w * q.w * abs(sign(p.y - q.y)))))
            ''')} AS corr
            FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, count(*)::DOUBLE AS w
                FROM {source} AS s WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL) AS p,
                (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, count(*)::DOUBLE AS w
                FROM {source} AS s WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL) AS q""")
    return " UNION ALL ".join(parts)


_PART = ["p_size", "p_retailprice"]


@query("g11_kendall", _both_ways(_kendall_sql("part", _PART), _PART))
def g11(spark, folder):
    corr = ts.compute_correlation(read(spark, folder, "part"), _PART, "kendall")
    return corr.withColumn("corr", rnd("corr"))


@query("g11_kendall_blocks", _both_ways(_kendall_sql("part", _PART), _PART))
def g11_blocks(spark, folder):
    corr = ts.compute_correlation(
        read(spark, folder, "part"), _PART, "kendall", rows_per_range=300, rank_block=64)
    return corr.withColumn("corr", rnd("corr"))


_SIX = {
    "size": "p_size", "price": "p_retailprice", "key": "p_partkey",
    "rest": "p_partkey % 17", "per_size": "floor(p_retailprice / p_size)",
    "odd_price": "CASE WHEN p_size % 5 <> 0 THEN p_retailprice - p_size * 10 END"}
_SIX_SQL = "(SELECT " + ", ".join(f"{x} AS {name}" for name, x in _SIX.items()) + " FROM part)"


@query("g11_kendall_many", _both_ways(_kendall_sql(_SIX_SQL, list(_SIX)), list(_SIX)))
def g11_many(spark, folder):
    df = read(spark, folder, "part").select(*[F.expr(x).alias(name) for name, x in _SIX.items()])
    corr = ts.compute_correlation(df, list(_SIX), "kendall")
    return corr.withColumn("corr", rnd("corr"))


_FEW = ["l_linenumber", "l_quantity", "l_discount"]


@query("g11_kendall_gaps", _both_ways(_kendall_sql(LINEITEM_GAPS, _FEW), _FEW))
def g11_gaps(spark, folder):
    corr = ts.compute_correlation(lineitem_gaps(spark, folder), _FEW, "kendall")
    return corr.withColumn("corr", rnd("corr"))


_LINKED = ("(SELECT l_quantity, l_extendedprice, -l_quantity * l_discount AS rebate, "
           "l_extendedprice * (1 - l_discount) AS net, l_tax FROM lineitem)")
_LINKED_COLUMNS = ["l_quantity", "l_extendedprice", "rebate", "net", "l_tax"]


def _linked(spark, folder):
    return read(spark, folder, "lineitem").select(
        "l_quantity", "l_extendedprice",
        (-F.col("l_quantity") * F.col("l_discount")).alias("rebate"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), "l_tax")


@query("g12_strong_relationships", f"""WITH u AS ({_pearson_sql(_LINKED, _LINKED_COLUMNS)}),
    f AS (SELECT a, b, corr FROM u UNION ALL SELECT b, a, corr FROM u)
    SELECT a AS "column", string_agg(b, ',' ORDER BY b) AS related FROM f
    WHERE abs(corr) >= 0.5 GROUP BY a""")
def g12(spark, folder):
    corr = ts.compute_correlation(_linked(spark, folder))
    return ts.identify_strong_relationships(corr, 0.5).withColumn(
        "related", F.array_join("related", ","))


@query("g13_signed_pairs", f"""WITH u AS ({_pearson_sql(_LINKED, _LINKED_COLUMNS)})
    SELECT least(a, b) AS col_a, greatest(a, b) AS col_b, corr,
        CASE WHEN corr > 0 THEN 'positive' ELSE 'negative' END AS sign
    FROM u WHERE abs(corr) >= 0.6""")
def g13(spark, folder):
    pairs = ts.signed_pairs(ts.compute_correlation(_linked(spark, folder)))
    return pairs.withColumn("corr", rnd("corr"))


@query("g14_importance", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {sig_sql(f'var_pop({c}) * count({c}) / count(*)')} AS importance
    FROM {LINEITEM_GAPS} AS s""" for c in _GAPPY) + ") ORDER BY importance DESC LIMIT 3")
def g14(spark, folder):
    return sigs(ts.calculate_feature_importance(lineitem_gaps(spark, folder), _GAPPY), "importance")


def _numeric_importance_sql(source, columns):
    spread = " UNION ALL ".join(
        f"SELECT '{c}' AS c, var_pop({c}) AS v, count({c}) / count(*) AS k FROM {source} AS s"
        for c in columns)
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM {source} AS s"
        for a, b in combinations(columns, 2))
    return f"""WITH v AS ({spread}), kept AS (
            SELECT * FROM v WHERE v > (SELECT max(v) FROM v) * 1e-6),
        p AS ({pairs}), f AS (SELECT a, b, r FROM p UNION ALL SELECT b, a, r FROM p),
        best AS (SELECT a, max(r) AS r FROM f WHERE a IN (SELECT c FROM kept)
            AND b IN (SELECT c FROM kept) GROUP BY a)
        SELECT c AS "column",
            {sig_sql('v / ((SELECT max(v) FROM kept) + 1e-8) * k * (1 + coalesce(r, 0))')} AS score
        FROM kept LEFT JOIN best ON c = a ORDER BY score DESC LIMIT 5"""


@query("g15_numeric_importance", _numeric_importance_sql("lineitem", _WIDE))
def g15(spark, folder):
    return sigs(numeric_importance(read(spark, folder, "lineitem"), _WIDE), "score")


@query("g15_numeric_importance_excluded", _numeric_importance_sql(
    _LINKED, ["l_quantity", "rebate", "l_tax"]))
def g15_excluded(spark, folder):
    return sigs(numeric_importance(
        _linked(spark, folder), exclude_cols=["l_extendedprice", "net"]), "score")


@query("g18_near_zero_variance", _numeric_importance_sql(
    LINEITEM_GAPS, ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]))
def g18(spark, folder):
    return sigs(numeric_importance(
        lineitem_gaps(spark, folder),
        ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]), "score")


def _categorical_sql(source, columns):
    return "SELECT * FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {sig_sql('''
        count(*) / any_value(t) * CASE WHEN count(*) > 1
            THEN sum(-(n / t) * ln(n / t)) / ln(count(*)) ELSE 0 END * sum(n) / any_value(t)
        ''')} AS score FROM (SELECT {c}, count(*)::DOUBLE AS n,
            (SELECT count(*) FROM {source} AS a)::DOUBLE AS t
        FROM {source} AS s WHERE {c} IS NOT NULL GROUP BY {c})""" for c in columns
    ) + ") ORDER BY score DESC LIMIT 5"


@query("g16_categorical_importance", _categorical_sql(
    LINEITEM_GAPS, ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]))
def g16(spark, folder):
    scores = categorical_importance(
        lineitem_gaps(spark, folder),
        ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"])
    return sigs(scores, "score")


def _dominant_sql(source, columns):
    return " UNION ALL ".join(f"""(SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value,
        {sig_sql(f'count(*) / (SELECT count(*) FROM {source} AS a)')} AS ratio
        FROM {source} AS s WHERE {c} IS NOT NULL GROUP BY {c}
        ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)""" for c in columns)


@query("g17_dominant_categories", _dominant_sql(
    LINEITEM_GAPS, ["l_returnflag", "l_linestatus", "l_linenumber"]))
def g17(spark, folder):
    return sigs(ts.dominant_categories(
        lineitem_gaps(spark, folder), ["l_returnflag", "l_linestatus", "l_linenumber"]), "ratio")


# Every line has a label of its own, but that of each order's first line comes three times: one true
# tie of as many long labels as there are orders, unlike only beyond their first 64 characters.
_LONG_TIES = """(SELECT repeat('x', 64) || CASE WHEN l_linenumber = 1 THEN 'h' ELSE 'g' END
    || l_orderkey || '-' || l_linenumber AS label
    FROM lineitem, (SELECT unnest(range(3)) AS k) WHERE k = 0 OR l_linenumber = 1)"""


@query("g17_long_text_ties", f"""SELECT 'label' AS "column", label AS top_value FROM (
    SELECT label, count(*) AS n FROM {_LONG_TIES} AS s GROUP BY 1) ORDER BY n DESC, label LIMIT 1""")
def g17_ties(spark, folder):
    number, key = F.col("l_linenumber"), F.col("l_orderkey")
    df = read(spark, folder, "lineitem").select(F.explode(F.array_repeat(F.concat(
        F.lit("x" * 64), F.when(number == 1, "h").otherwise("g"), key, F.lit("-"), number),
        F.when(number == 1, 3).otherwise(1))).alias("label"))
    found = ts.dominant_categories(df, ["label"])
    return found.select("column", F.col(found.columns[1]).alias("top_value"))


@query("g2_g5_constant_column", """SELECT 'fixed' AS "column", count(*) AS "count", 0.1 AS mean,
    0.0 AS std, 0.0 AS variance, 0.0 AS skewness, 0.0 AS kurtosis FROM orders""")
def constant(spark, folder):
    df = read(spark, folder, "orders").select(F.lit(0.1).alias("fixed"))
    return ts.describe_numerical(df).select(
        "column", "count", sig("mean").alias("mean"), "std", "variance", "skewness", "kurtosis")
