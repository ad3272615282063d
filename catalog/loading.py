"""A: sources and sinks. B: types, schema, roles."""

from __future__ import annotations

from pyspark.sql import functions as F

import tablescope as ts
from tablescope.functions.coerce import text_to_number
from tablescope.functions.ordered import RANGE, carried_sums, split_by_order
from tablescope.operators.inference import TableSchema
from tablescope.operators.schema import NAME_WORDS
from tablescope.storage import new_folder

from .base import query, read

_CSV_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
    nullif(c_mktsegment, 'BUILDING') AS c_mktsegment,
    '1,5 "big"' || chr(10) || 'x' AS note FROM customer"""


def _csv(spark, folder, suffix):
    path = new_folder(spark, "csv") + suffix
    read(spark, folder, "customer").select(
        "c_custkey", "c_name",
        F.when(F.col("c_mktsegment") == "BUILDING", "N/A").otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"),
        F.lit('1,5 "big"\nx').alias("note"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return ts.load_dataframe(spark, path)


@query("a1_load_csv", _CSV_SQL)
def a1(spark, folder):
    return _csv(spark, folder, ".csv")


@query("a1_line_breaks", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
    CASE WHEN o_orderkey % 3 = 0 THEN 'to "' || o_custkey || '",' || chr(10) || chr(10) || o_orderpriority
        ELSE CAST(o_custkey AS VARCHAR) END AS note, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders""")
def a1_line_breaks(spark, folder):
    """Line breaks inside cells, by the reader of large files: splits, not a task a file."""
    path = new_folder(spark, "csv") + ".csv"
    read(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(
            F.lit('to "'), "o_custkey", F.lit('",\n\n'), "o_orderpriority"))
        .otherwise(F.col("o_custkey").cast("string")).alias("note"),
        F.when(F.col("o_orderstatus") == "F", "NULL").otherwise(F.col("o_orderstatus"))
        .alias("o_orderstatus"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return ts.load_dataframe(spark, path, large_bytes=1)


@query("a3_load_other_suffix", _CSV_SQL)
def a3(spark, folder):
    return _csv(spark, folder, ".txt")


@query("a2_load_parquet", "SELECT * FROM supplier")
def a2(spark, folder):
    return ts.load_dataframe(spark, f"{folder}/supplier.parquet")


@query("a4_load_frame", "SELECT * FROM orders")
def a4(spark, folder):
    return ts.safe_load_dataframe(spark, read(spark, folder, "orders"))


@query("a7_normalize_columns",
       "SELECT s_suppkey AS supp_key, s_name AS supp_name, s_nationkey AS supp_key_2, "
       "s_acctbal AS acct_bal FROM supplier")
def a7(spark, folder):
    odd = read(spark, folder, "supplier").toDF(
        " Supp--Key ", "SUPP__name!", "supp.key", "(Acct Bal)")
    return ts.normalize_columns(odd)


@query("a8_save_report",
       "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders "
       "GROUP BY 1")
def a8(spark, folder):
    sections = {"by_priority": ts.rollup(
        read(spark, folder, "orders"), ["o_orderpriority"], ["o_totalprice"])}
    path = new_folder(spark, "report")
    ts.save_report(sections, path)
    saved = spark.read.parquet(f"{path}/by_priority")
    return saved.withColumn("o_totalprice", F.round("o_totalprice", 2))


def _orders_text(spark, folder):
    orders = read(spark, folder, "orders")
    return orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns])


@query("b1_detect_types", """SELECT * FROM (VALUES ('o_orderkey', 'numeric'),
    ('o_custkey', 'numeric'), ('o_orderstatus', 'categorical'), ('o_totalprice', 'numeric'),
    ('o_orderdate', 'datetime'), ('o_orderpriority', 'categorical')) AS t("column", kind)""")
def b1(spark, folder):
    text = _orders_text(spark, folder)
    return ts.detect_column_types(text).to_frame(text).select("column", "kind")


def _mixed_text():
    n = F.col("l_linenumber")
    return (
        F.when(n == 1, F.col("l_orderkey").cast("string"))
        .when(n == 2, F.concat(F.lit(" "), F.col("l_partkey"), F.lit(".5 ")))
        .when(n == 3, F.concat(F.col("l_partkey"), F.lit("d")))
        .when(n == 4, F.concat(F.lit("-"), F.col("l_suppkey"), F.lit("e2")))
        .when(n == 5, F.date_format("l_shipdate", "yyyy-MM-dd"))
        .when(n == 6, F.lit("True"))
    )


@query("b2_to_number", """SELECT l_orderkey, l_linenumber,
    CASE l_linenumber WHEN 1 THEN CAST(l_orderkey AS DOUBLE) WHEN 2 THEN l_partkey + 0.5
        WHEN 4 THEN CAST('-' || l_suppkey || 'e2' AS DOUBLE) END AS number FROM lineitem""")
def b2(spark, folder):
    return read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", text_to_number(_mixed_text()).alias("number"))


@query("b3_to_timestamp", """SELECT o_orderkey,
    CASE WHEN o_orderkey % 10 <> 0 THEN date_trunc('day', o_orderdate)::TIMESTAMP END AS day
    FROM orders""")
def b3(spark, folder):
    text = read(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 10 == 0, "soon")
        .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("day"),
    )
    return ts.ensure_datetime(text, "day")


@query("b4_convert_types", """SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey,
    CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus, o_totalprice, o_orderdate,
    o_orderpriority FROM orders""")
def b4(spark, folder):
    return ts.validate_and_convert_types(_orders_text(spark, folder))


@query("b5_mixed_types", """WITH k AS (SELECT CASE l_linenumber WHEN 1 THEN 'int'
        WHEN 2 THEN 'float' WHEN 3 THEN 'text' WHEN 4 THEN 'float' WHEN 5 THEN 'date'
        WHEN 6 THEN 'bool' END AS kind FROM lineitem)
    SELECT 'mixed' AS "column", kind, count(*) AS n,
        round(count(*) / sum(count(*)) OVER (), 9) AS share
    FROM k WHERE kind IS NOT NULL GROUP BY kind""")
def b5(spark, folder):
    df = read(spark, folder, "lineitem").select(_mixed_text().alias("mixed"), "l_returnflag")
    return ts.detect_mixed_types(df).withColumn("share", F.round("share", 9))


_DATE, _AMOUNT, _CATEGORY, _REGION, _CUSTOMER = (
    "|".join(NAME_WORDS[rule]) for rule in ("date", "amount", "category", "region", "customer"))
_TABLE_COLUMNS = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice "
                "l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "embeddings": "vec_id embedding label",
}


def _filled_sql(table, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count FROM {table}"
        for c in columns)


def _schema_sql(table):
    return f"""WITH k AS (SELECT column_name AS "column",
        CASE WHEN regexp_matches(column_name, '{_DATE}') THEN 'datetime'
             WHEN regexp_matches(column_name, '{_AMOUNT}') THEN 'numeric'
             WHEN regexp_matches(column_name, '{_CATEGORY}|{_REGION}|{_CUSTOMER}')
                  OR column_name LIKE '%\\_id' ESCAPE '\\' THEN 'categorical'
             WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime'
             WHEN data_type = 'VARCHAR' THEN 'categorical'
             WHEN data_type LIKE '%[]' THEN 'other' ELSE 'numeric' END AS kind
        FROM information_schema.columns WHERE table_name = '{table}'),
        m AS ({_filled_sql(table, _TABLE_COLUMNS[table].split())})
        SELECT * FROM k JOIN m USING ("column")"""


def _register_schema(table):
    @query(f"b6_schema_{table}", _schema_sql(table))
    def b6(spark, folder):
        df = read(spark, folder, table)
        kinds = ts.detect_schema(df).to_frame(df).select("column", "kind")
        return kinds.join(ts.detect_missing_values(df).drop("missing_ratio"), "column")


for _table in _TABLE_COLUMNS:
    _register_schema(_table)


@query("b6_schema_verified", f"""SELECT * FROM (VALUES ('event_id', 'categorical'),
    ('ts', 'datetime'), ('user_id', 'categorical'), ('event_type', 'categorical'),
    ('value', 'numeric'), ('props', 'categorical')) AS t("column", kind)
    JOIN ({_filled_sql('events', _TABLE_COLUMNS['events'].split())}) AS m USING ("column")""")
def b6_verified(spark, folder):
    df = read(spark, folder, "events")
    kinds = ts.detect_schema(df, verify=True).to_frame(df).select("column", "kind")
    return kinds.join(ts.detect_missing_values(df).drop("missing_ratio"), "column")


@query("b7_find_by_keywords", _filled_sql(
    "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]))
def b7(spark, folder):
    df = read(spark, folder, "lineitem")
    found = ts.find_columns_by_keywords(df, ["key", "date"])
    return ts.detect_missing_values(df.select(*found)).drop("missing_ratio")


@query("b8_find_datetime", """SELECT 'o_orderkey' AS by_name, 'o_orderdate' AS verified,
    count(*) AS row_count FROM orders""")
def b8(spark, folder):
    df = read(spark, folder, "orders")
    return df.agg(
        F.lit(ts.find_datetime_column(df)).alias("by_name"),
        F.lit(ts.find_datetime_column(df, verify=True)).alias("verified"),
        F.count(F.lit(1)).alias("row_count"),
    )


@query("b9_find_datetime_heuristic", """SELECT 'created' AS from_text, 'o_orderdate' AS by_type,
    'epoch' AS from_epoch, count(*) AS row_count FROM orders""")
def b9(spark, folder):
    df = read(spark, folder, "orders")
    text = df.select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("created"))
    epoch = read(spark, folder, "events").select(
        "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"))
    return df.agg(
        F.lit(ts.find_datetime_column_heuristic(text)).alias("from_text"),
        F.lit(ts.find_datetime_column_heuristic(df)).alias("by_type"),
        F.lit(ts.find_datetime_column_heuristic(epoch)).alias("from_epoch"),
        F.count(F.lit(1)).alias("row_count"),
    )


def _late_text(spark, folder):
    """Numbers in the first hundredth of the keys, codes in all others."""
    key, orders = F.col("o_orderkey"), read(spark, folder, "orders")
    last = orders.agg(F.max("o_orderkey").alias("last"))
    return orders.join(F.broadcast(last)).select(
        "o_orderkey", F.when(100 * key > F.col("last"), F.concat(F.lit("code-"), key)).otherwise(
            key.cast("string")).alias("label"))


_LATE = """(SELECT o_orderkey, CASE WHEN 100 * o_orderkey > (SELECT max(o_orderkey) FROM orders)
    THEN 'code-' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS label FROM orders)"""


def _numbered_text(spark, folder):
    """Numbers in the first 500 rows by key, codes in all others. All orders are numbered, range by
    range of their keys."""
    key, orders = F.col("o_orderkey"), read(spark, folder, "orders")
    ranged = split_by_order(orders, "o_orderkey", rows=orders.count())
    before = carried_sums(
        ranged.df.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")), {"n": "before"})
    rank = F.col("before") + F.row_number().over(ranged.window())
    return ranged.df.join(before, RANGE).withColumn("r", rank).select(
        "o_orderkey", F.when(F.col("r") > 500, F.concat(F.lit("code-"), key)).otherwise(
            key.cast("string")).alias("label"))


_NUMBERED = """(SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) > 500
    THEN 'code-' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS label FROM orders)"""


@query("b4_convert_late_text", f"SELECT * FROM {_NUMBERED} AS t")
def b4_late(spark, folder):
    return ts.validate_and_convert_types(_numbered_text(spark, folder))


@query("b4_conversion_losses", f"""SELECT 'label' AS "column", 'categorical' AS kind,
    count(*) AS "values", 0 AS lost FROM {_LATE} AS t
    UNION ALL SELECT 'mostly', 'numeric', count(*), count(*) FILTER (l_linenumber = 7)
    FROM lineitem""")
def b4_losses(spark, folder):
    mostly = read(spark, folder, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, "seven").otherwise(
            F.col("l_linenumber").cast("string")).alias("mostly"))
    return ts.conversion_losses(_late_text(spark, folder).select("label")).unionByName(
        ts.conversion_losses(mostly)).withColumn("lost", F.col("lost").cast("int"))


@query("b10_mixed_layouts", """SELECT o_orderkey,
    CASE WHEN o_orderkey % 4 <> 0 THEN date_trunc('day', o_orderdate) END AS o_orderdate
    FROM orders""")
def b10_mixed(spark, folder):
    date, key = F.col("o_orderdate"), F.col("o_orderkey")
    text = read(spark, folder, "orders").select("o_orderkey", F.when(
        key % 4 == 0, F.date_format(date, "yyyy.MM.dd")).otherwise(
            F.date_format(date, "yyyy/M/d")).alias("o_orderdate"))
    return ts.ensure_datetime(text, "o_orderdate")


@query("b10_ensure_datetime", "SELECT event_id, ts FROM events")
def b10(spark, folder):
    text = read(spark, folder, "events").select("event_id", F.col("ts").cast("string").alias("ts"))
    return ts.ensure_datetime(text, "ts")


_ROLE_TABLES = {
    "orders": (["o_orderkey", "o_custkey", "o_totalprice"],
               ["o_orderstatus", "o_orderpriority"], ["o_orderdate"]),
    "part": (["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"], []),
    "lineitem": (["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_tax"],
                 ["l_returnflag", "l_linestatus"], ["l_shipdate"]),
}


def _roles_sql(table, numeric, categorical, temporal):
    parts = []
    for c in numeric:
        named = "true" if any(w in c for w in ("id", "postal", "code")) else "false"
        parts.append(f"SELECT '{c}' AS \"column\", CASE WHEN {named} OR count(DISTINCT {c}) / "
                     f"count(*) > 0.9 THEN 'identifier' ELSE 'metric' END AS role FROM {table}")
    for c in categorical:
        parts.append(f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) / count(*) > 0.9 THEN "
                     f"'identifier' WHEN count(DISTINCT {c}) < 50 THEN 'dimension' END "
                     f"FROM {table}")
    parts += [f"SELECT '{c}', 'temporal'" for c in temporal]
    roles = " UNION ALL ".join(parts)
    spread = " UNION ALL ".join(
        f"SELECT {i} AS i, '{c}' AS \"column\", var_samp({c}) AS v FROM {table}"
        for i, c in enumerate(numeric))
    return f"""WITH r AS ({roles}), s AS ({spread}),
        m AS (SELECT s.* FROM s JOIN r USING ("column") WHERE r.role = 'metric')
        SELECT * FROM r WHERE role IS NOT NULL
        UNION ALL (SELECT "column", 'target_like' FROM m
            WHERE v > (SELECT median(v) FROM m) ORDER BY i LIMIT 1)"""


def _register_roles(table, numeric, categorical, temporal):
    @query(f"b11_roles_{table}", _roles_sql(table, numeric, categorical, temporal))
    def b11(spark, folder):
        df = read(spark, folder, table)
        schema = TableSchema(numeric=numeric, categorical=categorical, datetime=temporal)
        return ts.infer_column_semantics(df, schema).to_frame(df).select("column", "role")


for _table, _columns in _ROLE_TABLES.items():
    _register_roles(_table, *_columns)

# on the smallest scale the only number of events is nearly unique, so no metric is left
_CLASSES = {
    "orders": "'temporal_dataset'", "part": "'analytical_dataset'", "region": "'unknown'",
    "events": "CASE WHEN count(DISTINCT value) / count(*) > 0.9 THEN 'unknown' "
              "ELSE 'temporal_dataset' END",
}


@query("b12_classify", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", {k} AS class, count(*) AS row_count FROM {t}"
    for t, k in _CLASSES.items())
    + " UNION ALL SELECT 'numbers', 'feature_dataset', count(*) FROM lineitem")
def b12(spark, folder):
    frames = {t: read(spark, folder, t) for t in _CLASSES}
    frames["numbers"] = read(spark, folder, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    out = None
    for name, df in frames.items():
        schema = ts.detect_schema(df, verify=True)
        kind = ts.classify_dataset(df, schema, ts.infer_column_semantics(df, schema))
        row = df.agg(F.lit(name).alias("table"), F.lit(kind).alias("class"),
                     F.count(F.lit(1)).alias("row_count"))
        out = row if out is None else out.unionByName(row)
    return out
