"""What the physical plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

import tablescope as ts
from tablescope.functions.ordered import running_counts
from tablescope.operators import facets


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def columns_read(df) -> set[str]:
    found = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(df))
    return {c.split(":")[0] for part in found for c in part.split(",") if c}


def test_rollup_reads_its_columns_and_combines_before_the_shuffle(table):
    df = ts.slice_olap(table("lineitem"), {"l_returnflag": "A"}, ["l_quantity"])
    plan = plan_of(df)
    assert columns_read(df) == {"l_returnflag", "l_quantity"}
    assert "EqualTo(l_returnflag,A)" in plan
    assert "partial_sum" in plan and plan.count("Exchange") == 1


def test_types_of_many_text_columns_are_judged_in_one_scan(spark, tmp_path):
    """300 text columns: one scan, one shuffle, and shares as of each column alone."""
    from tablescope.operators.inference import _cell_codes, text_shares
    layouts = ["yyyy-M-d", "M/d/yyyy"]
    kinds = ["CAST(id AS STRING)", "concat('2024-01-', 1 + id % 31)", "concat('x', id)",
             "CASE WHEN id % 2 = 0 THEN NULL ELSE concat('2/', 1 + id % 40, '/2020') END"]
    spark.range(200).selectExpr(*[f"{kinds[i % 4]} AS c{i}" for i in range(300)]).write.csv(
        str(tmp_path / "wide"), header=True)
    df = spark.read.csv(str(tmp_path / "wide"), header=True)
    counted = _cell_codes(df, df.columns, layouts).groupBy("column", "code").count()
    assert plan_of(counted).count("FileScan") == 1 and plan_of(counted).count("Exchange") == 1
    shares = text_shares(df, df.columns, formats=layouts)
    assert all(shares[f"c{i}"].numeric == (i % 4 == 0) for i in range(300))
    assert shares["c5"].datetime == 1 and shares["c5"].layout == "yyyy-M-d"
    assert shares["c7"].values == 100 and shares["c7"].dates == sum(
        1 + i % 40 <= 29 for i in range(1, 200, 2)) and shares["c7"].layout == "M/d/yyyy"


def test_counts_of_many_columns_take_one_scan_and_shuffle_per_type(spark, tmp_path):
    from tablescope.functions.counts import distinct_counts, top_values, value_counts
    kinds = ["CAST(id % 7 AS INT)", "CAST(id % 5 AS DOUBLE)", "concat('x', id % 3)",
             "CAST(NULL AS BIGINT)", "CAST(nullif(id % 4, 3) AS BIGINT)", "id % 2 = 0"]
    spark.range(100).selectExpr(*[f"{kinds[i % 6]} AS c{i}" for i in range(300)]).write.parquet(
        str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    counts = distinct_counts(df, df.columns)
    plan = plan_of(counts)
    assert plan.count("FileScan") == 4 and plan.count("Exchange hashpartitioning") <= 9
    want = [7, 5, 3, 0, 3, 2]
    assert {r["column"]: r["unique"] for r in counts.collect()} == {
        f"c{i}": want[i % 6] for i in range(300)}
    few = value_counts(df, ["c0", "c1", "c2", "c5"]).where("n > 30").collect()
    assert {(r["column"], r["value"], r["n"]) for r in few} == {
        ("c2", "x0", 34), ("c2", "x1", 33), ("c2", "x2", 33), ("c5", "true", 50),
        ("c5", "false", 50)}
    assert top_values(df, ["c3", "c2"]) == {"c2": ("x0", 34, 3)}


def test_time_buckets_read_two_columns(table):
    df = ts.aggregate_time(table("orders"), "o_orderdate", "M", ["o_totalprice"])
    assert columns_read(df) == {"o_orderdate", "o_totalprice"}
    assert "partial_sum" in plan_of(df)


def test_correlation_is_one_pass_without_cross_join(table):
    df = ts.compute_correlation(table("lineitem"), ["l_quantity", "l_tax", "l_discount"])
    plan = plan_of(df)
    assert columns_read(df) == {"l_quantity", "l_tax", "l_discount"}
    assert plan.count("FileScan") == 1 and "CartesianProduct" not in plan


@pytest.mark.parametrize("make", [
    lambda t: ts.fill_along_time(
        t("events").withColumn("value", F.expr("nullif(value, 1)"))
        .withColumn("event_type", F.expr("CASE WHEN event_id % 2 = 0 THEN event_type END")),
        "ts", rows_per_range=100),
    lambda t: running_counts(
        t("lineitem"), "l_extendedprice", rows=6000, rows_per_range=500),
    lambda t: ts.detect_trend(
        t("orders"), "o_orderdate", "o_totalprice", rows_per_range=100),
    lambda t: ts.compute_correlation(
        t("lineitem"), ["l_quantity", "l_extendedprice"], "kendall", rows_per_range=500,
        rank_block=100),
])
def test_windows_over_rows_are_partitioned(table, make):
    """A window without partition may only run on the one-row-per-range table: an aggregate by
    range, alone or joined to the list of range numbers."""
    lines = optimized(make(table)).splitlines()
    seen = 0
    for i, line in enumerate(lines):
        if "Window [" not in line:
            continue
        seen += 1
        # Window [functions], [partition], [order]
        if re.search(r"\], \[[^\]]*(_range|block|level)[^\]]*\], \[", line):
            continue
        below = [part.strip(" :+-") for part in lines[i + 1:i + 6]]
        below = [part for part in below if not part.startswith("Project")]
        if below[0].startswith("Join LeftOuter, (_range"):
            numbers = [part for part in below[1:] if not part.startswith("Filter")]
            assert re.match(r"Range \(0, \d+, step=1", numbers[0]), below
            continue
        assert re.match(r"Aggregate \[_range#\d+\]", below[0]), below
    assert seen


def test_duplicate_search_uses_no_window(table):
    assert "Window" not in plan_of(ts.detect_duplicates(table("lineitem"), ["l_partkey"]))


def test_join_without_hints_is_left_to_spark(table):
    orders = table("orders").withColumnRenamed("o_custkey", "c_custkey")
    plan = plan_of(ts.merge_tables(orders, table("customer"), on="c_custkey"))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_pivot_product_needs_no_cross_join(table):
    df = ts.pivot_analysis(table("lineitem"), ["l_returnflag", "l_linenumber"],
                           ["l_linestatus"], "l_tax")
    plan = plan_of(df)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_top_categories_is_a_top_k(table):
    assert "TakeOrderedAndProject" in plan_of(
        facets.top_categories(table("part"), "p_name", "p_retailprice"))
