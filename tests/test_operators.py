"""Operators on small frames and on the smallest test tables: rules, edge cases, properties."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import tablescope as ts
from tablescope.operators import correlation, facets
from tablescope.operators.importance import numeric_importance
from tablescope.operators.olap import group_aggregate
from tablescope.plans.insights import generate_insights
from tablescope.sources import tables
from tablescope.storage import materialize, new_folder


# -- sources ---------------------------------------------------------------------------------

def test_csv_cells_are_text_and_missing_tokens_are_null(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,Amount $,note\n1,NA,"a, ""b""\nc"\n2, NA,\n003,1.50,null\n')
    df = ts.load_dataframe(spark, path)
    assert {t for _, t in df.dtypes} == {"string"}
    assert [tuple(r) for r in df.collect()] == [
        ("1", None, 'a, "b"\nc'), ("2", " NA", None), ("003", "1.50", None)]


def test_ragged_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("a,b\n1,2\n6\n3,4,\n")
    assert [tuple(r) for r in ts.load_dataframe(spark, str(path)).collect()] == [
        ("1", "2"), ("6", None), ("3", "4")]
    path.write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more cells than the header"):
        ts.load_dataframe(spark, str(path)).select("a").collect()


@pytest.mark.parametrize("text,breaks", [
    ('a,b\n1,"x, ""y"""\n2,z\n', False), ('a,b\n1,"x\ny"\n2,z\n', True)])
def test_large_csv_is_split_only_without_broken_lines(spark, tmp_path, text, breaks):
    path = tmp_path / "t.csv"
    path.write_text(text)
    assert tables._breaks_lines(spark, str(path)) is breaks
    checked = tables._read_csv(spark, str(path), {}, 1)
    whole = tables._read_csv(spark, str(path), {"multiLine": True})
    assert sorted(checked.collect()) == sorted(whole.collect()) and whole.count() == 2


@pytest.fixture()
def tiny_splits(spark):
    """Splits of a few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "300b")
    spark.conf.set(names[1], "1b")
    yield
    for n, value in zip(names, old):
        spark.conf.set(n, value)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_breaks_over_splits(spark, tmp_path, tiny_splits, end):
    """Cells with line breaks, separators, escaped and stray quotes, empty lines and long cells over
    several splits and files, as Spark's reader of whole files has them."""
    rng = random.Random(len(end))
    cells = ['plain', '', '""', '"a,b"', '"say ""x"""', f'"two{end}lines"', f'"{end}"', 'pipe 5" long',
             'x"y"z', '"' + f"long text,{end}" * 60 + '"', '""""', f'"q""{end}""q"', "N/A", " pad "]
    for k in range(3):
        with open(tmp_path / f"p{k}.csv", "w", newline="") as out:
            out.write(f"id,first,second{end}")
            for i in range(150):
                out.write(",".join([str(1000 * k + i), rng.choice(cells), rng.choice(cells)]) + end)
                out.write(end if i % 40 == 7 else "")
    got = ts.load_dataframe(spark, str(tmp_path), large_bytes=1)
    want = tables._read_csv(spark, str(tmp_path), {"multiLine": True})
    assert got.columns == want.columns == ["id", "first", "second"]
    fix = lambda df: sorted(tuple(c and c.replace("\r\n", "\n") for c in r) for r in df.collect())
    assert len(fix(got)) == 450 and fix(got) == fix(want)
    from tablescope.sources.records import quoted_records
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    assert "Window [" in quoted_records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    with open(tmp_path / "p0.csv", "a", newline="") as out:
        out.write(f'1,2,3,"4{end}"{end}')
    with pytest.raises(Exception, match="more cells than the header"):
        ts.load_dataframe(spark, str(tmp_path), large_bytes=1).collect()


def test_load_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ts.load_dataframe(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(FileNotFoundError):
        ts.load_dataframe(spark, str(tmp_path / "absent.parquet"))
    with pytest.raises(ValueError):
        ts.load_dataframe(spark, 5)
    with pytest.raises(ValueError):
        ts.load_dataframe(spark, "book.xlsx")


def test_names():
    assert ts.normalize_column_name("  Order--Date (UTC) ") == "order_date_utc"
    assert ts.normalize_column_name("__a__B") == "a_b"
    assert ts.normalize_column_name("§§") == "§§"


def test_normalize_columns_keeps_colliding_names_apart(frame):
    df = frame([(1, 2, 3, 4)], "`a b` int, `A-B` int, a_b_2 int, `ok` int")
    assert ts.normalize_columns(df).columns == ["a_b", "a_b_2", "a_b_2_2", "ok"]


def test_materialize_and_save(spark, table):
    df = table("embeddings")
    again = materialize(df)
    assert again.schema == df.schema and again.count() == df.count()
    path = new_folder(spark, "report")
    assert ts.save_report({"a": df, "note": "text"}, path) == ["a"]
    assert spark.read.parquet(f"{path}/a").count() == df.count()


# -- types, schema, roles --------------------------------------------------------------------

def test_detect_column_types(frame):
    rows = [(str(i), "2024-01-05" if i % 2 else "x", None, True, [1], i, datetime(2024, 1, 1),
             "1" if i < 8 else "many") for i in range(10)]
    df = frame(rows, "n string, d string, e string, b boolean, o array<int>, i int, "
                     "t timestamp_ntz, mostly string")
    got = ts.detect_column_types(df)
    assert got.numeric == ["n", "i", "mostly"] and got.datetime == ["d", "t"]
    assert got.categorical == ["e"] and got.boolean == ["b"] and got.other == ["o"]
    assert ts.detect_column_types(df.limit(0)) == ts.TableSchema()


def test_sample_looks_past_leading_gaps(frame):
    df = frame([(None, "a")] * 600 + [("5", "a")] * 10, "late string, c string")
    got = ts.detect_column_types(df)
    assert got.numeric == ["late"] and got.categorical == ["c"]


def test_convert_types(frame):
    df = frame([("1", "03/15/2024", "a", 1.5, True), ("2.5", "13/15/2024", "b", float("nan"), None),
                (" 3 ", "12/31/2023", "1", None, False), ("x", None, None, 2.0, True)],
               "n string, d string, c string, f double, b boolean")
    got = ts.validate_and_convert_types(df)
    assert dict(got.dtypes) == {
        "n": "double", "d": "timestamp_ntz", "c": "string", "f": "double", "b": "boolean"}
    rows = got.collect()
    assert [r["n"] for r in rows] == [1.0, 2.5, 3.0, None]
    assert [r["d"] for r in rows] == [
        datetime(2024, 3, 15), None, datetime(2023, 12, 31), None]
    assert [r["f"] for r in rows] == [1.5, None, None, 2.0]


def test_schema_name_rules(frame):
    df = frame([(1, "x", 2.0, True, "a", "b", 5, "q")],
               "order_no int, ship_mode string, unit_price double, flag boolean, "
               "product_name string, client string, id_x int, note string")
    got = ts.detect_schema(df)
    assert got.datetime == ["order_no", "ship_mode"] and got.numeric == ["unit_price"]
    assert got.categorical == ["product_name", "client", "id_x", "note"]
    assert got.boolean == ["flag"] and got.rules["product_name"] == "category"
    checked = ts.detect_schema(df, verify=True)
    assert checked.datetime == [] and checked.numeric == ["unit_price", "order_no"]
    assert ts.find_datetime_column(df) == "order_no"
    assert ts.find_datetime_column(df, verify=True) is None
    own = ts.detect_schema(df, {"date": ["note"]})
    assert own.datetime == ["note"]
    assert ts.find_columns_by_keywords(df, ["price", "ship"]) == ["ship_mode", "unit_price"]


def test_heuristic_time_column(frame):
    years = frame([(1, 1999), (2, 2024)], "k int, y int")
    assert ts.find_datetime_column_heuristic(years) == "y"
    assert ts.find_datetime_column_heuristic(frame([(1, 5)], "k int, v int")) is None
    hinted = frame([(None, "2024-01-01"), ("2024-01-01", "x")], "update_date string, z string")
    assert ts.find_datetime_column_heuristic(hinted) == "update_date"


def test_roles_and_class(frame):
    rows = [(i, i % 4, float(i % 7) * 100, f"n{i}", "ab"[i % 2], i % 2) for i in range(100)]
    df = frame(rows, "key int, zip_code int, amount double, label string, grp string, small int")
    schema = ts.TableSchema(numeric=["key", "zip_code", "amount", "small"],
                            categorical=["label", "grp"])
    roles = ts.infer_column_semantics(df, schema)
    assert roles.identifiers == ["key", "zip_code", "label"]
    assert roles.identifier_reasons["key"] == ["high_cardinality_100.0%"]
    assert roles.identifier_reasons["zip_code"] == ["name_contains_id"]
    assert roles.metrics == ["amount", "small"] and roles.dimensions == ["grp"]
    assert roles.target_like == ["amount"]
    assert ts.classify_dataset(df, schema, roles) == "analytical_dataset"


# -- quality and imputation ------------------------------------------------------------------

def test_profile_of_nested_and_empty_tables(spark, table):
    got = {r["column"]: r for r in ts.summarize_schema(table("embeddings")).collect()}
    assert got["embedding"]["unique"] is None and got["embedding"]["null_ratio"] == 0
    empty = table("orders").limit(0)
    assert ts.summarize_schema(empty).isEmpty() and ts.detect_missing_values(empty).isEmpty()


def test_duplicate_count_agrees_with_rows(table):
    df = table("lineitem")
    for subset in (["l_partkey", "l_suppkey"], ["l_orderkey"], None):
        assert ts.duplicate_count(df, subset).first()[0] == ts.detect_duplicates(
            df, subset).count()


def test_mixed_kinds(frame):
    df = frame([("1",), ("2.5",), ("True",), ("x",), (None,)], "m string").withColumn(
        "clean", F.lit("x"))
    got = {r["kind"]: (r["n"], r["share"]) for r in ts.detect_mixed_types(df).collect()}
    assert got == {k: (1, 0.25) for k in ("int", "float", "bool", "text")}


def test_mixed_kinds_of_variants(frame):
    df = frame([("1",), ("2",), ('"x"',), ("null",), (None,)], "j string").select(
        F.parse_json("j").alias("v"), F.parse_json(F.lit("1")).alias("one"))
    got = {(r["column"], r["kind"]): r["n"] for r in ts.detect_mixed_types(df).collect()}
    assert got == {("v", "BIGINT"): 2, ("v", "STRING"): 1}


def test_fill_leaves_only_columns_without_any_value_empty(frame):
    df = frame([(None, None, None, None), (1, None, "a", True), (3, None, "a", None),
                (None, None, "b", True)], "n int, e double, c string, b boolean")
    clean, notes = ts.handle_missing_values(df)
    assert dict(clean.dtypes) == {"n": "double", "e": "double", "c": "string", "b": "boolean"}
    assert clean.where("n IS NULL OR c IS NULL OR b IS NULL").isEmpty()
    assert clean.where("e IS NOT NULL").isEmpty()
    found = {r["column"]: r["fill_value"] for r in notes.collect()}
    assert found == {"n": "2", "e": None, "c": "a", "b": "true"}


def test_fill_with_time_column_fills_everything_in_order(frame):
    df = frame([(datetime(2024, 1, 2), None, "b"), (datetime(2024, 1, 1), 1.0, None),
                (None, None, None)], "t timestamp_ntz, v double, c string")
    clean, notes = ts.handle_missing_values(df, "t")
    assert sorted(map(tuple, clean.collect()), key=repr) == sorted([
        (datetime(2024, 1, 1), 1.0, "b"), (datetime(2024, 1, 2), 1.0, "b"),
        (datetime(2024, 1, 2), 1.0, "b")], key=repr)
    assert notes.first()["column"] == "time_series"


def test_empty_table_is_passed_through(frame):
    df = frame([], "a int")
    clean, notes = ts.handle_missing_values(df)
    assert clean.columns == ["a"] and notes.first()["column"] == "warning"
    out, report = ts.run_pipeline(df)
    assert out.isEmpty() and report.warnings
    assert report["summary"].isEmpty() and report["anomaly_count"].first()["count"] == 0


@pytest.mark.parametrize("per_range", [1_000_000, 997, 150])
def test_time_fill_does_not_depend_on_ranges_or_partitions(table, per_range):
    df = table("events").select(
        F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE date_trunc('day', ts) END"
               "::timestamp_ntz").alias("t"),
        F.expr("CASE WHEN event_id % 4 > 0 THEN value END").alias("v"),
        F.expr("CASE WHEN event_id % 5 > 2 THEN event_type END").alias("c"), "event_id")
    base = ts.fill_along_time(df, "t", ["event_id"], rows_per_range=10_000_000)
    got = ts.fill_along_time(df.repartition(7), "t", ["event_id"], rows_per_range=per_range)
    assert got.exceptAll(base).isEmpty() and base.exceptAll(got).isEmpty()
    free = ts.fill_along_time(df, "t", rows_per_range=10_000_000)
    split = ts.fill_along_time(df.repartition(5), "t", rows_per_range=per_range)
    assert free.exceptAll(split).isEmpty()


def test_date_features_without_a_date(frame):
    df = frame([(1, "x")], "a int, b string")
    assert ts.auto_extract_date_features(df).columns == ["a", "b"]
    dated = frame([("2024-02-29",), ("bad",)], "created string")
    r = ts.auto_extract_date_features(dated).first()
    assert (r["created_year"], r["created_month"], r["created_day"], r["created_weekday"],
            r["created_quarter"]) == (2024, 2, 29, "Thursday", 1)


# -- statistics ------------------------------------------------------------------------------

@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_correlation_is_symmetric(table, method):
    df = table("part").select("p_size", "p_retailprice")
    corr = {(r["col_a"], r["col_b"]): r["corr"]
            for r in ts.compute_correlation(df, method=method).collect()}
    assert corr[("p_size", "p_retailprice")] == corr[("p_retailprice", "p_size")]
    assert corr[("p_size", "p_size")] == 1.0


@pytest.mark.parametrize("gaps", [False, True])
def test_correlation_of_many_columns_agrees_with_few(table, gaps, monkeypatch):
    df = table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_tax", F.expr(
        "CASE WHEN l_linenumber > 2 THEN l_discount END AS l_discount" if gaps else "l_discount"),
        F.expr("CASE WHEN l_linenumber <= 2 THEN 5.0 WHEN l_linenumber > 4 THEN l_quantity END"
               " AS l_part" if gaps else "l_suppkey AS l_part"))

    def matrix():
        return {(r["col_a"], r["col_b"]): r["corr"] for r in ts.compute_correlation(df).collect()}

    few = matrix()
    monkeypatch.setattr(correlation, "_FEW_PASSES", 0)
    many = matrix()
    assert few.keys() == many.keys()
    for pair, r in few.items():
        assert many[pair] == (r if r is None else pytest.approx(r, abs=1e-12)), pair


def test_pair_without_spread_on_shared_rows(frame, monkeypatch):
    df = frame([(1.0, 0.3), (2.0, 0.3), (4.0, 0.3), (None, 9.1), (None, 7.7)], "a double, b double")
    for limit in (2, 0):
        monkeypatch.setattr(correlation, "_FEW_PASSES", limit)
        for method in ("pearson", "spearman", "kendall"):
            got = ts.compute_correlation(df, method=method).where("col_a < col_b").first()
            assert got["corr"] is None


def test_ranks_of_few_values_are_sent_to_the_rows(spark):
    """Columns with gaps: only one with many values moves the rows."""
    df = spark.range(60_000).selectExpr(
        "nullif(id % 7, 3) AS a", "nullif(id % 5, 1) AS b", "nullif(id, 9) AS c")
    corr = ts.compute_correlation(df, method="spearman")
    plan = corr._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2
    ranks = df.where("a IS NOT NULL AND b IS NOT NULL").toPandas().rank()
    got = corr.where("col_a = 'a' AND col_b = 'b'").first()["corr"]
    assert got == pytest.approx(ranks["a"].corr(ranks["b"]), abs=1e-9)


@pytest.mark.parametrize("most", [40, 0])
def test_ranks_of_many_values_stay_out_of_the_rows(frame, monkeypatch, most):
    """Columns with gaps of many values and of few, a value with a third of the rows, two columns
    without a row in common; no join of all rows with all ranks is left to the result."""
    monkeypatch.setattr(correlation, "_FEW_VALUES", most)
    rng = random.Random(4)
    rows = [(rng.choice([5.0, rng.random(), float(i % 90)]) if i % 4 else None, float(i % 7) if i % 3 else None,
             rng.gauss(0, 1) if i % 5 else None, float(i * i % 301) if i % 2 else None,
             float("nan") if i % 2 else float(i % 150), float(i % 3)) for i in range(600)]
    df = frame(rows, "a double, b double, c double, d double, e double, f double")
    corr = ts.compute_correlation(df, method="spearman", rows_per_range=50)
    plan = corr._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 if most else "Join " not in plan
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in corr.collect()}
    assert len(got) == 36
    data = df.toPandas()
    for x, y in got:
        both = data[[x, y]].dropna()
        ranks = both.iloc[:, 0].rank(), both.iloc[:, 1].rank()
        if x == y or len(both):
            assert got[x, y] == pytest.approx(1.0 if x == y else ranks[0].corr(ranks[1]), abs=1e-9), (x, y)
        else:
            assert got[x, y] is None and {x, y} == {"d", "e"}


def test_correlation_of_no_numbers_and_unknown_method(frame):
    assert ts.compute_correlation(frame([("a",)], "c string")).isEmpty()
    with pytest.raises(ValueError):
        ts.compute_correlation(frame([(1,)], "c int"), method="other")


def test_importance_excludes_and_drops_flat_columns(frame):
    df = frame([(float(i), float(i * 1000), 1e-4 * (i % 2), 2.0 * i) for i in range(50)],
               "a double, big double, flat double, twin double")
    scores = {r["column"]: r["score"] for r in numeric_importance(df).collect()}
    assert "flat" not in scores and max(scores, key=scores.get) == "big"
    assert scores["big"] == pytest.approx(2.0, rel=1e-6)
    assert "big" not in {r["column"] for r in numeric_importance(
        df, exclude_cols=["big"]).collect()}
    both = ts.calculate_advanced_feature_importance(df, exclude_cols=["big"])
    assert both["excluded_identifiers"] == ["big"] and both["categorical"].isEmpty()


# -- OLAP ------------------------------------------------------------------------------------

def test_rollup_total_is_the_table_total(table):
    df = table("lineitem")
    parts = ts.rollup(df, ["l_returnflag", "l_linenumber"], ["l_quantity"])
    assert parts.agg(F.sum("l_quantity")).first()[0] == df.agg(F.sum("l_quantity")).first()[0]


def test_rollup_errors(frame):
    df = frame([("a", 1)], "k string, v int")
    for keys, metrics in ((["absent"], ["v"]), (["k"], ["absent"])):
        with pytest.raises(ValueError):
            ts.rollup(df, keys, metrics)
    with pytest.raises(ValueError):
        ts.rollup(df, ["k"], ["v"], "first")
    with pytest.raises(ValueError):
        ts.rollup(df, ["k"], ["v"], "mystery")
    with pytest.raises(ValueError):
        ts.pivot_analysis(df, ["absent"], ["k"], "v")


def test_sum_of_nothing_is_zero_and_flags_add_up(frame):
    df = frame([("a", None, True), ("a", float("nan"), True), ("b", 2.0, None)],
               "k string, v double, f boolean")
    got = {r["k"]: (r["v"], r["f"]) for r in ts.rollup(df, ["k"], ["v", "f"]).collect()}
    assert got == {"a": (0.0, 2), "b": (2.0, 0)}


def test_median_paths_agree(table):
    df = table("lineitem")
    args = (df, ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_tax"],
            {"l_extendedprice": "median", "l_tax": "sum"})
    small = group_aggregate(*args).collect()
    large = group_aggregate(*args, median_limit=100).collect()
    key = lambda r: (r["l_returnflag"], r["l_linestatus"])
    for a, b in zip(sorted(small, key=key), sorted(large, key=key)):
        assert a["l_extendedprice"] == b["l_extendedprice"]
        assert a["l_tax"] == pytest.approx(b["l_tax"])


def test_dense_pivot_without_columns(frame):
    df = frame([("x", "p", 1), ("y", "q", 2), (None, "p", 4)], "a string, b string, v int")
    some = ts.pivot_analysis(df, ["a", "b"], values="v").collect()
    assert len(some) == 3
    rows = {(r["a"], r["b"]): r["v"] for r in ts.pivot_analysis(
        df, ["a", "b"], values="v", dense=True).collect()}
    assert rows == {("x", "p"): 1, ("x", "q"): 0, ("y", "p"): 0, ("y", "q"): 2,
                    (None, "p"): 4, (None, "q"): 0}


def test_pivot_limit_names_the_setting(spark, frame):
    df = frame([(i, i, 1) for i in range(5)], "a int, b int, v int")
    old = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        with pytest.raises(ValueError, match="pivotMaxValues"):
            ts.pivot_analysis(df, ["a"], ["b"], "v")
        assert ts.pivot_analysis(df, ["a", "b"], None, "v", dense=False).count() == 5
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", old)


# -- facets and report -----------------------------------------------------------------------

def test_filters(frame):
    df = frame([(datetime(2024, 1, 1, 23), "2024-01-01", 1), (datetime(2024, 1, 2), "2024-01-02", 2)],
               "t timestamp_ntz, s string, v int")
    one = date(2024, 1, 1)
    assert [r["v"] for r in facets.filter_dates(df, "t", one, one).collect()] == [1]
    assert [r["v"] for r in facets.filter_dates(df, "s", one, one).collect()] == [1]
    assert facets.filter_values(df, "v", []).count() == 2
    assert facets.apply_filters(df, {"v": [9]}).count() == 2


def test_date_filter_reaches_the_scan(table):
    df = facets.filter_dates(table("orders"), "o_orderdate", date(1996, 1, 1), date(1996, 2, 1))
    plan = df.select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_histogram_of_a_constant_and_kpis(frame):
    df = frame([(3.0,), (3.0,), (None,)], "v double")
    assert [tuple(r) for r in facets.histogram(df, "v").collect()] == [(1, 3.0, 3.0, 2)]
    assert tuple(facets.kpis(df, "v").first()) == (3, 6.0, 3.0)
    assert tuple(facets.kpis(df, None).first()) == (3, None, None)
    with pytest.raises(ValueError):
        facets.drill_level(df, "Deep")


def test_insight_rules():
    stats = [dict(column="a", outlier_ratio=0.1, skewness=-3.0),
             dict(column="b", outlier_ratio=0.2, skewness=None)]
    found = generate_insights(
        rows=500, duplicates=3, missing=[dict(column="m", missing_ratio=0.5)], stats=stats,
        pairs=[dict(col_a="a", col_b="b", corr=0.9, sign="positive"),
               dict(col_a="a", col_b="c", corr=-0.7, sign="negative")])
    by = {i.kind: i for i in found}
    assert len(found) == 3 and found[0].kind == "quality"
    assert by["quality"].score == pytest.approx(0.6 * 0.45)
    assert by["skewness"].score == pytest.approx(0.8 * 0.9 * 0.5 * 0.6)
    assert "left" in by["skewness"].text
    assert by["correlation"].score == pytest.approx(0.8 * 0.85 * 0.5 * 0.7)
    assert generate_insights(rows=10)[0].kind == "clean"


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.mark.parametrize("name", TABLES)
def test_report_runs_on_every_table(table, name):
    df = table(name)
    clean, report = ts.run_pipeline(df)
    assert clean.count() == df.count()
    for section in report.sections.values():
        section.collect()
    assert report["insights"].count() in (1, 2, 3)
    kinds = {r["column"]: r["kind"] for r in report["schema"].collect()}
    assert set(kinds) == set(df.columns)
    if name == "embeddings":
        assert kinds["embedding"] == "other"
