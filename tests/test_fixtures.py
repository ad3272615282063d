"""Hand tables with expected values (FIXTURES.md F1-F10)."""

from datetime import datetime

import pytest

import tablescope as ts
from tablescope.functions.coerce import text_to_number
from tablescope.operators import facets
from tablescope.operators.importance import categorical_importance
from tablescope.functions.columns import col


def day(m, d):
    return datetime(2024, m, d)


F1 = [
    ([1, 2, 3, 4, 100], 5, 22, 3, 39.012818, 1522, 2.2323959116, 4.9868659572, 2, 4, 1),
    ([2, 2, 2, 2], 4, 2, 2, 0, 0, 0, 0, 2, 2, 0),
    ([1, 2], 2, 1.5, 1.5, 0.5, 0.25, None, None, 1.25, 1.75, 0),
    ([1, None, 3, 5, 9], 4, 4.5, 4, 2.95804, 8.75, 0.7528371991, 0.3428571429, 2.5, 6, 0),
]


@pytest.mark.parametrize("values,n,mean,median,std,var,skew,kurt,q1,q3,out", F1)
def test_f1_moments(frame, values, n, mean, median, std, var, skew, kurt, q1, q3, out):
    df = frame([(None if v is None else float(v),) for v in values], "v double")
    r = ts.describe_numerical(df).first()
    assert r["count"] == n and r["outlier_count"] == out
    expected = dict(mean=mean, median=median, std=std, variance=var, skewness=skew,
                    kurtosis=kurt, q1=q1, q3=q3, iqr=q3 - q1, outlier_ratio=out / n)
    for name, value in expected.items():
        if value is None:
            assert r[name] is None, name
        else:
            assert r[name] == pytest.approx(value, abs=1e-6), name


def test_f1_nan_is_missing_and_empty_column(frame):
    df = frame([(1.0, None), (float("nan"), None), (3.0, None)], "v double, e double")
    rows = {r["column"]: r for r in ts.describe_numerical(df).collect()}
    assert rows["v"]["count"] == 2 and rows["v"]["mean"] == 2
    assert rows["e"]["count"] == 0 and rows["e"]["mean"] is None
    assert rows["e"]["outlier_count"] == 0 and rows["e"]["outlier_ratio"] == 0


F2 = [(day(1, 3), 3.0, None), (day(1, 1), None, "a"), (day(1, 2), 2.0, None),
      (None, None, "b"), (day(1, 4), None, None)]


@pytest.mark.parametrize("per_range", [100, 2, 1])
def test_f2_time_fill(frame, per_range):
    df = frame(F2, "t timestamp_ntz, v double, c string")
    got = ts.fill_along_time(df, "t", rows_per_range=per_range)
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted([
        (day(1, 1), 2.0, "a"), (day(1, 2), 2.0, "a"), (day(1, 3), 3.0, "a"),
        (day(1, 4), 3.0, "a"), (day(1, 4), 3.0, "b"),
    ], key=repr)


F3 = [(1.0, 2.0, 7.0), (2.0, None, 7.0), (3.0, 5.0, 7.0), (None, 9.0, 7.0), (5.0, 4.0, 7.0),
      (4.0, 4.0, 7.0)]


@pytest.mark.parametrize("method,expected", [
    ("pearson", 0.659231724), ("spearman", 0.316227766), ("kendall", 0.182574186)])
@pytest.mark.parametrize("per_range", [None, 2])
def test_f3_correlation(frame, method, expected, per_range):
    df = frame(F3, "x double, y double, k double")
    got = {
        (r["col_a"], r["col_b"]): r["corr"] for r in ts.compute_correlation(
            df, method=method, rows_per_range=per_range, rank_block=2).collect()
    }
    assert len(got) == 9
    assert got[("x", "y")] == pytest.approx(expected, abs=1e-9)
    assert got[("y", "x")] == got[("x", "y")]
    assert got[("x", "x")] == got[("y", "y")] == 1.0
    for other in "xyk":
        assert got[("k", other)] is None and got[(other, "k")] is None


def test_f4_pivot(frame):
    df = frame([("x", "p", 1.0), ("x", None, 2.0), ("y", "p", 3.0), (None, "q", None)],
               "a string, b string, v double")
    got = ts.pivot_analysis(df, ["a"], ["b"], "v")
    assert got.columns == ["a", "v_p", "v_q", "v_nan"]
    assert {tuple(r) for r in got.collect()} == {
        ("x", 1.0, 0.0, 2.0), ("y", 3.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0)}


def test_f4_pivot_with_two_index_columns_gives_every_combination(frame):
    df = frame([("x", "p", "u", 1.0), ("x", None, "v", 2.0), ("y", "p", "u", 3.0),
                (None, "q", "v", None)], "a string, b string, c string, v double")
    got = ts.pivot_analysis(df, ["a", "b"], ["c"], "v", dense=True)
    rows = {(r["a"], r["b"]): (r["v_u"], r["v_v"]) for r in got.collect()}
    assert len(rows) == 9
    assert rows[("x", "p")] == (1.0, 0.0) and rows[("x", None)] == (0.0, 2.0)
    assert rows[(None, None)] == (0.0, 0.0)
    assert ts.pivot_analysis(df, ["a", "b"], ["c"], "v", dense=False).count() == 4
    two = ts.pivot_analysis(df, ["a"], ["b", "c"], "v")
    assert two.columns == ["a", "v_p_u", "v_p_v", "v_q_u", "v_q_v", "v_nan_u", "v_nan_v"]


@pytest.mark.parametrize("how,rows,nulls", [
    ("inner", 3, 1), ("left", 4, 2), ("right", 4, 2), ("outer", 5, 3)])
def test_f5_join(frame, how, rows, nulls):
    left = frame([("a", 1), ("a", 2), (None, 3), ("c", 4)], "k string, v int")
    right = frame([("a", 10), (None, 20), ("d", 30)], "k string, v int")
    merged, stats = ts.safe_merge_tables(left, right, how=how, on="k")
    assert merged.columns == ["k", "v_left", "v_right"]
    s = stats.first()
    assert (s["left_rows"], s["right_rows"], s["merged_rows"], s["nulls_after_merge"]) == (
        4, 3, rows, nulls)
    assert merged.count() == rows and s["join_type"] == how and s["keys"] == ["k"]
    by_key = {r["v_right"]: r["k"] for r in merged.collect()}
    if how in ("right", "outer"):
        assert by_key[30] == "d"


def test_f5_join_without_common_column(frame):
    with pytest.raises(ValueError):
        ts.merge_tables(frame([(1,)], "a int"), frame([(1,)], "b int"))


F6 = [(day(1, 31), 1.0), (day(1, 1), 2.0), (day(3, 15), 4.0), (None, 8.0), (day(6, 30), 16.0)]


def test_f6_time_buckets(frame):
    df = frame(F6, "t timestamp_ntz, v double")
    for freq in ("ME", "M"):
        got = ts.aggregate_time(df, "t", freq, ["v"]).orderBy("t").collect()
        assert [tuple(r) for r in got] == [(day(1, 1), 3), (day(3, 1), 4), (day(6, 1), 16)]
    rolled = ts.rolling_average(df, "t", ["v"], window=2).orderBy("t").collect()
    assert [r["v"] for r in rolled] == [3, 3.5, 10]
    strict = ts.rolling_average(df, "t", ["v"], window=2, min_periods=2).orderBy("t").collect()
    assert [r["v"] for r in strict] == [None, 3.5, 10]


def test_f6_gap_filled_months(frame):
    df = frame(F6, "t timestamp_ntz, v double")
    got = facets.monthly_rolling(df, "t", "v").orderBy("t").collect()
    assert [(r["t"], r["v"]) for r in got] == [
        (day(1, 31), 3), (day(2, 29), 0), (day(3, 31), 4), (day(4, 30), 0), (day(5, 31), 0),
        (day(6, 30), 16)]
    assert [r["rolling_avg"] for r in got] == pytest.approx(
        [3, 1.5, 7 / 3, 4 / 3, 4 / 3, 16 / 3])
    assert facets.monthly_rolling(df.where("t < '2024-03-01'"), "t", "v").isEmpty()


F7 = [3, 5, 4, 8, 7, 9, 12, 10, 11, 15, 14, 13]


@pytest.mark.parametrize("per_range", [None, 5, 1])
def test_f7_trend(frame, per_range):
    df = frame([(day(1, i + 1), float(y)) for i, y in enumerate(F7)], "t timestamp_ntz, v double")
    r = ts.detect_trend(df, "t", "v", rows_per_range=per_range).first()
    assert r["trend"] == "increasing" and r["points"] == 12
    assert r["slope"] == pytest.approx(1.0314685315, abs=1e-9)
    assert r["seasonality_index"] == pytest.approx(0.2218322218, abs=1e-9)


def test_f7_trend_special_cases(frame):
    two = frame([(day(1, 1), 1.0), (day(1, 2), 2.0)], "t timestamp_ntz, v double")
    assert ts.detect_trend(two, "t").first()["trend"] == "insufficient_points"
    assert ts.detect_trend(two, "absent").first()["trend"] == "no_date_column"
    assert ts.detect_trend(two.select("t"), "t").first()["trend"] == "no_numeric_values"
    flat = frame([(day(1, i), 4.0) for i in range(1, 6)], "t timestamp_ntz, v double")
    r = ts.detect_trend(flat, "t").first()
    assert r["trend"] == "flat" and r["seasonality_index"] is None


def test_f7_anomaly(frame):
    df = frame([(day(1, i), 50.0 if i == 4 else 10.0) for i in range(1, 11)],
               "t timestamp_ntz, v double")
    got = ts.detect_temporal_anomalies(df, "t", "v")
    assert got["count"].first()["count"] == 1
    r = got["anomalies"].first()
    assert r["t"] == day(1, 4) and r["z_score"] == pytest.approx(2.8460498919, abs=1e-6)
    few = ts.detect_temporal_anomalies(df.limit(3), "t", "v")
    assert few["count"].first()["count"] == 0


def test_f8_categorical_importance(frame):
    df = frame([("a", "z"), ("a", "z"), ("b", "z"), (None, "z")], "c string, one string")
    got = {r["column"]: r["score"] for r in categorical_importance(df, ["c", "one"]).collect()}
    assert got["c"] == pytest.approx(0.375)
    assert got["one"] == 0


F9 = {
    "1": 1, " 2 ": 2, "1e3": 1000, "+5": 5, ".5": 0.5, "5.": 5, "inf": float("inf"),
    "Infinity": float("inf"), "1,000": None, "12d": None, "12f": None, "0x1F": None,
    "True": None, "1_000": None, "": None, "nan": None,
}


def test_f9_coercion(frame):
    df = frame([(k,) for k in F9], "s string")
    got = {r["s"]: r["n"] for r in df.select("s", text_to_number(col("s")).alias("n")).collect()}
    assert got == F9


def test_f10_mode_ties(frame):
    df = frame([(v,) for v in ["b", "a", "b", "a", "c", None, "c", "a", "b"]], "c string")
    clean, notes = ts.handle_missing_values(df)
    assert clean.where("c IS NULL").isEmpty()
    assert notes.where("column = 'c'").first()["fill_value"] == "a"
