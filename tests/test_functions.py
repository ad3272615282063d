"""The distributed building blocks against brute force, for several range counts."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

import tablescope as ts
from tablescope.functions.ordered import (
    RANGE,
    running_counts,
    split_by_order,
    total_order,
)
from tablescope.functions.quantiles import exact_quantiles, grouped_median
from tablescope.functions.skew import _hot_parts, attach, deal_hot, hot_keys, skew_join


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(5)
    values = [7.0] * 300 + [rng.choice([1.0, 2.0, 3.5]) for _ in range(200)]
    values += [rng.gauss(0, 1000) for _ in range(500)]
    rng.shuffle(values)
    return values


@pytest.mark.parametrize("per_range", [10_000, 300, 37])
def test_running_counts_equal_brute_force(frame, skewed, per_range):
    df = frame([(v,) for v in skewed] + [(None,)], "v double")
    got = running_counts(df, "v", rows=len(skewed), rows_per_range=per_range).collect()
    ordered = sorted(skewed)
    distinct = sorted(set(skewed))
    assert len(got) == len(distinct)
    for r in got:
        assert r["n"] == ordered.count(r["v"])
        assert r["before"] == sum(1 for x in ordered if x < r["v"])
        assert r["position"] == distinct.index(r["v"])


@pytest.mark.parametrize("limit,accuracy", [(500_000, 2000), (20, 50), (3, 10)])
def test_exact_quantiles_equal_numpy(frame, skewed, limit, accuracy):
    rows = [(v, float(i), None) for i, v in enumerate(skewed)]
    df = frame(rows, "v double, i double, e double").repartition(5)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = exact_quantiles(df, ["v", "i", "e"], probs, max_in_bracket=limit,
                          sketch_accuracy=accuracy)
    for p in probs:
        assert got["v"][p] == pytest.approx(np.quantile(skewed, p), rel=1e-12)
        assert got["i"][p] == pytest.approx(np.quantile(range(len(skewed)), p), rel=1e-12)
        assert got["e"][p] is None


def test_exact_quantiles_survive_a_poor_sample(frame, skewed, monkeypatch):
    from tablescope.functions import quantiles

    monkeypatch.setattr(quantiles, "SKETCH_ROWS", 12)
    df = frame([(v,) for v in skewed], "v double").repartition(4)
    probs = (0.05, 0.25, 0.5, 0.75)
    for margin in (2000, 3):
        got = exact_quantiles(df, ["v"], probs, max_in_bracket=10, sketch_accuracy=margin)
        for p in probs:
            assert got["v"][p] == pytest.approx(np.quantile(skewed, p), rel=1e-12)


def test_exact_quantiles_of_extreme_values(frame):
    values = [-1.7e308, -1e300, -5.0, 0.0, 5e-324, 1e-300, 3.0, 1e300, 1.7e308]
    df = frame([(v,) for v in values], "v double")
    got = exact_quantiles(df, ["v"], (0.25, 0.5, 0.75), max_in_bracket=1, sketch_accuracy=3)
    assert [got["v"][p] for p in (0.25, 0.5, 0.75)] == [values[2], values[4], values[6]]


@pytest.mark.parametrize("per_range", [10_000, 50])
def test_grouped_median_with_a_hot_group_and_missing_key(frame, skewed, per_range):
    keys = ["hot" if i % 3 else f"k{i % 7}" for i in range(len(skewed))]
    rows = list(zip(keys, skewed)) + [(None, 4.0), (None, 5.0), ("empty", None)]
    got = {
        r["k"]: r["v"] for r in grouped_median(
            frame(rows, "k string, v double"), ["k"], "v",
            rows=len(rows), rows_per_range=per_range).collect()
    }
    for k in set(keys):
        assert got[k] == statistics.median(v for kk, v in zip(keys, skewed) if kk == k)
    assert got[None] == 4.5
    assert got["empty"] is None


@pytest.mark.parametrize("text", [
    lambda i: "one",                                    # a constant
    lambda i: "x" * 40 + f"{i:06d}",                    # alike in the first level
    lambda i: None if i % 4 == 0 else "y" * 700 + f"{i:06d}",   # alike in three levels, and NULL
    lambda i: f"{i % 3}" + "z" * 100,                   # few long texts
])
@pytest.mark.parametrize("as_key", [True, False])
def test_ranges_split_text(spark, frame, text, as_key):
    """Text as the key or as a tie-break of one constant key: 20 ranges are wanted, none is full,
    and ranges follow the order."""
    rows = [(text(i), i) for i in range(4000)]
    random.Random(1).shuffle(rows)
    df = frame(rows, "t string, k int").withColumn("one", F.lit(1)).repartition(8)
    by, ties = ("t", ["k"]) if as_key else ("one", ["t", "k"])
    ranged = split_by_order(df, by, ties, rows=len(rows), rows_per_range=200)
    sizes = [r["count"] for r in ranged.df.groupBy(RANGE).count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 700
    missing = F.col("t").isNull() & F.lit(as_key)
    ends = ranged.df.groupBy(RANGE).agg(
        F.min(F.struct(missing, "t", "k")).alias("lo"),
        F.max(F.struct(missing, "t", "k")).alias("hi")).orderBy(RANGE).collect()
    key = lambda r: (r[0], r[1] is not None, r[1] or "", r[2])
    for a, b in zip(ends, ends[1:]):
        assert key(a["hi"]) < key(b["lo"])


@pytest.mark.parametrize("per_range", [None, 40])
def test_fill_by_entity(spark, frame, per_range):
    """A hot entity over many ranges, NULL as an entity, entities without values, against a loop."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        who = rng.choice(["hot"] * 5 + [f"e{i % 40}", "e1", None, "none"])
        rows.append((who, rng.choice([None, *range(50)]), i,
                     rng.choice([None, None, float(i)]) if who != "none" else None,
                     rng.choice([None, f"s{i}"])))
    df = frame(rows, "who string, t int, i int, v double, s string").repartition(5)
    got = {r["i"]: (r["who"], r["v"], r["s"]) for r in ts.fill_along_time(
        df, "t", ["i"], partition_by="who", rows_per_range=per_range).collect()}
    want = {}
    for who in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == who), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        for c in (3, 4):
            last = next((r[c] for r in own if r[c] is not None), None)
            for r in own:
                last = r[c] if r[c] is not None else last
                want.setdefault(r[2], [who]).append(last)
    assert got == {i: tuple(v) for i, v in want.items()}


def test_fill_by_entity_reads_no_frame_anew_for_each_row(spark):
    """A frame from each row to the end of its entity costs the square of the entity's rows."""
    df = spark.range(100).selectExpr("id % 2 AS who", "id AS t", "nullif(id % 3, 0) AS v")
    plan = ts.fill_along_time(df, "t", partition_by="who")._jdf.queryExecution().optimizedPlan()
    frames = [part.split(")")[0] for part in plan.toString().split("specifiedwindowframe(")[1:]]
    assert frames and all("unboundedpreceding" in f for f in frames)


def test_fill_by_entity_of_nothing(frame):
    df = frame([], "who string, t int, v double")
    assert ts.fill_along_time(df, "t", partition_by=["who"]).collect() == []
    clean, notes = ts.handle_missing_values(
        frame([("a", 1, 1.0), ("a", 2, None), ("b", 1, None)], "who string, t int, v double"),
        "t", partition_by="who")
    assert sorted(map(tuple, clean.collect())) == [("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 1.0)]
    assert any("per who" in (r["rationale"] or "") for r in notes.collect())


def test_ranges_follow_the_order_and_split_a_hot_time(spark, frame):
    """One timestamp, and one exact row, hold most of the table; no range keeps them all."""
    rows = [(1, i) for i in range(400)] + [(2, 0)] * 400 + [(None, i) for i in range(200)]
    df = frame(rows, "t int, k int").repartition(8)
    ranged = split_by_order(df, "t", ["k"], rows=len(rows), rows_per_range=50)
    sizes = ranged.df.groupBy(RANGE).count().collect()
    assert len(sizes) > 10
    assert max(r["count"] for r in sizes) < 200
    ends = ranged.df.groupBy(RANGE).agg(
        F.min(F.struct(F.col("t").isNull(), "t", "k")).alias("lo"),
        F.max(F.struct(F.col("t").isNull(), "t", "k")).alias("hi"),
    ).orderBy(RANGE).collect()
    key = lambda r: (r[0], r[1] or 0, r[2])
    for a, b in zip(ends, ends[1:]):
        assert key(a["hi"]) <= key(b["lo"])
    assert len(total_order(df, "t", ["k"])) == 4


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_skew_join_equals_plain_join(frame, how):
    left = frame([("hot", i) for i in range(300)] + [(None, 1), ("a", 2), ("only_left", 3)],
                 "k string, x int")
    right = frame([("hot", 1), ("hot", 2), (None, 5), ("a", 6), ("only_right", 7)]
                  + [("hot_right", i) for i in range(200)], "k string, y int")
    plain = skew_join(left, right, ["k"], how)
    salted = skew_join(left, right, ["k"], how, large_bytes=1, share=0.2)
    as_set = lambda df: sorted(map(tuple, df.select("k", "x", "y").collect()), key=repr)
    assert as_set(plain) == as_set(salted)
    swapped = skew_join(right.select("k", F.col("y").alias("x")),
                        left.select("k", F.col("x").alias("y")), ["k"], how,
                        large_bytes=1, share=0.2)
    again = skew_join(right.select("k", F.col("y").alias("x")),
                      left.select("k", F.col("x").alias("y")), ["k"], how)
    assert as_set(swapped) == as_set(again)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("part_rows", [7, 1000])
def test_join_of_keys_hot_on_both_sides(frame, how, part_rows):
    """A key, NULL and a two-column key that are hot on both sides, keys hot on one side only, and
    copies of one row; each cell of the grid holds a bounded part of the key."""
    left = frame([("hot", 1, i % 40) for i in range(120)] + [(None, 1, i) for i in range(60)]
                 + [("left", 2, i) for i in range(80)] + [("a", 1, 2), ("b", None, 3)],
                 "k string, m int, x int").repartition(3)
    right = frame([("hot", 1, i) for i in range(50)] + [(None, 1, i) for i in range(40)]
                  + [("right", 2, i) for i in range(70)] + [("a", 1, 6), ("c", None, 7)],
                  "k string, m int, y int").repartition(3)
    options = {"large_bytes": 1, "share": 0.1, "part_rows": part_rows}
    as_list = lambda df: sorted(map(tuple, df.select("k", "m", "x", "y").collect()), key=repr)
    got = skew_join(left, right, ["k", "m"], how, **options)
    assert got.columns == ["k", "m", "x", "y"]
    assert as_list(got) == as_list(skew_join(left, right, ["k", "m"], how))
    table = frame([("hot", 1, 18, 8, True)], "k string, m int, _skew_left int, _skew_right int, "
                                             "_skew_both boolean")
    dealt = deal_hot(left, table, ["k", "m"], "_skew_left", "_skew_right")
    cells = dealt.where("k = 'hot'").groupBy("_skew_own", "_skew_other").count().collect()
    assert sum(r["count"] for r in cells) == 120 * 8 and max(r["count"] for r in cells) < 40


def test_join_grid_is_one_join_without_broadcast_of_rows(spark, frame):
    left = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS x")
    right = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE -id END AS k", "id AS y")
    df = skew_join(left, right, ["k"], "outer", large_bytes=1, share=0.1, part_rows=100)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert sum("FullOuter" in line for line in joins) == 1
    assert all("LeftOuter" in line and "broadcast" in line for line in joins if "FullOuter" not in line)
    assert "_skew_i" in next(line for line in joins if "FullOuter" in line)


def test_join_cuts_keys_whose_rows_on_both_sides_multiply(spark):
    """Half a percent of the rows on either side, yet a million rows of the result and more."""
    left = spark.range(300_000).selectExpr("CASE WHEN id % 200 > 0 THEN id END AS k", "id AS x")
    right = spark.range(300_000).selectExpr("CASE WHEN id % 200 > 0 THEN -id END AS k", "id AS y")
    df = skew_join(left, right, ["k"], "outer", large_bytes=1)
    assert "_skew_i" in df._jdf.queryExecution().optimizedPlan().toString()
    got = df.agg(F.count("*"), F.count("k"), F.count_distinct("x"), F.count_distinct("y")).first()
    assert tuple(got) == (1500 * 1500 + 2 * 298_500, 2 * 298_500, 300_000, 300_000)


def test_copies_of_a_key_hot_on_both_sides_stay_few(spark):
    """In parts of 50 rows each row of the key would be sent some 70 times."""
    left = spark.range(8000).selectExpr("CASE WHEN id % 2 = 0 THEN 0 ELSE id END AS k", "id AS x")
    right = spark.range(6000).selectExpr("CASE WHEN id % 2 = 0 THEN 0 ELSE -id END AS k", "id AS y")
    table = _hot_parts(left, right, ["k"], 0.1, 50)
    (hot,) = table.collect()
    assert hot["_skew_left"] > 2 and hot["_skew_right"] > 1
    sent = sum(deal_hot(side, table, ["k"], own, other).where("k = 0").count() for side, own, other in (
        (left, "_skew_left", "_skew_right"), (right, "_skew_right", "_skew_left")))
    assert sent <= 6 * 7000
    # A wide row counts for more.
    (wide,) = _hot_parts(left.withColumn("x", F.repeat(F.lit("x"), 100_000)), right, ["k"], 0.1, 50).collect()
    assert wide["_skew_left"] > 2 * hot["_skew_left"]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan is not final
    try:
        df = skew_join(left, right, ["k"], "outer", large_bytes=1, share=0.1, part_rows=50)
        assert df.count() == 4000 * 3000 + 4000 + 3000
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # Generated code would hold all that a cell makes.
    assert "*(" in plan
    (join,) = [line for line in plan.splitlines() if "FullOuter" in line]
    assert "*(" not in join


def test_hot_keys_and_attach(frame):
    df = frame([(1.0, i) for i in range(500)] + [(float(i), i) for i in range(2, 300)],
               "k double, i int")
    hot = hot_keys(df, ["k"])
    assert [r["k"] for r in hot.collect()] == [1.0]
    table = df.select("k").distinct().withColumn("z", F.col("k") * 2)
    got = attach(df, table, "k", rows=df.count(), large_rows=10)
    assert got.count() == df.count()
    assert got.where("z IS NULL OR z != 2 * k").isEmpty()
    plan = attach(
        attach(df, table, "k", rows=800, large_rows=10).withColumnRenamed("z", "y"), table, "k",
        rows=800, like=df, large_rows=10)
    assert plan.count() == df.count() and "Union" not in plan._jdf.queryExecution(
        ).optimizedPlan().toString()


READABLE = {
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]": "2024-02-13 04:05:06.123456",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]": "2024-02-13T04:05:06+00:00",
    "yyyy-MM-dd HH:mm": "2024-02-13 04:05",
    "yyyy-M-d": "2024-02-13", "d-M-yyyy": "13-2-2024", "M/d/yyyy": "2/13/2024",
    "yyyy/M/d": "2024/02/13", "MMM d yyyy": "Feb 13 2024", "d MMM yyyy": "13 feb 2024",
    "d/M/yyyy": "13/02/2024", "M/d/yyyy H:mm[:ss]": "02/13/2024 4:05",
    "yyyy/M/d H:mm[:ss]": "2024/2/13 04:05:06", "d-M-yyyy H:mm[:ss]": "13-02-2024 04:05",
}


def test_every_layout_reads_its_text_and_only_text_of_its_shape(frame):
    import re

    from tablescope.functions.coerce import DATETIME_FORMATS, layout_shape, text_to_timestamp
    from tablescope.operators.inference import text_shares

    assert list(READABLE) == list(DATETIME_FORMATS)
    for layout, text in READABLE.items():
        assert re.match(layout_shape(layout), f" {text} "), layout
        assert not re.match(layout_shape(layout), "soon")
        df = frame([(f" {text} ",), ("2024-99-99",), ("10:30",), (None,)], "t string")
        got = [r[0] for r in df.select(text_to_timestamp(F.col("t"), layout)).collect()]
        assert str(got[0])[:10] == "2024-02-13" and got[1:] == [None, None, None], layout
        share = text_shares(df.limit(1), ["t"])["t"]
        assert (share.layout, share.datetime, share.numeric) == (layout, 1.0, 0.0)
    assert layout_shape("EEEE d MMMM yyyy") is None


@pytest.mark.parametrize("subset", [None, ["a", "b"], ["b"]])
def test_duplicates_agree_on_every_path(frame, subset, monkeypatch):
    from tablescope.operators import quality

    rows = [("x", 1, None)] * 200 + [(None, 2, 1.0)] * 2 + [("y", i, float(i)) for i in range(300)]
    df = frame(rows, "a string, b int, c double").repartition(6)
    as_list = lambda d: sorted(map(tuple, d.collect()), key=repr)
    plain = as_list(quality.detect_duplicates(df, subset))
    assert as_list(quality.detect_duplicates(df, subset, large_bytes=1)) == plain
    assert quality.duplicate_count(df, subset, large_bytes=1).first()[0] == len(plain)
    assert as_list(quality.detect_duplicates(df, subset, large_bytes=1)) == plain
    assert quality.duplicate_count(df, subset).first()[0] == len(plain)


def test_duplicates_of_hot_keys_stay_spread(spark, frame):
    """No task gets all rows of a key that half of the rows hold."""
    from tablescope.operators import quality

    rows = [(None if i % 4 == 1 else float("nan") if i % 4 == 3 else float(i // 8), i)
            for i in range(4000)]
    df = frame(rows, "k double, i int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = quality.detect_duplicates(df, ["k"], large_bytes=1)
        assert found.count() == 4000 and found.distinct().count() == 4000
        places = found.select("k", F.spark_partition_id().alias("place")).where(
            "k IS NULL OR isnan(k)").groupBy("place").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(places) > 1 and max(r["count"] for r in places) < 1500
    assert quality.duplicate_count(df, ["k"], large_bytes=1).first()[0] == 4000


def test_distinct_counts_of_long_text(frame):
    from tablescope.functions.counts import distinct_counts, top_values, value_counts

    long = "z" * 500
    df = frame([(long + str(i % 7), float(i % 3)) for i in range(50)]
               + [(None, float("nan")), ("z", -0.0)], "t string, v double")
    got = {r["column"]: r["unique"] for r in distinct_counts(df, ["t", "v"]).collect()}
    assert got == {"t": 8, "v": 3}
    kept = value_counts(df, ["t"]).where("length(value) > 128").count()
    assert kept == 7
    more = df.unionByName(df.where(F.col("t").endswith("z3")))
    assert top_values(more, ["t", "v"]) == {"t": (long + "3", 14, 8), "v": ("0.0", 21, 3)}
    approx = {r["column"]: r["unique"] for r in distinct_counts(df, ["t"], approx=True).collect()}
    assert approx == {"t": 8}


@pytest.mark.parametrize("start", [70, 256, 300, 5000])
def test_ties_of_long_texts_are_told_without_a_join(frame, monkeypatch, start):
    from tablescope.functions.counts import top_values

    same = "x" * start
    rows = [same + f"h{i:03}" for i in range(90)] * 3 + [same + f"g{i}" for i in range(50)]
    df = frame([(t, i) for i, t in enumerate(rows)], "t string, i int").select("t")

    def joined(*args):
        raise AssertionError("texts are joined")
    monkeypatch.setattr(type(df), "join", joined)
    assert top_values(df, ["t"]) == {"t": (same + "h000", 3, 140)}
    more = df.union(frame([(same,)] * 3, "t string"))
    assert top_values(more, ["t"]) == {"t": (same, 3, 141)}
