import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spokeline.operators import fill_missing as L
from spokeline.operators import table_diff as D
from spokeline.operators import units as U
from spokeline.sources.tables import latest_rows


def test_units(spark):
    sources = spark.createDataFrame([("a", "mph", None, "widths in whole centimetres"), ("b", None, None, "velocity in metres per second; width in thousandths of a metre"), ("c", None, None, "nobody measured it"), ("d", "KM/H", "ft", None)], "source string, s string, w string, description string")
    told = U.source_units(sources, "source", {"speed": "s", "length": "w"})
    assert sorted(map(tuple, told.collect())) == [("a", "length", "cm"), ("a", "speed", "mph"), ("b", "length", "mm"), ("b", "speed", "m/s"), ("d", "length", "ft"), ("d", "speed", "km/h")]
    cases = [
        ("speed", "30", "a", 3000), ("speed", "max ３５ mph", "b", 3500), ("speed", "56,3 km/h", "a", 3498), ("speed", "10", "b", 2237), ("speed", "17 kn", None, 1956), ("speed", "30", "c", None), ("speed", "30", None, None),
        ("speed", "none", "a", None), ("speed", None, "a", None), ("speed", "", "a", None), ("speed", "30 parsecs", "a", None), ("speed", "30 mph 20", "a", None), ("speed", "1" * 400, "a", None),
        ("length", "12'6\"", "a", 1250), ("length", "19 ft 7 in", "c", 1958), ("length", "300", "a", 984), ("length", "3,5 m", "a", 1148), ("length", "9′", "a", 900), ("length", "24 FT.", "c", 2400), ("length", "8.3 yards", "c", 2490), ("length", '230"', "c", 1917),
    ]
    df = spark.createDataFrame([(k, q, v, s) for k, (q, v, s, _) in enumerate(cases)], "k int, quantity string, value string, source string").withColumns({"factor": F.lit(9), "unit": F.lit("x")})
    got = {r["k"]: r["h"] for r in U.convert_units(df, told).withColumn("h", U.hundredths(F.col("converted"))).collect()}
    for k, (q, v, s, want) in enumerate(cases):
        if v != "1" * 400:
            assert got[k] == want, (q, v, s)
    assert U.convert_units(df.where("false"), told).count() == 0


def rows(spark, data, schema="k long, x double, t string, m map<string,int>"):
    return spark.createDataFrame(data, schema)


def test_diff_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "MEAN_CHUNK", 4)
    a = [(k, k * 1.0, "t", {"a": k}) for k in range(400)]
    b = [list(r) for r in a]
    b[3][1] += 5e-7
    b[4][1] += 5e-6
    b[5][1] = math.nan
    b[6][2] = None
    b[7][3] = {"a": -1}
    a[8] = (8, math.nan, "t", {"a": 8})
    b[8][1] = None
    b[9][2] = "T"
    a[10] = (10, math.inf, "t", None)
    b[10] = [10, math.inf, "t", None]
    b = [tuple(r) for r in b if r[0] != 20] + [(1000, 1.0, "t", None)]
    got = sorted(tuple(r)[:2] for r in D.diff_tables(rows(spark, a), rows(spark, b).select("m", "t", "x", "k"), ["k"]).collect())
    assert got == [(4, "x"), (5, "x"), (6, "t"), (7, "m"), (9, "t"), (20, "rows_only_reference"), (1000, "rows_only_computed")]
    empty = rows(spark, [])
    assert D.diff_tables(empty, empty, ["k"]).count() == 0
    assert {r["diff"]: r["n_differ"] for r in D.diff_report(D.diff_tables(rows(spark, a), empty, ["k"])).collect()} == {"rows_only_reference": 400}


def test_a_lost_row_moves_no_cut_but_the_next(spark):
    a = spark.range(20_000).select((F.col("id") * 3).alias("k"), (F.col("id") * 0.5).alias("x"), F.lit("t").alias("t"), F.lit(None).cast("map<string,int>").alias("m"))
    for lost in (30, 30_000, 59_997):
        seen = D.diff_rows(a, a.where(F.col("k") != lost), ["k"]).collect()
        assert [r["k"] for r in seen if not r["__in_computed"]] == [lost] and len(seen) <= 150
    # without cuts by content, forced cuts alone keep chunks short
    longest = D._chunked(a.withColumn("__sort", F.col("k")), ["k"], ["x"], {"x"}, [], 0.0).groupBy("__range", "__chunk").count()
    assert longest.agg(F.max("count")).first()[0] <= D.LONGEST_CHUNK


def test_no_tolerance_tells_any_numbers_apart(spark):
    a, b = rows(spark, [(1, 1.0, "t", None), (2, 0.0, "t", None), (3, 5.0, "t", None)]), rows(spark, [(1, 1.0 + 1e-12, "t", None), (2, -0.0, "t", None), (3, 5.0, "t", None)])
    assert [tuple(r)[:2] for r in D.diff_tables(a, b, ["k"], tolerance=0).collect()] == [(1, "x")]


def test_diff_with_text_keys_null_keys_and_clashing_names(spark):
    a = spark.createDataFrame([("a", 1, 1.0), (None, 2, 2.0), ("c", 3, None)], "a string, b int, n double")
    b = spark.createDataFrame([("a", 1, 1.0), (None, 2, 2.5), ("c", 3, 0.0)], "a string, b int, n double")
    assert sorted(map(str, (tuple(r)[:3] for r in D.diff_tables(a, b, ["a", "b"]).collect()))) == ["('c', 3, 'n')", "(None, 2, 'n')"]


def test_latest_rows(spark):
    t = lambda d: datetime(2025, 1, d)
    df = spark.createDataFrame([(1, "a", {"x": 1}, t(1)), (1, "b", {"x": 2}, t(3)), (1, "b", {"x": 2}, t(3)), (1, "c", None, None), (None, "n", None, t(1)), (2, None, None, t(2))], "k long, v string, m map<string,int>, at timestamp")
    got = {r["k"]: (r["v"], r["m"]) for r in latest_rows(df, ["k"], "at").collect()}
    assert got == {1: ("b", {"x": 2}), None: ("n", None), 2: (None, None)}


def test_fill(spark):
    data = [(1, "a", "g", 3), (2, "a", "g", 3), (3, "a", "g", None), (4, "b", "g", None), (5, "c", None, None), (6, None, "h", 1), (7, None, "h", 2), (8, None, "h", None)]
    df = spark.createDataFrame(data, "k int, way string, town string, v int").withColumn("label", F.lit(0))
    got = {r["k"]: (r["label"], r["filled_by"]) for r in L.propagate(df, "v", [F.col("way"), F.col("town")]).collect()}
    assert got == {1: (3, None), 2: (3, None), 3: (3, 0), 4: (3, 1), 5: (None, None), 6: (1, None), 7: (2, None), 8: (1, 1)}
    assert L.propagate(df.where("false"), "v", [F.col("way")]).count() == 0


def test_fill_by_who_speaks_and_who_listens(spark):
    df = spark.createDataFrame([("c", 1, None), ("c", 1, 30), ("s", 1, None), ("c", 2, None), ("s", 2, 55), ("s", 3, None)], "kind string, state int, v int")
    city = F.col("kind") == "c"
    tiers = [(F.when(city, F.col("state")), F.col("state")), (F.when(~city, F.col("state")), F.when(city, F.col("state")))]
    got = sorted(map(str, L.filled(L.propagate(df, "v", tiers)).select("kind", "state", "label", "filled_by").collect()))
    assert got == ["Row(kind='c', state=1, label=30, filled_by=0)", "Row(kind='c', state=2, label=55, filled_by=1)", "Row(kind='s', state=1, label=30, filled_by=0)"]


def chain(spark, values, kind):
    """Record k shares a group with record k + 1: groups of even k in x, of odd ones in y."""
    rows = [(k, f"g{k - k % 2}", f"h{k + k % 2}" if 0 < k < len(values) - 1 else None, v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, f"k int, x string, y string, v {kind}")


def spread(df, kind, **more):
    return {r["k"]: (r["label"], r["filled_by"]) for r in L.propagate(df, "v", [F.col("x"), F.col("y")], kind=kind, spread=True, **more).collect()}


def test_numbers_spread_until_they_settle(spark, monkeypatch):
    for in_one in (L.IN_ONE_TASK, 0):
        monkeypatch.setattr(L, "IN_ONE_TASK", in_one)
        got = spread(chain(spark, [0.0, None, None, 10.0], "double"), "number", tolerance=1e-6 if in_one else 0.01)
        assert [round(got[k][0], 3 if in_one else 1) for k in range(4)] == ([0, 3.333, 6.667, 10] if in_one else [0, 3.3, 6.7, 10]) and [got[k][1] for k in range(4)] == [None, 0, 0, None]
    with pytest.raises(RuntimeError):
        spread(chain(spark, [0.0, None, None, 10.0], "double"), "number", rounds=3)
    monkeypatch.undo()
    # one observed value reaches the whole of a long chain; what no value reaches stays empty
    got = spread(chain(spark, [7.0] + [None] * 39, "double").unionAll(spark.createDataFrame([(99, "lost", None, None), (98, None, None, None)], "k int, x string, y string, v double")), "number")
    assert all(abs(got[k][0] - 7) < 1e-6 for k in range(40)) and got[99] == (None, None) and got[98] == (None, None)
    assert L.propagate(chain(spark, [1.0, None], "double").where("false"), "v", [F.col("x"), F.col("y")], kind="number", spread=True).count() == 0


def test_distributions_spread_until_they_settle(spark, monkeypatch):
    values = ["a", None, None, None, None, "b"]
    crowd = [(100 + k, "g4", None, None) for k in range(3)]
    for in_one in (L.IN_ONE_TASK, 0):
        monkeypatch.setattr(L, "IN_ONE_TASK", in_one)
        df = chain(spark, values, "string").unionAll(spark.createDataFrame(crowd, "k int, x string, y string, v string"))
        got = spread(df, "category", tolerance=0.02)
        assert [got[k][0] for k in range(6)] == ["a", "a", "a", "b", "b", "b"] and got[102] == ("b", 0) and got[0] == ("a", None)
    even = spark.createDataFrame([(0, "g", None, "b"), (1, "g", "h", None), (2, None, "h", "a")], "k int, x string, y string, v string")
    assert spread(even, "category")[1][0] == "a"
