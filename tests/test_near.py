import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeline.geo import EARTH_RADIUS_M, edges_of, place_of
from spokeline.operators import near as N


def distance(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1, h)))


def test_places_of_all_notations():
    assert place_of("POINT (1.5 2.5)") == place_of("SRID=4326;point(1.5  2.5)") == (1.5, 2.5)
    assert place_of("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))") == (2, 1)
    assert place_of("0101000020E6100000000000000000F83F0000000000000440") == (1.5, 2.5)
    assert place_of("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((3 3, 4 3, 4 4, 3 3)))") == (2, 2)
    for broken in (None, "", "n/a", "POINT EMPTY", "POINT (nan nan)", "POINT (412.5 95.1)", "POINT (0 0)", "POLYGON ((0 0, 1 1", "0101000000", "POLYGON ((0 0, 1 0, 1 1, 0 1))", "POINT (1 2) x"):
        assert place_of(broken) is None, broken
    assert edges_of("POINT (1 2)") is None


@pytest.mark.parametrize("cell_rows", [200_000, 40])
def test_near_points_equals_brute_force(spark, cell_rows, monkeypatch):
    rng = np.random.default_rng(5)
    spots = [(179.9999, 52.0), (-179.9999, 52.0), (10.0, 89.9999), (190.0 - 360, 89.9999), (0.0, 1e-7), (-180.0, 10.0), (180.0, 10.0)]
    centre = [(float(7 + x / 3000), float(48 + y / 3000)) for x, y in rng.normal(size=(120, 2))]
    hot = [(7.0, 48.0)] * 60
    places = [(k, x, y) for k, (x, y) in enumerate(spots + centre[:60] + hot)] + [(900, None, 1.0), (901, 5.0, 95.0), (902, 0.0, 0.0), (903, float("nan"), 1.0)]
    points = [(10_000 + k, x, y) for k, (x, y) in enumerate(spots + centre[40:] + hot[:25])] + [(90_000, None, None)]
    good = lambda r: r[1] is not None and r[2] is not None and abs(r[2]) <= 90 and abs(r[1]) <= 180 and (r[1], r[2]) != (0, 0)
    want = sorted((a[0], b[0]) for a in filter(good, places) for b in filter(good, points) if distance(a[1:], b[1:]) <= 30)
    plain = N.sweep_join
    monkeypatch.setattr(N, "sweep_join", lambda *a, **k: plain(*a, **{**k, "cell_rows": cell_rows}))
    found = N.near_points(spark.createDataFrame(places, "iid long, lon double, lat double"), spark.createDataFrame(points, "pid long, lon double, lat double"), 30.0)
    assert sorted(map(tuple, found.collect())) == want


def test_regions_with_holes_parts_and_wide_ones(spark):
    texts = [
        ("hole", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"),
        ("two", "MULTIPOLYGON (((20 0, 21 0, 21 1, 20 1, 20 0)), ((30 0, 31 0, 31 1, 30 1, 30 0)))"),
        ("tiny", "POLYGON((5 5, 5.01 5, 5.01 5.01, 5 5.01, 5 5))"), ("broken", "POLYGON ((0 0, 1"), ("none", None), ("point", "POINT (1 1)"),
    ]
    regions = N.regions_of(spark.createDataFrame(texts, "iid string, g string"), "g")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 4.5), (3, 20.5, 0.5), (4, 30.5, 0.5), (5, 25.0, 0.5), (6, 5.005, 5.005), (7, None, 1.0), (1, 1.0, 1.0)], "pid long, lon double, lat double")
    got = sorted(map(tuple, N.containing_regions(regions, points).collect()))
    assert got == [("hole", 1), ("hole", 1), ("tiny", 6), ("two", 3), ("two", 4)]


def test_regions_of_all_sizes_are_copied_a_few_times_at_most(spark, monkeypatch):
    rng = np.random.default_rng(8)
    sizes = [10 ** rng.uniform(-5, 1.3) for _ in range(60)]
    boxes = [(k, float(rng.uniform(-20, 20)), float(rng.uniform(-20, 20)), s) for k, s in enumerate(sizes)]
    text = lambda x, y, s: f"POLYGON (({x} {y}, {x + s} {y}, {x + s} {y + s}, {x} {y + s}, {x} {y}))"
    regions = N.regions_of(spark.createDataFrame([(k, text(*b)) for k, *b in boxes], "iid int, g string"), "g")
    spots = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-25, 40, size=(400, 2)))] + [(1000 + k, x + s / 2, y + s / 2) for k, x, y, s in boxes]
    copies = []
    plain = N.sweep_join

    def counted(intervals, points, strip, *more, **named):
        copies.append(intervals.agg(F.max(F.floor((F.col("lat_hi") + 90) / strip) - F.floor((F.col("lat_lo") + 90) / strip) + 1)).first()[0])
        return plain(intervals, points, strip, *more, **named)

    monkeypatch.setattr(N, "sweep_join", counted)
    got = sorted(map(tuple, N.containing_regions(regions, spark.createDataFrame(spots, "pid int, lon double, lat double")).collect()))
    assert got == sorted((k, p) for k, x, y, s in boxes for p, a, b in spots if x < a < x + s and y < b < y + s)
    assert max(copies) <= N.CLASS / 4 + 1


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "iid long, lon double, lat double")
    points = spark.createDataFrame([(1, 1.0, 1.0)], "pid long, lon double, lat double").withColumns({"r": F.lit(1), "edges": F.lit(2), "strip": F.lit(3)})
    assert N.near_points(empty, points, 30.0).count() == 0
    assert N.near_points(points.withColumnRenamed("pid", "iid"), points.where("false"), 30.0).count() == 0
