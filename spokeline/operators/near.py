"""Points near other points, or inside regions: latitude strips, local longitude order, one owner per pair.

Both searches are one join of *intervals* (what reaches over a stretch of latitude and longitude: the
window round a place, or a region's bounding box) with *points*:

1. Latitude is cut into strips. A point lies in one strip; an interval is copied to every strip it
   overlaps, a region keeping only the edges that touch the strip (all that a horizontal ray needs).
2. (strip, longitude) is one sort key. Quantiles of the keys of both sides, a fixed number of values,
   cut it into ranges of about equal size, however crowded a place is. A point belongs to one range; an
   interval is copied to the ranges between its ends. The point's range owns the pair, so that each
   pair comes out once.
3. A range that still holds too many rows (many points of one place can't be told apart by longitude)
   becomes a grid of cells: its points are dealt over the rows of the grid, its intervals over the
   columns, and each is copied along the other direction.
4. Inside a cell the points are sorted by (strip, longitude); the points active for an interval are one
   run of that order. Latitude, then the exact test, decide.

No cell holds more than about ``cell_rows`` rows of either side. Nothing but the quantiles and the
counts of the ranges (at most ``ranges.MAX_RANGES`` numbers each) reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeline.geo import EARTH_RADIUS_M, edges_of, place_of
from spokeline.operators.ranges import range_cuts, range_of
from spokeline.session import Scratch

CANDIDATES = 2_000_000
#: Classes of region heights: the lowest one in degrees, and how much higher the next one is.
LOWEST, CLASS = 1e-4, 16
Verify = Callable[[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def with_place(df: DataFrame, geometry: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add the place of a geometry text; both columns are null where there is none."""

    @F.pandas_udf("lon double, lat double")
    def place(texts: pd.Series) -> pd.DataFrame:
        found = [place_of(t) or (None, None) for t in texts]
        return pd.DataFrame(found, columns=["lon", "lat"], dtype="float64")

    return df.withColumn("__place", place(F.col(geometry))).withColumns({lon: F.col("__place.lon"), lat: F.col("__place.lat")}).drop("__place")


def usable_location(lon: str, lat: str):
    """Neither null, NaN nor out of range, and not 0,0."""
    lon, lat = F.col(lon), F.col(lat)
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def _key(strip, lon):
    return strip.cast("double") + (lon + 540.0) / 1080.0


def _expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and running positions of runs given by start and length."""
    rows = np.repeat(np.arange(len(counts)), counts)
    offsets = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return rows, starts[rows] + offsets


def _chunks(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose counts add up to about ``most``."""
    total, ends = np.cumsum(counts), [0]
    while ends[-1] < len(counts):
        before = total[ends[-1] - 1] if ends[-1] else 0
        ends.append(max(ends[-1] + 1, int(np.searchsorted(total, before + most, side="right"))))
    yield from zip(ends, ends[1:])


def verify_distance(radius_m: float) -> Verify:
    def test(shapes: dict, i: np.ndarray, lon: np.ndarray, lat: np.ndarray, _: np.ndarray) -> np.ndarray:
        first = shapes["offsets"][i]
        lon0, lat0 = shapes["x1"][first], shapes["y1"][first]
        p, q = np.radians(lat0), np.radians(lat)
        a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon - lon0) / 2) ** 2
        return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(a, 1.0))) <= radius_m

    return test


def verify_inside(shapes: dict, i: np.ndarray, lon: np.ndarray, lat: np.ndarray, _: np.ndarray) -> np.ndarray:
    """Even-odd rule over all edges; a point on a shared border belongs to one of the neighbours."""
    inside = np.zeros(len(i), dtype=bool)
    starts, counts = shapes["offsets"][i], shapes["offsets"][i + 1] - shapes["offsets"][i]
    for a, b in _chunks(counts, CANDIDATES):
        rows, edges = _expand(starts[a:b], counts[a:b])
        x1, y1, x2, y2 = (shapes[k][edges] for k in ("x1", "y1", "x2", "y2"))
        x, y = lon[a:b][rows], lat[a:b][rows]
        spans = (y1 > y) != (y2 > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        inside[a:b] = np.bincount(rows, weights=hit, minlength=b - a).astype(np.int64) % 2 == 1
    return inside


def sweep_join(intervals: DataFrame, points: DataFrame, strip_deg: float, verify: Verify, clip: bool, cell_rows: int = 200_000) -> DataFrame:
    """Pairs (iid, pid) of an interval and a point inside it that pass ``verify``.

    intervals: iid, lat_lo, lat_hi, lon_lo, lon_hi, edges ARRAY<STRUCT<x1, y1, x2, y2>>; points: pid, lon,
    lat. All locations must be usable; ids may be of any type and repeat.
    """
    spark = points.sparkSession
    scratch = Scratch(spark)
    strip = lambda c: F.floor((F.col(c) + 90.0) / strip_deg)
    top, low = F.col("strip") * strip_deg - 90.0 + strip_deg, F.col("strip") * strip_deg - 90.0
    wide = intervals.withColumn("strip", F.explode(F.sequence(strip("lat_lo"), strip("lat_hi"))))
    if clip:
        slack = strip_deg * 1e-6
        wide = wide.withColumn("edges", F.filter("edges", lambda e: (F.greatest(e.y1, e.y2) >= low - slack) & (F.least(e.y1, e.y2) <= top + slack)))
    wide = scratch.keep(wide.withColumns({"k_lo": _key(F.col("strip"), F.col("lon_lo")), "k_hi": _key(F.col("strip"), F.col("lon_hi"))}))
    narrow = scratch.keep(points.select("pid", "lon", "lat", _key(strip("lat"), F.col("lon")).alias("k_lo")))

    keys = narrow.select("k_lo").unionAll(wide.select("k_lo"))
    cuts = range_cuts(keys, "k_lo", cell_rows)

    wide = wide.withColumn("r", F.explode(F.sequence(range_of(cuts, F.col("k_lo")), range_of(cuts, F.col("k_hi")))))
    narrow = narrow.withColumn("r", range_of(cuts, F.col("k_lo")))
    counts = narrow.groupBy("r").agg(F.count("*").alias("p"), F.lit(0).alias("i")).unionAll(wide.groupBy("r").agg(F.lit(0).alias("p"), F.count("*").alias("i")))
    held = counts.groupBy("r").agg(F.sum("p").alias("p"), F.sum("i").alias("i")).where((F.col("p") > cell_rows) | (F.col("i") > cell_rows)).collect()
    grid = {row["r"]: (math.ceil(row["p"] / cell_rows), math.ceil(row["i"] / cell_rows)) for row in held if row["p"] and row["i"]}

    def cells(df: DataFrame, mine: int) -> DataFrame:
        if not grid:
            return df.withColumns({"a": F.lit(0), "b": F.lit(0)})
        sizes = F.create_map(*[F.lit(x) for r, n in grid.items() for x in (r, F.array(F.lit(max(1, n[0])), F.lit(max(1, n[1]))))])
        df = df.withColumn("__n", F.coalesce(F.try_element_at(sizes, F.col("r")), F.array(F.lit(1), F.lit(1))))
        dealt, copied = ("a", "b") if mine == 0 else ("b", "a")
        own = "pid" if mine == 0 else "iid"
        df = df.withColumn(dealt, F.pmod(F.xxhash64(own, "k_lo"), F.col("__n")[mine]).cast("int"))
        return df.withColumn(copied, F.explode(F.sequence(F.lit(0), F.col("__n")[1 - mine] - 1))).drop("__n")

    left = cells(wide, 1).select("r", "a", "b", "iid", "k_lo", "k_hi", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "edges")
    right = cells(narrow, 0).select("r", "a", "b", "pid", "k_lo", "lon", "lat")

    def sweep(i: pa.Table, p: pa.Table) -> pa.Table:
        iid, pid = i["iid"].combine_chunks(), p["pid"].combine_chunks()
        empty = pa.table({"iid": iid[:0], "pid": pid[:0]})
        if not len(i) or not len(p):
            return empty
        number = lambda t, c: t[c].to_numpy()
        order = np.argsort(number(p, "k_lo"), kind="stable")
        key, lon, lat = (number(p, c)[order] for c in ("k_lo", "lon", "lat"))
        edges = i["edges"].combine_chunks()
        flat = edges.flatten()
        shapes = {"offsets": np.concatenate([[0], np.cumsum(np.diff(edges.offsets.to_numpy()))])}
        shapes |= {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")}
        starts = np.searchsorted(key, number(i, "k_lo"), side="left")
        counts = np.searchsorted(key, number(i, "k_hi"), side="right") - starts
        box = [number(i, c) for c in ("lat_lo", "lat_hi", "lon_lo", "lon_hi")]
        got_i, got_p = [], []
        for a, b in _chunks(counts, CANDIDATES):
            rows, at = _expand(starts[a:b], counts[a:b])
            rows += a
            near = (lat[at] >= box[0][rows]) & (lat[at] <= box[1][rows]) & (lon[at] >= box[2][rows]) & (lon[at] <= box[3][rows])
            rows, at = rows[near], at[near]
            good = verify(shapes, rows, lon[at], lat[at], at)
            got_i.append(rows[good])
            got_p.append(order[at[good]])
        if not got_i:
            return empty
        return pa.table({"iid": iid.take(pa.array(np.concatenate(got_i))), "pid": pid.take(pa.array(np.concatenate(got_p)))})

    kinds = f"iid {wide.schema['iid'].dataType.simpleString()}, pid {narrow.schema['pid'].dataType.simpleString()}"
    return left.groupBy("r", "a", "b").cogroup(right.groupBy("r", "a", "b")).applyInArrow(sweep, kinds)


def near_points(places: DataFrame, points: DataFrame, radius_m: float) -> DataFrame:
    """Every (iid, pid) of a place and a point at most ``radius_m`` apart on the sphere.

    places: iid, lon, lat; points: pid, lon, lat. Rows without a usable location find nothing. Windows
    that cross the date line continue on its other side; near a pole they reach all round.
    """
    reach = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9) + 1e-12
    lat, lon = F.col("lat"), F.col("lon")
    polar = F.abs(lat) + reach >= 89.9999
    half = F.when(polar, 360.0).otherwise(reach / F.cos(F.radians(F.least(F.abs(lat) + reach, F.lit(89.9999)))) * (1 + 1e-9))
    window = lambda lo, hi: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    windows = F.when(polar, F.array(window(F.lit(-180.0), F.lit(180.0)))).otherwise(
        F.filter(
            F.array(
                window(F.greatest(lon - half, F.lit(-180.0)), F.least(lon + half, F.lit(180.0))),
                F.when(lon - half < -180, window(lon - half + 360, F.lit(180.0))),
                F.when(lon + half > 180, window(F.lit(-180.0), lon + half - 360)),
            ),
            lambda w: w.isNotNull(),
        )
    )
    edge = F.struct(lon.alias("x1"), lat.alias("y1"), lon.alias("x2"), lat.alias("y2"))
    intervals = (
        places.where(usable_location("lon", "lat"))
        .withColumns({"w": F.explode(windows), "edges": F.array(edge)})
        .select("iid", F.greatest(lat - reach, F.lit(-90.0)).alias("lat_lo"), F.least(lat + reach, F.lit(90.0)).alias("lat_hi"), F.col("w.lo").alias("lon_lo"), F.col("w.hi").alias("lon_hi"), "edges")
    )
    return sweep_join(intervals, points.where(usable_location("lon", "lat")), strip_deg=4 * reach, verify=verify_distance(radius_m), clip=False)


def regions_of(df: DataFrame, geometry: str) -> DataFrame:
    """Edges and bounding box of polygon texts; rows whose text is no polygon are left out (they hold no place)."""

    @F.pandas_udf("array<double>")
    def edges(texts: pd.Series) -> pd.Series:
        return pd.Series([edges_of(t) for t in texts], dtype="object")

    four = F.transform(F.sequence(F.lit(0), (F.size("__e") / 4).cast("int") - 1), lambda k: F.struct(*[F.get("__e", k * 4 + j).alias(c) for j, c in enumerate(("x1", "y1", "x2", "y2"))]))
    out = df.withColumn("__e", edges(F.col(geometry))).where(F.col("__e").isNotNull()).withColumn("edges", four).drop("__e")
    ends = {"lat_lo": (F.array_min, "y1"), "lat_hi": (F.array_max, "y1"), "lon_lo": (F.array_min, "x1"), "lon_hi": (F.array_max, "x1")}
    return out.withColumns({k: f(F.col(f"edges.{c}")) for k, (f, c) in ends.items()}).where((F.col("lat_lo") >= -90) & (F.col("lat_hi") <= 90))


def containing_regions(regions: DataFrame, points: DataFrame) -> DataFrame:
    """Every (iid, pid) of a region and a point inside it; holes are outside.

    regions: iid, edges, lat_lo, lat_hi, lon_lo, lon_hi as ``regions_of`` makes them; points: pid, lon, lat.
    Regions are taken by classes of height, each ``CLASS`` times as high as the one before: the strips of a class fit it, so
    that a region is copied to at most ``CLASS`` / 4 + 1 strips however its size differs from the others'. There are few
    classes, and each one that occurs is one sweep over the points.
    """
    regions = regions.select("iid", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "edges")
    height = F.greatest(F.col("lat_hi") - F.col("lat_lo"), F.lit(LOWEST))
    regions = regions.withColumn("__class", F.floor(F.log(height / LOWEST) / math.log(CLASS)).cast("int"))
    points = points.where(usable_location("lon", "lat"))
    classes = sorted(r[0] for r in regions.select("__class").distinct().collect())
    found = None
    for k in classes or [0]:
        pairs = sweep_join(regions.where(F.col("__class") == k).drop("__class"), points, 4 * LOWEST * CLASS**k, verify_inside, clip=True)
        found = pairs if found is None else found.unionAll(pairs)
    return found
