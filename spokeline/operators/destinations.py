"""Destinations: places clustered by distance and tied to census blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeline.geo import EARTH_RADIUS_M
from spokeline.operators.near import containing_regions, near_points
from spokeline.operators.network import connected_components
from spokeline.session import keep


def cluster_places(places: DataFrame, reach_m: float, by: str | None = None) -> DataFrame:
    """(id, cluster): places linked by steps of at most ``reach_m``; the cluster is named by its smallest id.

    places: id, lon, lat and, with ``by``, a column (the type) within which alone places cluster; a place of
    several types then has a row for each, which ``cluster_types`` tells apart. The links come from the strip
    sweep, the clusters from label spreading: no pair of distant places is ever looked at.
    """
    if by:
        return cluster_types(places, reach_m, by).select("id", "cluster")
    places = keep(places)
    pairs = near_points(places.withColumnRenamed("id", "iid"), places.withColumnRenamed("id", "pid"), reach_m).where("iid < pid")
    named = connected_components(pairs.select(F.col("iid").alias("a"), F.col("pid").alias("b")))
    return places.join(named, places["id"] == named["v"], "left").select("id", F.coalesce("component", "id").alias("cluster"))


def cluster_types(places: DataFrame, reach_m: float, by: str) -> DataFrame:
    """(id, ``by``, cluster): places clustered within each type; the cluster is named by its smallest id.

    places: id, lon, lat and the type, a row for each type of a place. The vertices of the graph are (type, id):
    a place of two types has a part in a cluster of each and ties neither to the other. A null type links nothing.
    """
    places = keep(places.select("id", "lon", "lat", by).distinct())
    spots = places.select("id", "lon", "lat").distinct()
    kinds = places.groupBy("id").agg(F.collect_set(by).alias("kinds"))
    pairs = near_points(spots.withColumnRenamed("id", "iid"), spots.withColumnRenamed("id", "pid"), reach_m).where("iid < pid").distinct()
    pairs = pairs.join(kinds.withColumnsRenamed({"id": "iid", "kinds": "x"}), "iid").join(kinds.withColumnsRenamed({"id": "pid", "kinds": "y"}), "pid")
    pairs = pairs.select("iid", "pid", F.explode(F.array_intersect("x", "y")).alias("kind"))
    vertex = lambda c: F.struct(F.col("kind"), F.col(c).alias("id"))
    named = connected_components(pairs.select(vertex("iid").alias("a"), vertex("pid").alias("b"))).select(F.col("v.id").alias("v"), F.col("v.kind").alias("kind"), F.col("component.id").alias("component"))
    members = places.select("id", by).distinct()
    return members.join(named, (members["id"] == named["v"]) & (members[by] == named["kind"]), "left").select("id", members[by], F.coalesce("component", "id").alias("cluster"))


def by_mode(places: DataFrame, regions: DataFrame, modes: dict[str, tuple[str, float]]) -> DataFrame:
    """(dest_type, id, place): the places (id) of every destination, which is named by its smallest place.

    places: id, lon, lat, dest_type, is_area, a row for each type of a place; regions: the areas as ``regions_of``
    makes them, iid being the place; modes: type -> (mode of the catalog, reach in metres). Places are near each
    other by their centres, and inside an area by its outline. Areas inside others aren't left out.
    """
    places = keep(places.join(F.broadcast(_mode_table(places, modes)), "dest_type"))
    # points inside an area of their own type are that area
    held = containing_regions(regions, places.where("not is_area").select(F.col("id").alias("pid"), "lon", "lat").distinct())
    areas = places.where("is_area").select(F.col("id").alias("iid"), "dest_type")
    inside = keep(held.join(areas, "iid").select(F.col("pid").alias("id"), "dest_type").distinct())
    mode = F.col("mode")
    open_ = places.join(inside.withColumn("in_area", F.lit(True)), ["id", "dest_type"], "left").where(~(F.col("in_area").isNotNull() & mode.isin("single", "areas", "stops"))).drop("in_area")
    # stops near an area are part of it
    reach = max([r for m, r in modes.values() if m == "stops"], default=0.0)
    if reach:
        near_area = _pairs_within(open_.where((mode == "stops") & ~F.col("is_area")), open_.where((mode == "stops") & F.col("is_area")), reach)
        open_ = open_.join(near_area.select(F.col("iid").alias("id"), "dest_type").distinct(), ["id", "dest_type"], "left_anti")
    open_ = keep(open_)
    joins = ((mode == "areas") & F.col("is_area")) | (mode == "together") | ((mode == "stops") & ~F.col("is_area"))
    reaching = max([r for _, r in modes.values()], default=0.0)
    found = open_.select("dest_type", "id", F.col("id").alias("place"))
    if reaching:
        some = keep(open_.where(joins & (F.col("reach") > 0)))
        pairs = _pairs_within(some, some, reaching).where("iid < pid")
        vertex = lambda c: F.struct("dest_type", F.col(c).alias("id"))
        named = connected_components(pairs.select(vertex("iid").alias("a"), vertex("pid").alias("b")))
        named = named.select(F.col("v.dest_type").alias("dest_type"), F.col("v.id").alias("place"), F.col("component.id").alias("whole"))
        found = found.join(named, ["dest_type", "place"], "left").select("dest_type", F.coalesce("whole", "id").alias("id"), "place")
    return found


def _mode_table(places: DataFrame, modes: dict[str, tuple[str, float]]) -> DataFrame:
    return places.sparkSession.createDataFrame([(t, m, float(r)) for t, (m, r) in modes.items()], "dest_type string, mode string, reach double")


def _pairs_within(some: DataFrame, others: DataFrame, most: float) -> DataFrame:
    """(iid, pid, dest_type) of places of one type that are within that type's own reach."""
    spot = lambda df, c: df.select(F.col("id").alias(c), "lon", "lat").distinct()
    pairs = near_points(spot(some, "iid"), spot(others, "pid"), most).where("iid <> pid")
    side = lambda df, c, x: df.select(F.col("id").alias(c), "dest_type", "reach", F.radians("lon").alias(f"lon{x}"), F.radians("lat").alias(f"lat{x}"))
    both = pairs.join(side(some, "iid", 1), "iid").join(side(others, "pid", 2).drop("reach"), ["pid", "dest_type"])
    half = lambda a, b: F.pow(F.sin((F.col(a) - F.col(b)) / 2), F.lit(2.0))
    metres = 2 * EARTH_RADIUS_M * F.asin(F.sqrt(half("lat1", "lat2") + F.cos("lat1") * F.cos("lat2") * half("lon1", "lon2")))
    return both.where(metres <= F.col("reach")).select("iid", "pid", "dest_type")


def block_lists(regions: DataFrame, places: DataFrame) -> DataFrame:
    """(id, blockid20 ARRAY<STRING>): the blocks that hold each place, none for places outside all."""
    held = containing_regions(regions, places.withColumnRenamed("id", "pid"))
    lists = held.groupBy("pid").agg(F.array_sort(F.collect_set("iid")).alias("blockid20"))
    return places.select("id").join(lists, F.col("id") == F.col("pid"), "left").select("id", F.coalesce("blockid20", F.array().cast("array<string>")).alias("blockid20"))


def outside_regions(regions: DataFrame, places: DataFrame) -> DataFrame:
    """Places that no region holds."""
    held = containing_regions(regions, places.withColumnRenamed("id", "pid")).select(F.col("pid").alias("id"))
    return places.join(held, "id", "left_anti")
