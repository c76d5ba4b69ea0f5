"""Street networks: splitting ways, the graph of segments, components, dead ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokeline.functions.scoring import link_cost, link_stress
from spokeline.geo import EARTH_RADIUS_M
from spokeline.session import Scratch


def node_usage(ways: DataFrame, way: str = "osm_id", nodes: str = "node_ids") -> DataFrame:
    """(node_id, n_uses, n_ways): how often ways pass a node, and how many ways do."""
    return ways.select(way, F.explode(nodes).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n_uses"), F.count_distinct(way).alias("n_ways"))


def split_ways(ways: DataFrame, way: str = "osm_id", nodes: str = "node_ids") -> DataFrame:
    """(way, part, node_ids): every way cut at the nodes that are used more than once.

    A cut node ends one part and begins the next; parts of fewer than two nodes vanish.
    """
    placed = ways.select(way, F.posexplode(nodes).alias("pos", "node_id"))
    shared = node_usage(ways, way, nodes).where("n_uses > 1").select("node_id", F.lit(1).alias("cut"))
    placed = placed.join(shared, "node_id", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    order = Window.partitionBy(way).orderBy("pos")
    before = F.coalesce(F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = placed.withColumns({"b": before, "u": upto}).withColumn("part", F.explode(F.array_distinct(F.array("b", "u"))))
    grouped = parts.groupBy(way, "part").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("p"))
    return grouped.where(F.size("p") >= 2).select(way, "part", F.col("p.node_id").alias("node_ids"))


def orphan_ways(ways: DataFrame, way: str = "osm_id", nodes: str = "node_ids") -> DataFrame:
    """Ways none of whose nodes another way uses."""
    shared = node_usage(ways, way, nodes).where("n_ways > 1").select("node_id")
    linked = ways.select(way, F.explode(nodes).alias("node_id")).join(shared, "node_id", "left_semi").select(way)
    return ways.join(linked, way, "left_anti").select(way)


def leg_counts(segments: DataFrame) -> DataFrame:
    """(node_id, legs): segment ends at every node."""
    return segments.select(F.explode(F.array("start_node_id", "end_node_id")).alias("node_id")).where("node_id is not null").groupBy("node_id").agg(F.count("*").alias("legs"))


def segment_links(segments: DataFrame, stress_model: str | None = None, levels: int = 3) -> DataFrame:
    """(source_vert, target_vert, link_cost[, link_stress]): turns from one segment to another at a shared node.

    segments: road_id, start_node_id, end_node_id, one_way (ft, tf or null), length_m and, for a stress model,
    ft/tf_seg_stress and ft/tf_int_stress. A segment is left at its end when driven forward and at its start
    when driven backward, which one_way may forbid; and entered likewise. Parallel links are kept.
    """
    forward, backward = F.coalesce(F.col("one_way") != "tf", F.lit(True)), F.coalesce(F.col("one_way") != "ft", F.lit(True))
    stress = stress_model is not None
    fields = lambda a, b, d: F.struct(a.alias("out"), b.alias("into"), F.col("start_node_id" if d == "s" else "end_node_id").alias("node_id"), *([F.col("tf_seg_stress" if d == "s" else "ft_seg_stress").alias("leave"), F.col("ft_seg_stress" if d == "s" else "tf_seg_stress").alias("enter"), F.col("tf_int_stress" if d == "s" else "ft_int_stress").alias("turn")] if stress else []))
    ends = segments.select("road_id", "length_m", F.explode(F.array(fields(backward, forward, "s"), fields(forward, backward, "e"))).alias("e")).select("road_id", "length_m", "e.*").where("node_id is not null")
    leave = ends.where("out").select("node_id", F.col("road_id").alias("source_vert"), F.col("length_m").alias("sl"), *(["leave", "turn"] if stress else []))
    enter = ends.where("into").select("node_id", F.col("road_id").alias("target_vert"), F.col("length_m").alias("tl"), *(["enter"] if stress else []))
    links = leave.join(enter, "node_id").where("source_vert <> target_vert")
    out = [F.col("source_vert"), F.col("target_vert"), link_cost(F.col("sl"), F.col("tl")).alias("link_cost")]
    if stress:
        out.append(link_stress(F.col("leave"), F.col("enter"), F.col("turn"), stress_model, levels).alias("link_stress"))
    return links.select(*out)


def cheapest_links(links: DataFrame) -> DataFrame:
    """One link for each pair of segments, the cheapest."""
    return links.groupBy("source_vert", "target_vert").agg(F.min("link_cost").alias("link_cost"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, component) of the vertices of ``edges`` (a, b), the component named by its smallest vertex.

    Alternating large and small stars: every vertex ties its larger neighbours, then its smaller ones, to the
    least vertex it knows, until all edges are stars round the components' smallest vertices. Long chains
    take a logarithmic number of rounds. Edges with a null end are left out.
    """
    scratch = Scratch(edges.sparkSession)
    edges = edges.where("a is not null and b is not null")
    vertices = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first())
        if state == before:
            return vertices.join(now, vertices["v"] == now["a"], "left").select("v", F.coalesce("b", "v").alias("component"))
        before = state
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(lowest, large["a"] == lowest["u"])
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        old, now = now, scratch.keep(small)
        scratch.drop(old)
    raise RuntimeError(f"components still changed after {most_rounds} rounds")


def peel_dead_ends(segments: DataFrame, removable: Column, fixed_node: Column | None = None) -> DataFrame:
    """``segments`` without removable ones that end at a node of no other segment, again and again until none is left.

    ``fixed_node`` is a condition on ``node_id``: such nodes (those on the boundary) are no dead ends. The
    result doesn't depend on the order. A null end is a dead end.

    What is left of the removable segments leads on at both ends. A segment of a chain (through nodes of two segments, both removable)
    stands or falls with its whole chain, once the chain has one dead end: so chains are contracted to one segment
    each, by components over their inner nodes, and a round peels whole chains. Rounds follow the branching of the
    dead-end trees, not the length of their branches, and go on with the removable segments alone, the legs
    of the others being counted once.
    """
    scratch = Scratch(segments.sparkSession)
    out = F.coalesce(removable, F.lit(False))
    marked = scratch.keep(segments.select("road_id", "start_node_id", "end_node_id", out.alias("out")))
    held = marked.where("not out").select(F.explode(F.array("start_node_id", "end_node_id")).alias("node_id")).where("node_id is not null").groupBy("node_id").agg(F.count("*").alias("held"))
    loose = marked.where("out").select(F.col("road_id").alias("chain"), F.col("start_node_id").alias("s"), F.col("end_node_id").alias("e"))
    ends = loose.select(F.explode(F.array("s", "e")).alias("node_id")).where("node_id is not null").distinct()
    fixed = F.coalesce(fixed_node, F.lit(False)) if fixed_node is not None else F.lit(False)
    # legs that never go: of segments that stay, and an endless one at nodes that are no dead ends
    held = scratch.keep(ends.join(held, "node_id", "left").select("node_id", (F.coalesce("held", F.lit(0)) + F.when(fixed, 2).otherwise(0)).alias("held")).where("held > 0"))
    member = scratch.keep(marked.where("out").select("road_id", F.col("road_id").alias("chain")))
    now = scratch.keep(loose)
    safe: DataFrame | None = None
    while True:
        legs = now.select("chain", F.explode(F.array("s", "e")).alias("node_id")).where("node_id is not null")
        degree = legs.groupBy("node_id").agg(F.count("*").alias("n"), F.min("chain").alias("a"), F.max("chain").alias("b")).join(held, "node_id", "left").withColumn("held", F.coalesce("held", F.lit(0)))
        degree = scratch.keep(degree.where("n + held <= 2"))
        # contract: an inner node of two chains and nothing else joins them
        inner = degree.where("n = 2 and held = 0 and a <> b")
        if inner.take(1):
            joined = connected_components(inner.select("a", "b"))
            names = scratch.keep(joined.select(F.col("v").alias("chain"), F.col("component").alias("whole")))
            renamed = now.join(names, "chain", "left").withColumn("chain", F.coalesce("whole", "chain"))
            gone = inner.select("node_id")
            tips = renamed.select("chain", F.posexplode(F.array("s", "e")).alias("side", "node_id")).join(gone, "node_id", "left_anti")
            # of a whole chain two ends are left, of a ring none (it stays); its null ends are dead
            tips = tips.groupBy("chain").agg(F.sort_array(F.collect_list("node_id")).alias("t"), F.count("*").alias("n"))
            whole = renamed.select("chain").distinct().join(tips, "chain", "left")
            again = whole.select("chain", F.get("t", 0).alias("s"), F.when(F.col("n") > 1, F.get("t", 1)).alias("e"), F.coalesce("n", F.lit(0)).alias("n"))
            ring = again.where("n = 0").select("chain")
            stays = member.join(names, "chain", "left").select("road_id", F.coalesce("whole", "chain").alias("chain"))
            before, member = member, scratch.keep(stays)
            scratch.drop(before)
            rings = scratch.keep(ring)
            again = again.where("n > 0").select("chain", "s", "e")
            before, now = now, scratch.keep(again)
            scratch.drop(before)
            kept_rings = scratch.keep(member.join(rings, "chain", "left_semi").select("road_id"))
            safe = kept_rings if safe is None else safe.unionAll(kept_rings)
            legs = now.select("chain", F.explode(F.array("s", "e")).alias("node_id")).where("node_id is not null")
            degree = legs.groupBy("node_id").agg(F.count("*").alias("n")).join(held, "node_id", "left").withColumn("held", F.coalesce("held", F.lit(0)))
        lone = degree.where("n = 1 and held = 0").select("node_id", F.lit(True).alias("lone"))
        tips = now.select("chain", F.explode(F.array("s", "e")).alias("node_id"))
        dead = scratch.keep(tips.join(lone, "node_id", "left").where("lone or node_id is null").select("chain").distinct())
        if not dead.take(1):
            break
        before, now = now, scratch.keep(now.join(dead, "chain", "left_anti"))
        scratch.drop(before)
    left = member.join(now.select("chain"), "chain", "left_semi").select("road_id")
    left = left.unionAll(safe) if safe is not None else left
    stay = marked.where("not out").select("road_id").unionAll(left)
    return segments.join(stay, "road_id", "left_semi")


def trail_roads(segments: DataFrame, wanted: Column) -> DataFrame:
    """The wanted segments with path_id, the smallest road of the connected run they belong to."""
    chosen = segments.where(F.coalesce(wanted, F.lit(False)))
    links = chosen.select("road_id", F.explode(F.array("start_node_id", "end_node_id")).alias("n")).where("n is not null")
    first = links.groupBy("n").agg(F.min("road_id").alias("b"))
    edges = links.join(first, "n").select(F.col("road_id").alias("a"), "b")
    named = connected_components(edges)
    return chosen.join(named, chosen["road_id"] == named["v"], "left").withColumn("path_id", F.coalesce("component", "road_id")).drop("v", "component")


def trails(segments: DataFrame, wanted: Column) -> DataFrame:
    """(path_id, n_segments, path_length, bbox_length): connected runs of the wanted segments.

    segments: road_id, start_node_id, end_node_id, length_m and the ends' x and y (x0, y0, x1, y1, in
    metres). path_id is the smallest road of the run.
    """
    return trail_sizes(trail_roads(segments, wanted))


def trail_sizes(roads: DataFrame) -> DataFrame:
    """``trails`` from the segments that ``trail_roads`` named."""
    width = F.max(F.greatest("x0", "x1")) - F.min(F.least("x0", "x1"))
    height = F.max(F.greatest("y0", "y1")) - F.min(F.least("y0", "y1"))
    return roads.groupBy("path_id").agg(F.count("*").alias("n_segments"), F.sum("length_m").alias("path_length"), F.sqrt(width * width + height * height).alias("bbox_length"))


def with_ends(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """``segments`` with the ends' places in metres, x0, y0, x1, y1 (null where a node has none)."""
    places = nodes.where("abs(lat) <= 90 and abs(lon) <= 180").select("node_id", (F.radians("lon") * F.cos(F.radians("lat")) * EARTH_RADIUS_M).alias("x"), (F.radians("lat") * EARTH_RADIUS_M).alias("y"))
    for node, k in (("start_node_id", 0), ("end_node_id", 1)):
        segments = segments.join(places.withColumnsRenamed({"node_id": node, "x": f"x{k}", "y": f"y{k}"}), node, "left")
    return segments
