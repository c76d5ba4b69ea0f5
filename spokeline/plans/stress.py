"""The stress rules: segments by class and facility, crossings, intersections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeline.functions.scoring import crossing_is_stressful
from spokeline.operators.near import near_points
from spokeline.operators.network import leg_counts
from spokeline.rules import Program, apply, read_program

NODE_FLAGS = ("signalized", "stop", "rrfb", "island")
HEAVY = ["motorway", "motorway_link", "trunk", "trunk_link"]
MAIN = ["primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link"]
MINOR = ["residential", "unclassified"]
#: Fixed values: (id, classes, other conditions, stress) of the segments whose class alone decides.
BY_CLASS = (
    ("heavy", HEAVY, {}, 3),
    ("apart", ["path", "track"], {}, 1),
    ("living_shut", ["living_street"], {"bicycle": "no"}, 3),
    ("living", ["living_street"], {}, 1),
)
#: Fixed values: (id, classes, facility, highest speed, lanes, least width of the facility): stress 1 within them, else 3.
BY_FACILITY = (
    ("main_track", MAIN, "track", None, None, None),
    ("main_buffered", MAIN, "buffered_lane", 25, {"le": 1}, None),
    ("main_lane", MAIN, "lane", 20, {"le": 1}, 4),
    ("main_shared", MAIN, None, 15, {"eq": 1}, None),
    ("minor", MINOR, None, 25, None, None),
)
#: What meets a stressful crossing at stress 3, by (id, classes, the crossings that count).
AT_CROSSINGS = (
    ("lesser", ["residential", "unclassified", "living_street", "track", "path"], "high_cross"),
    ("tertiary", ["tertiary"], "high_cross_no_tert"),
)
LINKS = ["motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link"]


def segment_stress_program() -> Program:
    """ft/tf_seg_stress, 1 or 3, from class, facility, speed, lanes and width."""
    stress = lambda level: {"<dir>_seg_stress": level}
    rules = [{"id": name, "when": {"functional_class": classes, **others}, "set": stress(level)} for name, classes, others, level in BY_CLASS]
    for name, classes, facility, speed, lanes, width in BY_FACILITY:
        here = {"functional_class": classes, **({"<dir>_bike_infra": facility} if facility else {})}
        bounds = {"speed_limit": {"le": speed}} if speed else {}
        bounds |= {"<dir>_lanes": lanes} if lanes else {}
        bounds |= {"<dir>_bike_infra_width": {"ge": width}} if width else {}
        rules.append({"id": f"{name}_low", "when": {**here, **bounds}, "set": stress(1)})
        if bounds:
            rules.append({"id": f"{name}_high", "when": here, "set": stress(3)})
    return read_program({"name": "segment_stress", "for": {"dir": ["ft", "tf"]}, "rules": rules})


def intersection_stress_program() -> Program:
    """ft/tf_int_stress: 3 where a lesser road meets a stressful crossing without signal or stop."""
    bare = {"node_signalized_<dir>": False, "node_stop_<dir>": False}
    rules = [{"id": name, "when": {"functional_class": classes, **bare, f"{crossing}_<dir>": True}, "set": {"<dir>_int_stress": 3}} for name, classes, crossing in AT_CROSSINGS]
    links = [{"id": "links", "when": {"functional_class": LINKS}, "set": {"ft_int_stress": 1, "tf_int_stress": 1}}]
    return read_program({
        "name": "intersection_stress",
        "passes": [{"name": "crossings", "for": {"dir": ["ft", "tf"]}, "default": {"<dir>_int_stress": 1}, "rules": rules}, {"name": "links", "after": "crossings", "rules": links}],
    })


def one_way_reset(df: DataFrame) -> DataFrame:
    """No stress against the direction of a one-way street."""
    return df.withColumns({
        "ft_seg_stress": F.when(~F.coalesce(F.col("one_way") == "tf", F.lit(False)), F.col("ft_seg_stress")),
        "tf_seg_stress": F.when(~F.coalesce(F.col("one_way") == "ft", F.lit(False)), F.col("tf_seg_stress")),
    })


def segment_stress(segments: DataFrame) -> DataFrame:
    return one_way_reset(apply(segments, segment_stress_program()))


def spread_flags(nodes: DataFrame, segments: DataFrame, radius_m: float = 25.0) -> DataFrame:
    """``nodes`` with the flags of other nodes within ``radius_m`` added at nodes of more than two legs."""
    crossing = nodes.join(leg_counts(segments).where("legs > 2").select("node_id"), "node_id", "left_semi")
    flagged = nodes.where(" or ".join(NODE_FLAGS))
    pairs = near_points(crossing.select(F.col("node_id").alias("iid"), "lon", "lat"), flagged.select(F.col("node_id").alias("pid"), "lon", "lat"), radius_m)
    near = pairs.join(flagged.select("node_id", *NODE_FLAGS), pairs["pid"] == F.col("node_id")).groupBy("iid").agg(*[F.max(F.coalesce(f, F.lit(False))).alias(f"near_{f}") for f in NODE_FLAGS])
    out = nodes.join(near, nodes["node_id"] == near["iid"], "left").drop("iid")
    return out.withColumns({f: F.coalesce(f, F.lit(False)) | F.coalesce(f"near_{f}", F.lit(False)) for f in NODE_FLAGS}).drop(*[f"near_{f}" for f in NODE_FLAGS])


def crossings(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, name, n_high, n_high_no_tert, named_high, named_high_no_tert): stressful roads at every node, in all and without
    tertiary ones, and of these how many bear the row's name (null for none: one row a node for each name, and one without).

    One aggregate per node in place of a join of segments with segments: a segment's crossings are those of
    its node without its own and without those that only go on under its name.
    """
    name = F.col("name") if "name" in segments.columns else F.lit(None).cast("string")
    ends = segments.select("road_id", name.alias("name"), "functional_class", "speed_limit", "ft_lanes", "tf_lanes", "one_way", F.explode(F.array_distinct(F.array("start_node_id", "end_node_id"))).alias("node_id")).where("node_id is not null")
    flags = nodes.select("node_id", "rrfb", "island")
    ends = ends.join(flags, "node_id", "left")
    high = crossing_is_stressful(*[F.col(c) for c in ("functional_class", "speed_limit", "ft_lanes", "tf_lanes", "one_way", "rrfb", "island")])
    ends = ends.withColumns({"high": high, "high_nt": high & ~F.coalesce(F.col("functional_class") == "tertiary", F.lit(False))}).where("high")
    return ends.groupBy("node_id", "name").agg(F.count("*").alias("n_high"), F.count_if("high_nt").alias("n_high_no_tert"))


def intersection_stress(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """``segments`` with ft_int_stress (at the end node) and tf_int_stress (at the start node)."""
    found = crossings(segments, nodes)
    of_nodes = found.groupBy("node_id").agg(F.sum("n_high").alias("n_high"), F.sum("n_high_no_tert").alias("n_high_no_tert"))
    named = "name" in segments.columns
    for d, node in (("ft", "end_node_id"), ("tf", "start_node_id")):
        at = nodes.select(F.col("node_id").alias(node), F.col("signalized").alias(f"node_signalized_{d}"), F.col("stop").alias(f"node_stop_{d}"), F.col("rrfb").alias(f"__rrfb_{d}"), F.col("island").alias(f"__island_{d}"))
        count = of_nodes.select(F.col("node_id").alias(node), F.col("n_high").alias("__n"), F.col("n_high_no_tert").alias("__nt"))
        segments = segments.join(at, node, "left").join(count, node, "left")
        mine = crossing_is_stressful(*[F.col(c) for c in ("functional_class", "speed_limit", "ft_lanes", "tf_lanes", "one_way", f"__rrfb_{d}", f"__island_{d}")])
        own, own_nt = mine.cast("int"), (mine & ~F.coalesce(F.col("functional_class") == "tertiary", F.lit(False))).cast("int")
        if named:
            # the roads of the segment's own name, itself among them where it has one
            same = found.where("name is not null").select(F.col("node_id").alias("__node"), F.col("name").alias("__name"), F.col("n_high").alias("__s"), F.col("n_high_no_tert").alias("__st"))
            segments = segments.join(same, (F.col(node) == F.col("__node")) & (F.col("name") == F.col("__name")), "left").drop("__node", "__name")
            own = F.when(F.col("name").isNotNull(), F.coalesce("__s", F.lit(0))).otherwise(own)
            own_nt = F.when(F.col("name").isNotNull(), F.coalesce("__st", F.lit(0))).otherwise(own_nt)
        segments = segments.withColumns({
            f"node_signalized_{d}": F.coalesce(f"node_signalized_{d}", F.lit(False)),
            f"node_stop_{d}": F.coalesce(f"node_stop_{d}", F.lit(False)),
            f"high_cross_{d}": F.coalesce("__n", F.lit(0)) > own,
            f"high_cross_no_tert_{d}": F.coalesce("__nt", F.lit(0)) > own_nt,
        }).drop(f"__rrfb_{d}", f"__island_{d}", "__n", "__nt", "__s", "__st")
    made = [f"{c}_{d}" for d in ("ft", "tf") for c in ("node_signalized", "node_stop", "high_cross", "high_cross_no_tert")]
    return apply(segments, intersection_stress_program()).drop(*made)
