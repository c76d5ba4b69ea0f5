import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spokeline.config import Config
from spokeline.operators import network as N
from spokeline.operators import reach as R
from spokeline.operators.attributes import Attribute, AttributeRegistry
from spokeline.operators.destinations import block_lists, by_mode, cluster_places
from spokeline.operators.near import regions_of, with_place
from spokeline.pipeline import STAGES, Stage, in_order, read_inputs, score_city
from spokeline.plans.stress import spread_flags
from spokeline.rules import read_program
from spokeline.sinks import export
from spokeline.sources.files import find_inputs, read_geojson, store_file

SMALL = "/root/testdata/sf0.001"


def test_ways(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 4]), (3, [9, 8]), (4, [7, 7, 6])], "osm_id int, node_ids array<int>")
    got = sorted((r["osm_id"], r["node_ids"]) for r in N.split_ways(ways).collect())
    assert got == [(1, [1, 2]), (1, [2, 3]), (2, [2, 4]), (3, [9, 8]), (4, [7, 6]), (4, [7, 7])]
    assert sorted(r["osm_id"] for r in N.orphan_ways(ways).collect()) == [3, 4]


def test_components_and_peeling(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)] + [(None, 3)]
    parent = {v: v for e in edges if None not in e for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[find(a)] = find(b)
    groups = {}
    for v in parent:
        groups.setdefault(find(v), []).append(v)
    want = {v: min(g) for g in groups.values() for v in g}
    assert {r["v"]: r["component"] for r in N.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    roads = [(1, 1, 2, True), (2, 2, 3, True), (3, 3, 4, False), (4, 4, 5, True), (5, 5, 3, True), (6, 9, None, True), (7, 5, 6, False), (8, 6, 7, True)]
    peeled = N.peel_dead_ends(spark.createDataFrame(roads, "road_id int, start_node_id int, end_node_id int, minor boolean"), F.col("minor"))
    assert sorted(r["road_id"] for r in peeled.collect()) == [3, 4, 5, 7]
    kept = N.peel_dead_ends(spark.createDataFrame(roads, "road_id int, start_node_id int, end_node_id int, minor boolean"), F.col("minor"), F.col("node_id") == 1)
    assert sorted(r["road_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 7]


def peeled(roads, fixed=()):
    """The roads left once no removable one has a null end or an end that no other end shares."""
    roads = list(roads)
    while True:
        ends = [n for r in roads for n in r[1:3] if n is not None]
        lone = lambda n: n is None or (ends.count(n) == 1 and n not in fixed)
        dead = [r for r in roads if r[3] and any(map(lone, r[1:3]))]
        if not dead:
            return sorted(r[0] for r in roads)
        roads = [r for r in roads if r not in dead]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_peeling_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    some = lambda: rng.choice([None, *range(22)]) if rng.random() < 0.1 else rng.randrange(22)
    roads = [(k, some(), some(), rng.random() < 0.75) for k in range(24)]
    # a long chain, a ring, a ring on a stick, a loop
    roads += [(100 + k, 100 + k, 101 + k, True) for k in range(40)] + [(200 + k, 200 + k, 200 + (k + 1) % 5, True) for k in range(5)]
    roads += [(300 + k, 300 + k, 300 + (k + 1) % 4, True) for k in range(4)] + [(310, 300, 310, True), (311, 310, 311, True), (320, 320, 320, True), (321, 320, 322, True)]
    df = spark.createDataFrame(roads, "road_id int, start_node_id int, end_node_id int, minor boolean")
    fixed = (100, 5)
    assert sorted(r["road_id"] for r in N.peel_dead_ends(df, F.col("minor")).collect()) == peeled(roads)
    assert sorted(r["road_id"] for r in N.peel_dead_ends(df, F.col("minor"), F.col("node_id").isin(*fixed)).collect()) == peeled(roads, fixed)


def dijkstra(sources, edges, limit):
    best, heap = {}, [(0, v) for v in sources]
    while heap:
        d, v = heapq.heappop(heap)
        if v in best:
            continue
        best[v] = d
        for a, b, c in edges:
            if a == v and d + c <= limit and b not in best:
                heapq.heappush(heap, (d + c, b))
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_equals_dijkstra(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30), rng.randrange(0, 9)) for _ in range(90)]
    starts = [("s", 0), ("s", 5), ("t", 7), ("t", 7), (None, 3)]
    got = {(r["source"], r["vert"]): r["cost"] for r in R.bounded_reach(spark.createDataFrame(starts, "source string, vert int"), spark.createDataFrame(edges + [(None, 1, 1), (1, 2, None)], "a int, b int, cost int"), 12).collect()}
    assert got == {(s, v): d for s, vs in (("s", [0, 5]), ("t", [7])) for v, d in dijkstra(vs, edges, 12).items()}
    back = {(r["source"], r["vert"]): r["cost"] for r in R.reach_back(spark.createDataFrame([("t", 7)], "source string, vert int"), spark.createDataFrame(edges, "a int, b int, cost int"), 12).collect()}
    assert back == {("t", v): d for v, d in dijkstra([7], [(b, a, c) for a, b, c in edges], 12).items()}


def test_block_pairs(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "source_block string, target_block string, cost double")
    high, low = pairs([("a", "b", 100.0), ("a", "c", 100.0), ("a", "d", 100.0), ("a", "e", 0.0)]), pairs([("a", "b", 125.0), ("a", "c", 126.0), ("a", "e", 9.0)])
    shared = spark.createDataFrame([("a", "d")], "source_block string, target_block string")
    got = {(r["source_block"], r["target_block"]): r["low_stress"] for r in R.block_pairs(high, low, shared, spark.createDataFrame([("a",)], "block string")).collect()}
    assert got == {("a", "b"): True, ("a", "c"): False, ("a", "d"): True, ("a", "e"): True, ("a", "a"): True}


def test_attributes(spark):
    registry = AttributeRegistry()
    registry.register(Attribute("speed", read_program({"rules": [{"when": {"maxspeed": "present"}, "set": {"speed": {"$apply": "parse_int", "to": "maxspeed"}}}]}), read_program({"rules": [{"when": {"speed": "is_null", "functional_class": "path"}, "set": {"speed": 15}}]}), tags=("maxspeed",)))
    registry.register(Attribute("kind", read_program({"rules": [{"when": {"highway": "path", "fast": False}, "set": {"functional_class": "path"}}, {"when": {"fast": True}, "set": {"functional_class": "main"}}]}), tags=("highway",), after=("fast",)))
    registry.register(Attribute("fast", read_program({"rules": [{"when": {"speed": {"gt": 30}}, "set": {"fast": True}}], "default": {"fast": False}}), after=("speed",), scratch=True))
    with pytest.raises(ValueError):
        registry.register(Attribute("other", read_program({"rules": [{"set": {"speed": 1}}]})))
    ways = spark.createDataFrame([(1, {"highway": "path"}), (2, {"highway": "path", "maxspeed": "40"}), (3, {"x": "y"})], "osm_id int, tags map<string,string>")
    got = {r["osm_id"]: (r["functional_class"], r["speed"], r["speed_imputed"]) for r in registry.run(ways).collect()}
    assert got == {1: ("path", 15, True), 2: ("main", 40, False)} and [a.name for a in registry.ordered()] == ["speed", "fast", "kind"]
    assert "fast" not in registry.run(ways).columns


def test_clusters(spark):
    rows = [(1, 7.0, 48.0, "a"), (2, 7.0005, 48.0, "a"), (3, 7.001, 48.0, "a"), (4, 7.0005, 48.0, "b"), (5, 8.0, 48.0, "a")]
    got = dict(map(tuple, cluster_places(spark.createDataFrame(rows, "id long, lon double, lat double, kind string"), 50.0, "kind").collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_place_clusters_in_each_of_its_types(spark, tmp_path):
    spots = [(1, 7.0, ["park", "clinic"]), (2, 7.0005, ["clinic"]), (3, 7.001, ["clinic", "park"]), (4, 7.0005, [None, "school"]), (5, 8.0, ["park", "school"]), (6, 8.0005, ["school", "park", "park"]), (7, 8.0, []), (8, 8.0, None)]
    rows = [(k, f"POINT ({x} 48.0)", t, 1) for k, x, t in spots]
    spark.createDataFrame(rows, "osm_id long, geometry string, matched_types array<string>, extracted_at int").write.parquet(str(tmp_path / "poi_raw.parquet"))
    got = sorted((r["id"], r["type"], r["cluster"]) for r in entry.queries()["poi_clusters"](spark, str(tmp_path)).collect())
    assert got == [(1, "clinic", 1), (1, "park", 1), (2, "clinic", 1), (3, "clinic", 1), (3, "park", 3), (4, "school", 4), (5, "park", 5), (5, "school", 5), (6, "park", 5), (6, "school", 5)]


def test_destinations_of_one_type_are_not_tied_by_another(spark):
    spots = [(1, 7.0, ["park", "clinic"]), (2, 7.0005, ["clinic"]), (3, 7.001, ["clinic", "park"])]
    poi = spark.createDataFrame([(k, f"POINT ({x} 48.0)", t, 1) for k, x, t in spots], "osm_id long, geometry string, matched_types array<string>, extracted_at int")
    blocks = spark.createDataFrame([("b", "POLYGON ((6.9 47.9, 7.1 47.9, 7.1 48.1, 6.9 48.1, 6.9 47.9))")], "iid string, geometry string")
    stage = next(s for s in STAGES if s.name == "destinations")
    rows = stage.build({"poi_raw": poi, "regions": regions_of(blocks, "geometry")}, Config.default())["destinations"].collect()
    assert sorted((r["dest_type"], r["id"], tuple(r["blockid20"])) for r in rows) == [("doctors", 1, ("b",)), ("doctors", 2, ("b",)), ("doctors", 3, ("b",)), ("parks", 1, ("b",)), ("parks", 3, ("b",))]


def test_destinations_by_mode(spark):
    box = lambda x, w: f"POLYGON (({x} 48.0, {x + w} 48.0, {x + w} {48 + w}, {x} {48 + w}, {x} 48.0))"
    point = lambda x, y=48.0001: f"POINT ({x} {y})"
    # places of every type: two areas some 45 m apart, a point in the first, two points some 37 m apart far off, one 30 m beside the first area
    spots = {1: box(7.0, 0.0003), 2: box(7.0006, 0.0003), 3: point(7.0001), 4: point(7.1), 5: point(7.1005), 6: point(6.99975)}
    modes = {"alone": ("single", 0.0), "grounds": ("areas", 60.0), "shops": ("together", 60.0), "stops": ("stops", 45.0)}
    rows = [(k, t) for k in spots for t in modes]
    geo = with_place(spark.createDataFrame(list(spots.items()), "id int, geometry string"), "geometry")
    areas = regions_of(geo.select(F.col("id").alias("iid"), "geometry"), "geometry")
    places = spark.createDataFrame(rows, "id int, dest_type string").join(geo.select("id", "lon", "lat"), "id").withColumn("is_area", F.col("id") < 3)
    got = {}
    for r in by_mode(places, areas, modes).collect():
        got.setdefault(r["dest_type"], {}).setdefault(r["id"], set()).add(r["place"])
    assert got["alone"] == {1: {1}, 2: {2}, 4: {4}, 5: {5}, 6: {6}}
    assert got["grounds"] == {1: {1, 2}, 4: {4}, 5: {5}, 6: {6}}
    assert got["shops"] == {1: {1, 2, 3, 6}, 4: {4, 5}}
    assert got["stops"] == {1: {1}, 2: {2}, 4: {4, 5}}


def groups_of(roads):
    """The smallest road of each road's group, by relabelling until nothing changes."""
    name = {r[0]: r[0] for r in roads}
    while True:
        new = {r[0]: min(name[o[0]] for o in roads if o[0] == r[0] or set(r[1:3]) & set(o[1:3]) - {None}) for r in roads}
        if new == name:
            return name
        name = new


def test_road_components(spark, tmp_path):
    rng = random.Random(6)
    roads = [(k, rng.randrange(70), rng.randrange(70)) for k in range(40)] + [(k, k, k + 1) for k in range(100, 130)] + [(200, None, None), (201, 5, None)]
    spark.createDataFrame([(*r, 1) for r in roads], "road_id int, start_node_id int, end_node_id int, extracted_at int").write.parquet(str(tmp_path / "segments.parquet"))
    got = {r["road_id"]: r["component"] for r in entry.queries()["road_components"](spark, str(tmp_path)).collect()}
    assert got == groups_of(roads)


def test_trails(spark):
    rng = random.Random(7)
    xy = {k: (rng.uniform(0, 900), rng.uniform(0, 900)) for k in range(50)}
    roads = [(k, rng.randrange(50), rng.randrange(50), float(rng.randrange(10, 99)), rng.random() < 0.6) for k in range(45)]
    rows = [(*r, *xy[r[1]], *xy[r[2]]) for r in roads]
    df = spark.createDataFrame(rows, "road_id int, start_node_id int, end_node_id int, length_m double, path boolean, x0 double, y0 double, x1 double, y1 double")
    chosen = [r for r in rows if r[4]]
    name = groups_of(chosen)
    want = {}
    for p in set(name.values()):
        mine = [r for r in chosen if name[r[0]] == p]
        xs, ys = [x for r in mine for x in (r[5], r[7])], [y for r in mine for y in (r[6], r[8])]
        want[p] = (len(mine), sum(r[3] for r in mine), round(((max(xs) - min(xs)) ** 2 + (max(ys) - min(ys)) ** 2) ** 0.5, 6))
    assert {r["path_id"]: (r["n_segments"], r["path_length"], round(r["bbox_length"], 6)) for r in N.trails(df, F.col("path")).collect()} == want


def test_block_lists(spark):
    rng = random.Random(8)
    boxes = {f"b{k}": (rng.uniform(7, 7.08), rng.uniform(48, 48.08)) for k in range(12)}
    text = lambda x, y: f"POLYGON (({x} {y}, {x + 0.03} {y}, {x + 0.03} {y + 0.02}, {x} {y + 0.02}, {x} {y}))"
    regions = regions_of(spark.createDataFrame([(k, text(*p)) for k, p in boxes.items()], "iid string, geometry string"), "geometry")
    spots = [(k, rng.uniform(7, 7.12), rng.uniform(48, 48.1)) for k in range(60)] + [(99, 9.0, 48.0)]
    got = {r["id"]: r["blockid20"] for r in block_lists(regions, spark.createDataFrame(spots, "id int, lon double, lat double")).collect()}
    assert got == {k: sorted(b for b, (x, y) in boxes.items() if x < lon < x + 0.03 and y < lat < y + 0.02) for k, lon, lat in spots}


def test_spread_flags(spark):
    rng = random.Random(9)
    nodes = [(k, 7 + rng.uniform(0, 0.002), 48 + rng.uniform(0, 0.0015), *[rng.random() < 0.1 or None for _ in range(4)]) for k in range(60)]
    roads = [(k, rng.randrange(60), rng.randrange(60)) for k in range(80)]
    flags = ("signalized", "stop", "rrfb", "island")
    df = spark.createDataFrame(nodes, "node_id int, lon double, lat double, " + ", ".join(f"{f} boolean" for f in flags))
    got = {r["node_id"]: [r[f] for f in flags] for r in spread_flags(df, spark.createDataFrame(roads, "road_id int, start_node_id int, end_node_id int"), 25.0).collect()}
    legs = [n for r in roads for n in r[1:]]

    def metres(a, b):
        h = math.sin(math.radians(a[2] - b[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    want = {a[0]: [any(b[3 + i] for b in nodes if b is a or (legs.count(a[0]) > 2 and metres(a, b) <= 25)) for i in range(4)] for a in nodes}
    assert got == want and any(any(want[a[0]]) and not any(a[3:]) for a in nodes)


def test_pipeline_order_and_pins(spark):
    assert [s.name for s in in_order(STAGES)].index("scores") > [s.name for s in in_order(STAGES)].index("connectivity")
    with pytest.raises(ValueError):
        in_order([Stage("a", None, ("b",)), Stage("b", None, ("a",))])
    with pytest.raises(ValueError):
        score_city({}, to_stage="nothing")
    config = Config.build(overrides={"reach.limit_m": "400"})
    result = score_city(read_inputs(spark, SMALL), config)
    assert result.ran[-1] == "neighborhood" and result.tables["scores"].count() > 0
    assert result.tables["score_inputs"].count() == 132 and [r["score_id"] for r in result.tables["city_scores"].orderBy("place").collect()][::22] == ["people", "total_miles_high_stress"]
    pairs = result.tables["connectivity"]
    assert pairs.where("low_stress_cost < high_stress_cost").count() == 0 and pairs.where("high_stress_cost > 400").count() == 0
    again = score_city(read_inputs(spark, SMALL), config, pinned={"connectivity": {"connectivity": pairs}, "graph": {k: result.tables[k] for k in ("links", "block_verts")}, "census": {k: result.tables[k] for k in ("blocks", "regions")}}, to_stage="scores")
    assert sorted(again.skipped) == ["census", "connectivity", "graph"] and "stress" not in again.ran
    assert sorted(map(str, again.tables["scores"].select("block", "pop_high_stress", "overall_score").collect())) == sorted(map(str, result.tables["scores"].select("block", "pop_high_stress", "overall_score").collect()))


def test_road_reach_equals_dijkstra(spark, tmp_path):
    rng = random.Random(4)
    xy = {k: (7 + 0.006 * (k % 6), 48 + 0.004 * (k // 6)) for k in range(36)}
    near = [(a, b) for a in xy for b in (a + 1, a + 6) if b in xy and (b != a + 1 or b % 6)]
    roads = [(k, a, b, rng.choice(["residential", "path", "primary", "motorway"]), rng.choice([None, None, "ft", "tf"]), float(rng.randrange(300, 900)), rng.choice([20, 30])) for k, (a, b) in enumerate(near)]
    segments = spark.createDataFrame([(*r, 1, 1, 1) for r in roads], "road_id int, start_node_id int, end_node_id int, functional_class string, one_way string, length_m double, speed_limit int, ft_lanes int, tf_lanes int, extracted_at int")
    nodes = spark.createDataFrame([(k, *p, False, False, False, False, 1) for k, p in xy.items()], "node_id int, lon double, lat double, signalized boolean, stop boolean, rrfb boolean, island boolean, extracted_at int")
    boxes = {f"b{i}{j}": (6.997 + 0.012 * i, 47.998 + 0.008 * j) for i in range(3) for j in range(3)}
    rings = [(k, f"POLYGON (({x} {y}, {x + 0.012} {y}, {x + 0.012} {y + 0.008}, {x} {y + 0.008}, {x} {y}))", 1, 1, 1) for k, (x, y) in boxes.items()]
    made = {"segments": segments, "nodes": nodes, "census_blocks": spark.createDataFrame(rings, "geoid20 string, geometry string, pop20 int, aland20 int, extracted_at int")}
    made |= {n: spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("poi_raw", "extracts", "city_fips_speed", "state_fips_speed")}
    for name, df in made.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    inside = lambda n, k: 0 < xy[n][0] - boxes[k][0] < 0.012 and 0 < xy[n][1] - boxes[k][1] < 0.008
    verts = {k: {r[0] for r in roads if inside(r[1], k) or inside(r[2], k)} for k in boxes}
    leave = [(n, r) for r in roads for n, shut in ((r[2], "tf"), (r[1], "ft")) if r[4] != shut]
    enter = [(n, r) for r in roads for n, shut in ((r[1], "tf"), (r[2], "ft")) if r[4] != shut]
    edges = [(a[0], b[0], (a[5] + b[5]) // 2) for n, a in leave for m, b in enter if n == m and a[0] != b[0]]
    query = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    want = {(k, v): c for k in boxes for v, c in dijkstra(verts[k], edges, 2680).items()}
    assert {(r["source"], r["vert"]): r["cost"] for r in query("road_reach")} == want and max(want.values()) > 2000
    back = [v for k in boxes for v in dijkstra(verts[k], [(b, a, c) for a, b, c in edges], 2680)]
    assert {r["vert"]: r["n_targets"] for r in query("road_reach_reverse")} == {v: back.count(v) for v in back}
    pairs = {(a, b): min(want[a, v] for v in verts[b] if (a, v) in want) for a in boxes for b in boxes if any((a, v) in want for v in verts[b])}
    assert {(r["source_block"], r["target_block"]): r["high_stress_cost"] for r in query("road_block_pairs")} == pairs


def test_attributes_stage(spark):
    rows = [
        (1, "residential", None, None, 999, None, None, "0100001", None),
        (2, "residential", None, None, None, 99, -1, "200002", None),
        (3, "residential", "tf", None, 3, None, None, "0300003", None),
        (4, "unclassified", None, "13.4", -1, 1, 2, "0100001", "lidar"),
        (5, "unclassified", None, "~20 mph", None, 1, 2, None, "lidar"),
        (6, "residential", None, "30", 20, 1, 1, "0100001", "lidar"),
        (7, "unclassified", None, "40", None, 1, 1, None, None),
        (8, "primary", None, "signals", 0, 0, None, None, None),
        (9, "path", None, None, None, None, None, None, None),
    ]
    segments = spark.createDataFrame([(k, k, k + 1, 10.0, 1, *r) for k, *r in rows], "road_id int, start_node_id int, end_node_id int, length_m double, extracted_at int, functional_class string, one_way string, maxspeed string, speed_limit int, ft_lanes int, tf_lanes int, city_fips string, extract_source string")
    inputs = {
        "segments": segments.withColumn("width_ft", F.when(F.col("road_id") == 4, "3000").when(F.col("road_id") == 5, "12'6")),
        "nodes": spark.createDataFrame([(1, 7.0, 48.0, False, False, False, False, 1)], "node_id int, lon double, lat double, signalized boolean, stop boolean, rrfb boolean, island boolean, extracted_at int"),
        "extracts": spark.createDataFrame([("lidar", None, None, "metres per second; thousandths of a metre")], "extract_source string, bare_speed_unit string, bare_width_unit string, description string"),
        "city_fips_speed": spark.createDataFrame([("100001", 20), ("0300003", 999)], "fips_code_city string, speed int"),
        "state_fips_speed": spark.createDataFrame([("2", 30), ("02", 30)], "fips_code_state string, speed int"),
    }
    tables = score_city(inputs, to_stage="stress").tables
    got = {r["road_id"]: r for r in tables["ways"].collect()}
    assert {k: (r["speed_limit"], r["speed_limit_imputed"]) for k, r in got.items()} == {1: (20, True), 2: (30, True), 3: (25, True), 4: (30, False), 5: (20, False), 6: (20, False), 7: (25, False), 8: (40, True), 9: (15, True)}
    assert {k: (r["ft_lanes"], r["tf_lanes"]) for k, r in got.items()} == {1: (1, 1), 2: (1, 1), 3: (None, 1), 4: (1, 2), 5: (1, 2), 6: (1, 1), 7: (1, 1), 8: (2, 2), 9: (1, 1)}
    assert round(got[4]["road_width_ft"], 2) == 9.84 and got[5]["road_width_ft"] == 12.5
    stress = {r["road_id"]: r["tf_seg_stress"] for r in tables["stress"].collect()}
    assert stress == {1: 1, 2: 3, 3: 1, 4: 3, 5: 1, 6: 1, 7: 1, 8: 3, 9: 1}
    assert Config.build(overrides={"variables.city_default_speed": "35"}).slice_of("stress") != Config.default().slice_of("stress")
    town = score_city(inputs, Config.build(overrides={"variables.city_default_speed": "35"}), to_stage="attributes").tables["ways"]
    assert town.where("road_id = 1").first()["speed_limit"] == 35


def test_catalog():
    catalog = Config.build(overrides={"scores.types.libraries": {"category": "recreation", "steps": [0.5, 0.0, 0.0], "aliases": ["library"]}, "scores.types.schools": {"enabled": False}, "scores.types.trails": {"weight": 0.25}}).catalog()
    assert catalog.names()["library"] == "libraries" and "school" not in catalog.names() and round(catalog.weights("recreation")["libraries"], 6) == 0.1
    assert round(catalog.jobs_weight(), 6) == 0.7 and len(Config.default().catalog().active()) == 14
    for bad in ({"scores.people_weight": 20}, {"scores.types.parks": {"weight": 0.9}}, {"scores.types.zoos": {"category": "fun"}}, {"scores.types.parks": {"nothing": 1}}):
        with pytest.raises(ValueError):
            Config.build(overrides=bad)
    config = Config.build(overrides={"reach.ratio": "1.5", "scores.types.zoos": {"category": "recreation", "weight": 0.0}})
    assert Config.from_json(config.to_json()).values == config.values


def test_config():
    assert Config.build().values == Config.default().values and Config.build({"reach": {"ratio": 2.0}}).get("reach.limit_m") == 2680
    with pytest.raises(ValueError):
        Config.build(overrides={"reach.limit_m": "-1"})
    with pytest.raises(KeyError):
        Config.build(overrides={"reach.nothing": "1"})
    assert Config.build(overrides={"reach.ratio": "2"}).slice_of("connectivity") != Config.default().slice_of("connectivity") and Config.build(overrides={"reach.ratio": "2"}).slice_of("stress") == Config.default().slice_of("stress")


def test_exports_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, True, [1, 2], 7.0, 48.0), (2, None, None, None, None)], "id int, ok boolean, l array<int>, lon double, lat double")
    export.write_table(df, str(tmp_path / "c"), "csv")
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).select("id", "ok", "l").collect()) == [("1", "t", "[1,2]"), ("2", None, None)]
    export.write_table(export.geojson_features(df.select("id", "lon", "lat"), export.point_geometry(F.col("lon"), F.col("lat"))), str(tmp_path / "g"), "geojson")
    back = read_geojson(spark, str(tmp_path / "g"), "id int")
    assert sorted(map(tuple, back.collect())) == [(1, "POINT (7.0 48.0)"), (2, None)]
    (tmp_path / "p.json").write_text('{"features": [{"type": "Feature", "properties": {"Name": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}')
    assert tuple(read_geojson(spark, str(tmp_path / "p.json"), "Name string", whole_file=True).first()) == ("x", "POLYGON ((0 0,1 0,1 1,0 0))")
    with pytest.raises(ValueError):
        export.register_bundle("bad", {"nothing": "x"})
    with pytest.raises(KeyError):
        export.build_target("census_blocks", {})
    stored = store_file(str(tmp_path / "p.json"), str(tmp_path / "pool"), "boundary")
    assert find_inputs(SMALL)["nodes"].endswith("nodes.parquet") and stored.rsplit("boundary-", 1)[1].endswith(".json") and store_file(str(tmp_path / "p.json"), str(tmp_path / "pool"), "boundary") == stored
