"""Stages as functions of tables: a lazy plan, written out only where a stage asks for it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeline.config import Config
from spokeline.operators import city, network, reach
from spokeline.operators.destinations import block_lists, by_mode
from spokeline.operators.near import containing_regions, regions_of, with_place
from spokeline.operators.scores import block_scores, city_tables
from spokeline.plans import attributes, stress
from spokeline.session import keep
from spokeline.sources.tables import latest_rows, table

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """Makes tables from those of the stages it needs; ``written`` ones are cut off from their lineage."""

    name: str
    build: Callable[[Mapping[str, DataFrame], Config], Tables]
    needs: tuple[str, ...] = ()
    written: bool = False
    version: int = 1


@dataclass
class Result:
    tables: Tables = field(default_factory=dict)
    ran: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)

    def write(self, folder: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, names: Sequence[str]) -> Result:
        return cls({n: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in names})


def in_order(stages: Sequence[Stage]) -> list[Stage]:
    by_name = {s.name: s for s in stages}
    for s in stages:
        if missing := [n for n in s.needs if n not in by_name]:
            raise ValueError(f"stage {s.name} needs unknown {missing}")
    try:
        return [by_name[n] for n in TopologicalSorter({s.name: s.needs for s in stages}).static_order()]
    except CycleError as e:
        raise ValueError(f"stages wait for one another: {e.args[1]}") from e


def run_stages(stages: Sequence[Stage], inputs: Mapping[str, DataFrame], config: Config, pinned: Mapping[str, Tables] | None = None, to_stage: str | None = None) -> Result:
    """Run the stages in order of need.

    A pinned stage isn't run: its tables are those given. With ``to_stage`` only that stage and what it needs run.
    """
    wanted = {s.name for s in stages}
    if to_stage is not None:
        by_name = {s.name: s for s in stages}
        if to_stage not in by_name:
            raise ValueError(f"no such stage: {to_stage}")
        wanted, todo = set(), [to_stage]
        while todo:
            name = todo.pop()
            if name not in wanted:
                wanted.add(name)
                todo += [] if pinned and name in pinned else by_name[name].needs
    result = Result(dict(inputs))
    for stage in in_order(stages):
        if stage.name not in wanted:
            continue
        if pinned and stage.name in pinned:
            result.tables |= pinned[stage.name]
            result.skipped.append(stage.name)
            continue
        made = stage.build(result.tables, config)
        result.tables |= {n: keep(df) for n, df in made.items()} if stage.written else made
        result.ran.append(stage.name)
    return result


def run_stage(stage: Stage, tables: Mapping[str, DataFrame], config: Config) -> Tables:
    return stage.build(tables, config)


def read_inputs(spark: SparkSession, folder: str, jobs: DataFrame | None = None) -> Tables:
    """The project's tables of a folder; ``jobs`` (block, jobs: workplaces by block code) where there are any."""
    more = {"jobs": jobs} if jobs is not None else {}
    return more | {n: table(spark, folder, n) for n in ("segments", "nodes", "census_blocks", "poi_raw", "extracts", "city_fips_speed", "state_fips_speed")}


def _streets(t: Mapping[str, DataFrame], config: Config) -> Tables:
    segments = latest_rows(t["segments"], ["road_id"], "extracted_at")
    good = F.when((F.col("length_m") > 0) & (F.col("length_m") < 1e5), F.col("length_m"))
    segments = segments.withColumn("length_m", good).where("length_m is not null and functional_class is not null")
    return {"streets": segments, "street_nodes": latest_rows(t["nodes"], ["node_id"], "extracted_at")}


def _census(t: Mapping[str, DataFrame], config: Config) -> Tables:
    blocks = latest_rows(t["census_blocks"], ["geoid20"], "extracted_at", ["geometry", "pop20", "aland20"])
    blocks = city.classify_blocks(blocks, F.lit(1.0)).where("block_class = 'included'")
    return {"blocks": blocks.withColumnRenamed("geoid20", "block"), "regions": regions_of(blocks, "geometry").withColumnRenamed("geoid20", "iid")}


def _attributes(t: Mapping[str, DataFrame], config: Config) -> Tables:
    return {"ways": attributes.with_attributes(t["streets"], config.get("variables"), t.get("extracts"), t.get("city_fips_speed"), t.get("state_fips_speed"))}


def _stress(t: Mapping[str, DataFrame], config: Config) -> Tables:
    nodes = stress.spread_flags(t["street_nodes"], t["ways"], config.get("stress.flag_radius_m"))
    rated = stress.segment_stress(t["ways"])
    return {"stress": stress.intersection_stress(rated, keep(nodes.select("node_id", *stress.NODE_FLAGS)))}


def _graph(t: Mapping[str, DataFrame], config: Config) -> Tables:
    links = network.segment_links(t["stress"], config.get("stress.link_model"), config.get("stress.levels"))
    ends = t["stress"].select("road_id", F.explode(F.array("start_node_id", "end_node_id")).alias("node_id")).where("node_id is not null")
    held = containing_regions(t["regions"], t["street_nodes"].withColumnRenamed("node_id", "pid"))
    verts = ends.join(held, F.col("node_id") == F.col("pid")).select(F.col("iid").alias("block"), F.col("road_id").alias("vert")).distinct()
    return {"links": links.select(F.col("source_vert").alias("a"), F.col("target_vert").alias("b"), F.col("link_cost").alias("cost"), "link_stress"), "block_verts": verts}


def _connectivity(t: Mapping[str, DataFrame], config: Config) -> Tables:
    sources = t["block_verts"].withColumnRenamed("block", "source")
    low = F.coalesce(F.col("link_stress") <= config.get("stress.low"), F.lit(False))
    costs = [keep(reach.block_costs(reach.bounded_reach(sources, e, config.get("reach.limit_m")), t["block_verts"])) for e in (t["links"], t["links"].where(low))]
    v = t["block_verts"]
    shared = v.select(F.col("block").alias("source_block"), "vert").join(v.select(F.col("block").alias("target_block"), "vert"), "vert").where("source_block <> target_block")
    return {"connectivity": reach.block_pairs(*costs, shared, v.select("block"), config.get("reach.ratio"))}


def _trails(t: Mapping[str, DataFrame], config: Config) -> Tables:
    """Runs of paths that are long enough to ride to, and their roads."""
    roads = keep(network.trail_roads(network.with_ends(t["ways"], t["street_nodes"]), F.col("functional_class") == "path"))
    sizes = network.trail_sizes(roads).where((F.col("path_length") >= config.get("trails.least_length_m")) & (F.col("bbox_length") >= config.get("trails.least_span_m")))
    return {"trails": sizes, "trail_roads": roads.join(sizes.select("path_id"), "path_id", "left_semi").select("path_id", "road_id")}


def _jobs(t: Mapping[str, DataFrame], config: Config) -> Tables:
    return {"block_jobs": city.jobs_per_block(t["jobs"], "block", "jobs").select(F.col("blockid20").alias("block"), F.col("jobs").alias("amount"))} if "jobs" in t else {}


def _destinations(t: Mapping[str, DataFrame], config: Config) -> Tables:
    catalog = config.catalog()
    names = catalog.names()
    poi = latest_rows(t["poi_raw"], ["osm_id"], "extracted_at", ["geometry", "matched_types"])
    poi = keep(with_place(poi, "geometry").where("lat is not null"))
    areas = regions_of(poi.select(F.col("osm_id").alias("iid"), "geometry"), "geometry")
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    places = poi.select(F.col("osm_id").alias("id"), "lon", "lat", F.explode("matched_types").alias("t")).withColumn("dest_type", F.try_element_at(known, F.col("t"))).where("dest_type is not null").drop("t").distinct()
    areas = keep(areas)
    places = places.join(areas.select(F.col("iid").alias("id"), F.lit(True).alias("a")), "id", "left").withColumn("is_area", F.col("a").isNotNull()).drop("a")
    rows = by_mode(places, areas, {d.name: (d.mode, d.reach_m) for d in catalog.active("place")})
    lists = block_lists(t["regions"], places.select("id", "lon", "lat").distinct()).withColumnRenamed("id", "place")
    rows = rows.join(lists, "place")
    return {"destinations": rows.groupBy("dest_type", "id").agg(F.array_distinct(F.flatten(F.collect_set("blockid20"))).alias("blockid20"))}


def _scores(t: Mapping[str, DataFrame], config: Config) -> Tables:
    blocks, verts = t["blocks"].select("block", "pop20"), t["block_verts"]
    ends = t["trail_roads"].select(F.col("path_id").alias("source"), F.col("road_id").alias("vert"))
    low = F.coalesce(F.col("link_stress") <= config.get("stress.low"), F.lit(False))
    reached = None
    for links, is_low in ((t["links"], False), (t["links"].where(low), True)):
        back = reach.reach_back(ends, links, config.get("reach.limit_m")).join(verts, "vert").select("block", F.col("source").alias("id"), F.lit(is_low).alias("low_stress")).distinct()
        reached = back if reached is None else reached.unionAll(back)
    return {"scores": block_scores(t["connectivity"], blocks, t["destinations"], config.catalog(), t.get("block_jobs"), reached)}


def _neighborhood(t: Mapping[str, DataFrame], config: Config) -> Tables:
    made = city_tables(t["scores"], t["blocks"], t["connectivity"], t["stress"], config.catalog())
    return {**made, "mileage": city.facility_miles(t["stress"])}


STAGES = (
    Stage("streets", _streets, written=True),
    Stage("census", _census, written=True),
    Stage("attributes", _attributes, ("streets",), written=True),
    Stage("stress", _stress, ("streets", "attributes"), written=True, version=2),
    Stage("graph", _graph, ("stress", "census"), written=True),
    Stage("connectivity", _connectivity, ("graph",), written=True),
    Stage("trails", _trails, ("attributes", "streets"), written=True),
    Stage("jobs", _jobs),
    Stage("destinations", _destinations, ("census",), written=True, version=2),
    Stage("scores", _scores, ("connectivity", "destinations", "graph", "jobs", "trails"), written=True, version=2),
    Stage("neighborhood", _neighborhood, ("scores", "stress"), version=2),
)


def score_city(inputs: Mapping[str, DataFrame], config: Config | None = None, pinned: Mapping[str, Tables] | None = None, to_stage: str | None = None) -> Result:
    """From streets, nodes, census blocks and places to the scores of blocks and city."""
    return run_stages(STAGES, inputs, config or Config.default(), pinned, to_stage)
