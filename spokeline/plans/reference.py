"""Queries that exercise the operators over the project's tables, each with the SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeline import pipeline
from spokeline.config import Config
from spokeline.functions import parse
from spokeline.operators import network, reach
from spokeline.plans import stress
from spokeline.rules import apply, matcher, read_matcher, read_program
from spokeline.session import keep
from spokeline.sources.tables import latest_rows, pad_code, table


def query_table():
    """Queries by name, SQL by name, and the decorator that adds to both."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f: Callable[[SparkSession, str], DataFrame]):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


QUERIES, ORACLES, query = query_table()


def segments_of(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest_rows(table(spark, d, "segments"), ["road_id"], "extracted_at", list(columns) or None)


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    return latest_rows(table(spark, d, "nodes"), ["node_id"], "extracted_at")


def _latest(name: str, key: str, at: str) -> str:
    return f"(select * exclude (rn) from (select *, row_number() over (partition by {key} order by {at} desc) rn from {name}) where rn = 1)"


SEG, NODE = _latest("segments", "road_id", "extracted_at"), _latest("nodes", "node_id", "extracted_at")
DEST, BLOCK = _latest("destinations", "id", "loaded_at"), _latest("census_blocks", "geoid20", "extracted_at")

# --- rules: tests ---------------------------------------------------------------------------------------

_OPS = {
    "eq": ({"one_way": "ft"}, "coalesce(one_way = 'ft', false)"),
    "ne": ({"one_way": {"ne": "ft"}}, "one_way is distinct from 'ft'"),
    "in": ({"functional_class": ["primary", "trunk"]}, "coalesce(functional_class in ('primary', 'trunk'), false)"),
    "not_in": ({"functional_class": {"not_in": ["primary", "trunk"]}}, "coalesce(functional_class not in ('primary', 'trunk'), true)"),
    "present": ({"maxspeed": "present"}, "maxspeed is not null"),
    "absent": ({"maxspeed": "absent"}, "maxspeed is null"),
    "lt": ({"ft_lanes": {"lt": 2}}, "coalesce(ft_lanes < 2, false)"),
    "le": ({"ft_lanes": {"le": 2}}, "coalesce(ft_lanes <= 2, false)"),
    "gt": ({"speed_limit": {"gt": 30}}, "coalesce(speed_limit > 30, false)"),
    "ge": ({"speed_limit": {"ge": 30, "lt": 50}}, "coalesce(speed_limit >= 30 and speed_limit < 50, false)"),
    "cast": ({"width_ft": {"gt": 12.5}}, "coalesce(try_cast(width_ft as double) > 12.5, false)"),
    "wrong_type": ({"speed_limit": "30"}, "false"),
}


@query("select road_id, " + ", ".join(f"{sql} as is_{op}" for op, (_, sql) in _OPS.items()) + f" from {SEG}")
def dsl_ops(spark: SparkSession, d: str) -> DataFrame:
    """Every test of the rule language on every segment."""
    df = segments_of(spark, d, "one_way", "functional_class", "maxspeed", "ft_lanes", "speed_limit", "width_ft")
    return df.select("road_id", *[matcher(df, read_matcher([when])).alias(f"is_{op}") for op, (when, _) in _OPS.items()])


@query(f"""select road_id, (coalesce(functional_class = 'path', false) or (coalesce(functional_class = 'track', false) and coalesce(ft_lanes <= 1, false))) and not coalesce(one_way in ('ft', 'tf'), false) as wanted, false as nothing from {SEG}""")
def dsl_matcher(spark: SparkSession, d: str) -> DataFrame:
    """Alternatives of conditions, an exclusion, and the empty matcher."""
    df = segments_of(spark, d, "functional_class", "ft_lanes", "one_way")
    wanted = matcher(df, read_matcher([{"functional_class": "path"}, {"functional_class": "track", "ft_lanes": {"le": 1}}]))
    return df.select("road_id", (wanted & ~matcher(df, read_matcher([{"one_way": ["ft", "tf"]}]))).alias("wanted"), matcher(df, ()).alias("nothing"))


# --- rules: choice ---------------------------------------------------------------------------------------

CHOICE = {
    "name": "choice",
    "sets": {"big": ["primary", "secondary", "trunk"]},
    "predicates": {"fast": {"speed_limit": {"gt": 35}}},
    "rules": [
        {"id": "big_fast", "when": {"functional_class": "$big", "use": "fast"}, "set": {"level": 3, "kind": "main"}},
        {"id": "big", "when": {"functional_class": "$big"}, "set": {"kind": "big"}},
        {"id": "wide", "when": {"ft_lanes": {"ge": 3}}, "set": {"level": 2}},
        {"id": "off", "enabled": False, "set": {"level": 9}},
        {"id": "switch", "enabled": {"$var": "strict"}, "when": {"speed_limit": {"gt": {"$var": "bound"}}}, "set": {"level": 4}},
    ],
    "default": {"level": 1},
}


@query(f"""select road_id, case when functional_class in ('primary', 'secondary', 'trunk') and speed_limit > 35 then 3 when ft_lanes >= 3 then 2 when speed_limit > 25 then 4 else 1 end as level,
    case when functional_class in ('primary', 'secondary', 'trunk') and speed_limit > 35 then 'main' when functional_class in ('primary', 'secondary', 'trunk') then 'big' end as kind,
    case when functional_class = 'path' then 'ft' else one_way end as one_way from {SEG}""")  # fmt: skip
def dsl_first_match(spark: SparkSession, d: str) -> DataFrame:
    """First match per output column, defaults, existing columns, switches and variables."""
    df = segments_of(spark, d, "functional_class", "speed_limit", "ft_lanes", "one_way")
    df = apply(df, read_program(CHOICE), {"strict": True, "bound": 25})
    existing = read_program({"rules": [{"when": {"functional_class": "path"}, "set": {"one_way": "ft"}}]})
    return apply(df, existing).select("road_id", "level", "kind", "one_way")


@query(f"""with a as (select road_id, case when speed_limit > 40 then 3 else 1 end as x, ft_lanes from {SEG}), b as (select *, case when x = 3 then 30 when ft_lanes > 2 then 20 end as y from a),
    c as (select *, case when y is null then 0 else x end as z from b) select road_id, x, y, case when z = 3 then -1 else z end as z from c""")
def dsl_sequential_passes(spark: SparkSession, d: str) -> DataFrame:
    """A later output sees an earlier one of its table; a later pass sees both."""
    df = segments_of(spark, d, "speed_limit", "ft_lanes")
    program = read_program({"passes": [
        {"name": "last", "after": "first", "rules": [{"when": {"z": 3}, "set": {"z": -1}}]},
        {"name": "first", "rules": [{"when": {"speed_limit": {"gt": 40}}, "set": {"x": 3}}, {"when": {"x": 3}, "set": {"y": 30}}, {"when": {"ft_lanes": {"gt": 2}}, "set": {"y": 20}}, {"when": {"y": "absent"}, "set": {"z": 0}}, {"set": {"z": {"$field": "x"}}}], "default": {"x": 1}},
    ]})
    return apply(df, program).select("road_id", "x", "y", "z")


@query(f"""select road_id, {", ".join(f"case when {x}_lanes >= {n} then '{x}{n}' end as {x}_{n}" for x in ("ft", "tf") for n in (2, 3))},
    case when ft_lanes > 1 then 'left' end as ft_side, case when tf_lanes > 1 then 'right' end as tf_side,
    case when functional_class = 'primary' and speed_limit > 30 then 'a' when functional_class = 'primary' then 'b' else 'c' end as nested from {SEG}""")
def dsl_sweeps_and_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Sweeps over all combinations and over pairs, and rules inside rules."""
    df = segments_of(spark, d, "ft_lanes", "tf_lanes", "functional_class", "speed_limit")
    grid = read_program({"for": {"x": ["ft", "tf"], "n": [2, 3]}, "rules": [{"when": {"<x>_lanes": {"ge": 2}}, "rules": [{"when": {"<x>_lanes": {"ge": "<n>"}}, "set": {"<x>_<n>": "<x><n>"}}]}]})
    pairs = read_program({"for": [{"d": "ft", "s": "left"}, {"d": "tf", "s": "right"}], "rules": [{"when": {"<d>_lanes": {"gt": 1}}, "set": {"<d>_side": "<s>"}}]})
    nested = read_program({"rules": [{"when": {"functional_class": "primary"}, "rules": [{"when": {"speed_limit": {"gt": 30}}, "set": {"nested": "a"}}, {"set": {"nested": "b"}}]}], "default": {"nested": "c"}})
    for p in (grid, pairs, nested):
        df = apply(df, p)
    return df.select("road_id", "ft_2", "ft_3", "tf_2", "tf_3", "ft_side", "tf_side", "nested")


@query(f"""select road_id, case functional_class when 'primary' then 'A' when 'trunk' then 'B' else 'Z' end as mapped,
    case when functional_class in ('path', 'track') then case functional_class when 'path' then 1 else 2 end when ft_lanes > 2 then 7 end as looked,
    coalesce(speed_limit, ft_lanes, 25) as cascade, coalesce(maxspeed, width_ft, case when ft_lanes = 1 then 'narrow' end) as chained from {SEG}""")
def dsl_values(spark: SparkSession, d: str) -> DataFrame:
    """Maps, lookups that only speak for known keys, cascades and chains."""
    df = segments_of(spark, d, "functional_class", "ft_lanes", "speed_limit", "maxspeed", "width_ft")
    program = read_program({
        "map": {"field": "functional_class", "to": "mapped", "table": {"primary": "A", "trunk": "B"}, "default": "Z"},
        "rules": [
            {"set": {"looked": {"$lookup": "functional_class", "map": {"path": 1, "track": 2}}, "cascade": {"$cascade": [{"$field": "speed_limit"}, {"$field": "ft_lanes"}, {"$var": "usual"}]}}},
            {"when": {"ft_lanes": {"gt": 2}}, "set": {"looked": 7}},
        ],
        "first_non_null": {"chained": ["maxspeed", "width_ft", {"value": "narrow", "when": {"ft_lanes": 1}}]},
    })
    return apply(df, program, {"usual": 25}).select("road_id", "mapped", "looked", "cascade", "chained")


# --- transforms ------------------------------------------------------------------------------------------

_NUM = r"nullif(regexp_extract(lower({c}), '(\d+(?:\.\d+)?)', 1), '')::double"
_SPEED = _NUM.format(c="maxspeed")


@query(f"""select road_id, case when contains(lower(maxspeed), 'mph') and not contains(lower(maxspeed), 'kmph') then trunc({_SPEED})::int else (round_even({_SPEED} / 1.609 / 5, 0) * 5)::int end as mph,
    case when contains(lower(maxspeed), 'mph') and not contains(lower(maxspeed), 'kmph') then trunc({_SPEED})::int when contains(lower(maxspeed), 'km') then (round_even({_SPEED} / 1.609 / 5, 0) * 5)::int else trunc({_SPEED})::int end as mph_bare,
    try_cast(nullif(regexp_extract(maxspeed, '(\\d+)', 1), '') as int) as digits, ceil(try_cast(nullif(regexp_extract(maxspeed, '(\\d+)', 1), '') as int) / 2.0)::int as half,
    (length(maxspeed) - length(replace(maxspeed, '|', '')) + 1)::int as pipes from {SEG} where maxspeed is not null""")  # fmt: skip
def tf_speed_and_lanes(spark: SparkSession, d: str) -> DataFrame:
    df = segments_of(spark, d, "maxspeed").where("maxspeed is not null")
    c = F.col("maxspeed")
    return df.select("road_id", parse.parse_speed_mph(c).alias("mph"), parse.parse_speed_mph(c, "mph").alias("mph_bare"), parse.parse_int(c).alias("digits"), parse.parse_int_half(c).alias("half"), parse.count_pipes(c).alias("pipes"))


_W_NUMBER = r"try_cast(nullif(regexp_extract(trim(width_ft), '(\d+\.?\d*)', 1), '') as double)"
_W_FEET, _W_INCHES = (rf"""try_cast(nullif(regexp_extract(trim(width_ft), '^(\d+)''(?:(\d+)")?', {g}), '') as double)""" for g in (1, 2))
_W = rf"""case when regexp_matches(trim(width_ft), '^\d+''') then {_W_FEET} + coalesce({_W_INCHES}, 0) / 12 when contains(lower(width_ft), 'ft') then {_W_NUMBER}
    when contains(lower(width_ft), 'm') then {_W_NUMBER} * 3.28084 when {_W_NUMBER} < 20 then {_W_NUMBER} * 3.28084 end"""


@query(f"select road_id, round(w, 6) as feet, trunc(w)::int as whole from (select road_id, {_W} as w from {SEG} where width_ft is not null)")
def tf_width(spark: SparkSession, d: str) -> DataFrame:
    df = segments_of(spark, d, "width_ft").where("width_ft is not null")
    return df.select("road_id", F.round(parse.parse_width_ft(F.col("width_ft")), 6).alias("feet"), parse.parse_width_int(F.col("width_ft")).alias("whole"))


# --- attributes ------------------------------------------------------------------------------------------


@query(f"""with s as (select road_id, functional_class, case when speed_limit between 5 and 85 then speed_limit end as v, c.speed as city, t.speed as state from {SEG} s
      left join (select lpad(fips_code_city, 7, '0') k, min(case when speed between 5 and 85 then speed end) speed from city_fips_speed group by 1) c on lpad(s.city_fips, 7, '0') = c.k
      left join (select lpad(fips_code_state, 2, '0') k, min(case when speed between 5 and 85 then speed end) speed from state_fips_speed group by 1) t on left(lpad(s.city_fips, 7, '0'), 2) = t.k),
    f as (select *, coalesce(v, case when functional_class = 'residential' and coalesce(city, state) is not null then coalesce(city, state) when functional_class in ('primary', 'secondary', 'trunk') then 40 when functional_class = 'tertiary' then 30
      when functional_class in ('residential', 'unclassified') then 25 when functional_class in ('living_street', 'track', 'path') then 15 end) as speed from s)
    select road_id, speed, v is null and speed is not null as speed_imputed from f""")  # fmt: skip
def attr_speed_observed_then_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Observed speeds, else the town's or state's for residential streets, else the class's; fills are flagged."""
    from spokeline.operators.attributes import apply_fallback

    df = segments_of(spark, d, "functional_class", "speed_limit", "city_fips").withColumn("speed", F.when(F.col("speed_limit").between(5, 85), F.col("speed_limit")))
    town = pad_code(F.col("city_fips"), 7)
    speeds = lambda name, code, width: table(spark, d, name).groupBy(pad_code(F.col(code), width).alias("k")).agg(F.min(F.when(F.col("speed").between(5, 85), F.col("speed"))).alias("v"))
    city, state = speeds("city_fips_speed", "fips_code_city", 7), speeds("state_fips_speed", "fips_code_state", 2)
    df = df.withColumns({"kc": town, "ks": F.substring(town, 1, 2)})
    df = df.join(city.withColumnsRenamed({"k": "kc", "v": "city_speed"}), "kc", "left").join(state.withColumnsRenamed({"k": "ks", "v": "state_speed"}), "ks", "left")
    classes = {40: ["primary", "secondary", "trunk"], 30: ["tertiary"], 25: ["residential", "unclassified"], 15: ["living_street", "track", "path"]}
    fallback = read_program({"rules": [{"when": {"speed": "is_null"}, "rules": [
        {"when": {"functional_class": "residential"}, "set": {"speed": {"$cascade": [{"$field": "city_speed"}, {"$field": "state_speed"}]}}},
        *[{"when": {"functional_class": fcs}, "set": {"speed": mph}} for mph, fcs in classes.items()],
    ]}]})
    return apply_fallback(df, fallback).select("road_id", "speed", "speed_imputed")


# --- stress ----------------------------------------------------------------------------------------------

_INFRA = "case when road_id % 5 = 0 then 'track' when road_id % 5 = 1 then 'lane' when road_id % 5 = 2 then 'buffered_lane' end"


def _with_facilities(df: DataFrame) -> DataFrame:
    """Facilities by road number: the tables have none, and every branch of the rules must be reached."""
    return df.withColumns({"ft_bike_infra": F.expr(_INFRA), "tf_bike_infra": F.expr(_INFRA), "ft_bike_infra_width": F.col("road_id") % 7, "tf_bike_infra_width": F.col("road_id") % 7, "bicycle": F.expr("if(road_id % 3 = 0, 'no', null)")})


def _seg_case(x: str) -> str:
    low = lambda cond: f"case when coalesce({cond}, false) then 1 else 3 end"
    return f"""case when functional_class = 'trunk' then 3 when functional_class in ('path', 'track') then 1 when functional_class = 'living_street' then case when road_id % 3 = 0 then 3 else 1 end
      when functional_class in ('primary', 'secondary', 'tertiary') then case coalesce({_INFRA}, '') when 'track' then 1 when 'buffered_lane' then {low(f"speed_limit <= 25 and {x}_lanes <= 1")}
        when 'lane' then {low(f"speed_limit <= 20 and {x}_lanes <= 1 and road_id % 7 >= 4")} else {low(f"speed_limit <= 15 and {x}_lanes = 1")} end
      when functional_class in ('residential', 'unclassified') then {low("speed_limit <= 25")} end"""


@query(f"""select road_id, case when one_way is distinct from 'tf' then {_seg_case("ft")} end as ft_seg_stress, case when one_way is distinct from 'ft' then {_seg_case("tf")} end as tf_seg_stress from {SEG}""")
def stress_segments(spark: SparkSession, d: str) -> DataFrame:
    """Stress of every segment in both directions, none against a one-way street."""
    df = _with_facilities(segments_of(spark, d, "functional_class", "speed_limit", "ft_lanes", "tf_lanes", "one_way"))
    return stress.segment_stress(df).select("road_id", "ft_seg_stress", "tf_seg_stress")


_CROSS = """(functional_class in ('motorway', 'trunk') or coalesce(functional_class in ('primary', 'secondary', 'tertiary') and case when one_way is not null then
    coalesce(ft_lanes, tf_lanes, dl) > 2 or (rrfb and coalesce(ft_lanes, tf_lanes, dl) = 2 and v > 40) or (rrfb and coalesce(ft_lanes, tf_lanes, dl) < 2 and v > 35) or (not rrfb and v > 30)
  else tot > 4 or (rrfb and tot = 4 and (v > 40 or (v > 30 and not island))) or (rrfb and tot < 4 and v > 35 and not island) or (not rrfb and tot = 4 and (v > 30 or (v = 30 and not island))) or (not rrfb and tot < 4 and v > 30 and not island) end, false))"""
_ENDS = f"""s as {SEG}, n as {NODE}, e0 as (select road_id, functional_class, one_way, ft_lanes, tf_lanes, speed_limit, start_node_id as node_id from s union select road_id, functional_class, one_way, ft_lanes, tf_lanes, speed_limit, end_node_id from s),
  e1 as (select e0.*, case when functional_class in ('primary', 'secondary') then 2 else 1 end as dl, coalesce(speed_limit, case when functional_class in ('primary', 'secondary') then 40 else 30 end) as v, coalesce(n.rrfb, false) as rrfb, coalesce(n.island, false) as island
    from e0 left join n using (node_id) where node_id is not null), e2 as (select *, coalesce(ft_lanes, dl) + coalesce(tf_lanes, dl) as tot from e1), e as (select *, coalesce({_CROSS}, false) as high from e2)"""


@query(f"""with {_ENDS}, x as (select node_id, road_id from e where high), xn as (select node_id, road_id from e where high and functional_class is distinct from 'tertiary'),
    r as (select s.road_id, s.functional_class, s.start_node_id, s.end_node_id, exists (select 1 from x where x.node_id = s.end_node_id and x.road_id <> s.road_id) as hf, exists (select 1 from x where x.node_id = s.start_node_id and x.road_id <> s.road_id) as ht,
      exists (select 1 from xn where xn.node_id = s.end_node_id and xn.road_id <> s.road_id) as hnf, exists (select 1 from xn where xn.node_id = s.start_node_id and xn.road_id <> s.road_id) as hnt from s),
    b as (select r.*, not coalesce(f.signalized, false) and not coalesce(f.stop, false) as bf, not coalesce(t.signalized, false) and not coalesce(t.stop, false) as bt from r left join n f on f.node_id = r.end_node_id left join n t on t.node_id = r.start_node_id)
    select road_id, case when bf and ((functional_class in ('residential', 'unclassified', 'living_street', 'track', 'path') and hf) or (functional_class = 'tertiary' and hnf)) then 3 else 1 end as ft_int_stress,
      case when bt and ((functional_class in ('residential', 'unclassified', 'living_street', 'track', 'path') and ht) or (functional_class = 'tertiary' and hnt)) then 3 else 1 end as tf_int_stress from b""")  # fmt: skip
def stress_intersections(spark: SparkSession, d: str) -> DataFrame:
    """Stress of the node ahead: EXISTS a stressful crossing road, decorrelated into one count per node."""
    segments = keep(segments_of(spark, d, "functional_class", "speed_limit", "ft_lanes", "tf_lanes", "one_way", "start_node_id", "end_node_id"))
    return stress.intersection_stress(segments, keep(nodes_of(spark, d))).select("road_id", "ft_int_stress", "tf_int_stress")


_METRES = "2 * 6371008.8 * asin(sqrt(pow(sin(radians(f.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(f.lat)) * pow(sin(radians(f.lon - c.lon) / 2), 2)))"


@query(f"""with n as {NODE}, c as (select n.* from n join (select node_id from (select start_node_id as node_id from {SEG} union all select end_node_id from {SEG}) group by 1 having count(*) > 2) using (node_id) where abs(lat) <= 90 and abs(lon) <= 180 and not (lat = 0 and lon = 0)),
    f as (select * from n where (signalized or stop or rrfb or island) and abs(lat) <= 90 and abs(lon) <= 180 and not (lat = 0 and lon = 0)),
    w as (select c.node_id, {", ".join(f"bool_or(coalesce(f.{x}, false)) as {x}" for x in stress.NODE_FLAGS)} from c join f on f.lat between c.lat - 0.00023 and c.lat + 0.00023 where {_METRES} <= 25 group by 1)
    select n.node_id, {", ".join(f"coalesce(n.{x}, false) or coalesce(w.{x}, false) as {x}" for x in stress.NODE_FLAGS)} from n left join w using (node_id)""")
def node_flags_within(spark: SparkSession, d: str) -> DataFrame:
    """Signals, stops, beacons and islands spread to crossings within 25 m."""
    nodes = keep(nodes_of(spark, d).select("node_id", "lon", "lat", *stress.NODE_FLAGS))
    return stress.spread_flags(nodes, segments_of(spark, d, "start_node_id", "end_node_id")).select("node_id", *stress.NODE_FLAGS)


# --- networks --------------------------------------------------------------------------------------------


@query(f"select node_id, count(*) as legs from (select start_node_id as node_id from {SEG} union all select end_node_id from {SEG}) where node_id is not null group by 1")
def node_leg_counts(spark: SparkSession, d: str) -> DataFrame:
    return network.leg_counts(segments_of(spark, d, "start_node_id", "end_node_id"))


def _ways(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ways over parts as nodes: the only ordered lists in the tables."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("osm_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    return items.select("osm_id", F.col("p.l_partkey").alias("node_ids"))


@query("select l_partkey as node_id, count(*) as n_uses, count(distinct l_orderkey) as n_ways from lineitem group by 1")
def node_usage_counts(spark: SparkSession, d: str) -> DataFrame:
    return network.node_usage(_ways(spark, d))


@query("""with u as (select l_partkey, count(*) > 1 as cut from lineitem group by 1), o as (select l_orderkey, l_partkey, cut::int as cut, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as pos from lineitem join u using (l_partkey)),
      p as (select *, coalesce(sum(cut) over (partition by l_orderkey order by pos rows between unbounded preceding and 1 preceding), 0) as b, sum(cut) over (partition by l_orderkey order by pos rows between unbounded preceding and current row) as a from o),
      q as (select l_orderkey, l_partkey, pos, b as part from p union all select l_orderkey, l_partkey, pos, a from p where a <> b)
    select l_orderkey as osm_id, part::bigint as part, count(*) as n_nodes, arg_min(l_partkey, pos) as first_node, arg_max(l_partkey, pos) as last_node from q group by 1, 2 having count(*) >= 2""")
def way_split_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Ways cut at shared nodes."""
    return network.split_ways(_ways(spark, d)).select("osm_id", F.col("part").cast("bigint").alias("part"), F.size("node_ids").cast("bigint").alias("n_nodes"), F.element_at("node_ids", 1).alias("first_node"), F.element_at("node_ids", -1).alias("last_node"))


@query(f"""with n as (select distinct osm_id, node_id from (select osm_id, start_node_id as node_id from {SEG} union all select osm_id, end_node_id from {SEG}) where node_id is not null and osm_id is not null)
    select distinct osm_id from n where osm_id not in (select osm_id from n where node_id in (select node_id from n group by 1 having count(*) > 1))""")
def orphan_ways(spark: SparkSession, d: str) -> DataFrame:
    """Ways of the road network that meet no other."""
    ends = segments_of(spark, d, "osm_id", "start_node_id", "end_node_id").where("osm_id is not null")
    ways = ends.groupBy("osm_id").agg(F.array_compact(F.flatten(F.collect_list(F.array("start_node_id", "end_node_id")))).alias("node_ids")).where(F.size("node_ids") > 0)
    return network.orphan_ways(ways)


_LINKS = f"""with s as (select road_id, start_node_id, end_node_id, one_way, length_m, case functional_class when 'path' then 1 when 'trunk' then 3 else 2 end as f, case when ft_lanes > 1 then 3 else 1 end as t, case when tf_lanes > 2 then 2 else 1 end as i from {SEG} where not isnan(length_m)),
    lv as (select start_node_id as n, road_id, length_m, t as st, i as tn from s where one_way is distinct from 'ft' union all select end_node_id, road_id, length_m, f, i from s where one_way is distinct from 'tf'),
    en as (select start_node_id as n, road_id, length_m, f as st from s where one_way is distinct from 'tf' union all select end_node_id, road_id, length_m, t from s where one_way is distinct from 'ft'),
    l as (select lv.road_id as source_vert, en.road_id as target_vert, floor((round_even(lv.length_m, 0) + round_even(en.length_m, 0)) / 2)::bigint as link_cost, lv.st as a, en.st as b, lv.tn as c from lv join en using (n) where lv.road_id <> en.road_id)"""


def _stressed(spark: SparkSession, d: str) -> DataFrame:
    df = segments_of(spark, d, "start_node_id", "end_node_id", "one_way", "length_m", "functional_class", "ft_lanes", "tf_lanes").where("not isnan(length_m)")
    turn = F.expr("if(tf_lanes > 2, 2, 1)")
    return df.withColumns({"ft_seg_stress": F.expr("case functional_class when 'path' then 1 when 'trunk' then 3 else 2 end"), "tf_seg_stress": F.expr("if(ft_lanes > 1, 3, 1)"), "ft_int_stress": turn, "tf_int_stress": turn})


@query(_LINKS + " select source_vert, target_vert, link_cost, greatest(a, b, c) as link_stress from l")
def line_graph_links_max(spark: SparkSession, d: str) -> DataFrame:
    """Turns between segments; a turn is as stressful as the worst of both segments and the crossing."""
    return network.segment_links(_stressed(spark, d), "max")


@query(_LINKS + " select source_vert, target_vert, link_cost, greatest(a, b) as link_stress from l")
def line_graph_links_segment_only(spark: SparkSession, d: str) -> DataFrame:
    return network.segment_links(_stressed(spark, d), "segment_only")


@query(_LINKS + " select source_vert, target_vert, link_cost, least(a + b + c, 5) as link_stress from l")
def line_graph_links_sum(spark: SparkSession, d: str) -> DataFrame:
    return network.segment_links(_stressed(spark, d), "sum", 5)


@query(_LINKS + " select source_vert, target_vert, min(link_cost) as link_cost from l group by 1, 2")
def link_dedup_min(spark: SparkSession, d: str) -> DataFrame:
    return network.cheapest_links(network.segment_links(segments_of(spark, d, "start_node_id", "end_node_id", "one_way", "length_m").where("not isnan(length_m)")))


_EDGES = """e as (select c_nationkey::bigint as a, s_nationkey::bigint as b, (10 + count(*) % 30)::bigint as cost, min(l_discount) <= 0.005 as low from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2)"""


def _nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Trade between nations as a small graph: customers' nation to suppliers' nation."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_discount").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    out = rows.groupBy(F.col("c_nationkey").cast("bigint").alias("a"), F.col("s_nationkey").cast("bigint").alias("b")).agg(F.count("*").alias("n"), F.min("l_discount").alias("m"))
    return keep(out.select("a", "b", (10 + F.col("n") % 30).alias("cost"), (F.col("m") <= 0.005).alias("low")))


def _walk(where: str, name: str = "r", edge: str = "e", source: str = "n_nationkey") -> str:
    return f"{name} as (select {source}::bigint as source, n_nationkey::bigint as vert, 0::bigint as cost from nation union select {name}.source, {edge}.b, {name}.cost + {edge}.cost from {name} join {edge} on {name}.vert = {edge}.a where {where} and {name}.cost + {edge}.cost <= 35)"


def _sources(spark: SparkSession, d: str, column: str = "n_nationkey") -> DataFrame:
    return table(spark, d, "nation").select(F.col(column).cast("bigint").alias("source"), F.col("n_nationkey").cast("bigint").alias("vert"))


@query(f"with recursive {_EDGES}, {_walk('true')} select source, vert, min(cost)::double as cost from r group by 1, 2")
def reach_bounded(spark: SparkSession, d: str) -> DataFrame:
    return reach.bounded_reach(_sources(spark, d), _nation_edges(spark, d), 35)


@query(f"with recursive {_EDGES}, {_walk('true', source='n_regionkey')} select source, vert, min(cost)::double as cost from r group by 1, 2")
def reach_multi_source(spark: SparkSession, d: str) -> DataFrame:
    """Regions start from all their nations at once."""
    return reach.bounded_reach(_sources(spark, d, "n_regionkey"), _nation_edges(spark, d), 35)


@query(f"with recursive {_EDGES}, f as (select b as a, a as b, cost from e), {_walk('true', edge='f', source='n_regionkey')} select vert, count(distinct source) as n_targets from r group by 1")
def reach_reverse(spark: SparkSession, d: str) -> DataFrame:
    """How many targets can reach each vertex's place: paths walked backwards from the few targets."""
    back = reach.reach_back(_sources(spark, d, "n_regionkey"), _nation_edges(spark, d), 35)
    return back.groupBy("vert").agg(F.count_distinct("source").alias("n_targets"))


@query(f"""with recursive {_EDGES}, el as (select * from e where low), {_walk('true')}, {_walk('true', 'q', 'el')}, h as (select source, vert, min(cost) as c from r group by 1, 2 having source <> vert), l as (select source, vert, min(cost) as c from q group by 1, 2),
    sh as (select distinct a.n_nationkey::bigint as x, b.n_nationkey::bigint as y from nation a join nation b on a.n_regionkey = b.n_regionkey)
    select h.source as source_block, h.vert as target_block, coalesce(sh.x is not null or (l.c is not null and (h.c = 0 or l.c <= 1.25 * h.c)), false) as low_stress, l.c::double as low_stress_cost, true as high_stress, h.c::double as high_stress_cost
      from h left join l using (source, vert) left join sh on sh.x = h.source and sh.y = h.vert
    union all select n_nationkey, n_nationkey, true, 0, true, 0 from nation""")  # fmt: skip
def block_pairs_low_stress(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of blocks with the low-stress flag: nations as blocks, sharing a 'road' within a region."""
    edges, sources = _nation_edges(spark, d), _sources(spark, d)
    verts = sources.withColumnRenamed("source", "block")
    high = reach.block_costs(reach.bounded_reach(sources, edges, 35), verts)
    low = reach.block_costs(reach.bounded_reach(sources, edges.where("low"), 35), verts)
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_regionkey")
    shared = nation.withColumnRenamed("k", "source_block").join(nation.withColumnRenamed("k", "target_block"), "n_regionkey")
    return reach.block_pairs(high, low, shared, verts.select("block"))


ROAD_LIMIT_M = 2680


def _roads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All turns of the road network (a, b, cost, link_stress), and the roads of every census block (block, vert)."""
    made = pipeline.score_city(pipeline.read_inputs(spark, d), to_stage="graph").tables
    return made["links"], made["block_verts"]


@query()
def road_reach(spark: SparkSession, d: str) -> DataFrame:
    """The roads that each census block reaches within the limit, all roads being open."""
    links, verts = _roads(spark, d)
    return reach.bounded_reach(verts.withColumnRenamed("block", "source"), links, ROAD_LIMIT_M)


@query()
def road_reach_reverse(spark: SparkSession, d: str) -> DataFrame:
    """How many census blocks can be reached from each road, the roads walked backwards from the blocks."""
    links, verts = _roads(spark, d)
    back = reach.reach_back(verts.withColumnRenamed("block", "source"), links, ROAD_LIMIT_M)
    return back.groupBy("vert").agg(F.count_distinct("source").alias("n_targets"))


@query()
def road_block_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of census blocks within the limit on the road network, with the low-stress flag."""
    config = Config.build(overrides={"reach.limit_m": ROAD_LIMIT_M})
    return pipeline.score_city(pipeline.read_inputs(spark, d), config, to_stage="connectivity").tables["connectivity"]


@query("""with recursive e as (select distinct least(c_nationkey, s_nationkey)::bigint as a, greatest(c_nationkey, s_nationkey)::bigint as b from customer join supplier on c_nationkey = s_nationkey + 5 and c_acctbal < 0 and s_acctbal < 3000),
    both_ways as (select a, b from e union select b, a from e), r as (select a as v, a as w from both_ways union select r.v, both_ways.b from r join both_ways on r.w = both_ways.a) select v, min(w) as component from r group by 1""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").cast("bigint").alias("b")).distinct()
    s = table(spark, d, "supplier").where("s_acctbal < 3000").select(F.col("s_nationkey").cast("bigint").alias("a")).distinct()
    return network.connected_components(c.join(s, F.col("b") == F.col("a") + 5))


@query(f"""with recursive s as {SEG}, l as (select distinct road_id, node_id from (select road_id, start_node_id as node_id from s union all select road_id, end_node_id from s) where node_id is not null),
    e as (select distinct a.road_id as a, b.road_id as b from l a join l b using (node_id) where a.road_id <> b.road_id),
    g(road_id, component) using key (road_id) as (select road_id, road_id from s union select e.b, min(g.component) from g join e on g.road_id = e.a join recurring.g as old on old.road_id = e.b where g.component < old.component group by e.b)
    select road_id, component from g""")
def road_components(spark: SparkSession, d: str) -> DataFrame:
    """(road_id, component) of every road: roads linked by shared nodes, the component named by its smallest road."""
    roads = keep(segments_of(spark, d, "start_node_id", "end_node_id"))
    ends = roads.select("road_id", F.explode(F.array("start_node_id", "end_node_id")).alias("n")).where("n is not null and road_id is not null")
    first = ends.groupBy("n").agg(F.min("road_id").alias("b"))
    named = network.connected_components(ends.join(first, "n").select(F.col("road_id").alias("a"), "b"))
    return roads.join(named, roads["road_id"] == named["v"], "left").select("road_id", F.coalesce("component", "road_id").alias("component"))


@query()
def dead_end_peel(spark: SparkSession, d: str) -> DataFrame:
    """Paths and tracks that end nowhere, peeled until none is left."""
    df = segments_of(spark, d, "start_node_id", "end_node_id", "functional_class")
    return network.peel_dead_ends(df, F.col("functional_class").isin("path", "track")).select("road_id")


@query()
def trail_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Connected runs of paths and tracks that are long enough."""
    df = segments_of(spark, d, "start_node_id", "end_node_id", "functional_class", "length_m").where("functional_class in ('path', 'track') and length_m > 0 and length_m < 1e5 and not isnan(length_m)")
    df = network.with_ends(df, nodes_of(spark, d))
    return network.trails(df, F.lit(True)).where("path_length >= 200").withColumns({c: F.round(c, 3) for c in ("path_length", "bbox_length")})
