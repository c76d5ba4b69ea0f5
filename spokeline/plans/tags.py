"""Attributes of ways out of their raw tags: direction, speed, lanes, widths, parking and class.

Every attribute is a rule program made from a table of fixed values; the registry runs the observed programs in order
of need, drops ways without a class and what only served others, and then fills what is still missing by class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeline.operators.attributes import Attribute, AttributeRegistry
from spokeline.plans.reference import SEG, query_table, segments_of
from spokeline.rules import read_program

QUERIES, ORACLES, query = query_table()

#: The oneway tag of streets driven along and against their direction.
ALONG, AGAINST = ["1", "yes"], ["-1"]
#: Speeds (mph) and lanes by class where nothing is recorded.
SPEEDS = {
    55: ["motorway", "motorway_link"],
    40: ["primary", "primary_link", "secondary", "secondary_link", "trunk", "trunk_link"],
    30: ["tertiary", "tertiary_link"],
    25: ["residential", "unclassified"],
    15: ["living_street", "track", "path"],
}
LANES = {
    2: ["primary", "primary_link", "secondary", "secondary_link", "trunk", "trunk_link", "motorway", "motorway_link"],
    1: ["tertiary", "tertiary_link", "residential", "living_street", "unclassified", "track", "path"],
}
#: Tags by which a street has parking, and by which it has none ({side} is right, left or both).
PARKING = (("parking:lane:{side}", ["parallel", "paralell", "diagonal", "perpendicular"]), ("parking:{side}", ["lane"]))
NO_PARKING = (("parking:lane:{side}", ["no_parking", "no_stopping"]), ("parking:{side}", ["no"]), ("parking:{side}:restriction", ["no_stopping", "no_parking"]))
#: Who may ride where it isn't said by the class.
RIDDEN = ["yes", "permissive", "designated"]
#: Fixed values: (highway, other conditions, class, whether it is a crosswalk) of ways that aren't of the class their highway tag says.
SPECIAL = (
    ("pedestrian", {"bicycle": RIDDEN}, "living_street", False),
    ("path", {"is_golf_path": True}, "unclassified", False),
    ("service", {"bicycle": RIDDEN}, "unclassified", False),
    ("footway", {"bicycle": RIDDEN, "footway_wide": True}, "path", False),
    ("footway", {"footway": ["crossing", "traffic_island"]}, "path", True),
    ("cycleway", {}, "path", False),
    ("path", {}, "path", False),
    ("track", {"tracktype": "grade1"}, "track", False),
)
#: Highway tags that are classes.
PLAIN = ["motorway", "trunk", "primary", "secondary", "tertiary", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "unclassified", "residential", "living_street"]
#: Facilities on both sides of a street that make it more than a minor one.
BOTH_SIDES = ["track", "buffered_lane", "lane"]


def _flag(name: str, *alternatives: dict, tags: tuple[str, ...] = (), after: tuple[str, ...] = ()) -> Attribute:
    """A column that is true where any of the alternatives holds, else false, and only serves other attributes."""
    return Attribute(name, read_program({"name": name, "rules": [{"when": a, "set": {name: True}} for a in alternatives], "default": {name: False}}), tags=tags, after=after, scratch=True)


def _lanes(direction: str, way: str, one_way: list[str], other: str) -> Attribute:
    """Lanes in one direction: by its own turn lanes, then by those of a one-way street, then by numbers in the same order, then half of all."""
    column = f"{direction}_lanes"
    take = lambda when, transform, tag: {"when": when, "set": {column: {"$apply": transform, "to": tag}}}
    rules = []
    for tag, transform in ((f"turn:lanes:{way}", "count_pipes"), ("turn:lanes", "count_pipes"), (f"lanes:{way}", "parse_int"), ("lanes", "parse_int")):
        rules.append(take({tag: "present", **({} if tag.endswith(way) else {"oneway": one_way})}, transform, tag))
    rules += [take({"lanes": "present", "oneway": two_way}, "parse_int_half", "lanes") for two_way in ("absent", "no")]
    usual = [{"when": {column: "is_null", "one_way_car": {"not_in": [other]}, "functional_class": classes}, "set": {column: n}} for n, classes in LANES.items()]
    return Attribute(f"lanes_{direction}", read_program({"name": f"lanes_{direction}", "rules": rules}), read_program({"name": f"usual_lanes_{direction}", "rules": usual}), ("turn:lanes", f"turn:lanes:{way}", "lanes", f"lanes:{way}", "oneway"), ("one_way_car",))


def _parking() -> Attribute:
    rules = []
    for direction, own in (("ft", "right"), ("tf", "left")):
        for side in (own, "both"):
            for (tag, values), there in [*((p, 1) for p in PARKING[:1]), *((p, 0) for p in NO_PARKING[:1]), *((p, 1) for p in PARKING[1:]), *((p, 0) for p in NO_PARKING[1:])]:
                rules.append({"when": {tag.format(side=side): values}, "set": {f"{direction}_park": there}})
    tags = tuple(sorted({t for r in rules for t in r["when"]}))
    return Attribute("parking", read_program({"name": "parking", "rules": rules}), tags=tags)


def _facility_width() -> Attribute:
    """Width of the facility on either side, where there is one: of its own side, of the other side of a one-way street, of both, of any."""
    rules = []
    for direction, own, other in (("ft", "right", "left"), ("tf", "left", "right")):
        for tag, more in ((f"cycleway:{own}:width", {}), (f"cycleway:{other}:width", {"one_way_car": direction}), ("cycleway:both:width", {}), ("cycleway:width", {})):
            rules.append({"when": {f"{direction}_bike_infra": "present", tag: "present", **more}, "set": {f"{direction}_bike_infra_width": {"$apply": "parse_width_ft", "to": tag}}})
    return Attribute("facility_width", read_program({"name": "facility_width", "rules": rules}), tags=("cycleway:right:width", "cycleway:left:width", "cycleway:both:width", "cycleway:width"), after=("one_way_car",))


def _class() -> Attribute:
    open_ = {"access_ok": True}
    special = [{"when": {"highway": highway, **others, **open_}, "set": {"functional_class": kind, **({"xwalk": 1} if crosswalk else {})}} for highway, others, kind, crosswalk in SPECIAL]
    plain = [{"when": {"highway": PLAIN, **open_}, "set": {"functional_class": {"$field": "highway"}}}]
    raised = [{"when": {"functional_class": ["residential", "unclassified"], flag: True}, "set": {"functional_class": "tertiary"}} for flag in ("facilities_both_sides", "ft_many_lanes", "tf_many_lanes", "fast")]
    program = read_program({"name": "functional_class", "passes": [{"name": "by_highway", "rules": special + plain}, {"name": "raised", "after": "by_highway", "rules": raised}]})
    needs = ("access_ok", "footway_wide", "is_golf_path", "facilities_both_sides", "ft_many_lanes", "tf_many_lanes", "fast")
    return Attribute("functional_class", program, tags=("highway", "bicycle", "footway", "tracktype"), after=needs)


def way_attributes() -> AttributeRegistry:
    """The attributes of the standard analysis, but for facilities: ft/tf_bike_infra are taken as given, null where absent."""
    registry = AttributeRegistry()
    one_way = read_program({"name": "one_way_car", "rules": [{"when": {"oneway": ALONG}, "set": {"one_way_car": "ft"}}, {"when": {"oneway": AGAINST}, "set": {"one_way_car": "tf"}}]})
    usual = [{"when": {"speed_limit": "is_null", "functional_class": "residential"}, "set": {"speed_limit": {"$cascade": [{"$var": "city_default_speed"}, {"$var": "state_default_speed"}]}}}]
    usual += [{"when": {"speed_limit": "is_null", "functional_class": classes}, "set": {"speed_limit": mph}} for mph, classes in SPEEDS.items()]
    observed = read_program({"name": "speed", "rules": [{"when": {"maxspeed": "present"}, "set": {"speed_limit": {"$apply": "parse_speed_mph", "to": "maxspeed", "bare_unit": {"$var": "speed_bare_unit"}}}}]})
    width = read_program({"name": "width", "rules": [{"when": {"width": "present"}, "set": {"width_ft": {"$apply": "parse_width_int", "to": "width"}}}]})
    for a in (
        Attribute("one_way_car", one_way, tags=("oneway",)),
        Attribute("speed", observed, read_program({"name": "usual_speed", "rules": usual}), ("maxspeed",)),
        _lanes("ft", "forward", ALONG, "tf"),
        _lanes("tf", "backward", AGAINST, "ft"),
        Attribute("width", width, tags=("width",)),
        _parking(),
        _facility_width(),
        _flag("access_ok", {"access": "is_null"}, {"access": "no", "bicycle": RIDDEN}, {"access": {"not_in": ["no", "private"]}}, tags=("access", "bicycle")),
        _flag("footway_wide", {"bicycle": "designated"}, {"width_ft": {"ge": 8}}, tags=("bicycle",), after=("width",)),
        _flag("is_golf_path", {"golf": ["path", "cartpath"]}, {"golf_cart": ["yes", "designated"]}, tags=("golf", "golf_cart")),
        _flag("facilities_both_sides", {"ft_bike_infra": BOTH_SIDES, "tf_bike_infra": BOTH_SIDES}),
        _flag("ft_many_lanes", {"ft_lanes": {"gt": 1}}, after=("lanes_ft",)),
        _flag("tf_many_lanes", {"tf_lanes": {"gt": 1}}, after=("lanes_tf",)),
        _flag("fast", {"speed_limit": {"ge": 30}}, after=("speed",)),
        _class(),
    ):
        registry.register(a)
    return registry


# Tags made of the segments' columns and road numbers: the tables have no raw tags, and every branch must be reached.
_TAGS = {
    "highway": "case when road_id % 11 = 0 then 'footway' when road_id % 11 = 1 then 'pedestrian' when road_id % 11 = 2 then 'service' when road_id % 11 = 3 then 'cycleway' else functional_class end",
    "oneway": "case when one_way = 'ft' then case when road_id % 2 = 0 then 'yes' else '1' end when one_way = 'tf' then '-1' when road_id % 3 = 0 then 'no' end",
    "maxspeed": "maxspeed",
    "width": "width_ft",
    "access": "case road_id % 7 when 0 then 'no' when 1 then 'private' when 2 then 'yes' end",
    "bicycle": "case road_id % 5 when 0 then 'designated' when 1 then 'yes' when 2 then 'no' end",
    "footway": "case road_id % 4 when 0 then 'crossing' when 1 then 'sidewalk' end",
    "tracktype": "case road_id % 2 when 0 then 'grade1' end",
    "golf_cart": "case road_id % 9 when 0 then 'yes' end",
    "turn:lanes:forward": "case when road_id % 13 = 0 then 'left|through|right' end",
    "turn:lanes": "case when road_id % 13 = 1 then 'left|through' end",
    "lanes:backward": "case when road_id % 13 = 2 then '3' end",
    "lanes": "case when ft_lanes between 1 and 8 and road_id % 2 = 0 then (ft_lanes + 1)::string end",
    "parking:lane:right": "case road_id % 6 when 0 then 'parallel' when 1 then 'no_parking' end",
    "parking:both": "case road_id % 8 when 0 then 'lane' when 1 then 'no' end",
    "parking:left:restriction": "case road_id % 10 when 0 then 'no_stopping' end",
    "cycleway:both:width": "case when road_id % 3 = 1 then '1.5 m' end",
}
_FT, _TF = (f"case when road_id % {n} = 0 then 'lane' when road_id % {n} = 1 then 'track' end" for n in (4, 5))
_COLUMN = {t: t.replace(":", "_") for t in _TAGS}


def _sql_tag(e: str) -> str:
    return e.replace("::string", "::varchar")


def _by_class(table: dict, column: str) -> str:
    return "case " + " ".join(f"when {column} in ({', '.join(repr(c) for c in classes)}) then {n}" for n, classes in table.items()) + " end"


_NUMBER = r"nullif(regexp_extract(lower(maxspeed), '(\d+(?:\.\d+)?)', 1), '')::double"
_WIDE = r"""case when regexp_matches(trim(width), '^\d+''') then try_cast(nullif(regexp_extract(trim(width), '^(\d+)''(?:(\d+)")?', 1), '') as double) + coalesce(try_cast(nullif(regexp_extract(trim(width), '^(\d+)''(?:(\d+)")?', 2), '') as double), 0) / 12
    when contains(lower(width), 'ft') then w when contains(lower(width), 'm') or w < 20 then w * 3.28084 end"""


@query(rf"""with t as (select road_id, {", ".join(f"{_sql_tag(e)} as {_COLUMN[k]}" for k, e in _TAGS.items())}, {_FT} as ft_infra, {_TF} as tf_infra from {SEG}),
    a as (select *, case when oneway in ('1', 'yes') then 'ft' when oneway = '-1' then 'tf' end as car, case when contains(lower(maxspeed), 'mph') and not contains(lower(maxspeed), 'kmph') then trunc({_NUMBER})::int else (round_even({_NUMBER} / 1.609 / 5, 0) * 5)::int end as v,
      try_cast(nullif(regexp_extract(trim(width), '(\d+\.?\d*)', 1), '') as double) as w,
      case when turn_lanes_forward is not null then 3 when turn_lanes is not null and oneway in ('1', 'yes') then 2 when lanes is not null and oneway in ('1', 'yes') then lanes::int when lanes is not null and coalesce(oneway, 'no') = 'no' then ceil(lanes::int / 2.0)::int end as fl,
      case when turn_lanes is not null and oneway = '-1' then 2 when lanes_backward is not null then 3 when lanes is not null and oneway = '-1' then lanes::int when lanes is not null and coalesce(oneway, 'no') = 'no' then ceil(lanes::int / 2.0)::int end as tl,
      coalesce(access is null or (access = 'no' and bicycle in ('yes', 'designated')) or access not in ('no', 'private'), false) as ok from t),
    b as (select *, trunc({_WIDE})::int as wf from a),
    c as (select *, case when not ok then null when highway = 'pedestrian' and bicycle in ('yes', 'designated') then 'living_street' when highway = 'path' and golf_cart = 'yes' then 'unclassified' when highway = 'service' and bicycle in ('yes', 'designated') then 'unclassified'
        when highway = 'footway' and bicycle in ('yes', 'designated') and (bicycle = 'designated' or coalesce(wf >= 8, false)) then 'path' when highway = 'footway' and footway = 'crossing' then 'path' when highway in ('cycleway', 'path') then 'path'
        when highway = 'track' and tracktype = 'grade1' then 'track' when highway in ({", ".join(map(repr, PLAIN))}) then highway end as c0,
        case when ok and highway = 'footway' and footway = 'crossing' then 1 end as xwalk from b),
    k as (select *, case when c0 in ('residential', 'unclassified') and ((ft_infra is not null and tf_infra is not null) or coalesce(fl > 1, false) or coalesce(tl > 1, false) or coalesce(v >= 30, false)) then 'tertiary' else c0 end as fc from c)
    select road_id, fc as functional_class, xwalk, car as one_way_car, coalesce(v, case when fc = 'residential' then 20 end, {_by_class(SPEEDS, "fc")})::int as speed_limit, v is null and fc is not null as speed_limit_imputed,
      coalesce(fl, case when car is distinct from 'tf' then {_by_class(LANES, "fc")} end)::int as ft_lanes, coalesce(tl, case when car is distinct from 'ft' then {_by_class(LANES, "fc")} end)::int as tf_lanes, wf as width_ft,
      case when parking_lane_right = 'parallel' then 1 when parking_lane_right = 'no_parking' then 0 when parking_both = 'lane' then 1 when parking_both = 'no' then 0 end as ft_park,
      case when parking_left_restriction = 'no_stopping' then 0 when parking_both = 'lane' then 1 when parking_both = 'no' then 0 end as tf_park,
      round(case when ft_infra is not null and cycleway_both_width is not null then 1.5 * 3.28084 end, 6) as ft_bike_infra_width from k where fc is not null""")
def attributes_from_tags(spark: SparkSession, d: str) -> DataFrame:
    """Direction, speed, lanes, widths, parking and class of ways, from their raw tags."""
    df = segments_of(spark, d, "functional_class", "one_way", "maxspeed", "width_ft", "ft_lanes")
    pairs = [x for t, e in _TAGS.items() for x in (F.lit(t), F.expr(e))]
    ways = df.select("road_id", F.create_map(*pairs).alias("tags"), F.expr(_FT).alias("ft_bike_infra"), F.expr(_TF).alias("tf_bike_infra"))
    out = way_attributes().run(ways, {"speed_bare_unit": "km/h", "city_default_speed": None, "state_default_speed": 20})
    return out.select("road_id", "functional_class", "xwalk", "one_way_car", F.col("speed_limit").cast("int").alias("speed_limit"), "speed_limit_imputed", F.col("ft_lanes").cast("int").alias("ft_lanes"), F.col("tf_lanes").cast("int").alias("tf_lanes"), F.col("width_ft").cast("int").alias("width_ft"), "ft_park", "tf_park", F.round("ft_bike_infra_width", 6).alias("ft_bike_infra_width"))
