"""Attributes that the stress rules read: speed, lanes and widths, observed where recorded, else by class."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeline.operators.attributes import Attribute, AttributeRegistry
from spokeline.operators.units import convert_units, source_units
from spokeline.rules import read_program
from spokeline.sources.files import default_speeds
from spokeline.sources.tables import pad_code

#: Values beyond these are no measurements: mph, lanes of one direction, feet.
SPEEDS, LANES, WIDTHS = (5, 85), (1, 8), (3, 330)
FACILITY_FT = 5.0
_WITH_LINK = lambda *names: [c for n in names for c in (n, f"{n}_link")]


def within(c: Column, low: float, high: float) -> Column:
    """Null where the value is none of the range."""
    return F.when(c.between(low, high), c)


def registry() -> AttributeRegistry:
    """The fallbacks: residential streets take their town's speed if there is one, all others their class's."""
    out = AttributeRegistry()
    by_class = {40: _WITH_LINK("primary", "secondary", "trunk"), 55: _WITH_LINK("motorway"), 30: _WITH_LINK("tertiary"), 25: ["residential", "unclassified"], 15: ["living_street", "track", "path"]}
    town = {"when": {"functional_class": "residential", "town_speed": "present"}, "set": {"speed_limit": {"$field": "town_speed"}}}
    rules = [town, *[{"when": {"functional_class": classes}, "set": {"speed_limit": mph}} for mph, classes in by_class.items()]]
    out.register(Attribute("speed_limit", fallback=read_program({"rules": [{"when": {"speed_limit": "is_null"}, "rules": rules}]})))
    several, single = _WITH_LINK("primary", "secondary", "trunk", "motorway"), [*_WITH_LINK("tertiary"), "residential", "living_street", "unclassified", "track", "path"]
    for d, against in (("ft", "tf"), ("tf", "ft")):
        lanes = [{"when": {"functional_class": classes}, "set": {f"{d}_lanes": n}} for n, classes in ((2, several), (1, single))]
        out.register(Attribute(f"{d}_lanes", fallback=read_program({"rules": [{"when": {f"{d}_lanes": "is_null", "one_way": {"not_in": [against]}}, "rules": lanes}]})))
    return out


def _converted(segments: DataFrame, units: DataFrame, value: str, quantity: str) -> DataFrame:
    return convert_units(segments.withColumn("__quantity", F.lit(quantity)), units, value, "__quantity", "__source").drop("__quantity", "number")


def with_attributes(segments: DataFrame, variables: Mapping[str, Any], extracts: DataFrame | None = None, cities: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """``segments`` with usable speed_limit, ft_lanes, tf_lanes and road_width_ft, and ``{column}_imputed`` flags.

    A recorded speed outside ``SPEEDS`` counts as missing; then maxspeed speaks, miles rounded to whole ones,
    other units to 5 mph; then the fallbacks. extracts: what each extract_source says of its bare numbers; where
    it says nothing of speeds, they have the unit ``speed_bare_unit``. cities, states: default speeds by code.
    """
    spark = segments.sparkSession
    segments = segments.withColumn("__source", F.coalesce("extract_source", F.lit("")) if "extract_source" in segments.columns else F.lit(""))
    units = spark.createDataFrame([], "source string, quantity string, unit string")
    if extracts is not None:
        units = source_units(extracts.dropDuplicates(["extract_source"]), "extract_source", {"speed": "bare_speed_unit", "length": "bare_width_unit"})
    silent = segments.select(F.col("__source").alias("source")).distinct().join(units.where("quantity = 'speed'"), "source", "left_anti")
    units = units.unionByName(silent.select("source", F.lit("speed").alias("quantity"), F.lit(variables.get("speed_bare_unit") or "km/h").alias("unit")))
    recorded = within(F.col("speed_limit"), *SPEEDS)
    if "maxspeed" in segments.columns:
        segments = _converted(segments, units, "maxspeed", "speed")
        step = F.when(F.col("unit_found") == "mph", 1).otherwise(5)
        recorded = F.coalesce(recorded, within((F.round(F.col("converted") / step) * step).cast("int"), *SPEEDS))
    segments = segments.withColumn("speed_limit", recorded).drop("converted", "unit_found")
    if "width_ft" in segments.columns:
        segments = _converted(segments, units, "width_ft", "length")
        segments = segments.withColumn("road_width_ft", within(F.col("converted"), *WIDTHS)).drop("converted", "unit_found")
    segments = segments.withColumns({c: within(F.col(c), *LANES) for c in ("ft_lanes", "tf_lanes")})
    # a column of facilities alone has widths, which the stress rules compare
    for d in [d for d in ("ft", "tf") if f"{d}_bike_infra" in segments.columns]:
        own = F.col(f"{d}_bike_infra_width") if f"{d}_bike_infra_width" in segments.columns else F.lit(None).cast("double")
        segments = segments.withColumn(f"{d}_bike_infra_width", F.coalesce(own, F.lit(FACILITY_FT)))
    city, state = F.lit(variables.get("city_default_speed")).cast("int"), F.lit(variables.get("state_default_speed")).cast("int")
    town = F.coalesce(city, state)
    if cities is not None and states is not None and "city_fips" in segments.columns:
        usable = lambda df: df.where(F.col("speed").between(*SPEEDS))
        codes = segments.select("city_fips").where("city_fips is not null").distinct()
        known = default_speeds(codes.withColumn("fips", F.col("city_fips")), usable(cities), usable(states))
        known = known.select("fips", "city_speed", "state_speed").distinct()
        segments = segments.withColumn("__fips", pad_code(F.col("city_fips"), 7)).join(known, F.col("__fips") == F.col("fips"), "left")
        town = F.coalesce(city, F.col("city_speed"), state, F.col("state_speed"))
    segments = segments.withColumn("town_speed", town.cast("int")).drop("__fips", "fips", "city_speed", "state_speed", "__source")
    return registry().run(segments, tag_map=None).drop("town_speed")
