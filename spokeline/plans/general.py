"""The queries of the general problems (p1 to p4 and p7) over the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeline.operators.fill_missing import filled, propagate
from spokeline.operators.near import containing_regions, near_points, regions_of, with_place
from spokeline.operators.split_values import split_values
from spokeline.operators.table_diff import diff_report, diff_statistics, diff_tables
from spokeline.operators.units import convert_units, hundredths, source_units
from spokeline.session import keep
from spokeline.sources.tables import latest_rows, pad_code, table

NEAR_M = 30.0


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within 30 m of every place, and the census block that holds it."""
    poi = latest_rows(table(spark, d, "poi_raw"), ["osm_id"], "extracted_at", ["geometry"])
    places = keep(with_place(poi, "geometry").where("lat is not null").select("osm_id", "lon", "lat"))
    nodes = latest_rows(table(spark, d, "nodes"), ["node_id"], "extracted_at", ["lon", "lat"])
    blocks = latest_rows(table(spark, d, "census_blocks"), ["geoid20"], "extracted_at", ["geometry"])
    regions = keep(regions_of(blocks, "geometry").withColumnRenamed("geoid20", "iid"))
    near = near_points(places.withColumnRenamed("osm_id", "iid"), nodes.withColumnRenamed("node_id", "pid"), NEAR_M)
    held = containing_regions(regions, places.withColumnRenamed("osm_id", "pid"))
    near = near.select(F.col("iid").alias("osm_id"), F.lit("node").alias("relation"), F.col("pid").cast("string").alias("other_id"))
    return near.unionAll(held.select(F.col("pid").alias("osm_id"), F.lit("block").alias("relation"), F.col("iid").alias("other_id")))


#: The poi_raw tags that may hold several values.
MULTI_TAGS = ("cuisine", "sport", "payment", "phone")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    segments = latest_rows(table(spark, d, "segments"), ["road_id"], "extracted_at", ["maxspeed"])
    # the tags in question before the row in force is picked: whole maps are costly to compare and move
    pois = table(spark, d, "poi_raw").select("osm_id", "extracted_at", *[F.try_element_at("tags", F.lit(k)).alias(k) for k in MULTI_TAGS])
    pois = latest_rows(pois, ["osm_id"], "extracted_at")
    tags = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("value")) for k in MULTI_TAGS]))
    pois = pois.withColumn("t", tags).select(F.lit("poi_raw").alias("source_table"), F.col("osm_id").alias("record_id"), "t.field", "t.value")
    segments = segments.select(F.lit("segments").alias("source_table"), F.col("road_id").alias("record_id"), F.lit("maxspeed").alias("field"), F.col("maxspeed").alias("value"))
    return segments.unionAll(pois).where("value is not null")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per item of every packed field that holds at least two."""
    split = split_values(keep(_packed(spark, d)))
    items = split.where(F.size("items") >= 2).select("source_table", "record_id", "field", F.posexplode("items").alias("pos", "item"))
    return items.withColumn("pos", F.col("pos") + 1)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """maxspeed and width_ft of single values in hundredths of mph and feet."""
    segments = latest_rows(table(spark, d, "segments"), ["road_id"], "extracted_at", ["maxspeed", "width_ft", "extract_source"])
    segments = keep(segments.where("maxspeed is not null or width_ft is not null"))
    speeds = segments.where("maxspeed is not null").select("road_id", F.lit("maxspeed").alias("field"), F.lit("speed").alias("quantity"), F.col("maxspeed").alias("value"), F.col("extract_source").alias("source"))
    speeds = split_values(speeds).where(F.size("items") == 1).withColumn("value", F.col("items")[0]).drop("items")
    widths = segments.where("width_ft is not null").select("road_id", F.lit("width_ft").alias("field"), F.lit("length").alias("quantity"), F.col("width_ft").alias("value"), F.col("extract_source").alias("source"))
    defaults = source_units(table(spark, d, "extracts").dropDuplicates(["extract_source"]), "extract_source", {"speed": "bare_speed_unit", "length": "bare_width_unit"})
    found = convert_units(speeds.unionByName(widths), defaults).where("converted is not null")
    return found.select("road_id", "field", hundredths(F.col("converted")).alias("hundredths"))


def _stress_differences(spark: SparkSession, d: str) -> DataFrame:
    reference, computed = (latest_rows(table(spark, d, t), ["road_id"], "loaded_at").drop("loaded_at") for t in ("stress_reference", "stress_computed"))
    return diff_tables(reference, computed, ["road_id"], tolerance=1e-6)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Roads missing in either copy, and every field that differs in the others."""
    return _stress_differences(spark, d).select("road_id", "diff")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """The same, counted."""
    return diff_report(_stress_differences(spark, d))


def stress_distances(spark: SparkSession, d: str) -> DataFrame:
    """How far both copies' numbers lie apart, by column."""
    found = diff_statistics(_stress_differences(spark, d))
    return found.select("diff", "n_differ", *[F.round(c, 5).alias(c) for c in ("max_abs", "mean_abs", "p50", "p95")])


def _within(column: str, low: int, high: int) -> Column:
    return F.when(F.col(column).between(low, high), F.col(column))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Missing speed limits, lanes and default speeds, filled from the same way, town and class or state."""
    segments = latest_rows(table(spark, d, "segments"), ["road_id"], "extracted_at", ["osm_id", "city_fips", "functional_class", "speed_limit", "ft_lanes"])
    segments = keep(segments.withColumns({"speed_limit": _within("speed_limit", 5, 85), "ft_lanes": _within("ft_lanes", 1, 8)}))
    way = F.col("osm_id").cast("string")
    town = F.when(F.col("functional_class").isNotNull(), F.concat_ws("|", pad_code(F.col("city_fips"), 7), "functional_class"))
    town = F.when(F.col("city_fips").isNotNull(), town)
    out = []
    for field in ("speed_limit", "ft_lanes"):
        found = filled(propagate(segments, field, [way, town]))
        out.append(found.select(F.lit("segments").alias("source_table"), F.col("road_id").cast("string").alias("row_key"), F.lit(field).alias("field"), F.col("label").cast("bigint").alias("filled")))

    # one speed for each code: a repeated code counts once, and is known if any of its rows knows it
    def speeds(name: str, code: str, width: int) -> DataFrame:
        rows = table(spark, d, name).where(F.col(code).isNotNull()).select(pad_code(F.col(code), width).alias("code"), _within("speed", 5, 85).alias("speed"))
        return rows.groupBy("code").agg(F.min("speed").alias("speed"))

    cities, states = speeds("city_fips_speed", "fips_code_city", 7), speeds("state_fips_speed", "fips_code_state", 2)
    both = cities.withColumn("is_city", F.lit(True)).unionAll(states.withColumn("is_city", F.lit(False)))
    state = F.substring("code", 1, 2)
    # cities speak to cities and states; a state speaks to its cities where none of them does
    tiers = [(F.when(F.col("is_city"), state), state), (F.when(~F.col("is_city"), state), F.when(F.col("is_city"), state))]
    name = F.when(F.col("is_city"), "city_fips_speed").otherwise("state_fips_speed")
    of_codes = filled(propagate(both, "speed", tiers)).select(name.alias("source_table"), F.col("code").alias("row_key"), F.lit("speed").alias("field"), F.col("label").cast("bigint").alias("filled"))
    return out[0].unionAll(out[1]).unionAll(of_codes)


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_report": p4_report, "stress_distances": stress_distances, "p7_found": p7_found}


def _latest(name: str, key: str, at: str) -> str:
    return f"(select * exclude (rn) from (select *, row_number() over (partition by {key} order by {at} desc) rn from {name}) where rn = 1)"


_NUMBERS = ("length_m", "ft_seg_stress", "tf_seg_stress", "ft_int_stress", "tf_int_stress")
_TEXTS = ("functional_class", "one_way")


def _copy_sql(name: str) -> str:
    plain = ", ".join(f"case when isnan({c}) then null else {c} end as {c}" for c in _NUMBERS)
    return f"(select road_id, {', '.join(_TEXTS)}, {plain} from {_latest(name, 'road_id', 'loaded_at')})"


_DIFFS = f"""r as {_copy_sql("stress_reference")}, c as {_copy_sql("stress_computed")}, both_ as (select {", ".join(f"r.{x} as r_{x}, c.{x} as c_{x}" for x in ("road_id", *_TEXTS, *_NUMBERS))} from r full join c on r.road_id is not distinct from c.road_id),
    d as (select coalesce(r_road_id, c_road_id) as road_id, 'rows_only_reference' as diff from both_ where c_road_id is null union all select c_road_id, 'rows_only_computed' from both_ where r_road_id is null
      {" ".join(f"union all select r_road_id, '{x}' from both_ where r_road_id is not null and c_road_id is not null and r_{x} is distinct from c_{x}" for x in _TEXTS)}
      {" ".join(f"union all select r_road_id, '{x}' from both_ where r_road_id is not null and c_road_id is not null and ((r_{x} is null) <> (c_{x} is null) or abs(r_{x} - c_{x}) > 1e-6)" for x in _NUMBERS)})"""


def _most_frequent(rows: str, group: str, value: str) -> str:
    """(g, v): the most frequent value of every group, the smaller of equal ones."""
    return f"(select g, v from (select *, row_number() over (partition by g order by n desc, v) as rn from (select {group} as g, {value} as v, count(*) as n from {rows} where {group} is not null and {value} is not null group by 1, 2)) where rn = 1)"


def _filled_sql(field: str, low: int, high: int) -> str:
    return f"""select 'segments' as source_table, s.road_id::varchar as row_key, '{field}' as field, coalesce(w.v, t.v)::bigint as filled from seg s left join {_most_frequent(f"(select *, case when {field} between {low} and {high} then {field} end as x from seg)", "osm_id", "x")} w on w.g = s.osm_id
      left join {_most_frequent(f"(select *, case when {field} between {low} and {high} then {field} end as x from seg)", "town", "x")} t on t.g = s.town where (s.{field} is null or s.{field} not between {low} and {high}) and coalesce(w.v, t.v) is not null"""


_CODES = """city as (select lpad(fips_code_city, 7, '0') as code, min(case when speed between 5 and 85 then speed end) as speed from city_fips_speed where fips_code_city is not null group by 1),
    state as (select lpad(fips_code_state, 2, '0') as code, min(case when speed between 5 and 85 then speed end) as speed from state_fips_speed where fips_code_state is not null group by 1)"""

_APART = f"""{_DIFFS}, q as (select d.diff, case d.diff {" ".join(f"when '{x}' then abs(r_{x} - c_{x})" for x in _NUMBERS)} end as v from d left join both_ on d.road_id = r_road_id and d.road_id = c_road_id)"""

ORACLES = {
    "stress_distances": f"with {_APART} select diff, count(*) as n_differ, round(max(v), 5) as max_abs, round(avg(v), 5) as mean_abs, round(quantile_cont(v, 0.5), 5) as p50, round(quantile_cont(v, 0.95), 5) as p95 from q group by 1",
    "p4_found": f"with {_DIFFS} select road_id, diff from d",
    "p4_report": f"with {_DIFFS} select diff, count(*) as n_differ from d group by 1",
    "p7_found": f"""with seg as (select *, case when city_fips is not null and functional_class is not null then lpad(city_fips, 7, '0') || '|' || functional_class end as town from {_latest("segments", "road_id", "extracted_at")}), {_CODES},
      best as {_most_frequent("city", "left(code, 2)", "speed")}
      {_filled_sql("speed_limit", 5, 85)} union all {_filled_sql("ft_lanes", 1, 8)}
      union all select 'city_fips_speed', c.code, 'speed', coalesce(b.v, s.speed)::bigint from city c left join best b on b.g = left(c.code, 2) left join state s on s.code = left(c.code, 2) where c.speed is null and coalesce(b.v, s.speed) is not null
      union all select 'state_fips_speed', s.code, 'speed', b.v::bigint from state s join best b on b.g = s.code where s.speed is null""",
}
