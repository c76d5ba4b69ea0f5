"""Queries of scores, city tables, analysis, validation and export; suppliers and customers stand in as blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spokeline.catalog import Catalog, DestinationType
from spokeline.functions import scoring
from spokeline.operators import city, scores
from spokeline.operators.destinations import block_lists, cluster_types, outside_regions
from spokeline.operators.near import regions_of, with_place
from spokeline.plans.reference import BLOCK, DEST, NODE, SEG, nodes_of, query_table, segments_of
from spokeline.plans.stress import segment_stress_program
from spokeline.rules import analysis, read_program
from spokeline.session import keep
from spokeline.sinks import export
from spokeline.sources.files import default_speeds, union_regions
from spokeline.sources.tables import latest_rows, table
from spokeline.streaming.rules import decide_stream, run_once, stream_table, windowed_counts

QUERIES, ORACLES, query = query_table()


def _access_sql(low: str, high: str) -> str:
    r = f"({low}::double / nullif({high}::double, 0))"
    return f"""case when {high} is null or {high} = 0 or {low} is null then null when {low} = 0 then 0.0 when {r} >= 1 then 1.0 when {r} <= 0.03 then 0.1 * {r} / 0.03 when {r} <= 0.2 then 0.1 + 0.3 * ({r} - 0.03) / 0.17
      when {r} <= 0.5 then 0.4 + 0.4 * ({r} - 0.2) / 0.3 else 0.8 + 0.2 * ({r} - 0.5) / 0.5 end"""


def _dest_sql(low: str, high: str, a: float, b: float, c: float) -> str:
    return f"""case when {high} = 0 or {high} is null then null when {low} = 0 then 0.0 when {low} = {high} then 1.0 when {low} = 1 then {a} when {low} = 2 then {a + b} when {low} = 3 then {a + b + c}
      else {a + b + c} + (1.0 - {a + b + c}) * ({low} - 3)::double / ({high} - 3) end"""


_PAIRS = "p as (select l_suppkey as source_block, o_custkey as target_block, min(l_discount) <= 0.01 as low_stress from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"
#: Credit for the first three destinations of a type.
TYPES = {"building": (0.4, 0.2, 0.1), "machinery": (0.7, 0.2, 0.05)}
_SEGMENTS = {"building": "BUILDING", "machinery": "MACHINERY"}


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Supplier and customer pairs as pairs of blocks; low-stress if any item came at a small discount."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_discount")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_suppkey").alias("source_block"), F.col("o_custkey").alias("target_block")).agg((F.min("l_discount") <= 0.01).alias("low_stress"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("block"))


def _people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("block"), F.floor(F.abs("c_acctbal")).cast("bigint").alias("amount"))


_REACH = f"{_PAIRS}, a as (select s_suppkey as block, coalesce(sum(floor(abs(c_acctbal))::bigint), 0)::bigint as high, coalesce(sum(case when low_stress then floor(abs(c_acctbal))::bigint end), 0)::bigint as low from supplier left join p on s_suppkey = source_block left join customer on c_custkey = target_block group by 1)"
_COUNTS = f"""{_PAIRS}, t as (select s_suppkey as block, {", ".join(f"count(distinct case when c_mktsegment = '{m}' then c_custkey end) as {k}_high, count(distinct case when c_mktsegment = '{m}' and low_stress then c_custkey end) as {k}_low" for k, m in _SEGMENTS.items())}
    from supplier left join p on s_suppkey = source_block left join customer on c_custkey = target_block group by 1), d as (select *, {", ".join(f"{_dest_sql(f'{k}_low', f'{k}_high', *TYPES[k])} as {k}_score" for k in TYPES)} from t)"""


@query(f"with {_REACH} select block, high, low, round({_access_sql('low', 'high')}, 6) as score from a")
def access_population_score(spark: SparkSession, d: str) -> DataFrame:
    """People each block reaches, in all and at low stress, and the score of the ratio."""
    found = city.block_access(_pairs(spark, d), _people(spark, d), _blocks(spark, d))
    return found.withColumn("score", F.round("score", 6))


def _destinations(spark: SparkSession, d: str) -> DataFrame:
    kind = F.lower("c_mktsegment")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), kind.alias("dest_type"), F.array("c_custkey").alias("blockid20"))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return city.destination_access(_pairs(spark, d), _destinations(spark, d), _blocks(spark, d), TYPES)


@query(f"with {_COUNTS} select block, {', '.join(f'{k}_high, {k}_low, round({k}_score, 6) as {k}_score' for k in TYPES)} from d")
def access_destination_score(spark: SparkSession, d: str) -> DataFrame:
    """Distinct destinations of every type reached by each block, in one aggregate."""
    return _counted(spark, d).withColumns({f"{k}_score": F.round(f"{k}_score", 6) for k in TYPES})


_CATEGORY = "(coalesce(building_score, 0) * 30 + coalesce(machinery_score, 0) * 20) / nullif(case when building_score is not null then 30 else 0 end + case when machinery_score is not null then 20 else 0 end, 0)"


@query(f"with {_COUNTS} select block, round({_CATEGORY}, 6) as category_score from d")
def category_weighted_score(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the scores that exist, by weight."""
    score = scoring.weighted_mean([(F.col("building_score"), 30.0), (F.col("machinery_score"), 20.0)])
    return _counted(spark, d).select("block", F.round(score, 6).alias("category_score"))


_OVERALL = f"with {_REACH}, {_COUNTS[len(_PAIRS) + 2 :]}, x as (select block, {_access_sql('low', 'high')} as pop, {_CATEGORY} as cat, building_high > 0 or machinery_high > 0 as there from a join d using (block))"


@query(f"{_OVERALL} select block, round(100 * (15 * coalesce(pop, 0) + case when there then 25 * coalesce(cat, 0) else 0 end) / (15 + case when there then 25 else 0 end), 5) as overall_score from x")
def overall_block_score(spark: SparkSession, d: str) -> DataFrame:
    """Population and categories put together; a category counts only where anything of it is reachable."""
    people = city.block_access(_pairs(spark, d), _people(spark, d), _blocks(spark, d))
    category = scoring.weighted_mean([(F.col("building_score"), 30.0), (F.col("machinery_score"), 20.0)])
    joined = people.join(_counted(spark, d), "block")
    overall = scoring.overall_score(F.col("score"), 15.0, [(category, 25.0, (F.col("building_high") > 0) | (F.col("machinery_high") > 0))])
    return joined.select("block", F.round(overall, 5).alias("overall_score"))


@query(f"with {_PAIRS} select source_block as block, count(*) as reachable_blocks, count(*) filter (where low_stress) as reachable_low from p group by 1")
def reachable_blocks_count(spark: SparkSession, d: str) -> DataFrame:
    return scores.reachable_blocks(_pairs(spark, d))


_DRATIO = f"d as (select dest_type, pop_low_stress as l, pop_high_stress as h from {DEST} where pop_low_stress >= 0 and pop_high_stress >= 0)"


@query(f"""with {_DRATIO} select dest_type, {", ".join(f"round(quantile_cont(case when h > 0 then l::double / h end, {q}), 6) as p{round(q * 100)}" for q in (0.3, 0.5, 0.7))},
    round(coalesce(sum(l)::double / nullif(sum(h), 0), 0), 6) as average, floor(coalesce(sum(l)::double / nullif(sum(h), 0), 0))::bigint as whole_average from d group by 1""")
def score_inputs_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles and averages of low- to high-stress reach by destination type."""
    df = latest_rows(table(spark, d, "destinations"), ["id"], "loaded_at", ["dest_type", "pop_low_stress", "pop_high_stress"]).where("pop_low_stress >= 0 and pop_high_stress >= 0")
    out = city.ratio_percentiles(df, "pop_low_stress", "pop_high_stress", by=["dest_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("p30", "p50", "p70", "average")})


@query(f"""with {_REACH}, s as (select block, {_access_sql('low', 'high')} as score, high, low from a) select 1 as id, 'mean score by people' as name, round(coalesce(sum(score * high) / nullif(sum(high)::double, 0), 0), 5) as value from s
    union all select 2, 'mean score by people where any', round(coalesce(sum(case when low > 0 then score * high end) / nullif(sum(case when low > 0 then high end)::double, 0), 0), 5) from s
    union all select 3, 'blocks with a score', count(score)::double from s union all select 4, 'any people', max(case when high > 0 then 1 else 0 end)::double from s""")  # fmt: skip
def city_overall_rows(spark: SparkSession, d: str) -> DataFrame:
    """City figures from one aggregate, as rows with fixed numbers."""
    df = city.block_access(_pairs(spark, d), _people(spark, d), _blocks(spark, d))
    row = df.agg(city.weighted_by("score", "high").alias("a"), city.weighted_by("score", "high", F.col("low") > 0).alias("b"), F.count("score").alias("c"), F.max((F.col("high") > 0).cast("int")).alias("e"))
    values = {"mean score by people": F.round("a", 5), "mean score by people where any": F.round("b", 5), "blocks with a score": F.col("c"), "any people": F.col("e")}
    return city.long_table(row, values)


#: Two types and jobs for the scores of blocks and city: customers are blocks, with their orders as jobs.
_CATALOG = Catalog((DestinationType("building", "core_services", 0.6, TYPES["building"]), DestinationType("machinery", "opportunity", 0.5, TYPES["machinery"])), {"core_services": 50, "opportunity": 35})
_SCORED = f"""{_PAIRS}, blk as (select c_custkey as block, c_mktsegment as seg, floor(abs(c_acctbal))::bigint as pop, coalesce(n, 0) as jobs from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey),
    a as (select source_block as block, count(*) as n, {", ".join(f"sum({v})::bigint as {k}_h, sum(case when low_stress then {v} else 0 end)::bigint as {k}_l" for k, v in (("pop", "pop"), ("emp", "jobs"), ("building", "(seg = 'BUILDING')::int"), ("machinery", "(seg = 'MACHINERY')::int")))} from p join blk on target_block = blk.block group by 1),
    h as (select blk.block, pop, n, pop_h, coalesce(pop_l, 0) as pop_l, emp_h, coalesce(emp_l, 0) as emp_l, {", ".join(f"coalesce({k}_{x}, 0) as {k}_{x}" for k in TYPES for x in "hl")} from blk left join a using (block)),
    s as (select *, {_access_sql("pop_l", "pop_h")} as pop_s, {_access_sql("emp_l", "emp_h")} as emp_s, {_dest_sql("building_l", "building_h", *TYPES["building"])} as building_s, {_dest_sql("machinery_l", "machinery_h", *TYPES["machinery"])} as machinery_s from h),
    o as (select *, (coalesce(machinery_s, 0) * 0.5 + coalesce(emp_s, 0) * 0.5) / nullif((machinery_s is not null)::int * 0.5 + (emp_s is not null)::int * 0.5, 0) as opportunity,
      case when pop_h is not null then 100 * (15 * coalesce(pop_s, 0) + case when building_h > 0 then 50 * coalesce(building_s, 0) else 0 end + case when machinery_h > 0 then 35 * (0.5 * coalesce(machinery_s, 0) + 0.5 * coalesce(emp_s, 0)) else 0 end)
        / (15 + case when building_h > 0 then 50 else 0 end + case when machinery_h > 0 then 35 else 0 end) end as overall from s)"""


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, blocks and their scores."""
    pairs = keep(_pairs(spark, d))
    blocks = _people(spark, d).withColumnRenamed("amount", "pop20")
    jobs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("block")).agg(F.count("*").alias("amount"))
    return pairs, blocks, keep(scores.block_scores(pairs, blocks, _destinations(spark, d), _CATALOG, jobs))


@query(f"""with {_SCORED} select block, pop_h as pop_high_stress, emp_l as emp_low_stress, building_h as building_high_stress, machinery_l as machinery_low_stress, round(emp_s, 6) as emp_score, round(building_s, 6) as core_services_score,
    round(opportunity, 6) as opportunity_score, round(overall, 5) as overall_score from o""")
def scores_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with what they reach, their categories and overall score; those that reach nothing have none."""
    found = _scored(spark, d)[2]
    return found.select("block", "pop_high_stress", "emp_low_stress", "building_high_stress", "machinery_low_stress", *[F.round(c, 6).alias(c) for c in ("emp_score", "core_services_score", "opportunity_score")], F.round("overall_score", 5).alias("overall_score"))


def _inputs_sql() -> str:
    share = lambda k, q: f"round(quantile_cont(case when {k}_h > 0 then {k}_l::double / {k}_h end, {q}), 4)"
    average = lambda k, whole: f"round(coalesce({'floor' if whole else ''}(sum({k}_l)::double / nullif(sum({k}_h), 0)), 0), 4)"
    mean = lambda k, only: f"round(coalesce(sum(pop * {k}_s) / nullif(sum(pop){only}, 0), 0), 4)"
    rows = []
    for start, k, category, noun, what in ((1, "pop", "People", "population", "population"), (6, "emp", "Opportunity", "employment", "jobs")):
        rows += [(start + i, category, f"{n} score of access to {noun}", share(k, q), "") for i, (n, q) in enumerate((("Median", 0.5), ("70th percentile", 0.7), ("30th percentile", 0.3)))]
        rows += [(start + 3, category, f"Average score of access to {noun}", average(k, False), ""), (start + 4, category, f"Average score of access to {what}", mean(k, ""), f"use_{k}")]
    for start, k, category in ((133, "building", "Core Services"), (142, "machinery", "Opportunity")):
        named = (("Median", 0.5), ("70th percentile", 0.7), ("30th percentile", 0.3))
        rows.append((start, category, f"Average score of low stress access to {k}", average(k, True), ""))
        rows += [(start + 1 + i, category, f"{n} score of {k} access", share(k, q), "") for i, (n, q) in enumerate(named)]
        rows += [(start + 4, category, f"Average score of access to {k}", mean(k, f" filter (where {k}_h > 0)"), f"use_{k}"), (start + 5, category, f"Average {k} bike shed access score", "max(null::double)", "")]
        rows += [(start + 6 + i, category, f"{n} {k} population shed score", "max(null::double)", "") for i, (n, q) in enumerate(named)]
    return " union all ".join(f"select {i} as id, '{c}' as category, '{n}' as score_name, {e} as score, {f"'{f}'" if f else 'null'} as use_flag from o" for i, c, n, e, f in rows)


@query(f"with {_SCORED} {_inputs_sql()}")
def scores_city_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The long table of the city's figures: medians, percentiles, averages, means by people, by type."""
    pairs, blocks, found = _scored(spark, d)
    return scores.score_inputs(scores.city_aggregates(found, blocks, pairs, _CATALOG), _CATALOG)


_STRESS = "(select case when isnan(ft_seg_stress) then null else ft_seg_stress end as f, case when isnan(tf_seg_stress) then null else tf_seg_stress end as t, length_m from (select *, row_number() over (partition by road_id order by loaded_at desc) rn from stress_reference) where rn = 1 and length_m > 0 and length_m < 100000 and not isnan(length_m))"
_MILES = f"""m as (select coalesce(sum(length_m * case when ok then (coalesce(f, 0) = 1)::int + (coalesce(t, 0) = 1)::int else 0 end) / 1609.34, 0) as low, coalesce(sum(length_m * case when ok then (coalesce(f, 0) = 3)::int + (coalesce(t, 0) = 3)::int else 0 end) / 1609.34, 0) as high
    from (select *, coalesce(f, 0) in (0, 1, 3) and coalesce(t, 0) in (0, 1, 3) as ok from {_STRESS}))"""


@query(f"""with {_SCORED}, {_MILES}, w as (select round(coalesce(sum(pop * pop_s) / nullif(sum(pop), 0), 0), 4) as people, round(coalesce(sum(pop * emp_s) / nullif(sum(pop), 0), 0), 4) as jobs, round(coalesce(sum(pop * building_s) / nullif(sum(pop) filter (where building_h > 0), 0), 0), 4) as building,
      round(coalesce(sum(pop * machinery_s) / nullif(sum(pop) filter (where machinery_h > 0), 0), 0), 4) as machinery, coalesce(sum(overall / 100 * pop) filter (where n > 0 and pop > 0) / nullif(sum(pop) filter (where n > 0), 0), 0) as whole, sum(pop)::double as total,
      coalesce(bool_or(machinery_h > 0), false)::int as has_m, coalesce(bool_or(emp_h > 0), false)::int as has_e from o),
    r as (select 1 as place, 'people' as score_id, people as v from w union all select 2, 'opportunity_employment', jobs from w union all select 3, 'core_services_building', building from w union all select 4, 'opportunity_machinery', machinery from w
      union all select 5, 'opportunity', (0.5 * machinery * has_m + 0.5 * jobs * has_e) / nullif(0.5 * has_m + 0.5 * has_e, 0) from w union all select 6, 'overall_score', whole from w union all select 7, 'population_total', total from w
      union all select 8, 'total_miles_low_stress', low from m union all select 9, 'total_miles_high_stress', high from m)
    select place, score_id, round(v, 6) as score_original, case when place = 7 then null when place >= 8 then round(v, 1) else round(v * 100, 4) end as score_normalized from r""")
def scores_city(spark: SparkSession, d: str) -> DataFrame:
    """People, jobs, types, categories, the city as a whole, and its miles."""
    pairs, blocks, found = _scored(spark, d)
    rows = scores.city_scores(scores.city_aggregates(found, blocks, pairs, _CATALOG), _CATALOG, city.stress_miles(_stress_rows(spark, d)))
    return rows.withColumns({"score_original": F.round("score_original", 6), "score_normalized": F.round("score_normalized", 4)})


_LEN = "length_m > 0 and length_m < 100000 and not isnan(length_m)"


@query(f"""with s as (select * from {SEG} where {_LEN}) select feature_type, round(sum(length_m) / 1609.34, 4) as total_mileage from (select 'path' as feature_type, length_m from s where functional_class = 'path' union all select 'one_way', length_m from s where one_way is not null
    union all select 'fast', length_m from s where speed_limit > 40) group by 1""")
def mileage_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Miles of kinds of streets that overlap."""
    df = segments_of(spark, d, "length_m", "functional_class", "one_way", "speed_limit").where(_LEN)
    kinds = {"path": F.col("functional_class") == "path", "one_way": F.col("one_way").isNotNull(), "fast": F.col("speed_limit") > 40}
    return city.mileage(df, kinds).withColumn("total_mileage", F.round("total_mileage", 4))


def _stress_rows(spark: SparkSession, d: str) -> DataFrame:
    df = latest_rows(table(spark, d, "stress_reference"), ["road_id"], "loaded_at", ["length_m", "ft_seg_stress", "tf_seg_stress"]).where(_LEN)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("ft_seg_stress", "tf_seg_stress")})


@query(f"with {_MILES} select round(low, 4) as low_miles, round(high, 4) as high_miles from m")
def total_miles(spark: SparkSession, d: str) -> DataFrame:
    """Miles of low and of high stress, each open direction counted."""
    return city.stress_miles(_stress_rows(spark, d)).select(*[F.round(c, 4).alias(c) for c in ("low_miles", "high_miles")])


@query("select lpad(l_suppkey::varchar, 15, '0') as blockid20, sum(l_quantity::bigint)::bigint as jobs from lineitem group by 1 having sum(l_quantity::bigint) > 0")
def jobs_by_block(spark: SparkSession, d: str) -> DataFrame:
    return city.jobs_per_block(table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("bigint").alias("n")), "l_suppkey", "n")


@query("select c_custkey as k, min(c_nationkey) as nation from (select * from customer where c_nationkey < 15 union all select * from customer where c_nationkey > 10) group by 1")
def multi_region_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping regions put together, each key once."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    return union_regions([c.where("nation < 15"), c.where("nation > 10")], ["k"])


@query(f"select geoid20, case when coalesce(aland20, 0) <= 0 then 'water' when coalesce(pop20, 0) % 4 < 2 then 'outside' else 'included' end as block_class from {BLOCK}")
def block_classify(spark: SparkSession, d: str) -> DataFrame:
    """Water before outside before included."""
    df = latest_rows(table(spark, d, "census_blocks"), ["geoid20"], "extracted_at", ["aland20", "pop20"])
    return city.classify_blocks(df, (F.coalesce("pop20", F.lit(0)) % 4) / 4).select("geoid20", "block_class")


@query("select x.range * 200 as x_m, y.range * 200 as y_m, 100 as pop20 from range(0, 26) x, range(0, 16) y")
def synthetic_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cells of 200 m over a box, for places without a census."""
    return spark.range(26).select((F.col("id") * 200).alias("x_m"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k")).select("x_m", (F.col("k") * 200).cast("bigint").alias("y_m"), F.lit(100).alias("pop20"))


@query(f"select functional_class, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from {SEG} group by 1")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    df = segments_of(spark, d, "functional_class").groupBy("functional_class").agg(F.count("*").alias("n"))
    return df.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"""select distinct lpad(s.city_fips, 7, '0') as fips, c.v as city_speed, t.v as state_speed, coalesce(c.v, t.v) as speed from {SEG} s left join (select lpad(fips_code_city, 7, '0') k, min(speed) v from city_fips_speed group by 1) c on lpad(s.city_fips, 7, '0') = c.k
    left join (select lpad(fips_code_state, 2, '0') k, min(speed) v from state_fips_speed group by 1) t on left(lpad(s.city_fips, 7, '0'), 2) = t.k""")
def fips_default_speeds(spark: SparkSession, d: str) -> DataFrame:
    """Default speed of every town: its own, else its state's."""
    towns = segments_of(spark, d, "city_fips").select(F.col("city_fips").alias("fips")).distinct()
    return default_speeds(towns, table(spark, d, "city_fips_speed"), table(spark, d, "state_fips_speed")).distinct()


def _places(spark: SparkSession, d: str) -> DataFrame:
    poi = latest_rows(table(spark, d, "poi_raw"), ["osm_id"], "extracted_at", ["geometry", "matched_types"])
    return keep(with_place(poi, "geometry").where("lat is not null").select(F.col("osm_id").alias("id"), "lon", "lat", F.element_at(F.filter("matched_types", lambda x: x.isNotNull()), -1).alias("kind")))


@query()
def poi_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Places of one type within 50 m of each other, directly or over others, as one destination of that type."""
    poi = latest_rows(table(spark, d, "poi_raw"), ["osm_id"], "extracted_at", ["geometry", "matched_types"])
    places = with_place(poi, "geometry").where("lat is not null").select(F.col("osm_id").alias("id"), "lon", "lat", F.explode("matched_types").alias("type")).where("type is not null")
    return cluster_types(places, 50.0, "type")


@query()
def poi_block_lists(spark: SparkSession, d: str) -> DataFrame:
    """The census blocks of every place."""
    blocks = latest_rows(table(spark, d, "census_blocks"), ["geoid20"], "extracted_at", ["geometry"])
    return block_lists(keep(regions_of(blocks, "geometry").withColumnRenamed("geoid20", "iid")), _places(spark, d))


@query()
def poi_outside_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Places that no census block holds."""
    blocks = latest_rows(table(spark, d, "census_blocks"), ["geoid20"], "extracted_at", ["geometry"])
    return outside_regions(keep(regions_of(blocks, "geometry").withColumnRenamed("geoid20", "iid")), _places(spark, d))


# --- analysis --------------------------------------------------------------------------------------------

_RULES = {"name": "comfort", "rules": [
    {"id": "busy", "when": {"functional_class": ["primary", "trunk"], "speed_limit": {"gt": {"$var": "bound"}}}, "set": {"comfort": "low"}},
    {"id": "wide", "when": {"functional_class": ["primary", "trunk"], "ft_lanes": {"ge": 3}}, "set": {"comfort": "fair"}},
    {"id": "calm", "when": {"speed_limit": {"le": 20}}, "set": {"comfort": "high"}},
], "default": {"comfort": "unknown"}}
_RULES_CASE = "case when functional_class in ('primary', 'trunk') and speed_limit > {b} then {low} when functional_class in ('primary', 'trunk') and ft_lanes >= 3 then {fair} when speed_limit <= 20 then {high} else {rest} end"
_COMFORT = lambda bound: _RULES_CASE.format(b=bound, low="'low'", fair="'fair'", high="'high'", rest="'unknown'")


@query(f"""with c as (select f.functional_class in ('primary', 'trunk') as main, s.speed_limit, l.ft_lanes >= 3 as wide, {_COMFORT(45)} as comfort
      from (values ('primary'), ('trunk'), ('other'), (null)) f(functional_class), (select unnest(range(0, 100)) as speed_limit union all select null) s, (select unnest(range(0, 9)) as ft_lanes union all select null) l)
    select comfort, count(*) as n from (select distinct coalesce(main, false) as main, coalesce(speed_limit > 45, false) as fast, coalesce(speed_limit <= 20, false) as slow, coalesce(wide, false) as wide, comfort from c) group by 1""")
def contexts_enumerate(spark: SparkSession, d: str) -> DataFrame:
    """Every context that the rules can tell apart, decided: the SQL tries all values and counts the distinct outcomes of the tests."""
    return analysis.contexts(spark, read_program(_RULES), variables={"bound": 45}).groupBy("comfort").agg(F.count("*").alias("n"))


@query(f"select road_id, {_COMFORT(45)} as comfort_before, {_COMFORT(30)} as comfort_after, ({_COMFORT(45)}) <> ({_COMFORT(30)}) as changed from {SEG}")
def simulate_diff(spark: SparkSession, d: str) -> DataFrame:
    """What a changed variable would change."""
    program = read_program(_RULES)
    out = analysis.simulate(segments_of(spark, d, "functional_class", "speed_limit", "ft_lanes"), program, program, {"bound": 45}, {"bound": 30})
    return out.select("road_id", "comfort_before", "comfort_after", "changed")


@query(f"""select 'comfort' as pass, 'comfort' as output, {_RULES_CASE.format(b=45, low="'busy'", fair="'wide'", high="'calm'", rest="'default'")} as winner, count(*) as n from {SEG} group by 3""")
def rule_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each rule decides."""
    return analysis.coverage(segments_of(spark, d, "functional_class", "speed_limit", "ft_lanes"), read_program(_RULES), {"bound": 45})


@query("select 'pass0' as pass, 'y' as output, 'b' as rule, 'a' as by")
def rule_unreachable(spark: SparkSession, d: str) -> DataFrame:
    """Rules that can never decide, of the stress rules and of a program that has one."""
    shadowed = read_program({"rules": [{"id": "a", "when": {"x": {"gt": 1}}, "set": {"y": 1}}, {"id": "b", "when": {"x": {"gt": 2}, "z": "k"}, "set": {"y": 2}}]})
    rows = analysis.unreachable(segment_stress_program()) + analysis.unreachable(shadowed)
    return spark.createDataFrame(rows, "pass string, output string, rule string, by string")


# --- validation ------------------------------------------------------------------------------------------


@query("""select road_id, 'reference' as side from (select distinct road_id from stress_reference except select distinct road_id from stress_computed) union all
    select road_id, 'computed' from (select distinct road_id from stress_computed except select distinct road_id from stress_reference)""")
def key_except_both(spark: SparkSession, d: str) -> DataFrame:
    """Keys that only one of two tables has."""
    a, b = (table(spark, d, t).select("road_id").distinct() for t in ("stress_reference", "stress_computed"))
    return a.subtract(b).withColumn("side", F.lit("reference")).unionAll(b.subtract(a).withColumn("side", F.lit("computed")))


@query(f"""with a as (select start_node_id as s, end_node_id as t from {SEG} where functional_class is distinct from 'path'), b as (select start_node_id as s, end_node_id as t from {SEG} where functional_class is distinct from 'track')
    select s, t, sum(x)::bigint as n_reference, sum(y)::bigint as n_computed from (select s, t, 1 as x, 0 as y from a union all select s, t, 0, 1 from b) group by 1, 2 having sum(x) <> sum(y)""")
def graph_edge_diff(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose number differs between two graphs, counted in one aggregate."""
    df = segments_of(spark, d, "start_node_id", "end_node_id", "functional_class").select(F.col("start_node_id").alias("s"), F.col("end_node_id").alias("t"), (~F.col("functional_class").eqNullSafe("path")).cast("bigint").alias("x"), (~F.col("functional_class").eqNullSafe("track")).cast("bigint").alias("y"))
    return df.groupBy("s", "t").agg(F.sum("x").alias("n_reference"), F.sum("y").alias("n_computed")).where("n_reference <> n_computed")


# --- export ----------------------------------------------------------------------------------------------


@query(f"select node_id, case when signalized then 't' when not signalized then 'f' end as signalized, case when stop then 't' when not stop then 'f' end as stop from {NODE}")
def export_bool_tf(spark: SparkSession, d: str) -> DataFrame:
    return export.bool_letters(nodes_of(spark, d).select("node_id", "signalized", "stop"))


@query(f"select b.geoid20, b.pop20, s.score from {BLOCK} b left join (select geoid20, max(aland20)::double / 1000 as score from census_blocks where pop20 > 50 group by 1) s using (geoid20)")
def export_blocks_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with their scores; blocks without one stay."""
    blocks = latest_rows(table(spark, d, "census_blocks"), ["geoid20"], "extracted_at", ["pop20"]).select("geoid20", "pop20")
    scores = table(spark, d, "census_blocks").where("pop20 > 50").groupBy(F.col("geoid20").alias("block")).agg((F.max("aland20").cast("double") / 1000).alias("score"))
    return export.build_target("census_blocks", {"blocks": blocks, "scores": scores})


@query(f"select n.node_id, n.lon, n.lat, l.legs from {NODE} n join (select node_id, count(*) as legs from (select start_node_id as node_id from {SEG} union all select end_node_id from {SEG}) group by 1) l using (node_id)")
def export_intersections(spark: SparkSession, d: str) -> DataFrame:
    return export.build_target("intersections", {"segments": segments_of(spark, d, "start_node_id", "end_node_id"), "nodes": nodes_of(spark, d).select("node_id", "lon", "lat")})


@query(f"""select '{{"type":"Feature","id":' || s_suppkey || ',"geometry":{{"type":"Point","coordinates":[' || (s_nationkey * 1.5)::double || ',' || (s_nationkey + 0.25)::double || ']}},"properties":{{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}}}}' as value from supplier""")
def export_geojson(spark: SparkSession, d: str) -> DataFrame:
    """GeoJSON features, one per row."""
    df = table(spark, d, "supplier")
    lon, lat = (F.col("s_nationkey") * 1.5).cast("double"), (F.col("s_nationkey") + 0.25).cast("double")
    named = df.select("s_suppkey", "s_name", lon.alias("__x"), lat.alias("__y"))
    features = named.select(F.struct(F.lit("Feature").alias("type"), F.col("s_suppkey").alias("id"), export.point_geometry(F.col("__x"), F.col("__y")).alias("geometry"), F.struct("s_suppkey", "s_name").alias("properties")).alias("f"))
    return features.select(F.to_json("f", {"ignoreNullFields": "false"}).alias("value"))


# --- streams ---------------------------------------------------------------------------------------------


@query("select event_id, case when value > 90 then 'high' when event_type = 'click' then 'click' else 'rest' end as kind from events")
def stream_rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule program over a stream of events, driven to its end."""
    schema = table(spark, d, "events").schema
    program = read_program({"rules": [{"when": {"value": {"gt": 90}}, "set": {"kind": "high"}}, {"when": {"event_type": "click"}, "set": {"kind": "click"}}], "default": {"kind": "rest"}})
    return run_once(decide_stream(stream_table(spark, d, schema, "events.parquet"), program).select("event_id", "kind"))


@query("select ts::date::varchar as day, event_type, count(*) as n from events group by 1, 2")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type over a stream; complete windows and open ones."""
    schema = table(spark, d, "events").schema
    events = stream_table(spark, d, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_counts(events, "ts", ["event_type"])
    return run_once(counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n"), "complete")
