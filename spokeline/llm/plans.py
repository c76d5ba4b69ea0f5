"""The queries of the training-data problems (p5, p6, p8, p9, p10) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeline.llm.components import group_records
from spokeline.llm.encode import decode_corpus, encode_corpus
from spokeline.llm.pack import pack_texts
from spokeline.llm.quantile_sketch import percentiles
from spokeline.llm.reading import reading_levels
from spokeline.session import keep
from spokeline.sources.tables import latest_rows, table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every road: roads that share nodes, directly or over others."""
    segments = keep(latest_rows(table(spark, d, "segments"), ["road_id"], "extracted_at", ["start_node_id", "end_node_id"]))
    ends = segments.select("road_id", F.explode(F.array("start_node_id", "end_node_id")).alias("key"))
    return group_records(segments, "road_id", ends, keys=table(spark, d, "nodes").select(F.col("node_id").alias("key")))


PERCENTS = (25, 50, 75, 90, 95, 99)


def _reach(spark: SparkSession, d: str) -> DataFrame:
    fields = ("pop_low_stress", "pop_high_stress")
    rows = latest_rows(table(spark, d, "destinations"), ["id"], "loaded_at", ["dest_type", *fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields]))
    return rows.select("dest_type", pairs.alias("p")).select("dest_type", "p.*").where("v >= 0")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of both reach columns per destination type."""
    found = percentiles(_reach(spark, d), ["dest_type", "field"], "v", PERCENTS)
    return found.withColumn("amount", F.col("amount").cast("bigint"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    """Every document encoded and decoded again: its text."""
    return decode_corpus(p8_ids(spark, d))


#: Tokens in a container.
CAPACITY = 2048


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of one larger than a container."""
    return pack_texts(table(spark, d, "documents"), CAPACITY)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens, the fewest containers possible, and how many are over capacity (none)."""
    sizes = p9_pack(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return sizes.agg(
        F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.ceil(F.sum("n") / CAPACITY).alias("least_containers"),
        F.count_if(F.col("n") > CAPACITY).alias("over_capacity"), (F.sum("n") / (F.count("*") * CAPACITY)).alias("fill"),
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Reading level of every document with enough words."""
    return reading_levels(table(spark, d, "documents"), table(spark, d, "level_grades").select("doc_id", "rater", "reading_level"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and reading level."""
    levels = p10_found(spark, d)
    return table(spark, d, "documents").select("doc_id", "source").join(levels, "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("n"))


QUERIES = {"p5_found": p5_found, "p6_found": p6_found, "p8_ids": p8_ids, "p8_text": p8_text, "p9_pack": p9_pack, "p9_report": p9_report, "p10_found": p10_found, "p10_profile": p10_profile}
def _latest(name: str, key: str, at: str) -> str:
    return f"(select * exclude (rn) from (select *, row_number() over (partition by {key} order by {at} desc) rn from {name}) where rn = 1)"


ORACLES = {
    # the least road spreads over shared nodes until nothing changes
    "p5_found": f"""with recursive s as {_latest("segments", "road_id", "extracted_at")}, l as (select distinct road_id, node_id from (select road_id, start_node_id as node_id from s union all select road_id, end_node_id from s) where node_id in (select node_id from nodes)),
      e as (select distinct a.road_id as a, b.road_id as b from l a join l b using (node_id) where a.road_id <> b.road_id),
      g(road_id, group_id) using key (road_id) as (select road_id, road_id from s where road_id is not null union select e.b, min(g.group_id) from g join e on g.road_id = e.a join recurring.g as old on old.road_id = e.b where g.group_id < old.group_id group by e.b)
      select road_id, group_id from g""",
    # groups of up to 2048 values are exact
    "p6_found": f"""with d as (select dest_type, unnest([{{'field': 'pop_low_stress', 'v': pop_low_stress}}, {{'field': 'pop_high_stress', 'v': pop_high_stress}}], recursive := true) from {_latest("destinations", "id", "loaded_at")}),
      r as (select *, row_number() over (partition by dest_type, field order by v) as rn, count(*) over (partition by dest_type, field) as n from d where v >= 0), p as (select unnest([25, 50, 75, 90, 95, 99])::int as percentile)
      select dest_type, field, percentile, min(v)::bigint as amount from r, p where rn * 100 >= n * percentile group by 1, 2, 3""",
    "p8_text": "select doc_id, coalesce(text, '') as text from documents",
}
