"""Bounded shortest paths from many sources, and what follows from them for pairs of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeline.session import Scratch


def bounded_reach(sources: DataFrame, edges: DataFrame, limit: float, most_rounds: int = 10_000) -> DataFrame:
    """(source, vert, cost): the least cost, at most ``limit``, from any start of a source to each vertex.

    sources: (source, vert), a source may have many starts; edges: (a, b, cost), costs not negative. Only what
    improved in a round goes on from it, joined with the edges by vertex; nothing is broadcast, so
    that the network may be of any size. Ends when nothing improves.
    """
    scratch = Scratch(sources.sparkSession)
    edges = scratch.keep(edges.where("a is not null and b is not null and cost is not null").groupBy("a", "b").agg(F.min("cost").cast("double").alias("w")))
    best = scratch.keep(sources.where("source is not null and vert is not null").select("source", "vert", F.lit(0.0).alias("cost")).distinct())
    front = best
    for _ in range(most_rounds):
        step = front.join(edges, front["vert"] == edges["a"]).select("source", F.col("b").alias("vert"), (F.col("cost") + F.col("w")).alias("cost")).where(F.col("cost") <= limit)
        step = step.groupBy("source", "vert").agg(F.min("cost").alias("new"))
        merged = scratch.keep(best.join(step, ["source", "vert"], "full_outer").select("source", "vert", F.least("cost", "new").alias("cost"), F.coalesce(F.col("new") < F.col("cost"), F.col("cost").isNull()).alias("better")))
        scratch.drop(best)
        best = merged.select("source", "vert", "cost")
        best._spokeline_path = merged._spokeline_path
        front = merged.where("better").select("source", "vert", "cost")
        if not front.limit(1).count():
            return best
    raise RuntimeError(f"costs still fell after {most_rounds} rounds")


def reach_back(targets: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """(source, vert, cost) the other way: the least cost from each vertex to any vertex of a target.

    Cheaper than ``bounded_reach`` where targets (trails) are fewer than sources (blocks).
    """
    return bounded_reach(targets, edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost"), limit)


def block_costs(reached: DataFrame, verts: DataFrame) -> DataFrame:
    """(source_block, target_block, cost): least cost from a block to the verts (block, vert) of another."""
    joined = reached.join(verts.withColumnRenamed("block", "target_block"), "vert").where("source <> target_block")
    return joined.groupBy(F.col("source").alias("source_block"), "target_block").agg(F.min("cost").alias("cost"))


def block_pairs(high: DataFrame, low: DataFrame, shared: DataFrame, blocks: DataFrame, ratio: float = 1.25) -> DataFrame:
    """(source_block, target_block, low_stress, low_stress_cost, high_stress, high_stress_cost) of reachable pairs.

    A pair is low-stress if the blocks share a road (``shared``: source_block, target_block) or the low-stress
    way is at most ``ratio`` times as long as the way on all roads. Every block reaches itself at no cost.
    """
    pair = ["source_block", "target_block"]
    joined = high.withColumnRenamed("cost", "high_stress_cost").join(low.withColumnRenamed("cost", "low_stress_cost"), pair, "left")
    joined = joined.join(shared.select(*pair).distinct().withColumn("s", F.lit(True)), pair, "left")
    near = (F.col("high_stress_cost") == 0) | (F.col("low_stress_cost") <= ratio * F.col("high_stress_cost"))
    flag = F.coalesce("s", F.lit(False)) | (F.col("low_stress_cost").isNotNull() & near)
    rows = joined.select(*pair, F.coalesce(flag, F.lit(False)).alias("low_stress"), "low_stress_cost", F.lit(True).alias("high_stress"), "high_stress_cost")
    own = blocks.select(F.col("block").alias("source_block"), F.col("block").alias("target_block"), F.lit(True).alias("low_stress"), F.lit(0.0).alias("low_stress_cost"), F.lit(True).alias("high_stress"), F.lit(0.0).alias("high_stress_cost")).distinct()
    return rows.unionByName(own)
