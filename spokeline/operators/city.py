"""City tables: reachability per block, percentiles, mileage, the long table of score inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeline.functions.scoring import access_score, destination_score

METRES_PER_MILE = 1609.34


def block_access(pairs: DataFrame, amounts: DataFrame, blocks: DataFrame, amount: str = "amount") -> DataFrame:
    """(block, high, low, score): the amount (people, jobs) that a block reaches, in all and at low stress.

    pairs: source_block, target_block, low_stress; amounts: (block, amount), null counts as 0. Blocks that
    reach nothing get 0 and no score.
    """
    worth = F.coalesce(F.col(amount), F.lit(0))
    found = pairs.join(amounts.withColumnRenamed("block", "target_block"), "target_block", "left").groupBy("source_block").agg(F.sum(worth).alias("high"), F.sum(F.when(F.col("low_stress"), worth).otherwise(0)).alias("low"))
    out = blocks.select("block").join(found.withColumnRenamed("source_block", "block"), "block", "left").na.fill(0, ["high", "low"])
    return out.withColumn("score", access_score(F.col("low"), F.col("high")))


def destination_access(pairs: DataFrame, destinations: DataFrame, blocks: DataFrame, types: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    """One row per block with ``{type}_high``, ``{type}_low`` and ``{type}_score`` for every type.

    destinations: id, dest_type, blockid20 ARRAY. A destination in several blocks counts once: a first aggregate
    brings every (block, type, destination) to one row, so that the second needs no distinct counts.
    """
    placed = destinations.select("id", "dest_type", F.explode("blockid20").alias("target_block"))
    once = pairs.join(placed, "target_block").groupBy("source_block", "dest_type", "id").agg(F.max("low_stress").alias("low"))
    counts = []
    for t in types:
        mine = F.col("dest_type") == t
        counts += [F.count_if(mine).alias(f"{t}_high"), F.count_if(mine & F.col("low")).alias(f"{t}_low")]
    found = once.groupBy(F.col("source_block").alias("block")).agg(*counts)
    out = blocks.select("block").join(found, "block", "left").na.fill(0)
    return out.withColumns({f"{t}_score": destination_score(F.col(f"{t}_low"), F.col(f"{t}_high"), *steps) for t, steps in types.items()})


def ratio_percentiles(df: DataFrame, low: str, high: str, shares: Sequence[float] = (0.3, 0.5, 0.7), by: Sequence[str] = ()) -> DataFrame:
    """Linear percentiles of low/high where anything is reachable, the ratio of the sums, and its whole part."""
    ratio = F.try_divide(F.col(low).cast("double"), F.nullif(F.col(high).cast("double"), F.lit(0.0)))
    values = F.percentile(ratio, list(shares)).alias("p")
    sums = [F.sum(low).alias("l"), F.sum(high).alias("h")]
    out = df.groupBy(*by).agg(values, *sums) if by else df.agg(values, *sums)
    plain = F.coalesce(F.try_divide(F.col("l").cast("double"), F.nullif(F.col("h").cast("double"), F.lit(0.0))), F.lit(0.0))
    return out.select(*by, *[F.get("p", k).alias(f"p{round(s * 100)}") for k, s in enumerate(shares)], plain.alias("average"), F.floor(plain).alias("whole_average"))


def weighted_by(score: str, weight: str, only: Column | None = None) -> Column:
    """Mean score by weight over the rows of ``only``; 0 without any weight."""
    here = only if only is not None else F.lit(True)
    return F.coalesce(F.try_divide(F.sum(F.when(here, F.col(score) * F.col(weight))), F.nullif(F.sum(F.when(here, F.col(weight))).cast("double"), F.lit(0.0))), F.lit(0.0))


def mileage(segments: DataFrame, kinds: Mapping[str, Column]) -> DataFrame:
    """(feature_type, total_mileage): miles of every kind, a segment counting for each kind it is of."""
    tagged = segments.select("length_m", F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in kinds.items()]), lambda x: x.isNotNull())).alias("feature_type"))
    return tagged.groupBy("feature_type").agg((F.sum("length_m") / METRES_PER_MILE).alias("total_mileage"))


#: Kinds of facilities that have miles of their own.
FACILITIES = ("sharrow", "buffered_lane", "lane", "track", "path")


def facility_miles(segments: DataFrame) -> DataFrame:
    """(feature_type, total_mileage): miles of facilities by direction, and of paths that are no crosswalks (xwalk, where given)."""
    has = lambda c: c in segments.columns
    kinds = [F.when(F.col(c).isin(*FACILITIES), F.col(c)) for c in ("ft_bike_infra", "tf_bike_infra") if has(c)]
    path = F.col("functional_class") == "path"
    kinds.append(F.when(path & F.col("xwalk").isNull() if has("xwalk") else path, "path"))
    tagged = segments.select("length_m", F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("feature_type"))
    return tagged.groupBy("feature_type").agg((F.sum(F.coalesce("length_m", F.lit(0.0))) / METRES_PER_MILE).alias("total_mileage"))


def stress_miles(segments: DataFrame, low: int = 1, high: int = 3, length: str = "length_m") -> DataFrame:
    """(low_miles, high_miles): a segment counts for each open direction at ``low`` or at ``high`` stress; one with a direction at
    any other level for neither. ``length`` may name the length inside the boundary."""
    ft, tf = F.coalesce("ft_seg_stress", F.lit(0)), F.coalesce("tf_seg_stress", F.lit(0))
    usual = ft.isin(0, low, high) & tf.isin(0, low, high)
    times = lambda level: F.when(usual, (ft == level).cast("int") + (tf == level).cast("int")).otherwise(0)
    total = lambda level: F.coalesce(F.sum(F.col(length) * times(level)) / METRES_PER_MILE, F.lit(0.0))
    return segments.agg(total(low).alias("low_miles"), total(high).alias("high_miles"))


def jobs_per_block(pairs: DataFrame, block: str, jobs: str) -> DataFrame:
    """(blockid20, jobs): positive sums by 15-digit block code."""
    code = F.col(block).cast("string")
    code = F.when(F.length(code) < 15, F.lpad(code, 15, "0")).otherwise(code)
    return pairs.groupBy(code.alias("blockid20")).agg(F.sum(jobs).alias("jobs")).where("jobs > 0")


def classify_blocks(blocks: DataFrame, share_inside: Column, least_share: float = 0.5) -> DataFrame:
    """``blocks`` with block_class: water (no land) before outside (too little inside the boundary) before included."""
    land = F.coalesce(F.col("aland20"), F.lit(0)) > 0
    return blocks.withColumn("block_class", F.when(~land, "water").when(F.coalesce(share_inside, F.lit(0.0)) < least_share, "outside").otherwise("included"))


def long_table(row: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """(id, name, value): a one-row table of aggregates turned into rows, numbered in order from 1."""
    entries = [F.struct(F.lit(k).alias("id"), F.lit(n).alias("name"), c.cast("double").alias("value")) for k, (n, c) in enumerate(values.items(), 1)]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
