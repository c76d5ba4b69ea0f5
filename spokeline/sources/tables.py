"""Readers of the project's tables and the rule that picks the row in force."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_rows(df: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one with the latest ``at``; equal rows count once.

    An aggregate, not a window, so that the copies of a hot key are combined before the shuffle. Rows
    of one key with the same ``at`` but other values are decided by the order of their values; a null
    ``at`` is older than any. Null keys form a key of their own. Maps are compared by sorted entries.
    """
    columns = [c for c in (columns or df.columns) if c not in keys and c != at]
    maps = {c for c in columns if isinstance(df.schema[c].dataType, T.MapType)}
    part = [F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(f"`{c}`") for c in columns]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(at).alias("__at"), *part)).alias("__row"))

    def out(c: str) -> Column:
        value = F.col("__row").getField(c)
        return (F.map_from_entries(value) if c in maps else value).alias(c)

    return best.select(*keys, *[out(c) for c in columns], F.col("__row").getField("__at").alias(at))


def clean_number(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def pad_code(c: Column, width: int) -> Column:
    """Left-pad a code with zeros; longer codes stay as they are (lpad alone would cut them)."""
    c = F.trim(c.cast("string"))
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)
