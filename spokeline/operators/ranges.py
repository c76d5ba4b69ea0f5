"""Cut points that divide the values of a column into ranges of about equal size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RANGES = 4096
#: Quantiles asked for at first; only larger tables need a second look.
FEW = 256


def range_cuts(df: DataFrame, column: str, range_rows: int) -> list:
    """Ascending distinct cuts; range k holds the values from cut k-1 (inclusive) to cut k (exclusive).

    There are enough ranges for ``range_rows`` rows each and for the session's shuffle partitions, but at
    most ``MAX_RANGES``: that many numbers reach the driver, whatever the size of the data.
    """
    spark = df.sparkSession

    def quantiles(parts: int) -> tuple[int, list]:
        # as text: one expression to parse, where 4096 literals of their own would cost a call each
        fractions = ",".join(f"{i / parts!r}D" for i in range(1, parts))
        seen = df.agg(F.count(column).alias("n"), F.expr(f"percentile_approx(`{column}`, array({fractions}), 20000)").alias("cuts")).first()
        return seen["n"], seen["cuts"] or []

    fine = FEW
    n, values = quantiles(fine)
    ranges = min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / range_rows)))
    if ranges > FEW:
        fine = MAX_RANGES
        values = quantiles(fine)[1]
    picked = {values[min(len(values) - 1, max(0, round(k * fine / ranges) - 1))] for k in range(1, ranges)} if values else set()
    return sorted(picked)


def range_of(cuts: list, column: Column) -> Column:
    """The range of a value, by binary search: a chain of comparisons would cost each row all cuts."""
    sorted_cuts = np.array(cuts)

    @F.pandas_udf("int")
    def search(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sorted_cuts, values.to_numpy(), side="right").astype("int32"))

    return search(column) if cuts else F.lit(0)
