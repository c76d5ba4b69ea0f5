"""Differences between two copies of a table, found by content-defined chunks.

Both copies are cut into ranges of keys at the same points and sorted by key inside each range. A rolling
hash over the last ``WINDOW`` keys cuts a chunk wherever it meets a condition, so that a missing or added
row moves the cuts next to it and no others; a chunk that has grown to ``LONGEST_CHUNK`` rows without one is cut there,
counted from the last cut by content. Chunks whose fingerprints (two 64-bit sums over hashes of the
rows' values, the row count, the first and last key) occur on both sides are equal and drop out by
anti-joins; only rows of the other chunks are joined by key and compared field by field.

Numbers enter a fingerprint rounded to the tolerance: equal fingerprints then mean differences below it,
while a pair on the two sides of a rounding border only costs a comparison.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeline.operators.ranges import range_cuts, range_of
from spokeline.session import Scratch

WINDOW = 4
MEAN_CHUNK = 32
LONGEST_CHUNK = 512
ONLY_REFERENCE, ONLY_COMPUTED = "rows_only_reference", "rows_only_computed"


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def _plain(df: DataFrame, c: str) -> Column:
    """NaN as null; maps as sorted entries, so that they can be hashed and compared."""
    kind = df.schema[c].dataType
    col = F.col(f"`{c}`")
    if _is_number(kind):
        return F.when(~F.isnan(col), col.cast("double")).alias(c)
    return F.array_sort(F.map_entries(col)).alias(c) if isinstance(kind, T.MapType) else col.alias(c)


def differs(a: Column, b: Column, number: bool, tolerance: float) -> Column:
    """Null differs from any value but null; numbers differ by more than ``tolerance``, others unless identical."""
    if not number:
        return ~a.eqNullSafe(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(F.coalesce((a != b) & ~(F.abs(a - b) <= tolerance), F.lit(False)))


def _chunked(df: DataFrame, keys: Sequence[str], fields: Sequence[str], numbers: set[str], cuts: list, tolerance: float) -> DataFrame:
    """``df`` with its range, the chunk (the place of its first row in the range) and two hashes of each row."""
    inside = Window.partitionBy("__range").orderBy("__sort", *keys)
    rolling = F.sum(F.shiftright(F.xxhash64(*keys), 8)).over(inside.rowsBetween(1 - WINDOW, 0))
    scaled = lambda c: F.round(F.col(c) / tolerance) if tolerance else F.col(c) + 0.0
    rounded = [scaled(c).alias(c) if c in numbers else F.col(c) for c in fields]
    df = df.withColumn("__range", range_of(cuts, F.col("__sort"))).withColumns({"__cut": F.pmod(rolling, F.lit(MEAN_CHUNK)) == 0, "__nr": F.row_number().over(inside)})
    # where the content last cut; only from there on do rows count towards a forced cut, so that a lost row moves no cut beyond the next
    last = F.coalesce(F.max(F.when(F.col("__cut"), F.col("__nr"))).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunk = F.col("__last") + F.floor((F.col("__nr") - F.col("__last") - 1) / LONGEST_CHUNK).cast("int") * LONGEST_CHUNK
    # nulls keep their place: xxhash64 alone skips them
    shown = [x for c in rounded for x in (c, c.isNull())]
    df = df.withColumn("__last", last)
    return df.withColumns({"__chunk": chunk, "__h1": F.xxhash64(*keys, *shown), "__h2": F.xxhash64(F.lit(7), *shown, *keys)}).drop("__cut", "__nr", "__last")


def _fingerprints(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    part = lambda c, how: F.sum(how(F.col(c)))
    high, low = (lambda c: F.shiftright(c, 32)), (lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)))
    first = F.struct(*keys)
    return df.groupBy("__range", "__chunk").agg(
        F.count("*").alias("n"), F.min(first).alias("first"), F.max(first).alias("last"),
        *[part(h, f).alias(f"{h}{i}") for h in ("__h1", "__h2") for i, f in enumerate((high, low))],
    )


def diff_rows(reference: DataFrame, computed: DataFrame, keys: Sequence[str], fields: Sequence[str] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """A tolerance of 0 tells any two unequal numbers apart. (keys, __in_reference, __in_computed, __a, __b) of all rows that may differ, values as structs.

    One row per key on each side is expected (``latest_rows``); null keys equal each other. ``fields`` are by
    default the columns both sides have. Integers compare with integers of any width, numbers with numbers.
    """
    spark = reference.sparkSession
    scratch = Scratch(spark)
    fields = list(fields or [c for c in reference.columns if c in computed.columns and c not in keys])
    numbers = {c for c in fields if _is_number(reference.schema[c].dataType) or _is_number(computed.schema[c].dataType)}
    single = len(keys) == 1 and isinstance(reference.schema[keys[0]].dataType, T.IntegralType)
    sort = F.coalesce(F.col(keys[0]).cast("bigint"), F.lit(-(2**63))) if single else F.xxhash64(*keys)
    sides = []
    for df in (reference, computed):
        plain = df.select(*keys, *[_plain(df, c).cast("double").alias(c) if c in numbers else _plain(df, c) for c in fields])
        sides.append(plain.withColumn("__sort", sort))
    cuts = range_cuts(sides[0].select("__sort"), "__sort", 200_000)
    kept = [scratch.keep(_chunked(s, keys, fields, numbers, cuts, tolerance)) for s in sides]
    prints = [_fingerprints(k, keys) for k in kept]
    same = [c for c in prints[0].columns if c not in ("__chunk", "first", "last")]
    on = lambda a, b: reduce(lambda x, y: x & y, [a[c] == b[c] for c in same] + [a[c].eqNullSafe(b[c]) for c in ("first", "last")])
    rows = []
    for mine, other, k in ((prints[0], prints[1], kept[0]), (prints[1], prints[0], kept[1])):
        odd = mine.join(other, on(mine, other), "left_anti").select("__range", "__chunk")
        rows.append(k.join(odd, ["__range", "__chunk"], "left_semi"))
    a, b = (r.select(*[F.col(c).alias(f"__{side}_{c}") for c in keys], F.struct(*fields).alias(f"__{side}"), F.lit(True).alias(f"__in_{side}")) for r, side in zip(rows, "ab"))
    joined = a.join(b, reduce(lambda x, y: x & y, [F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")) for c in keys]), "full_outer")
    key = [F.when(F.col("__in_a"), F.col(f"__a_{c}")).otherwise(F.col(f"__b_{c}")).alias(c) for c in keys]
    return joined.select(*key, F.coalesce("__in_a", F.lit(False)).alias("__in_reference"), F.coalesce("__in_b", F.lit(False)).alias("__in_computed"), "__a", "__b")


def diff_tables(reference: DataFrame, computed: DataFrame, keys: Sequence[str], fields: Sequence[str] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(keys, diff, reference_value, computed_value): a row for each missing row and each differing field."""
    rows = diff_rows(reference, computed, keys, fields, tolerance)
    names = rows.schema["__a"].dataType.fieldNames()
    numbers = {f.name for f in rows.schema["__a"].dataType if _is_number(f.dataType)}
    both = F.col("__in_reference") & F.col("__in_computed")
    entry = lambda name, x, y: F.struct(F.lit(name).alias("diff"), x.cast("string").alias("reference_value"), y.cast("string").alias("computed_value"))
    nothing = F.lit(None)
    found = [F.when(~F.col("__in_computed"), entry(ONLY_REFERENCE, nothing, nothing)), F.when(~F.col("__in_reference"), entry(ONLY_COMPUTED, nothing, nothing))]
    for c in names:
        x, y = F.col("__a").getField(c), F.col("__b").getField(c)
        found.append(F.when(both & differs(x, y, c in numbers, tolerance), entry(c, x, y)))
    return rows.select(*keys, F.explode(F.filter(F.array(*found), lambda d: d.isNotNull())).alias("d")).select(*keys, "d.*")


def diff_report(differences: DataFrame) -> DataFrame:
    """(diff, n): how many rows are missing on either side, and in how many each column differs."""
    return differences.groupBy("diff").agg(F.count("*").alias("n_differ"))


def diff_statistics(differences: DataFrame, shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """(diff, n_differ, max_abs, mean_abs, p50, p95): how far the numbers of each differing column lie apart.

    Only pairs of two numbers count for the distances; columns of texts, and missing rows, have none.
    """
    apart = F.abs(F.col("reference_value").try_cast("double") - F.col("computed_value").try_cast("double"))
    found = differences.groupBy("diff").agg(F.count("*").alias("n_differ"), F.max(apart).alias("max_abs"), F.avg(apart).alias("mean_abs"), F.percentile(apart, [float(q) for q in shares]).alias("p"))
    return found.select("diff", "n_differ", "max_abs", "mean_abs", *[F.get("p", k).alias(f"p{round(q * 100)}") for k, q in enumerate(shares)])
