"""Quantities recorded in different units, brought to one unit in plain SQL expressions.

The number and the unit text come from regular expressions; the unit's alias is normalised by a join with
a table of fixed size; the unit is the unit field if there is one, else the unit in the text, else the
source's default; then value = number * factor + offset.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values. Every unit's factor to the common unit of its quantity: mph for speeds, feet for lengths.
MILE_M, NAUTICAL_M, FOOT_M = 1609.344, 1852.0, 0.3048
FACTORS = {
    "speed": {"mph": 1.0, "km/h": 1000 / MILE_M, "kn": NAUTICAL_M / MILE_M, "m/s": 3600 / MILE_M, "ft/s": FOOT_M * 3600 / MILE_M},
    "length": {"ft": 1.0, "in": 1 / 12, "yd": 3.0, "m": 1 / FOOT_M, "dm": 0.1 / FOOT_M, "cm": 0.01 / FOOT_M, "mm": 0.001 / FOOT_M, "km": 1000 / FOOT_M, "mi": MILE_M / FOOT_M},
}
#: Fixed values. Spellings in lower case, without blanks and full stops.
ALIASES = {
    "speed": {
        "mph": ["mph", "mi/h", "mileperhour", "milesperhour", "m/hr", "mile/h", "miles/h", "mileshour"],
        "km/h": ["km/h", "kmh", "kph", "kmph", "km/hr", "kilometreperhour", "kilometresperhour", "kilometerperhour", "kilometersperhour", "km"],
        "kn": ["kn", "kt", "kts", "knot", "knots"],
        "m/s": ["m/s", "mps", "m/sec", "metrepersecond", "metrespersecond", "meterpersecond", "meterspersecond"],
        "ft/s": ["ft/s", "fps", "footpersecond", "feetpersecond"],
    },
    "length": {
        "ft": ["ft", "foot", "feet", "'", "′", "’"],
        "in": ["in", "inch", "inches", '"', "″", "''", "”"],
        "yd": ["yd", "yds", "yard", "yards"],
        "m": ["m", "metre", "metres", "meter", "meters", "mtr"],
        "dm": ["dm", "decimetre", "decimetres", "decimeter", "decimeters"],
        "cm": ["cm", "centimetre", "centimetres", "centimeter", "centimeters"],
        "mm": ["mm", "millimetre", "millimetres", "millimeter", "millimeters"],
        "km": ["km", "kilometre", "kilometres", "kilometer", "kilometers"],
        "mi": ["mi", "mile", "miles"],
    },
}
#: Fixed values. How a source's description tells a unit; the first that matches counts. Speeds are struck out before lengths are sought.
PHRASES = {
    "speed": {
        "km/h": r"kilomet(?:re|er)s? (?:per|an) hour|kilom[eè]tres? (?:par heure|/ ?h)|\bkm ?/ ?h\b|\bkmh\b|\bkph\b",
        "mph": r"miles? (?:per|an) hour|\bmph\b|\bmi ?/ ?h\b",
        "kn": r"\bknots?\b|n[oœ]e?uds?\b",
        "m/s": r"met(?:re|er)s? (?:per|a) second|m[eè]tres? par seconde|\bm ?/ ?s\b",
    },
    "length": {
        "mm": r"thousandths? of an? met(?:re|er)|millim[eè]t(?:re|er)s?|\bmm\b",
        "cm": r"hundredths? of an? met(?:re|er)|centim[eè]t(?:re|er)s?|\bcm\b",
        "in": r"\binch(?:es)?\b|\bpouces?\b",
        "yd": r"\byards?\b",
        "ft": r"\bfeet\b|\bfoot\b|\bft\b|\bpieds?\b",
        "m": r"\bm[eè]t(?:re|er)s?\b",
    },
}
_FULL_WIDTH = ("０１２３４５６７８９．，", "0123456789.,")
_NUMBER = r"([0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)"
_LEAD = r"^(?:(?:max(?:imum)?|limit|ca|circa|approx|about|c)[.:]?|[~≈±])?\s*"
_PLAIN = rf"{_LEAD}{_NUMBER}\s*([^0-9]*)$"
_FEET_INCHES = rf"{_LEAD}{_NUMBER}\s*(?:'|′|’|ft\.?|feet|foot)\s*{_NUMBER}\s*(?:\"|''|″|”|in\.?|inch|inches)?$"


def alias_table(spark: SparkSession) -> DataFrame:
    rows = [(q, a, u, FACTORS[q][u], 0.0) for q, units in ALIASES.items() for u, aliases in units.items() for a in aliases]
    return spark.createDataFrame(rows, "quantity string, alias string, unit string, factor double, offset double")


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s.]+", "")



def source_units(sources: DataFrame, key: str, columns: Mapping[str, str], description: str = "description") -> DataFrame:
    """(source, quantity, unit) of sources that tell the unit of bare numbers.

    ``columns`` gives each quantity's unit column. Where that is null, blank or no known unit, the
    description may name one. Sources that tell none have no row.
    """
    told = F.lower(F.coalesce(F.col(description), F.lit("")))
    without_speed = F.regexp_replace(told, "|".join(PHRASES["speed"].values()), " ")
    rows = []
    for quantity, column in columns.items():
        text = told if quantity == "speed" else without_speed
        named = F.coalesce(*[F.when(text.rlike(pattern), F.lit(unit)) for unit, pattern in PHRASES[quantity].items()])
        known = F.coalesce(*[F.when(_squeezed(F.col(column)).isin(aliases), F.lit(unit)) for unit, aliases in ALIASES[quantity].items()])
        rows.append(F.struct(F.lit(quantity).alias("quantity"), F.coalesce(known, named).alias("unit")))
    return sources.select(F.col(key).alias("source"), F.explode(F.array(*rows)).alias("q")).select("source", "q.*").where("unit is not null")


def convert_units(records: DataFrame, defaults: DataFrame, value: str = "value", quantity: str = "quantity", source: str = "source", unit: str | None = None) -> DataFrame:
    """``records`` with ``number``, ``unit_found`` and ``converted`` (in the quantity's common unit).

    defaults: (source, quantity, unit), one row per pair and as few as there are sources: AQE broadcasts
    it if it is small. A comma is a decimal sign. Texts that are no single number with at most a unit (null,
    blank, words, ranges) and numbers of unknown unit get nulls. ``12'6"`` is feet and inches.
    """
    spark = records.sparkSession
    text = F.trim(F.lower(F.translate(F.col(value), *_FULL_WIDTH)))
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    records = records.withColumn("__t", text)
    feet, inches = (F.regexp_extract("__t", _FEET_INCHES, k) for k in (1, 2))
    both = (F.col(quantity) == "length") & (F.col("__t").rlike(_FEET_INCHES))
    as_double = lambda c: F.regexp_replace(c, ",", ".").try_cast("double")
    number = F.when(both, as_double(feet) + as_double(inches) / 12).otherwise(as_double(F.regexp_extract("__t", _PLAIN, 1)))
    written = F.when(both, F.lit("ft")).otherwise(_squeezed(F.regexp_extract("__t", _PLAIN, 2)))
    records = records.withColumns({"number": number, "__w": F.when(F.col("__t").rlike(_PLAIN) | both, written)})
    own = _squeezed(F.col(unit)) if unit else F.lit(None).cast("string")
    records = records.withColumn("__own", F.coalesce(F.nullif(own, F.lit("")), F.nullif("__w", F.lit(""))))
    aliases = F.broadcast(alias_table(spark))
    named = aliases.select(F.col("quantity").alias("__q"), F.col("alias").alias("__a"), F.col("unit").alias("__named"))
    records = records.join(named, (F.col(quantity) == F.col("__q")) & (F.col("__own") == F.col("__a")), "left")
    given = defaults.select(F.col("source").alias("__s"), F.col("quantity").alias("__q2"), F.col("unit").alias("__given"))
    records = records.join(given, (F.col(source) == F.col("__s")) & (F.col(quantity) == F.col("__q2")), "left")
    found = F.when(F.col("__own").isNotNull(), F.col("__named")).otherwise(F.col("__given"))
    records = records.withColumn("unit_found", F.when(F.col("number").isNotNull(), found))
    scale = aliases.dropDuplicates(["quantity", "unit"]).select(F.col("quantity").alias("__q3"), F.col("unit").alias("__u"), F.col("factor").alias("__factor"), F.col("offset").alias("__offset"))
    records = records.join(F.broadcast(scale), (F.col(quantity) == F.col("__q3")) & (F.col("unit_found") == F.col("__u")), "left")
    records = records.withColumn("converted", F.col("number") * F.col("__factor") + F.col("__offset"))
    return records.drop("__t", "__w", "__own", "__q", "__a", "__named", "__s", "__q2", "__given", "__q3", "__u", "__factor", "__offset")


def hundredths(c: Column) -> Column:
    """Rounded to the nearest hundredth, halves up; the slack keeps exact halves from falling below in binary."""
    return F.floor(c * 100 + 0.5 + 1e-9).cast("bigint")
