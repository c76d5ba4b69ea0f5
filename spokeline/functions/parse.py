"""Numbers out of tag texts, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_MILE = 1.609
FEET_PER_METRE = 3.28084


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def parse_speed_mph(c: Column, bare_unit: str | None = "km/h") -> Column:
    """The first number as whole mph: mph is truncated, km/h rounded to 5 mph (halves to even); a bare number has ``bare_unit``."""
    text = F.lower(c)
    number = _first(text, r"(\d+(?:\.\d+)?)").try_cast("double")
    miles = F.contains(text, F.lit("mph")) & ~F.contains(text, F.lit("kmph"))
    metric = F.contains(text, F.lit("km"))
    if (bare_unit or "km/h") != "mph":
        metric = F.lit(True)
    rounded = (F.bround(number / KM_PER_MILE / 5) * 5).cast("int")
    return F.when(miles, number.cast("int")).when(metric, rounded).otherwise(number.cast("int"))


def parse_int(c: Column) -> Column:
    """The first run of digits."""
    return _first(c, r"(\d+)").try_cast("int")


def parse_int_half(c: Column) -> Column:
    """Half of the first run of digits, rounded up."""
    return F.ceil(parse_int(c) / 2).cast("int")


def count_pipes(c: Column) -> Column:
    """Parts of a text divided by |."""
    return (F.length(c) - F.length(F.replace(c, F.lit("|"))) + 1).cast("int")


#: Feet and inches at the start of a text, and the first number anywhere in it.
_FEET_INCHES = r"^(\d+)'(?:(\d+)\")?"
_NUMBER = r"(\d+\.?\d*)"
#: Fixed value: bare numbers from here on are no widths.
BARE_BELOW = 20


def parse_width_ft(c: Column) -> Column:
    """Feet from a text that begins like 12'6", else from its first number: feet if it says ft, metres if it has an m anywhere.

    A number with neither counts as metres below ``BARE_BELOW`` and as nothing from there on.
    """
    text = F.trim(c)
    lower = F.lower(text)
    number = _first(text, _NUMBER).try_cast("double")
    inches = F.coalesce(_first(text, _FEET_INCHES, 2).try_cast("double"), F.lit(0.0))
    return (
        F.when(text.rlike(_FEET_INCHES), _first(text, _FEET_INCHES).try_cast("double") + inches / 12)
        .when(F.contains(lower, F.lit("ft")), number)
        .when(F.contains(lower, F.lit("m")) | (number < BARE_BELOW), number * FEET_PER_METRE)
    )


def parse_width_int(c: Column) -> Column:
    """``parse_width_ft`` cut to whole feet."""
    return parse_width_ft(c).cast("int")


TRANSFORMS: dict[str, Callable[..., Column]] = {
    "parse_speed_mph": parse_speed_mph,
    "parse_int": parse_int,
    "parse_int_half": parse_int_half,
    "count_pipes": count_pipes,
    "parse_width_ft": parse_width_ft,
    "parse_width_int": parse_width_int,
}


def register_transform(name: str, build: Callable[..., Column]) -> None:
    """Make a column function callable from rules as ``{$apply: name, to: column}``."""
    TRANSFORMS[name] = build


def transform(name: str, c: Column, **arguments: Any) -> Column:
    if name not in TRANSFORMS:
        raise ValueError(f"no such transform: {name}; there are {', '.join(sorted(TRANSFORMS))}")
    return TRANSFORMS[name](c, **arguments)
