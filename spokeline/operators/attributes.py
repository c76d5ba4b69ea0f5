"""Attributes of ways: a registry of rule programs with an observed and a fallback phase."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeline.rules import Program, apply
from spokeline.session import keep


@dataclass(frozen=True)
class Attribute:
    """What one attribute computes: from observed tags and, where that left nothing, from a fallback."""

    name: str
    observed: Program | None = None
    fallback: Program | None = None
    tags: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    scratch: bool = False

    def outputs(self) -> list[str]:
        return self.observed.outputs() if self.observed else [self.name]


def apply_fallback(df: DataFrame, program: Program, variables: Mapping[str, Any] | None = None) -> DataFrame:
    """``df`` after ``program``, with ``{output}_imputed`` where it turned a null into a value."""
    names = program.outputs()
    df = df.withColumns({f"__was_{c}": (F.col(c).isNull() if c in df.columns else F.lit(True)) for c in names})
    df = apply(df, program, variables)
    return df.withColumns({f"{c}_imputed": F.col(f"__was_{c}") & F.col(c).isNotNull() for c in names}).drop(*[f"__was_{c}" for c in names])


@dataclass
class AttributeRegistry:
    attributes: dict[str, Attribute] = field(default_factory=dict)

    def register(self, attribute: Attribute) -> None:
        """Add an attribute; its name and outputs must be new."""
        if attribute.name in self.attributes:
            raise ValueError(f"attribute {attribute.name} is registered already")
        made = {o: a.name for a in self.attributes.values() for o in a.outputs()}
        if clash := [o for o in attribute.outputs() if o in made]:
            raise ValueError(f"{attribute.name} makes {clash}, which {made[clash[0]]} makes already")
        self.attributes[attribute.name] = attribute

    def ordered(self) -> list[Attribute]:
        """Every attribute after those it names, by name where the order is open."""
        sorter = TopologicalSorter({a.name: set(a.after) & set(self.attributes) for a in self.attributes.values()})
        for a in self.attributes.values():
            if missing := set(a.after) - set(self.attributes):
                raise ValueError(f"{a.name} comes after unknown {sorted(missing)}")
        out: list[str] = []
        try:
            sorter.prepare()
        except CycleError as e:
            raise ValueError(f"attributes wait for one another: {e.args[1]}") from e
        while sorter.is_active():
            ready = sorted(sorter.get_ready())
            out += ready
            sorter.done(*ready)
        return [self.attributes[n] for n in out]

    def tags(self) -> list[str]:
        return sorted({t for a in self.attributes.values() for t in a.tags})

    def scratch_columns(self) -> list[str]:
        return [o for a in self.attributes.values() if a.scratch for o in a.outputs()]

    def run(self, ways: DataFrame, variables: Mapping[str, Any] | None = None, required: Sequence[str] = ("functional_class",), tag_map: str | None = "tags") -> DataFrame:
        """Observed phase, rows without a required column dropped, scratch columns dropped, fallback phase.

        The table is written before an attribute that reads flags made for it, and before the fallbacks: without that the
        optimizer puts the expressions of all attributes into one another, each as often as it is read.
        """
        if tag_map and tag_map in ways.columns:
            tag: dict[str, Column] = {t: F.try_element_at(F.col(tag_map), F.lit(t)) for t in self.tags() if t not in ways.columns}
            ways = ways.withColumns(tag) if tag else ways
        flags = {a.name for a in self.attributes.values() if a.scratch}
        for a in self.ordered():
            if a.observed:
                ways = apply(keep(ways) if flags & set(a.after) else ways, a.observed, variables)
        for c in required:
            ways = ways.where(F.col(c).isNotNull()) if c in ways.columns else ways
        ways = ways.drop(*self.scratch_columns())
        if flags:
            ways = keep(ways)
        for a in self.ordered():
            if a.fallback:
                ways = apply_fallback(ways, a.fallback, variables)
        return ways
