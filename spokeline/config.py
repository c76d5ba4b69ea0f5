"""Settings in layers: defaults, scenarios, overrides."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Mapping
from dataclasses import fields
from typing import Any

from spokeline.catalog import CATEGORY_WEIGHTS, PEOPLE_WEIGHT, STANDARD, TRAIL_LENGTH_M, TRAIL_SPAN_M, Catalog, DestinationType

DEFAULTS: dict[str, Any] = {
    "stress": {"flag_radius_m": 25.0, "link_model": "max", "levels": 3, "low": 1},
    "reach": {"limit_m": 2680, "ratio": 1.25},
    "trails": {"least_length_m": TRAIL_LENGTH_M, "least_span_m": TRAIL_SPAN_M},
    "scores": {"people_weight": PEOPLE_WEIGHT, "category_weights": CATEGORY_WEIGHTS, "types": {}},
    "variables": {"speed_bare_unit": "km/h", "city_default_speed": None, "state_default_speed": None},
}
#: Which settings a stage's result depends on.
SLICES = {"streets": (), "census": (), "attributes": ("variables",), "stress": ("stress", "variables"), "graph": ("stress", "variables"), "connectivity": ("stress", "reach", "variables"), "trails": ("trails", "variables"), "jobs": (), "destinations": ("scores",), "scores": ("scores", "reach", "stress", "trails", "variables"), "neighborhood": ("scores", "stress", "variables")}


def merged(base: Mapping[str, Any], layer: Mapping[str, Any]) -> dict:
    """A sparse layer: its leaves replace those of the base."""
    out = copy.deepcopy(dict(base))
    for k, v in layer.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def replaced(base: Mapping[str, Any], layer: Mapping[str, Any]) -> dict:
    """A complete layer: its blocks replace those of the base whole."""
    return copy.deepcopy({**base, **layer})


def coerced(text: str) -> Any:
    """true, false, null, numbers and JSON lists from a command line; anything else is text."""
    try:
        return json.loads(text)
    except ValueError:
        return {"True": True, "False": False, "None": None}.get(text, text)


class Config:
    def __init__(self, values: Mapping[str, Any]):
        self.values = copy.deepcopy(dict(values))

    @classmethod
    def default(cls) -> Config:
        return cls(DEFAULTS)

    @classmethod
    def build(cls, scenario: Mapping[str, Any] | None = None, overrides: Mapping[str, Any] | None = None, complete: bool = False) -> Config:
        """Defaults, then a scenario (sparse, or complete: block by block), then overrides {dotted.path: value}."""
        values = (replaced if complete else merged)(DEFAULTS, scenario or {})
        out = cls(values)
        for path, value in (overrides or {}).items():
            out.set(path, coerced(value) if isinstance(value, str) else value)
        if problems := out.problems():
            raise ValueError("; ".join(problems))
        return out

    def get(self, path: str) -> Any:
        value: Any = self.values
        for part in path.split("."):
            if not isinstance(value, Mapping) or part not in value:
                raise KeyError(f"no setting {path}")
            value = value[part]
        return value

    def set(self, path: str, value: Any) -> None:
        *parents, leaf = path.split(".")
        block: Any = self.values
        for part in parents:
            block = block.get(part) if isinstance(block, dict) else None
        if not isinstance(block, dict) or (leaf not in block and parents[:1] != ["variables"] and parents[:2] != ["scores", "types"]):
            raise KeyError(f"no setting {path}")
        block[leaf] = value

    def catalog(self) -> Catalog:
        """The standard destination types with the changes and additions of ``scores.types`` (name -> values)."""
        known = {f.name for f in fields(DestinationType)}
        types = {t.name: t for t in STANDARD}
        for name, values in self.get("scores.types").items():
            if unknown := set(values) - known:
                raise ValueError(f"{name}: unknown settings {sorted(unknown)}")
            values = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
            base = {f: getattr(types[name], f) for f in known} if name in types else {"name": name}
            types[name] = DestinationType(**{**base, **values})
        return Catalog(types.values(), self.get("scores.category_weights"), self.get("scores.people_weight"))

    def to_json(self) -> str:
        """All settings as text that ``from_json`` reads back."""
        return json.dumps(self.values, indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls.build(json.loads(text), complete=True)

    def problems(self) -> list[str]:
        out = [f"unknown block {k}" for k in self.values if k not in DEFAULTS]
        if self.get("stress.link_model") not in ("max", "segment_only", "sum"):
            out.append(f"no such stress model: {self.get('stress.link_model')}")
        for path in ("reach.limit_m", "reach.ratio", "stress.flag_radius_m"):
            value = self.get(path)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value <= 0:
                out.append(f"{path} must be a positive number, not {value!r}")
        for path in ("trails.least_length_m", "trails.least_span_m"):
            value = self.get(path)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0:
                out.append(f"{path} must be a number of at least 0, not {value!r}")
        try:
            self.catalog()
        except (ValueError, TypeError) as e:
            out.append(str(e))
        return out

    def slice_of(self, stage: str) -> str:
        """A digest of the settings that a stage's result depends on, to tell whether it is still good."""
        part = {k: self.values.get(k) for k in SLICES[stage]}
        return hashlib.sha256(json.dumps(part, sort_keys=True).encode()).hexdigest()[:12]
