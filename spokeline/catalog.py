"""The catalog of destination types: which places they are, how they cluster and what they count for."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

#: How the places of a type become destinations: every place for itself; areas joined within reach, with the points
#: outside them; areas and points joined alike; points joined where no area is near, areas for themselves.
MODES = ("single", "areas", "together", "stops")


@dataclass(frozen=True)
class DestinationType:
    """One type. ``tags``: alternatives of {tag: values} that a place must match (None: any value); ``kind``: place, or path for runs of streets."""

    name: str
    category: str
    weight: float | None = None
    steps: tuple[float, float, float] = (0.0, 0.0, 0.0)
    top: float = 1.0
    mode: str = "single"
    reach_m: float = 0.0
    tags: tuple[Mapping[str, Any], ...] = ()
    not_tags: tuple[Mapping[str, Any], ...] = ()
    kind: str = "place"
    enabled: bool = True
    plural: str = ""
    one: str = ""
    access: str = ""
    first_row: int | None = None
    flag: str = ""
    score_id: str = ""
    aliases: tuple[str, ...] = field(default=(), compare=False)

    def nouns(self) -> tuple[str, str, str]:
        """For several, for one, and for access to them."""
        plural = self.plural or self.name.replace("_", " ")
        return plural, self.one or plural, self.access or plural


def _tagged(*keys: str, values: Sequence[str]) -> tuple[Mapping[str, Any], ...]:
    return tuple({k: list(values)} for k in keys)


#: The standard types with their weight in the category, credit for the first three, reach in metres,
#: names, first row of the score inputs, flag and identifier.
STANDARD = (
    DestinationType("schools", "opportunity", 0.35, (0.3, 0.2, 0.2), tags=_tagged("amenity", values=["school", "kindergarten"]), plural="schools", one="school", access="K12 schools", first_row=11, flag="use_k12", score_id="opportunity_k12_education", aliases=("school",)),
    DestinationType("colleges", "opportunity", 0.10, (0.7, 0.0, 0.0), mode="areas", reach_m=100, tags=_tagged("amenity", values=["college"]), plural="tech/vocational colleges", one="tech/vocational college", first_row=20, flag="use_tech", score_id="opportunity_technical_vocational_college", aliases=("college",)),
    DestinationType("universities", "opportunity", 0.20, (0.7, 0.0, 0.0), mode="areas", reach_m=150, tags=_tagged("amenity", values=["university"]), plural="universities", one="university", first_row=29, flag="use_univ", score_id="opportunity_higher_education", aliases=("university",)),
    DestinationType("doctors", "core_services", 0.20, (0.4, 0.2, 0.1), mode="areas", reach_m=50, tags=({"amenity": ["clinic", "doctors"]}, {"healthcare": ["doctor", "doctors", "clinic"]}), plural="doctors", first_row=38, flag="use_doctor", score_id="core_services_doctors", aliases=("clinic", "doctor")),
    DestinationType("dentists", "core_services", 0.10, (0.4, 0.2, 0.1), mode="areas", reach_m=50, tags=_tagged("amenity", "healthcare", values=["dentist"]), plural="dentists", first_row=47, flag="use_dentist", score_id="core_services_dentists", aliases=("dentist",)),
    DestinationType("hospitals", "core_services", 0.20, (0.7, 0.0, 0.0), mode="areas", reach_m=50, tags=({"amenity": ["hospital", "hospitals"]}, {"healthcare": ["hospital"]}), plural="hospitals", first_row=56, flag="use_hospital", score_id="core_services_hospitals", aliases=("hospital",)),
    DestinationType("pharmacies", "core_services", 0.10, (0.4, 0.2, 0.1), mode="areas", reach_m=50, tags=({"amenity": ["pharmacy"]}, {"shop": ["chemist"]}), plural="pharmacies", first_row=65, flag="use_pharmacy", score_id="core_services_pharmacies", aliases=("pharmacy",)),
    DestinationType("retail", "retail", 1.00, (0.4, 0.2, 0.1), mode="together", reach_m=50, tags=({"landuse": ["retail"]}, {"building": ["retail"]}, {"shop": None}), not_tags=({"shop": ["supermarket"]}, {"shop": ["no"]}), plural="retail", first_row=74, flag="use_retail", score_id="retail", aliases=("retail",)),
    DestinationType("supermarkets", "core_services", 0.25, (0.6, 0.2, 0.0), tags=_tagged("shop", values=["supermarket"]), plural="supermarkets", access="grocery stores", first_row=83, flag="use_grocery", score_id="core_services_grocery", aliases=("grocery",)),
    DestinationType("social_services", "core_services", 0.15, (0.7, 0.0, 0.0), tags=_tagged("amenity", values=["social_facility"]), plural="social services", first_row=92, flag="use_social_svcs", score_id="core_services_social_services"),
    DestinationType("parks", "recreation", 0.40, (0.3, 0.2, 0.2), mode="areas", reach_m=50, tags=({"amenity": ["park"]}, {"leisure": ["park", "nature_reserve", "playground"]}), plural="parks", first_row=101, flag="use_parks", score_id="recreation_parks", aliases=("park",)),
    DestinationType("trails", "recreation", 0.35, (0.7, 0.2, 0.0), kind="path", tags=_tagged("functional_class", values=["path"]), plural="trails", first_row=110, flag="use_trails", score_id="recreation_trails"),
    DestinationType("community_centers", "recreation", 0.25, (0.4, 0.2, 0.1), mode="areas", reach_m=50, tags=_tagged("amenity", values=["community_centre", "community_center"]), plural="community centers", first_row=115, flag="use_comm_ctrs", score_id="recreation_community_centers", aliases=("community_center",)),
    DestinationType("transit", "transit", 1.00, (0.6, 0.0, 0.0), mode="stops", reach_m=75, tags=({"amenity": ["bus_station", "ferry_terminal"]}, {"railway": ["station"]}, {"public_transport": ["station"]}), not_tags=({"aerialway": None},), plural="transit", first_row=124, flag="use_transit", score_id="transit", aliases=("transit",)),
)
#: What the people reached and the categories count for in a block's score; they add up to 100.
PEOPLE_WEIGHT = 15
CATEGORY_WEIGHTS = {"opportunity": 20, "core_services": 20, "retail": 15, "recreation": 15, "transit": 15}
#: The category whose weight that its types leave goes to jobs.
JOBS_CATEGORY = "opportunity"
#: A run of paths at least this long, and this far across, is a trail to ride to.
TRAIL_LENGTH_M, TRAIL_SPAN_M = 4800, 3300


class Catalog:
    """The types in force. A category's weights must not exceed 1; types without a weight share what is left."""

    def __init__(self, types: Iterable[DestinationType] = STANDARD, category_weights: Mapping[str, int] | None = None, people_weight: int = PEOPLE_WEIGHT):
        self.types = {t.name: t for t in types}
        self.category_weights = dict(CATEGORY_WEIGHTS if category_weights is None else category_weights)
        self.people_weight = people_weight
        if wrong := self.problems():
            raise ValueError("; ".join(wrong))

    def active(self, kind: str | None = None) -> list[DestinationType]:
        return [t for t in self.types.values() if t.enabled and kind in (None, t.kind)]

    def categories(self) -> list[str]:
        return list(dict.fromkeys(t.category for t in self.active()))

    def weights(self, category: str) -> dict[str, float]:
        mine = [t for t in self.active() if t.category == category]
        open_ = [t for t in mine if t.weight is None]
        left = 1.0 - sum(t.weight for t in mine if t.weight is not None)
        return {t.name: left / len(open_) if t.weight is None else t.weight for t in mine}

    def jobs_weight(self) -> float:
        return max(0.0, 1.0 - sum(self.weights(JOBS_CATEGORY).values()))

    def problems(self) -> list[str]:
        out = [f"{t.name}: no such mode: {t.mode}" for t in self.active() if t.mode not in MODES]
        out += [f"{c}: no weight of the category" for c in self.categories() if c not in self.category_weights]
        out += [f"{c}: weights add up to more than 1" for c in self.categories() if sum(t.weight or 0.0 for t in self.active() if t.category == c) > 1 + 1e-9]
        total = self.people_weight + sum(self.category_weights.values())
        return out if total == 100 else [*out, f"weights add up to {total}, not 100"]

    def changed(self, name: str, **values: Any) -> Catalog:
        """The catalog with one type changed."""
        return Catalog([replace(t, **values) if t.name == name else t for t in self.types.values()], self.category_weights, self.people_weight)

    def names(self) -> dict[str, str]:
        """What a type may be called in the tables -> its name."""
        return {a: t.name for t in self.active() for a in (t.name, *t.aliases)}
