"""Scores as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (ratio, score) at the steps of the access curve.
ACCESS_STEPS = ((0.03, 0.1), (0.2, 0.4), (0.5, 0.8))


def access_score(low: Column, high: Column, steps: Sequence[tuple[float, float]] = ACCESS_STEPS, top: float = 1.0) -> Column:
    """Share of what is reachable that is reachable at low stress, on a piecewise linear curve.

    Null if nothing is reachable, 0 if nothing at low stress, ``top`` if everything is. Without steps, or
    with a first step of score 0, the curve is one line.
    """
    ratio = F.try_divide(low.cast("double"), F.nullif(high.cast("double"), F.lit(0.0)))
    if not steps or steps[0][1] == 0:
        curve = ratio * top
    else:
        knots = [(0.0, 0.0), *steps, (1.0, top)]
        curve = None
        for (r0, s0), (r1, s1) in reversed(list(zip(knots, knots[1:]))):
            line = F.lit(s0) + F.lit(s1 - s0) * (ratio - r0) / (r1 - r0)
            curve = line if curve is None else F.when(ratio <= r1, line).otherwise(curve)
    return F.when(ratio.isNull(), None).when(ratio == 0, 0.0).when(ratio >= 1, float(top)).otherwise(curve)


def destination_score(low: Column, high: Column, first: float, second: float, third: float, top: float = 1.0) -> Column:
    """Credit for the first, second and third destination at low stress, the rest shared out evenly.

    Null if there is none at all; with ``first`` 0 the score is the plain share.
    """
    low_, high_ = low.cast("double"), high.cast("double")
    sums, total = [], 0.0
    for step in (first, second, third):
        if not step:
            break
        total += step
        sums.append(total)
    if not sums:
        return F.when(high == 0, None).when(low == 0, 0.0).when(low == high, float(top)).otherwise(low_ / high_)
    tail = F.lit(sums[-1]) + F.lit(top - sums[-1]) * (low_ - len(sums)) / (high_ - len(sums))
    out = F.when((high == 0) | high.isNull(), None).when(low == 0, 0.0).when(low == high, float(top))
    for k, credit in enumerate(sums, 1):
        out = out.when(low == k, float(credit))
    return out.otherwise(tail)


def weighted_mean(scores: Sequence[tuple[Column, float]]) -> Column:
    """Mean of the scores that are there, by weight; null if none is."""
    worth = sum((F.coalesce(s, F.lit(0.0)) * w for s, w in scores), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in scores), F.lit(0.0))
    return F.try_divide(worth, F.nullif(weight, F.lit(0.0)))


def overall_score(population: Column, population_weight: float, categories: Sequence[tuple[Column, float, Column]]) -> Column:
    """0 to 100 from the population score and (score, weight, whether anything of it is reachable) by category."""
    worth, weight = F.coalesce(population, F.lit(0.0)) * population_weight, F.lit(float(population_weight))
    for score, w, reachable in categories:
        there = F.when(reachable, w).otherwise(0.0)
        worth, weight = worth + F.coalesce(score, F.lit(0.0)) * there, weight + there
    return F.try_divide(worth, weight) * 100


def link_cost(a: Column, b: Column) -> Column:
    """Half the lengths of two neighbouring segments: both rounded (halves to even), the sum halved and cut."""
    return F.floor((F.bround(a) + F.bround(b)) / 2).cast("bigint")


def link_stress(a: Column, b: Column, turn: Column, model: str = "max", levels: int = 3) -> Column:
    """Stress of going from a to b over a turn: the worst of them, that of the segments, or their sum up to ``levels``."""
    if model == "max":
        return F.greatest(a, b, turn)
    if model == "segment_only":
        return F.greatest(a, b)
    if model == "sum":
        return F.least(sum((F.coalesce(x, F.lit(0)) for x in (a, b, turn)), F.lit(0)), F.lit(levels))
    raise ValueError(f"no such stress model: {model}")


def crossing_is_stressful(fc: Column, speed: Column, lanes_ft: Column, lanes_tf: Column, one_way: Column, rrfb: Column, island: Column) -> Column:
    """Whether crossing a road is stressful, by class, speed, lanes, flashing beacon and refuge island."""
    heavy, busy = fc.isin("motorway", "trunk"), fc.isin("primary", "secondary")
    v = F.coalesce(speed, F.when(busy, 40).otherwise(30))
    usual = F.when(busy, 2).otherwise(1)
    beacon, bare = F.coalesce(rrfb, F.lit(False)), ~F.coalesce(island, F.lit(False))
    lanes = F.coalesce(lanes_ft, lanes_tf, usual)
    most = F.when(beacon & (lanes == 2), 40).when(beacon & (lanes < 2), 35).otherwise(30)
    total = F.coalesce(lanes_ft, usual) + F.coalesce(lanes_tf, usual)
    four = F.when(beacon, (v > 40) | ((v > 30) & bare)).otherwise((v > 30) | ((v == 30) & bare))
    fewer = bare & (v > F.when(beacon, 35).otherwise(30))
    two_way = (total > 4) | F.when(total == 4, four).otherwise(fewer)
    crossed = F.when(one_way.isNotNull(), (lanes > 2) | (v > most)).otherwise(two_way)
    return F.coalesce(heavy | ((busy | (fc == "tertiary")) & crossed), F.lit(False))
