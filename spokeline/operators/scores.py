"""Scores of blocks and of the city, from what every block reaches; one aggregate for each kind of thing reached."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeline.catalog import JOBS_CATEGORY, Catalog, DestinationType
from spokeline.functions.scoring import access_score, destination_score, weighted_mean
from spokeline.operators.city import stress_miles

SHARES = (0.5, 0.7, 0.3)


def reached_amount(pairs: DataFrame, amounts: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
    """(block, {name}_high_stress, {name}_low_stress, {name}_score): the amount that a block reaches, in all and at low stress.

    pairs: source_block, target_block, low_stress; amounts: block, amount. What a block without pairs reaches in all
    is null, at low stress 0; such a block has no score.
    """
    worth = F.coalesce(F.col("amount"), F.lit(0))
    rows = pairs.join(amounts.select(F.col("block").alias("target_block"), "amount"), "target_block", "left")
    found = rows.groupBy(F.col("source_block").alias("block")).agg(F.sum(worth).alias(f"{name}_high_stress"), F.sum(F.when(F.col("low_stress"), worth).otherwise(0)).alias(f"{name}_low_stress"))
    out = blocks.select("block").join(found, "block", "left").na.fill(0, [f"{name}_low_stress"])
    return out.withColumn(f"{name}_score", access_score(F.col(f"{name}_low_stress"), F.col(f"{name}_high_stress")))


def reached_destinations(seen: DataFrame, blocks: DataFrame, types: list[DestinationType]) -> DataFrame:
    """(block, {type}_high_stress, {type}_low_stress, {type}_score): distinct destinations reached, 0 for none.

    seen: block, dest_type, id, low_stress; a destination may be seen often. It is counted once by a first aggregate,
    so that the second needs no distinct counts.
    """
    once = seen.groupBy("block", "dest_type", "id").agg(F.max("low_stress").alias("low"))
    mine = lambda t: F.col("dest_type") == t.name
    counts = [c for t in types for c in (F.count_if(mine(t)).alias(f"{t.name}_high_stress"), F.count_if(mine(t) & F.col("low")).alias(f"{t.name}_low_stress"))]
    found = once.groupBy("block").agg(*counts)
    out = blocks.select("block").join(found, "block", "left").na.fill(0)
    return out.withColumns({f"{t.name}_score": destination_score(F.col(f"{t.name}_low_stress"), F.col(f"{t.name}_high_stress"), *t.steps, t.top) for t in types})


def _category(catalog: Catalog, category: str, has_jobs: bool) -> list[tuple[str, float, bool]]:
    """(name, weight, whether it decides that the category counts) of a category's members."""
    members = [(n, w, True) for n, w in catalog.weights(category).items()]
    return [*members, ("emp", catalog.jobs_weight(), False)] if category == JOBS_CATEGORY and has_jobs else members


def put_together(reached: DataFrame, catalog: Catalog, has_jobs: bool) -> DataFrame:
    """``reached`` with {category}_score and overall_score (0 to 100).

    A category's score is the weighted mean of its members' scores that exist. In the overall score a category
    counts for a block that reaches anything of it; its members there weigh by what is reachable, jobs always. A block
    that reaches no people at all (null) has no overall score.
    """
    zero = F.lit(0.0)
    worth, weight = F.coalesce("pop_score", zero) * catalog.people_weight, F.lit(float(catalog.people_weight))
    scores: dict[str, Column] = {}
    for category in catalog.categories():
        members = _category(catalog, category, has_jobs)
        scores[f"{category}_score"] = weighted_mean([(F.col(f"{n}_score"), w) for n, w, _ in members])
        high = {n: F.coalesce(F.col(f"{n}_high_stress"), F.lit(0)) for n, _, gates in members if gates}
        there = sum(high.values(), F.lit(0)) > 0
        total = sum((F.coalesce(f"{n}_score", zero) * w for n, w, _ in members), zero)
        within = sum((F.when(high[n] > 0, w).otherwise(0.0) if gates else F.lit(w) for n, w, gates in members), zero)
        inter = float(catalog.category_weights[category])
        worth = worth + F.when(there, F.coalesce(F.try_divide(total, within), total) * inter).otherwise(0.0)
        weight = weight + F.when(there, inter).otherwise(0.0)
    overall = F.when(F.col("pop_high_stress").isNotNull(), F.try_divide(worth, weight) * 100)
    return reached.withColumns({**scores, "overall_score": overall})


def block_scores(pairs: DataFrame, blocks: DataFrame, destinations: DataFrame, catalog: Catalog, jobs: DataFrame | None = None, trails: DataFrame | None = None) -> DataFrame:
    """One row for every block: what it reaches, the scores of it, of the categories, and overall.

    blocks: block, pop20; destinations: id, dest_type (names of the catalog), blockid20 ARRAY; jobs: block, amount;
    trails: block, id, low_stress of the trails a block reaches, the type being the catalog's of kind path.
    """
    out = reached_amount(pairs, blocks.select("block", F.col("pop20").alias("amount")), blocks, "pop")
    if jobs is not None:
        out = out.join(reached_amount(pairs, jobs, blocks, "emp"), "block")
    else:
        out = out.withColumns({f"emp_{c}": F.lit(None).cast("double") for c in ("high_stress", "low_stress", "score")})
    placed = destinations.select("id", "dest_type", F.explode("blockid20").alias("target_block"))
    seen = pairs.join(placed, "target_block").select(F.col("source_block").alias("block"), "dest_type", "id", "low_stress")
    out = out.join(reached_destinations(seen, blocks, catalog.active("place")), "block")
    paths = catalog.active("path")[:1]
    if paths:
        rows = trails.select("block", F.lit(paths[0].name).alias("dest_type"), "id", "low_stress") if trails is not None else None
        if rows is not None:
            out = out.join(reached_destinations(rows, blocks, paths), "block")
        else:
            name = paths[0].name
            out = out.withColumns({f"{name}_high_stress": F.lit(0), f"{name}_low_stress": F.lit(0), f"{name}_score": F.lit(None).cast("double")})
    return put_together(out, catalog, jobs is not None)


def reachable_blocks(pairs: DataFrame) -> DataFrame:
    """(block, reachable_blocks, reachable_low): how many blocks each one reaches, in all and at low stress."""
    return pairs.groupBy(F.col("source_block").alias("block")).agg(F.count("*").alias("reachable_blocks"), F.count_if("low_stress").alias("reachable_low"))


def _ratio(low: str, high: str) -> Column:
    return F.try_divide(F.col(low).cast("double"), F.nullif(F.greatest(F.col(high).cast("double"), F.lit(0.0)), F.lit(0.0)))


def _of_sums(low: str, high: str, whole: bool) -> Column:
    """Ratio of the sums, or its whole part; 0 if nothing is reachable."""
    ratio = F.try_divide(F.sum(low).cast("double"), F.nullif(F.sum(high).cast("double"), F.lit(0.0)))
    return F.coalesce(F.floor(ratio).cast("double") if whole else ratio, F.lit(0.0))


def _by_people(score: str, only: Column | None = None) -> Column:
    """Mean score weighted by the people of the blocks, over the people of all or of some blocks; 0 without people."""
    people = F.sum("pop20") if only is None else F.sum(F.when(only, F.col("pop20")))
    return F.coalesce(F.try_divide(F.sum(F.col("pop20") * F.col(score)).cast("double"), F.nullif(people.cast("double"), F.lit(0.0))), F.lit(0.0))


def _rows(catalog: Catalog) -> list[tuple[int, str, str, str, str]]:
    """(id, category, score name, column of the aggregates, flag) of the score inputs, in order."""
    named = {0.5: "Median", 0.7: "70th percentile", 0.3: "30th percentile"}
    share = lambda q: f"p{round(q * 100)}"
    out = []
    for start, category, name, noun, mean, flag in ((1, "People", "pop", "population", "population", "use_pop"), (6, "Opportunity", "emp", "employment", "jobs", "use_emp")):
        out += [(start + k, category, f"{named[q]} score of access to {noun}", f"{name}_{share(q)}", "") for k, q in enumerate(SHARES)]
        out += [(start + 3, category, f"Average score of access to {noun}", f"{name}_average", ""), (start + 4, category, f"Average score of access to {mean}", f"{name}_mean", flag)]
    standard = sorted((t for t in catalog.active() if t.first_row), key=lambda t: t.first_row)
    own = [t for t in catalog.active("place") if not t.first_row]
    starts = [*((t, t.first_row) for t in standard), *((t, 133 + 9 * k) for k, t in enumerate(own))]
    for t, start in starts:
        category = t.category.replace("_", " ").title()
        plural, one, access = t.nouns()
        of = plural if t.kind == "path" else one
        out.append((start, category, f"Average score of low stress access to {plural}", f"{t.name}_average", ""))
        out += [(start + 1 + k, category, f"{named[q]} score of {of} access", f"{t.name}_{share(q)}", "") for k, q in enumerate(SHARES)]
        out.append((start + 4, category, f"Average score of access to {access}", f"{t.name}_mean", t.flag or f"use_{t.name}"))
        if t.kind == "place":
            out.append((start + 5, category, f"Average {one} bike shed access score", f"{t.name}_shed_average", ""))
            out += [(start + 6 + k, category, f"{named[q]} {one} population shed score", f"{t.name}_shed_{share(q)}", "") for k, q in enumerate(SHARES)]
    return out


def city_aggregates(scores: DataFrame, blocks: DataFrame, pairs: DataFrame, catalog: Catalog, sheds: DataFrame | None = None) -> DataFrame:
    """One row with everything the city's tables are made of: one pass over the blocks, one over the destinations.

    sheds: dest_type, pop_low_stress, pop_high_stress of the destinations, where that was computed.
    """
    merged = scores.join(blocks.select("block", "pop20"), "block").join(reachable_blocks(pairs), "block", "left")
    wanted: dict[str, Column] = {}

    def ratios(name: str, low: str, high: str) -> None:
        wanted[f"__{name}"] = F.percentile(_ratio(low, high), [float(q) for q in SHARES])

    for name, whole in [("pop", False), ("emp", False), *((t.name, True) for t in catalog.active())]:
        low, high = f"{name}_low_stress", f"{name}_high_stress"
        ratios(name, low, high)
        wanted[f"{name}_average"] = _of_sums(low, high, whole)
        wanted[f"{name}_mean"] = _by_people(f"{name}_score", None if name in ("pop", "emp") else F.col(high) > 0)
        wanted[f"{name}_any"] = F.coalesce(F.bool_or(F.col(high) > 0), F.lit(False))
    reaching = F.coalesce(F.col("reachable_blocks"), F.lit(0)) > 0
    share = F.sum(F.when(reaching & (F.col("pop20") > 0), F.col("overall_score") / 100 * F.col("pop20")))
    wanted["overall"] = F.coalesce(F.try_divide(share, F.nullif(F.sum(F.when(reaching, F.col("pop20"))).cast("double"), F.lit(0.0))), F.lit(0.0))
    wanted["people"] = F.sum("pop20").cast("double")
    row = merged.agg(*[c.alias(n) for n, c in wanted.items()])
    kept = [n for n in wanted if not n.startswith("__")]
    row = row.select(*kept, *[F.get(n, k).alias(f"{n[2:]}_p{round(q * 100)}") for n in wanted if n.startswith("__") for k, q in enumerate(SHARES)])
    places = catalog.active("place")
    if sheds is None:
        return row.withColumns({f"{t.name}_shed_{c}": F.lit(None).cast("double") for t in places for c in ("average", "p50", "p70", "p30")})
    low, high = F.col("pop_low_stress").cast("double"), F.col("pop_high_stress").cast("double")
    made = sheds.groupBy().agg(*[c for t in places for mine in [F.col("dest_type") == t.name] for c in (
        F.try_divide(F.sum(F.when(mine, low)), F.nullif(F.sum(F.when(mine, high)), F.lit(0.0))).alias(f"{t.name}_shed_average"),
        F.percentile(F.when(mine, _ratio("pop_low_stress", "pop_high_stress")), [float(q) for q in SHARES]).alias(f"__{t.name}"),
    )])
    made = made.select(*[f"{t.name}_shed_average" for t in places], *[F.get(f"__{t.name}", k).alias(f"{t.name}_shed_p{round(q * 100)}") for t in places for k, q in enumerate(SHARES)])
    return _side_by_side(row, made)


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns of two tables of one row each."""
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")


def score_inputs(aggregates: DataFrame, catalog: Catalog) -> DataFrame:
    """(id, category, score_name, score, use_flag): the long table of the city's figures, to four places."""
    entries = [F.struct(F.lit(i).alias("id"), F.lit(c).alias("category"), F.lit(n).alias("score_name"), F.round(F.col(at), 4).alias("score"), F.lit(flag or None).cast("string").alias("use_flag")) for i, c, n, at, flag in _rows(catalog)]
    return aggregates.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def city_scores(aggregates: DataFrame, catalog: Catalog, miles: DataFrame) -> DataFrame:
    """(place, score_id, score_original, score_normalized): people, jobs, every type, the categories, the city as a whole.

    miles: low_miles, high_miles. A category of several types has a row of its own; it is null where none of its types
    is reachable anywhere.
    """
    mean = lambda name: F.round(F.col(f"{name}_mean"), 4)
    rows: list[tuple[str, Column]] = [("people", mean("pop")), ("opportunity_employment", mean("emp"))]
    for category in catalog.category_weights:
        mine = [t for t in catalog.active() if t.category == category]
        places = [t for t in mine if t.kind == "place"]
        if not mine:
            continue
        ordered = sorted(mine, key=lambda t: (t.first_row or 10_000))
        rows += [(t.score_id or f"{category}_{t.name}", mean(t.name)) for t in ordered]
        if len(places) > 1 or category in (JOBS_CATEGORY, "recreation"):
            members = [(n, w) for n, w, _ in _category(catalog, category, True)]
            there = sum((F.when(F.col(f"{n}_any"), w).otherwise(0.0) for n, w in members), F.lit(0.0))
            total = sum((F.when(F.col(f"{n}_any"), mean(n) * w).otherwise(0.0) for n, w in members), F.lit(0.0))
            rows.append((category, F.try_divide(total, F.nullif(there, F.lit(0.0)))))
    rows += [("overall_score", F.col("overall")), ("population_total", F.col("people")), ("total_miles_low_stress", F.col("low_miles")), ("total_miles_high_stress", F.col("high_miles"))]
    shown = lambda name, c: F.lit(None).cast("double") if name == "population_total" else F.round(c, 1) if name.startswith("total_miles") else c * 100
    entries = [F.struct(F.lit(k).alias("place"), F.lit(n).alias("score_id"), c.cast("double").alias("score_original"), shown(n, c).cast("double").alias("score_normalized")) for k, (n, c) in enumerate(rows, 1)]
    return _side_by_side(aggregates, miles).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def city_tables(scores: DataFrame, blocks: DataFrame, pairs: DataFrame, streets: DataFrame, catalog: Catalog, sheds: DataFrame | None = None) -> Mapping[str, DataFrame]:
    """score_inputs and city_scores."""
    row = city_aggregates(scores, blocks, pairs, catalog, sheds)
    return {"score_inputs": score_inputs(row, catalog), "city_scores": city_scores(row, catalog, stress_miles(streets))}
