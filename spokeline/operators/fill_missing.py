"""Missing values filled from similar records by label propagation.

Records and groups form a bipartite graph: an edge joins a record to each group it shares with similar records
(the same way, the same town and class). Observed values are clamped: they send their label and never change.

Without ``spread`` only observed values speak, so that one pass over the tiers is the fixed point: the groups are
ranked, from nearest to farthest, and a record without a value takes the label of its first group that has
one, the most frequent of the group's category distribution (the smaller of equal ones) or, for numbers, its mean.

With ``spread`` filled records speak as well and all tiers count alike. A group's value is the mean of its members'
(of numbers, or of distributions over the categories: share by label), an open record's the mean of its groups';
both are repeated until no share or number moves by more than ``tolerance``, on the open records only. Open
records with the same groups have the same value, so that they are one unknown with a weight, and a group of a
third of all rows costs no more than its distinct neighbours. Up to ``IN_ONE_TASK`` edges of unknowns, a
constant, are solved inside one task by conjugate gradients, which a long chain needs; more are iterated by joins.

A group's labels are combined before the shuffle (counts by group and label, then the best by group), so
that a group holding a third of all rows sends a few rows per task; rows look their group up in a join
that AQE splits where a group is crowded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeline.session import Scratch

IN_ONE_TASK = 50_000
Tier = Column | tuple[Column, Column]


def group_labels(senders: DataFrame, group: Column, value: Column, kind: str = "category") -> DataFrame:
    """(g, label) of every group that has a value: its most frequent one (ties: the smaller), or the mean."""
    sent = senders.select(group.alias("g"), value.alias("v")).where("g is not null and v is not null")
    if kind == "number":
        return sent.groupBy("g").agg(F.avg("v").alias("label"))
    counts = sent.groupBy("g", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("g").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b")).select("g", F.col("b.v").alias("label"))


def propagate(records: DataFrame, value: str, tiers: Sequence[Tier], kind: str = "category", spread: bool = False, tolerance: float = 1e-6, rounds: int | None = None) -> DataFrame:
    """``records`` with ``label`` (the value, observed or filled) and ``filled_by``: null if observed or
    still missing, else the tier (0, 1, ...) that filled it (with ``spread`` the first tier the record has).

    ``value`` must be null where it is missing. Each tier is an expression that names the record's group, null
    for none; a pair (sends, receives) names the group it speaks to and the one it listens to, which only differ
    without ``spread``. A record whose groups lead to no observed value stays missing. ``rounds`` bounds the
    iteration: it is an error if the values still move then. Columns of ``records`` named ``label`` or
    ``filled_by`` are replaced. An empty table stays empty; repeated records each speak.
    """
    scratch = Scratch(records.sparkSession)
    pairs = [t if isinstance(t, tuple) else (t, t) for t in tiers]
    if spread and any(isinstance(t, tuple) for t in tiers):
        raise ValueError("with spread a record listens to the groups it speaks to")
    speaks, hears = [f"__s{k}" for k in range(len(pairs))], [f"__g{k}" for k in range(len(pairs))]
    named = {n: g for names, side in ((speaks, 0), (hears, 1)) for n, g in zip(names, (p[side] for p in pairs))}
    now = scratch.keep(records.withColumns({"label": F.col(value), "filled_by": F.lit(None).cast("int"), **named}))
    if spread:
        return _spread(now, hears, kind, tolerance, rounds, scratch).drop(*speaks, *hears)
    observed = now.where(F.col(value).isNotNull())
    for k, (s, g) in enumerate(zip(speaks, hears)):
        best = group_labels(observed, F.col(s), F.col(value), kind).withColumnsRenamed({"g": "__g", "label": "__new"})
        have, want = now.where("label is not null"), now.where("label is null")
        want = want.join(best, want[g] == best["__g"], "left")
        want = want.withColumns({"label": F.col("__new").cast(now.schema["label"].dataType), "filled_by": F.coalesce("filled_by", F.when(F.col("__new").isNotNull(), F.lit(k)))}).drop("__g", "__new")
        now = have.unionByName(want)
    return now.drop(*speaks, *hears)


def _edges(df: DataFrame, groups: Sequence[str], *others: str) -> DataFrame:
    """(k, g, others): one row for each group of a row, k the tier."""
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.col(g).cast("string").alias("g")) for k, g in enumerate(groups)])
    return df.select(*others, F.explode(F.filter(every, lambda e: e.g.isNotNull())).alias("e")).select("e.k", "e.g", *others)


def _spread(now: DataFrame, groups: list[str], kind: str, tolerance: float, rounds: int | None, scratch: Scratch) -> DataFrame:
    number = kind == "number"
    label_type = now.schema["label"].dataType
    observed = now.where("label is not null").select("*", (F.lit(0) if number else F.col("label")).alias("l"), (F.col("label").cast("double") if number else F.lit(1.0)).alias("p"))
    sent = scratch.keep(_edges(observed, groups, "l", "p").groupBy("k", "g", "l").agg(F.sum("p").alias("sum"), F.count("*").alias("n")))
    # open records with the same groups are one unknown
    open_ = now.where("label is null").where(" or ".join(f"`{g}` is not null" for g in groups))
    unknown = open_.groupBy(*groups).agg(F.count("*").cast("double").alias("c")).withColumn("t", F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("+"), F.hex(F.encode(F.col(g).cast("string"), "UTF-8"))), F.lit("-")) for g in groups])))
    unknown = scratch.keep(unknown)
    links = scratch.keep(_edges(unknown, groups, "t", "c"))
    solve = _in_one_task if links.count() <= IN_ONE_TASK else _by_rounds
    found = solve(links, sent, number, tolerance, rounds, scratch)
    best = found.groupBy("t").agg(F.max("p").alias("v") if number else F.min(F.struct((-F.round("p", 9)).alias("p"), "l")).alias("b"))
    filled_in = unknown.join(best.select("t", (F.col("v") if number else F.col("b.l")).cast(label_type).alias("__new")), "t").select(*[F.col(g).alias(f"__w{i}") for i, g in enumerate(groups)], "__new")
    want = now.where("label is null")
    on = [want[g].eqNullSafe(filled_in[f"__w{i}"]) for i, g in enumerate(groups)]
    first = F.coalesce(*[F.when(F.col(g).isNotNull(), k) for k, g in enumerate(groups)])
    want = want.join(filled_in, on, "left").withColumns({"label": F.col("__new"), "filled_by": F.when(F.col("__new").isNotNull(), first)}).drop("__new", *[f"__w{i}" for i in range(len(groups))])
    return now.where("label is not null").unionByName(want)


def _by_rounds(links: DataFrame, sent: DataFrame, number: bool, tolerance: float, rounds: int | None, scratch: Scratch) -> DataFrame:
    """(t, l, p) of the unknowns that are reached, by one join to the groups and one back in every round."""
    state, done = None, 0
    while True:
        parts = sent.select("k", "g", "l", F.col("sum").alias("s"), (F.col("n").cast("double") if number else F.col("sum")).alias("w"))
        if state is not None:
            mine = links.join(state, "t").select("k", "g", "l", (F.col("c") * F.col("p")).alias("s"), (F.col("c") if number else F.col("c") * F.col("p")).alias("w"))
            parts = parts.unionAll(mine)
        of_groups = parts.groupBy("k", "g", "l").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
        weights = of_groups.groupBy("k", "g").agg(F.sum("w").alias("w"))
        means = of_groups.drop("w").join(weights, ["k", "g"]).select("k", "g", "l", (F.col("s") / F.col("w")).alias("m"))
        heard = links.join(means, ["k", "g"])
        tiers = links.join(weights, ["k", "g"], "left_semi").groupBy("t").agg(F.count("*").alias("d"))
        new = heard.groupBy("t", "l").agg(F.sum("m").alias("m")).join(tiers, "t").select("t", "l", (F.col("m") / F.col("d")).alias("p"))
        before, state = state, scratch.keep(new)
        done += 1
        if before is not None:
            both = state.withColumnRenamed("p", "x").join(before, ["t", "l"], "full_outer")
            # a fresh unknown moves without bound; a number counts relative to its size
            size = F.greatest(F.abs("x"), F.lit(1.0)) if number else F.lit(1.0)
            moved = both.agg(F.max(F.when(F.col("x").isNull() | F.col("p").isNull(), F.lit(1e300)).otherwise(F.abs(F.col("x") - F.col("p")) / size))).first()[0] or 0.0
            scratch.drop(before)
            if moved <= tolerance:
                return state
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"values still moved after {rounds} rounds")


def _in_one_task(links: DataFrame, sent: DataFrame, number: bool, tolerance: float, rounds: int | None, scratch: Scratch) -> DataFrame:
    """The same fixed point of at most ``IN_ONE_TASK`` edges; only groups that hold unknowns come into the task."""
    groups = links.select("k", "g").distinct()
    kind = sent.schema["l"].dataType.simpleString()
    heard = sent.join(F.broadcast(groups), ["k", "g"], "left_semi")
    rows = links.select(F.lit(0).alias("what"), "k", "g", "t", "c", F.lit(None).cast(kind).alias("l"), F.lit(0.0).alias("sum"))
    rows = rows.unionAll(heard.select(F.lit(1), "k", "g", F.lit(None).cast("string"), F.col("n").cast("double"), "l", "sum"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        df = table.to_pandas()
        g = df.groupby(["k", "g"], sort=False, dropna=False).ngroup().to_numpy()
        is_link = df["what"].to_numpy() == 0
        names, t = np.unique(df["t"].to_numpy(dtype=object)[is_link].astype(str), return_inverse=True)
        at, told = g[is_link], df[~is_link]
        n_groups, n = int(g.max()) + 1, len(names)
        weight = np.zeros(n)
        weight[t] = df["c"].to_numpy()[is_link]
        size = np.bincount(g[~is_link], weights=told["c"], minlength=n_groups)
        # who hears an observed value at all, over any number of groups
        live = size > 0
        while True:
            reached = np.bincount(t, weights=live[at], minlength=n) > 0
            grown = live | (np.bincount(at, weights=reached[t], minlength=n_groups) > 0)
            if (grown == live).all():
                break
            live = grown
        keep = reached[t]
        t, at = t[keep], at[keep]
        size = size + np.bincount(at, weights=weight[t], minlength=n_groups)
        size[size == 0] = 1.0
        degree = np.bincount(t, minlength=n).astype(float)
        diagonal = np.where(degree > 0, weight * degree, 1.0)

        def times(x: np.ndarray) -> np.ndarray:
            sums = np.bincount(at, weights=(weight * x)[t], minlength=n_groups) / size
            return diagonal * x - weight * np.bincount(t, weights=sums[at], minlength=n)

        labels = told["l"].drop_duplicates().tolist()
        for label in labels:
            own = told[(told["l"] == label).to_numpy()]
            sums = np.bincount(g[~is_link][(told["l"] == label).to_numpy()], weights=own["sum"], minlength=n_groups) / size
            b = weight * np.bincount(t, weights=sums[at], minlength=n)
            x = np.zeros(n)
            r = b - times(x)
            z = r / diagonal
            d, rz, steps = z.copy(), float(r @ z), 0
            bound = tolerance * max(1e-12, float(np.abs(b / diagonal).max()))
            while np.abs(r / diagonal).max() > bound * 1e-3 and rz > 0:
                q = times(d)
                step = rz / float(d @ q)
                x, r = x + step * d, r - step * q
                z = r / diagonal
                rz, before = float(r @ z), rz
                d, steps = z + rz / before * d, steps + 1
                if steps > 20 * n + 100:
                    raise RuntimeError("the values did not settle")
            found = reached & ((x > tolerance * 1e-3) | number)
            yield pa.RecordBatch.from_arrays([pa.array(names[found], pa.string()), pa.array([label] * int(found.sum()), table.schema.field("l").type), pa.array(x[found])], names=["t", "l", "p"])

    return rows.coalesce(1).mapInArrow(solve, f"t string, l {kind}, p double")


def filled(records: DataFrame) -> DataFrame:
    """The rows of ``propagate`` whose value was filled."""
    return records.where("filled_by is not null")
