"""Connected groups of pairwise links by randomised contraction.

Every round draws a fresh hash order of the vertices. Each vertex hooks to the vertex of lowest hash among
itself and its neighbours, the graph is relabelled by the hooks, loops and repeated edges vanish, and the
next round goes on with what is left: in expectation a constant share of the vertices vanishes whatever
the graph's shape, so that long chains take a logarithmic number of rounds. A vertex without edges left is a
finished group. Every round also carries the smallest original vertex that went into each of its vertices,
so that a finished vertex knows its group's name; the hooks are then expanded from the last round to the
first, which hands the names back to all vertices without a join on the (possibly giant) group.

Vertices are 64-bit numbers, and ``xxhash64`` of one such number is a bijection: the order has no ties, and
the least neighbour is ``min_by`` over two numbers, a hash aggregate. Each round writes two tables to the
shared folder, its hooks and its edges; their sizes and the largest degree are observed while they are written.

The last ``IN_ONE_TASK`` edges, a constant, are contracted to the end by the same rounds inside one task: they would
cost ten more rounds of jobs over almost nothing.

A vertex with very many edges (a hub of a third of all rows) would crowd one task of the relabelling
joins. Only if the largest degree asks for it, the hooks of such vertices (more than 1/``HUBS`` of all edges,
so at most 2 * ``HUBS`` of them) are broadcast instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spokeline.session import Scratch

HUBS = 1000
LEAST_HUB = 10_000
IN_ONE_TASK = 4096


def _order(v: Column, seed: int) -> Column:
    """Fresh hash order: a bijection of the 64-bit numbers."""
    return F.xxhash64(F.lit(seed), v)


def _observed(scratch: Scratch, df: DataFrame, **what: Column) -> tuple[DataFrame, dict]:
    """``df`` written once, and aggregates over it taken on the way."""
    seen = Observation()
    kept = scratch.keep(df.observe(seen, *[c.alias(name) for name, c in what.items()]))
    return kept, seen.get


def _lookup(rows: DataFrame, key: str, table: DataFrame, v: str, to: str, hubs: DataFrame | None) -> DataFrame:
    """``rows`` with column ``to`` of ``table`` where ``rows.key`` = ``table.v``: hubs by broadcast, the others by shuffle."""
    plain = table.select(F.col(v).alias("__v"), F.col(to).alias("__to"))
    if hubs is None:
        return rows.join(plain, F.col(key) == F.col("__v")).drop("__v")
    few = hubs.select(F.col(v).alias("__v"), F.col(to).alias("__to"))
    done = rows.join(F.broadcast(few), F.col(key) == F.col("__v")).drop("__v")
    rest = rows.join(F.broadcast(few.select("__v")), F.col(key) == F.col("__v"), "left_anti")
    return done.unionByName(rest.join(plain, F.col(key) == F.col("__v")).drop("__v"))


def _hubs(table: DataFrame, weight: str, most: int | None, total: int) -> DataFrame | None:
    """The rows whose ``weight`` exceeds 1/HUBS of ``total``; None if the largest weight does not."""
    bound = max(LEAST_HUB, total // HUBS)
    return table.where(F.col(weight) > bound) if (most or 0) > bound else None


def _half(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _contract_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, to) of the vertices of at most ``IN_ONE_TASK`` edges: rounds of contraction until no edge is left."""
    pairs = [np.stack([b["a"].to_numpy(zero_copy_only=False), b["b"].to_numpy(zero_copy_only=False)]) for b in batches]
    edges = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), dtype=np.int64)
    vertices, flat = np.unique(edges, return_inverse=True)
    a, b = flat.reshape(edges.shape)
    to, rng = np.arange(len(vertices)), np.random.default_rng(len(vertices))
    while len(a):
        order = rng.permutation(len(vertices))
        best = order.copy()
        np.minimum.at(best, a, order[b])
        np.minimum.at(best, b, order[a])
        hook = np.argsort(order)[best]
        to, a, b = hook[to], hook[a], hook[b]
        a, b = a[a != b], b[a != b]
    yield pa.RecordBatch.from_arrays([pa.array(vertices, pa.int64()), pa.array(vertices[to], pa.int64())], names=["v", "to"])


def contract(edges: DataFrame, seed: int = 1, most_rounds: int = 200) -> DataFrame:
    """(v, group_id) of every vertex of ``edges`` (a, b BIGINT) that has an edge to another one; group_id is
    the smallest vertex of its group.

    Repeats, either direction and loops are welcome; rows with a null end are left out.
    """
    scratch = Scratch(edges.sparkSession)
    usable = edges.where("a <> b").select(*_half(F.col("a"), F.col("b")))
    now, seen = _observed(scratch, usable, n=F.count(F.lit(1)))
    rounds: list[tuple[DataFrame, dict]] = []
    names: DataFrame | None = None
    while True:
        if len(rounds) > most_rounds:
            raise RuntimeError(f"{most_rounds} rounds did not end the contraction")
        left, k = seen["n"], seed + len(rounds)
        if left:
            ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")
            nothing = F.lit(None).cast("bigint")
            ends = ends.select("v", "w", _order(F.col("w"), k).alias("h"), (nothing if names is not None else F.col("v")).alias("least"))
            rows = ends if names is None else ends.unionAll(names.select("v", nothing.alias("w"), nothing.alias("h"), "least"))
            best = rows.groupBy("v").agg(F.min_by("w", "h").alias("w"), F.min("h").alias("h"), F.count("w").alias("n"), F.min("least").alias("least"))
            if left <= IN_ONE_TASK:
                rest = F.broadcast(now.coalesce(1).mapInArrow(_contract_rest, "v bigint, to bigint"))
                hook = best.join(rest, "v", "left").select("v", F.coalesce("to", "v").alias("to"), "n", "least")
            else:
                hook = best.select("v", F.when(F.col("h") < _order(F.col("v"), k), F.col("w")).otherwise(F.col("v")).alias("to"), "n", "least")
        elif names is not None:
            hook = names.groupBy("v").agg(F.min("least").alias("least")).select("v", F.col("v").alias("to"), F.lit(0).cast("bigint").alias("n"), "least")
        else:
            return edges.where("false").select(F.col("a").alias("v"), F.col("a").alias("group_id"))
        hook, size = _observed(scratch, hook, most=F.max("n"))
        rounds.append((hook, {**size, "total": 2 * left}))
        if not left:
            break
        names = hook.where("n > 0").select(F.col("to").alias("v"), "least")
        if left <= IN_ONE_TASK:
            seen = {"n": 0}
            continue
        hubs = _hubs(hook, "n", size["most"], 2 * left)
        step = _lookup(now, "a", hook, "v", "to", hubs).select(F.col("__to").alias("a"), "b")
        step = _lookup(step, "b", hook, "v", "to", hubs).select("a", F.col("__to").alias("b"))
        step = step.where("a <> b").select(*_half(F.col("a"), F.col("b"))).distinct()
        before, (now, seen) = now, _observed(scratch, step, n=F.count(F.lit(1)))
        scratch.drop(before)
    found: DataFrame | None = None
    for hook, size in reversed(rounds):
        done = hook.where("n = 0").select("v", F.col("least").alias("group_id"))
        if found is None:
            found = done
            continue
        # at most as many vertices hook to one as it has edges
        hubs = None
        if _hubs(hook, "n", size["most"], size["total"]) is not None:
            crowds = hook.where("n > 0").groupBy("to").agg(F.count("*").alias("c")).where(F.col("c") > max(LEAST_HUB, size["total"] // HUBS)).select("to")
            hubs = scratch.keep(found.join(F.broadcast(crowds), F.col("v") == F.col("to"), "left_semi"))
        named = _lookup(hook.where("n > 0").select(F.col("v").alias("x"), "to"), "to", found, "v", "group_id", hubs)
        whole = done.unionAll(named.select(F.col("x").alias("v"), F.col("__to").alias("group_id")))
        if hook is rounds[0][0]:
            return whole
        before, found = found, scratch.keep(whole)
        scratch.drop(before)
        scratch.drop(hook)
    return found


def group_records(records: DataFrame, record: str, links: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(record, group_id BIGINT) of every record: the smallest record linked with it, over any number of links.

    links: (record, key): records with an equal key are linked; rows with a null on either side link nothing, nor do
    keys that are not in ``keys`` (key), where given. A key of n records becomes n - 1 edges to its smallest record, not n * n.
    Records without links are groups of their own; a null record is left out; a repeated one has one row.
    """
    scratch = Scratch(records.sparkSession)
    ends = links.where(F.col(record).isNotNull() & F.col("key").isNotNull()).select(F.col(record).cast("bigint").alias("r"), "key")
    rows = ends.withColumn("valid", F.lit(keys is None))
    if keys is not None:
        rows = rows.unionAll(keys.where("key is not null").select(F.lit(None).cast("bigint").alias("r"), F.col("key").cast(ends.schema["key"].dataType).alias("key"), F.lit(True).alias("valid")))
    shared = rows.groupBy("key").agg(F.min("r").alias("least"), F.count("r").alias("n"), F.max("valid").alias("valid")).where("valid and n > 1").select("key", "least", "n")
    shared, size = _observed(scratch, shared, most=F.max("n"), total=F.sum("n"))
    edges = _lookup(ends, "key", shared, "key", "least", _hubs(shared, "n", size["most"], size["total"] or 0)).where("r <> __to")
    named = contract(edges.select(F.col("__to").alias("a"), F.col("r").alias("b")))
    # a group's name is never above its records, so the least of both columns is the name
    alone = records.where(F.col(record).isNotNull()).select(F.col(record).cast("bigint").alias(record), F.col(record).cast("bigint").alias("group_id"), F.lit(True).alias("asked"))
    both = alone.unionAll(named.select("v", "group_id", F.lit(False)))
    return both.groupBy(record).agg(F.min("group_id").alias("group_id"), F.max("asked").alias("asked")).where("asked").select(record, "group_id")
