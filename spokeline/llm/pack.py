"""Texts laid into containers of fixed capacity by linear grouping.

1. Sizes are token counts. A text larger than a container is split: full pieces fill containers of their own,
   the rest is an item like any other. Nothing else is split.
2. Large items (over 1/SMALL of the capacity) are grouped by size into ``GROUPS`` groups of about equal
   cardinality and rounded up to their group's largest size. The groups follow from the histogram of
   sizes, which has at most as many entries as the capacity; only it reaches the driver.
3. With few sizes left, the best mix of configurations (how many items of each group share a container) is
   a linear programme, solved by column generation: new configurations come from a knapsack over the
   duals. Rounded down it fills whole runs of containers; the few items left over are first-fit.
4. Actual items take the slots: the item of rank r in its group goes where slot r of the group lies. Ranks
   are counted by (group, salt) and summed, so that no task holds a whole group.
5. Small items are best-fit, the largest first, into what the actual sizes left free, in shards of about
   ``SHARD`` items by hash; what doesn't fit opens containers in its shard.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spokeline.llm.encode import _encoding, tokenizer_path
from spokeline.session import Scratch

GROUPS = 32
SMALL = 16
SHARD = 20_000
#: So many pivots for each group without any gain end column generation, with a warning.
STALLED = 50


def token_pieces(docs: DataFrame, doc: str, text: str, capacity: int, path: str | None = None) -> DataFrame:
    """(row, doc, piece, first_token, n_tokens): a row per text, or per piece of one larger than ``capacity``.

    Null and empty texts are one piece of no tokens. ``row`` numbers the rows, so that repeats stay apart.
    """
    path = path or tokenizer_path()
    kind = docs.schema[doc].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        start = TaskContext.get().partitionId() << 33
        encode = _encoding(path)[0].encode_ordinary
        for batch in batches:
            counts = np.array([len(encode(t)) if t else 0 for t in batch[text].to_pylist()], dtype=np.int64)
            pieces = np.maximum(1, -(-counts // capacity))
            owner = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(capacity, counts[owner] - piece * capacity)
            arrays = [pa.array(start + owner), batch[doc].take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(size.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", doc, "piece", "first_token", "n_tokens"])
            start += len(counts)

    return docs.select(doc, text).mapInArrow(cut, f"row bigint, `{doc}` {kind}, piece int, first_token bigint, n_tokens int")


def group_sizes(histogram: dict[int, int], groups: int = GROUPS) -> list[tuple[int, int]]:
    """(largest size, number of items) of groups of about equal cardinality, by descending size."""
    total, out = sum(histogram.values()), []
    want, held, top = max(1, math.ceil(total / groups)), 0, None
    for size in sorted(histogram, reverse=True):
        top = size if top is None else top
        held += histogram[size]
        if held >= want:
            out.append((top, held))
            held, top = 0, None
    return out + ([(top, held)] if held else [])


def _best_configuration(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Unbounded knapsack over whole capacities."""
    worth, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        gains = worth[c - sizes[fits]] + duals[fits]
        k = int(gains.argmax())
        worth[c] = worth[c - 1]
        if gains[k] > worth[c]:
            worth[c], pick[c] = gains[k], fits[k]
    counts, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if pick[c] < 0 or worth[c] == worth[c - 1]:
            c -= 1
            continue
        counts[pick[c]] += 1
        c -= int(sizes[pick[c]])
    return counts, float(worth[capacity])


def configurations(groups: list[tuple[int, int]], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(items of each group, number of containers): together they have a slot for every item."""
    if not groups:
        return []
    sizes, need = np.array([s for s, _ in groups]), np.array([n for _, n in groups], dtype=np.float64)
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(np.float64)
    x = need / np.diag(basis)
    best, stalled = math.inf, 0
    while stalled <= STALLED * len(sizes):
        best, stalled = (float(x.sum()), 0) if x.sum() < best - 1e-9 else (best, stalled + 1)
        duals = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column, worth = _best_configuration(sizes, np.maximum(duals, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(np.float64))
        ratios = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratios.argmin())
        if not np.isfinite(ratios[leave]):
            break
        x = np.maximum(0, x - step * ratios[leave])
        x[leave] = ratios[leave]
        basis[:, leave] = column
    else:
        warnings.warn(f"column generation stalled at {best:.1f} containers; the optimum may be lower", stacklevel=2)
    out, left = [], need.astype(np.int64).copy()
    for k in np.argsort(-x):
        column = basis[:, k].round().astype(np.int64)
        n = int(x[k] + 1e-9)
        if column.any():
            n = min(n, int(min(left[g] // column[g] for g in np.flatnonzero(column))))
        if n > 0 and column.any():
            out.append((column, n))
            left -= column * n
    # at most a few containers' worth: first-fit by descending size, whole runs of one group first
    free: list[list] = []
    for g in np.argsort(-sizes):
        per = max(1, capacity // int(sizes[g]))
        if left[g] >= 8 * per * len(sizes):
            n = int(left[g] // per)
            out.append((np.eye(len(sizes), dtype=np.int64)[g] * per, n))
            left[g] -= n * per
        for _ in range(int(left[g])):
            slot = next((f for f in free if f[0] >= sizes[g]), None)
            if slot is None:
                free.append(slot := [capacity, np.zeros(len(sizes), dtype=np.int64)])
            slot[0] -= sizes[g]
            slot[1][g] += 1
    return out + [(f[1], 1) for f in free]


def best_fit(free: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The container of each item (those at ``len(free)`` and above are new) and how many are new.

    Items come largest first and take the fullest container that has room; a bit set of the amounts of free
    space finds it.
    """
    stacks: dict[int, list[int]] = {}
    mask = 0
    for k, f in enumerate(free.tolist()):
        stacks.setdefault(f, []).append(k)
        mask |= 1 << f
    got, fresh = np.empty(len(sizes), dtype=np.int64), len(free)
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        room = mask >> s
        if room:
            f = s + (room & -room).bit_length() - 1
            k = stacks[f].pop()
            if not stacks[f]:
                mask &= ~(1 << f)
        else:
            f, k, fresh = capacity, fresh, fresh + 1
        got[i] = k
        stacks.setdefault(f - s, []).append(k)
        mask |= 1 << (f - s)
    return got, fresh - len(free)


def pack(items: DataFrame, capacity: int, groups: int = GROUPS, shard: int = SHARD) -> DataFrame:
    """``items`` with ``container_id`` BIGINT. items: row, piece (together unique) and n_tokens, 0 to capacity."""
    spark = items.sparkSession
    scratch = Scratch(spark)
    items = scratch.keep(items)
    large = F.col("n_tokens") * SMALL > capacity
    counts = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    histogram = {s: n for s, n in counts.items() if s * SMALL > capacity}
    n_large, n_small = sum(histogram.values()), sum(counts.values()) - sum(histogram.values())
    grouped = group_sizes(histogram, groups)
    plan = configurations(grouped, capacity)

    # the runs of slots of each group: from slot on, `per` to a container, from container `base` on
    runs: list[list[tuple[int, int, int]]] = [[] for _ in grouped]
    slots, base = [0] * len(grouped), 0
    for column, n in plan:
        for g in np.flatnonzero(column):
            runs[g].append((slots[g], base, int(column[g])))
            slots[g] += int(column[g]) * n
        base += n
    tops = np.array([s for s, _ in grouped][::-1])

    @F.pandas_udf("int")
    def group_of(sizes: pd.Series) -> pd.Series:
        return pd.Series((len(tops) - 1 - np.searchsorted(tops, sizes.to_numpy())).astype("int32"))

    @F.pandas_udf("bigint")
    def container_of(group: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(group), dtype=np.int64)
        for g in np.unique(group.to_numpy()):
            mine = (group == g).to_numpy()
            first, start, per = (np.array(x) for x in zip(*runs[g]))
            r = rank.to_numpy()[mine]
            k = np.searchsorted(first, r, side="right") - 1
            out[mine] = start[k] + (r - first[k]) // per[k]
        return pd.Series(out)

    done = items.where("false").withColumn("container_id", F.lit(0).cast("bigint"))
    if n_large:
        salts = max(1, math.ceil(n_large / 100_000))
        big = items.where(large).withColumns({"g": group_of("n_tokens"), "salt": F.pmod(F.xxhash64("row", "piece"), F.lit(salts)).cast("int")})
        before = Window.partitionBy("g").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        offsets = big.groupBy("g", "salt").agg(F.count("*").alias("n")).select("g", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        inside = Window.partitionBy("g", "salt").orderBy("row", "piece")
        ranked = big.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["g", "salt"])
        done = scratch.keep(ranked.withColumn("container_id", container_of("g", F.col("offset") + F.col("r"))).select(done.columns))
    if not n_small:
        return done
    shards = max(1, math.ceil(n_small / shard), math.ceil(base / shard))
    free = done.groupBy("container_id").agg((F.lit(capacity) - F.sum("n_tokens")).alias("free")).where("free > 0").withColumn("s", F.pmod("container_id", F.lit(shards)).cast("int"))
    little = items.where(~large).withColumn("s", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int"))

    def fit(rooms: pa.Table, small: pa.Table) -> pa.Table:
        ids, space = rooms["container_id"].to_numpy(), rooms["free"].to_numpy()
        got, fresh = best_fit(space, small["n_tokens"].to_numpy(), capacity)
        here = small["s"][0].as_py() if len(small) else 0
        names = np.concatenate([ids, base + np.arange(fresh) * shards + here])
        return small.drop_columns(["s"]).append_column("container_id", pa.array(names[got] if len(small) else [], pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done.schema)
    fitted = free.groupBy("s").cogroup(little.groupBy("s")).applyInArrow(fit, kinds)
    return done.unionAll(fitted)


def pack_texts(docs: DataFrame, capacity: int, doc: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc, piece, first_token, n_tokens, container_id) of every text."""
    return pack(token_pieces(docs, doc, text, capacity, path), capacity).drop("row")
