import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spokeline.llm import components as C
from spokeline.llm import quantile_sketch as Q


def union_find(links, records):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r, k in links:
        if r is not None and k is not None:
            parent[find(("r", r))] = find(("k", k))
    groups = {}
    for r in records:
        groups.setdefault(find(("r", r)), []).append(r)
    return {r: min(g) for g in groups.values() for r in g}


def test_groups_equal_union_find(spark, monkeypatch):
    rng = np.random.default_rng(3)
    chain = [(k, 5000 + k) for k in range(60)] + [(k + 1, 5000 + k) for k in range(60)]
    hub = [(k, 9999) for k in range(200, 400)]
    loose = [(int(a), int(b)) for a, b in zip(rng.integers(500, 700, 150), rng.integers(6000, 6150, 150))]
    odd = [(None, 9999), (800, None), (801, 9998), (801, 9998), (200, 9999)]
    links, records = chain + hub + loose + odd, sorted({*range(61), *range(200, 400), *range(500, 700), 800, 801, 802})
    want = union_find(links, records)
    # every vertex of some degree as a hub: the broadcast path must agree with the shuffle path
    for least, in_one in ((C.LEAST_HUB, C.IN_ONE_TASK), (5, 0), (C.LEAST_HUB, 20)):
        monkeypatch.setattr(C, "LEAST_HUB", least)
        monkeypatch.setattr(C, "HUBS", 10**9)
        monkeypatch.setattr(C, "IN_ONE_TASK", in_one)
        df = spark.createDataFrame([(r,) for r in records] + [(802,), (None,)], "record long").withColumn("root", F.lit(1))
        got = C.group_records(df, "record", spark.createDataFrame(links, "record long, key long").withColumn("v", F.lit(2)))
        found = got.collect()
        assert len(found) == len(records) and dict(map(tuple, found)) == want
    # keys that aren't listed link nothing
    keys = spark.createDataFrame([(k,) for k in range(5000, 5010)] * 2 + [(None,)], "key long")
    got = C.group_records(df, "record", spark.createDataFrame(links, "record long, key long"), keys=keys)
    assert dict(map(tuple, got.collect())) == union_find([(r, k) for r, k in links if k and 5000 <= k < 5010], records)


def test_no_links_and_no_records(spark):
    none = spark.createDataFrame([], "record long, key long")
    assert dict(map(tuple, C.group_records(spark.createDataFrame([(3,), (1,)], "record long"), "record", none).collect())) == {1: 1, 3: 3}
    assert C.group_records(none.select("record"), "record", none).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.lists(st.integers(1, 100), min_size=1, max_size=5))
def test_small_sketches_are_exact(values, percents):
    sketch = Q.Sketch(64)
    for v in np.array_split(np.array(values), 3):
        sketch.update(v)
    again = Q.Sketch.from_bytes(sketch.to_bytes())
    ordered = sorted(values)
    assert again.quantiles([p / 100 for p in percents]) == [ordered[max(1, math.ceil(p / 100 * len(values) - 1e-9)) - 1] for p in percents]


def test_merged_sketches_keep_their_bound():
    rng = np.random.default_rng(1)
    parts = [rng.lognormal(size=n) for n in (100_000, 37, 250_000, 1, 60_000)]
    whole = Q.Sketch()
    for k, p in enumerate(parts):
        s = Q.Sketch(seed=k)
        for chunk in np.array_split(p, 7):
            s.update(chunk)
        whole.merge(Q.Sketch.from_bytes(s.to_bytes(), seed=k))
    values = np.sort(np.concatenate(parts))
    assert whole.n == len(values) and whole.held() < 4 * Q.K
    for q, v in zip((0.01, 0.25, 0.5, 0.9, 0.99), whole.quantiles((0.01, 0.25, 0.5, 0.9, 0.99))):
        assert abs(np.searchsorted(values, v) / len(values) - q) < 0.004


def test_percentiles_of_groups(spark):
    data = [("a", float(k)) for k in range(1, 101)] + [("a", None), ("a", float("nan")), (None, 5.0), (None, 5.0), ("b", None), ("c", 7.0)]
    df = spark.createDataFrame(data, "g string, v double").withColumns({"sketch": F.lit(1), "__part": F.lit(1)})
    sketches = Q.build_sketches(df.repartition(3), ["g"], "v")
    halves = Q.merge_sketches(sketches.unionAll(Q.build_sketches(df.where("false"), ["g"], "v")), ["g"])
    got = {(r["g"], r["percentile"]): r["amount"] for r in Q.percentiles_of(halves, ["g"], [25, 50, 99]).collect()}
    assert got == {("a", 25): 25, ("a", 50): 50, ("a", 99): 99, (None, 25): 5, (None, 50): 5, (None, 99): 5, ("c", 25): 7, ("c", 50): 7, ("c", 99): 7}
    assert Q.percentiles(df.where("false"), ["g"], "v", [50]).count() == 0


def test_percentiles_of_a_whole_column(spark):
    df = spark.createDataFrame([(float(k),) for k in range(1, 101)] + [(None,)], "v double").repartition(3)
    assert {r["percentile"]: r["amount"] for r in Q.percentiles(df, [], "v", [25, 99]).collect()} == {25: 25, 99: 99}
    assert Q.percentiles(df.where("false"), [], "v", [50]).count() == 0
