from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spokeline.llm import encode as E
from spokeline.llm import pack as P
from spokeline.llm import reading as R

TEXTS = [
    "The dog's red bike isn't here, 123 times.", "", None, "  leading\n\n\ttabs  ", "Ärger 日本語 🙂 <|endoftext|>", "don't  stop " * 3000, "x" * 5000, "a", " ", "The dog's red bike isn't here, 123 times.", " nbsp ", "été",
]


def docs(spark, texts=TEXTS):
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0])] + [(None, "null id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("w"), "ids": F.lit(1), "row": F.lit(2), "n_tokens": F.lit(3)})


def reference_ids(texts):
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoding_equals_the_tokenizer_and_decodes_back(spark, monkeypatch):
    want = reference_ids(TEXTS)
    for block in (60_000, 10):
        monkeypatch.setattr(E, "BLOCK", block)
        got = E.encode_corpus(docs(spark).repartition(3))
        found = [(r["doc_id"], list(r["ids"])) for r in got.collect()]
        assert len(found) == len(TEXTS) + 2
        assert all(ids == (want[k] if k is not None else reference_ids(["null id"])[0]) for k, ids in found)
        assert sum(k == 0 for k, _ in found) == 2
    back = Counter(tuple(r) for r in E.decode_corpus(got).collect())
    assert back == Counter([(k, t or "") for k, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "null id")])
    lists = spark.createDataFrame([(1, None), (1, []), (None, want[0])], "doc_id long, ids array<int>")
    assert Counter(tuple(r) for r in E.decode_corpus(lists).collect()) == Counter([(1, ""), (1, ""), (None, TEXTS[0])])
    with pytest.raises(Exception, match="not in the table"):
        E.decode_corpus(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()
    assert E.encode_corpus(docs(spark).where("false")).count() == 0


def checked(spark, items, capacity, shard=P.SHARD):
    df = spark.createDataFrame([(k, 0, s) for k, s in enumerate(items)], "row long, piece int, n_tokens int").repartition(4)
    got = [(r["row"], r["n_tokens"], r["container_id"]) for r in P.pack(df, capacity, shard=shard).collect()]
    assert sorted(g[:2] for g in got) == list(enumerate(items))
    sums = {}
    for _, s, c in got:
        sums[c] = sums.get(c, 0) + s
    assert max(sums.values(), default=0) <= capacity
    return len(sums)


def test_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(2)
    mixed = [int(x) for x in np.clip(rng.lognormal(4.5, 1.2, 3000), 0, 512)]
    assert checked(spark, mixed, 512) <= -(-sum(mixed) // 512) * 1.03
    assert checked(spark, mixed, 512, shard=200) <= -(-sum(mixed) // 512) * 1.03 + 20
    thirds = [171] * 1000 + [300] * 500
    assert checked(spark, thirds, 512) <= 1000
    assert checked(spark, [257] * 300, 512) == 300
    assert checked(spark, [512] * 5 + [0] * 7, 512) <= 6
    assert checked(spark, [3] * 1000, 512) == 6
    assert checked(spark, [], 512) == 0


def test_only_oversized_texts_are_split(spark):
    got = P.pack_texts(docs(spark), 100).collect()
    sizes = [len(x) for x in reference_ids(TEXTS)]
    for k, n in enumerate(sizes):
        pieces = sorted((r["piece"], r["first_token"], r["n_tokens"]) for r in got if r["doc_id"] == k)
        pieces = pieces[::2] if k == 0 else pieces
        assert sum(p[2] for p in pieces) == n and len(pieces) == max(1, -(-n // 100))
        assert [p[1] for p in pieces] == [100 * i for i in range(len(pieces))]


EASY = ["the dog sees a red bike", "a child walks to the school", "the man buys bread near the river", "my friend waits at the corner"]
MIDDLE = ["the council decided to lower the speed limit because residents complained", "an engineer compared several routes between the station and the market", "the department published accident statistics although the budget is limited"]
HARD = ["jurisdictional ambiguity presupposes commensurability among heterogeneous indicators", "the writ if not stayed binds all heirs whom the grant did not bar", "probabilistic extrapolation remains contingent upon contemporaneous ratification"]


def graded(rng, n):
    out = []
    for k in range(n):
        level = k % 3
        pool = (EASY, MIDDLE, HARD)[level]
        other = (EASY, MIDDLE, HARD)[rng.integers(3)]
        parts = [pool[rng.integers(len(pool))] for _ in range(rng.integers(1, 5))] + ([other[rng.integers(len(other))]] if rng.random() < 0.15 and k % 2 else [])
        out.append((k, ". ".join(parts).capitalize() + ".", level + 1))
    return out


def test_reading_level_on_held_out_texts(spark):
    rng = np.random.default_rng(4)
    rows = graded(rng, 600)
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(9001, None), (9002, ""), (9003, "one two 3 4 5 6 7"), (9004, "12 13 14 15 16 17")], "doc_id long, text string").withColumn("word", F.lit(1))
    grades = spark.createDataFrame([(k, "r", (lv if rng.random() > 0.05 else 2)) for k, _, lv in rows if k % 5 == 0] + [(None, "r", 1), (1, "r", None)], "doc_id long, rater string, reading_level int")
    got = dict(map(tuple, R.reading_levels(df, grades).collect()))
    assert set(got) == {k for k, _, _ in rows}
    held_out = [got[k] == lv for k, _, lv in rows if k % 5]
    assert np.mean(held_out) > 0.93
    assert R.reading_levels(df, grades.where("false")).count() == 0
    assert R.reading_levels(df.where("false"), grades).count() == 0


def test_ordinal_model_recovers_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = 1 + (x[:, 0] * 2 - x[:, 1] + rng.logistic(size=2000) > -1).astype(int) + (x[:, 0] * 2 - x[:, 1] + rng.logistic(size=2000) > 1.5).astype(int)
    model = R.OrdinalModel.fit(x, y)
    w = model.weights / model.scale
    assert w[0] > 1 and w[1] < -0.4 and abs(w[2]) < 0.2 and model.cuts[0] < model.cuts[1]
