from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spokeline.operators import split_values as S


def divided(spark, texts, field="f"):
    df = spark.createDataFrame([(k, field, t) for k, t in enumerate(texts)], "id int, field string, value string").withColumn("items", F.lit("old"))
    return {r["value"]: r["items"] for r in S.split_values(df).collect()}


def test_quotes_brackets_units_and_decimals(spark):
    singles = ["30", "50", "20", "45", "56.3 km/h", "48.3 km/h", "30 mph", "20 km / h", None, "", " ", '"a;b"'] * 8
    lists = ["30;50", "20, 45", "45|20|30", '"30"; "50"', "30 mph / 20", "50;;20", "45; ", "20 km / h / 50", "30 mph @ (wet; snow); 20", "30,50", "50,20,45"]
    got = divided(spark, singles + lists + ["56,3 km/h", '"twelve"" pie"; x'])
    assert got["30;50"] == ["30", "50"] and got["20, 45"] == ["20", "45"] and got["45|20|30"] == ["45", "20", "30"]
    assert got['"30"; "50"'] == ["30", "50"] and got["30 mph / 20"] == ["30 mph", "20"] and got["50;;20"] == ["50", "20"]
    assert got["45; "] == ["45"] and got["20 km / h / 50"] == ["20 km / h", "50"]
    assert got["30 mph @ (wet; snow); 20"] == ["30 mph @ (wet; snow)", "20"]
    assert got["30,50"] == ["30", "50"] and got["50,20,45"] == ["50", "20", "45"] and got["56,3 km/h"] == ["56,3 km/h"]
    assert got['"twelve"" pie"; x'] == ['twelve" pie', "x"]
    assert got[None] is None and got[""] == [] and got[" "] == [] and got['"a;b"'] == ["a;b"]


def test_items_of_any_number_of_delimiters(spark):
    long, quoted = "A, B, C, D, E", '"A, B, C, D, E"'
    # one value of many records, though a shorter one begins like it
    assert divided(spark, [long] * 200 + ["A, B, C, D"] * 50) == {long: [long], "A, B, C, D": ["A, B, C, D"]}
    # a value that stands alone in quotes is found whole inside lists
    got = divided(spark, [quoted] * 200 + [long, f"{long}; F", f"F; {long}; G", "F; G"] + ["F", "G"] * 20)
    assert got[long] == [long] and got[f"{long}; F"] == [long, "F"] and got[f"F; {long}; G"] == ["F", long, "G"] and got["F; G"] == ["F", "G"]


def test_very_long_text_and_empty_table(spark):
    long = ";".join(["30", "50"] * 3000)
    got = divided(spark, ["30", "50"] * 5 + ["30;50", long])
    assert got[long] == ["30", "50"] * 3000
    assert divided(spark, ["x"] * 2) == {"x": ["x"]}
    assert S.split_values(spark.createDataFrame([], "field string, value string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='ab1,;/|"()“” \n', max_size=30))
def test_pieces_make_up_the_text(text):
    parts, delims = S.pieces(text)
    assert "".join(x for pair in zip(parts, [*delims, ""]) for x in pair) == text
    assert len(parts) == len(delims) + 1


def test_forward_backward_equals_enumeration():
    marks, lattice = ";,;", S._lattice(4)
    score = {(i, j): -1.0 - 0.3 * i - 0.7 * (j - i) for i, j in lattice}
    chance = {";": 0.9, ",": 0.4}
    w = S._weights(marks, score, chance)

    def paths(at):
        if at == 4:
            yield []
        for i, j in lattice:
            if i == at:
                for rest in paths(j + 1):
                    yield [(i, j), *rest]

    weights = {tuple(p): S.math.exp(sum(w[s] for s in p)) for p in paths(0)}
    total, want = sum(weights.values()), Counter()
    for p, x in weights.items():
        for s in p:
            want[s] += x / total
    got = S.posteriors(marks, score, chance)
    assert all(abs(got[s] - want[s]) < 1e-9 for s in lattice)
    assert tuple(S.best_path(marks, score, chance)) == max(weights, key=weights.get)


def test_decimal_commas_before_a_unit_hold_no_candidate():
    assert S.pieces("80,5 km/h; 30,50")[0] == ["80,5 km/h", "30", "50"]
    assert S.pieces("~48,3km/h")[0] == ["~48,3km/h"] and S.pieces("30,5")[0] == ["30", "5"]


def test_shape_and_surprise():
    assert S._item_shape("max 30.5 mph")[0] == "a 99.9 a"
    assert abs(S._item_shape("ab1")[1] + S.math.log(10) + 2 * S.math.log(20)) < 1e-12
