import random

import pytest
from pyspark.sql import functions as F

from spokeline.functions import parse
from spokeline.functions.scoring import access_score, crossing_is_stressful, destination_score, overall_score, weighted_mean
from spokeline.plans.stress import intersection_stress_program, segment_stress_program
from spokeline.rules import analysis, apply, read_program
from spokeline.rules.compiler import MissingVariable
from spokeline.rules.language import sweep, to_document

COMFORT = {"rules": [
    {"id": "busy", "when": {"road": ["main", "ring"], "mph": {"gt": 45}}, "set": {"comfort": 1}},
    {"id": "calm", "when": {"road": ["main", "ring"], "mph": {"le": 20}}, "set": {"comfort": 9}},
], "default": {"comfort": 5}}


def random_program(rng):
    fields = {"a": ["x", "y", None], "n": [0, 5, 10, None], "b": [True, False, None]}

    def when():
        out = {}
        for f in rng.sample(list(fields), rng.randint(0, 2)):
            if f == "n":
                out[f] = {rng.choice(["lt", "le", "gt", "ge", "eq", "ne"]): rng.choice([0, 5, 10])}
            elif f == "a":
                out[f] = rng.choice(["x", ["x", "y"], {"ne": "x"}, {"not_in": ["y"]}, "present", "absent"])
            else:
                out[f] = rng.choice([True, False, "present"])
        return out

    value = lambda: rng.choice([1, 2, 3, {"$var": "v"}, {"$cascade": [{"$field": "n"}, {"$var": "v"}]}, {"$field": "n"}])
    rules = [{"when": when(), "set": {o: value() for o in rng.sample(["p", "q"], rng.randint(1, 2))}} for _ in range(6)]
    rules.append({"when": {"p": {"gt": 1}}, "set": {"r": 1}})
    return read_program({"passes": [{"name": "one", "rules": rules[:4], "default": {"p": 0}}, {"name": "two", "after": "one", "rules": rules[4:]}]}), fields


@pytest.mark.parametrize("seed", range(6))
def test_compiled_programs_equal_the_interpreter(spark, seed):
    program, fields = random_program(random.Random(seed))
    grid = [{"a": a, "n": n, "b": b} for a in fields["a"] for n in fields["n"] for b in fields["b"]]
    rows = apply(spark.createDataFrame([(k, g["a"], g["n"], g["b"]) for k, g in enumerate(grid)], "k int, a string, n int, b boolean"), program, {"v": 7}).collect()
    for row in rows:
        state = dict(grid[row["k"]])
        for step in analysis.trace(program, state, {"v": 7}):
            state[step["output"]] = step["value"]
        for o in program.outputs():
            assert row[o] == state.get(o), (seed, grid[row["k"]], o)


def test_reading_errors():
    for bad in (
        {"rules": [{"when": {"a": "$none"}, "set": {"x": 1}}]}, {"rules": [{"when": {"use": "none"}, "set": {"x": 1}}]}, {"rules": [{"set": {"<d>_x": 1}}]}, {"rules": [{"when": {"a": {"like": 1}}, "set": {"x": 1}}]},
        {"rules": [{"rules": [], "set": {"x": 1}}]}, {"passes": [{"name": "a", "after": "b", "rules": []}, {"name": "b", "after": "a", "rules": []}]}, {"passes": [{"name": "a", "after": "zzz", "rules": []}]},
        {"rules": [{"set": {"x": {"$apply": "nothing", "to": "a"}}}]}, {"predicates": {"p": {"use": "p"}}, "rules": [{"when": {"use": "p"}, "set": {"x": 1}}]},
    ):
        with pytest.raises(ValueError):
            read_program(bad)
    assert sweep({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}] and sweep([]) == [] and sweep(None) == [{}]
    with pytest.raises(ValueError):
        sweep([{"a": 1}, {"b": 2}])


def test_round_trip_and_variables(spark):
    program = read_program({"sets": {"s": ["x"]}, "rules": [{"id": "r", "when": {"a": "$s", "n": {"gt": {"$var": "v"}}}, "enabled": {"$var": "on"}, "set": {"p": {"$var": "v"}}}]})
    assert read_program(to_document(program)).tables == program.tables
    assert program.variables() == {"v", "on"} and program.fields() == {"a", "n"}
    df = spark.createDataFrame([("x", 5)], "a string, n int")
    with pytest.raises(MissingVariable):
        apply(df, program, {"v": 1})
    assert apply(df, program, {"v": None, "on": None}).first()["p"] is None
    assert analysis.variable_problems([program], {"v": None, "w": 1}) == {"undeclared": ["on"], "null": ["v"], "unused": ["w"]}


def test_analysis(spark):
    program = read_program(COMFORT)
    df = spark.createDataFrame([("main", 50), ("ring", 10), ("lane", 50), (None, None)], "road string, mph int")
    covered = analysis.coverage(df, program)
    assert {r["winner"]: r["n"] for r in covered.collect()} == {"busy": 1, "calm": 1, "default": 2}
    assert analysis.never_fired(covered, program) == [] and analysis.problems(program, {"road": {"domain": ["main"]}, "mph": {}}) == ["pass0/busy: 'ring' is no value of road", "pass0/calm: 'ring' is no value of road"]
    assert analysis.unreachable(read_program({"rules": [{"id": "a", "when": {"x": {"gt": 1}}, "set": {"y": 1}}, {"id": "b", "when": {"x": {"gt": 2}}, "set": {"y": 2}}]})) == [("pass0", "y", "b", "a")]
    # values that no test tells apart are one: a road of the list or not, slow, fast or neither
    assert analysis.cells(program, "road") == ["main", "(other)"] and analysis.cells(program, "mph") == [19.0, 32.5, 46.0]
    assert analysis.contexts(spark, program).count() == 6
    assert {r["comfort"]: r["count"] for r in analysis.contexts(spark, program).groupBy("comfort").count().collect()} == {1: 1, 9: 1, 5: 4}
    gaps = {(r["road"], r["mph"]) for r in analysis.uncovered(spark, read_program({"rules": COMFORT["rules"]}).tables[0]).collect()}
    assert ("(other)", 46.0) in gaps and ("main", 46.0) not in gaps and ("main", 32.5) in gaps
    assert analysis.unproduced([program], ["road"]) == [("program", "mph")]
    assert [s["winner"] for s in analysis.trace(program, {"road": "lane", "mph": 50})] == ["default"]
    assert analysis.unreachable(segment_stress_program()) == [] and segment_stress_program().largest_output() == 3
    assert intersection_stress_program().outputs() == ["ft_int_stress", "tf_int_stress"]


def test_coverage_counts_a_sweep_as_its_rule(spark):
    columns = ("functional_class", "bicycle", "speed_limit", "ft_lanes", "tf_lanes", "ft_bike_infra", "tf_bike_infra", "ft_bike_infra_width", "tf_bike_infra_width")
    df = spark.createDataFrame([("trunk", None, 55, 2, 2, None, None, None, None)], ", ".join(f"{c} {'string' if c in ('functional_class', 'bicycle') or c.endswith('infra') else 'int'}" for c in columns))
    covered = analysis.coverage(df, segment_stress_program())
    assert sorted((r["output"], r["winner"]) for r in covered.collect()) == [("ft_seg_stress", "heavy"), ("tf_seg_stress", "heavy")]


def evaluate(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_transforms(spark):
    cases = [(parse.parse_speed_mph, {"30 mph": 30, "50": 30, "50 km/h": 30, "none": None, None: None, "45 kmph": 30, "62.9 mph": 62}), (parse.parse_width_int, {"12'6\"": 12, "3 m": 9, "10 ft": 10, "4": 13, "25": None, "x": None, None: None, "10 ft wide": 10, "3.5m approx": 11, "ca. 4": 13, "2.5 m (min)": 8, "12'6\" min": 12, "m": None})]
    cases += [(parse.parse_int_half, {"3": 2, "4": 2, "no": None}), (parse.count_pipes, {"a|b|c": 3, "": 1, None: None}), (parse.parse_int, {"x12y3": 12, "9" * 30: None})]
    for f, wanted in cases:
        for text, want in wanted.items():
            assert evaluate(spark, f(F.lit(text).cast("string"))) == want, (f, text)


def test_scores(spark):
    for low, want in {0: 0, 1: 0.0333, 10: 0.2235, 30: 0.5333, 75: 0.9, 100: 1}.items():
        assert abs(evaluate(spark, access_score(F.lit(low), F.lit(100))) - want) < 1e-4
    assert evaluate(spark, access_score(F.lit(0), F.lit(0))) is None
    assert [round(evaluate(spark, destination_score(F.lit(k), F.lit(5), 0.4, 0.2, 0.1)), 6) for k in range(6)] == [0, 0.4, 0.6, 0.7, 0.85, 1]
    assert evaluate(spark, destination_score(F.lit(0), F.lit(0), 0.4, 0.2, 0.1)) is None
    assert evaluate(spark, weighted_mean([(F.lit(1.0), 2.0), (F.lit(None).cast("double"), 5.0)])) == 1.0
    assert evaluate(spark, overall_score(F.lit(1.0), 15.0, [(F.lit(0.0), 15.0, F.lit(True)), (F.lit(0.0), 70.0, F.lit(False))])) == 50
    cross = lambda fc, v, a, b, one, beacon, island: evaluate(spark, crossing_is_stressful(F.lit(fc), F.lit(v).cast("int"), F.lit(a).cast("int"), F.lit(b).cast("int"), F.lit(one).cast("string"), F.lit(beacon).cast("boolean"), F.lit(island).cast("boolean")))
    assert cross("trunk", None, None, None, None, None, None) and not cross("residential", 90, 9, 9, None, None, None) and not cross("motorway_link", 90, 9, 9, None, None, None)
    assert cross("primary", None, None, None, None, None, None) and not cross("tertiary", None, None, None, None, None, None) and cross("tertiary", 30, 2, 2, None, None, False)
    assert not cross("secondary", 35, 1, None, "ft", True, None) and cross("secondary", 36, 1, None, "ft", True, None) and cross("secondary", 10, 3, None, "ft", True, None)
