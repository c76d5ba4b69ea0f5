"""Looking at rule programs: which contexts they tell apart, which rules decide, which never can."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeline.rules.compiler import apply, apply_table, is_enabled, variable, winner
from spokeline.rules.language import Program, Rule, Table, Test, Var, value_fields
from spokeline.rules.ops import NUMERIC, UNARY, holds

MOST_CONTEXTS = 200_000


def cells(program: Program, name: str, variables: Mapping[str, Any] | None = None) -> list[Any]:
    """One value for every set of tests of the program that a value of the field can pass; None may stand for one of them.

    Candidates are the bounds of number tests and a value in every gap, or the values named in tests and one that
    no test names, and None. Those that pass the same tests, and look up the same entries, can't be told apart: the first
    stands for all. A field whose value is itself handed on keeps every candidate.
    """
    named: set[Any] = set()
    bounds: set[float] = set()
    passed: list[tuple[str, Any]] = []
    lookups: list[dict] = []
    handed_on = False
    for rule in (r for t in program.tables for r in t.rules):
        for test in rule.tests:
            if test.field != name:
                continue
            value = variable(variables or {}, test.value.name) if isinstance(test.value, Var) else test.value
            passed.append(("in" if test.op == "eq" and isinstance(value, (list, tuple, set)) else test.op, value))
            if test.op in UNARY:
                continue
            values = value if isinstance(value, (list, tuple, set)) else [value]
            if test.op in NUMERIC or any(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
                bounds |= {float(v) for v in values if v is not None}
            else:
                named |= set(values)
        for v in rule.sets.values():
            if isinstance(v, dict) and v.get("$lookup") == name:
                named |= set(v.get("map", {}))
                lookups.append(v.get("map", {}))
            elif isinstance(v, dict) and name in value_fields(v):
                handed_on = True
    if bounds:
        cuts = sorted(bounds)
        between = [cuts[0] - 1, *[(a + b) / 2 for a, b in zip(cuts, cuts[1:])], cuts[-1] + 1]
        found = [*sorted({*cuts, *between}), None]
    elif named and all(isinstance(v, bool) for v in named):
        found = [False, True, None]
    else:
        found = [*sorted(named, key=str), "(other)" if named else "(any)", None]
    if handed_on:
        return found
    told: dict[tuple, Any] = {}
    for v in found:
        told.setdefault((*(holds(op, v, value) for op, value in passed), *(m.get(v) for m in lookups)), v)
    return list(told.values())


def context_grid(program: Program, fields: Mapping[str, list] | None = None, variables: Mapping[str, Any] | None = None) -> tuple[list[str], list[tuple]]:
    """The names of the outside fields and every combination of their cells."""
    axes = {f: (fields or {}).get(f) or cells(program, f, variables) for f in sorted(program.fields())}
    size = 1
    for values in axes.values():
        size *= len(values)
    if size > MOST_CONTEXTS:
        raise ValueError(f"{size} contexts; give fewer cells for some of {list(axes)}")
    return list(axes), list(itertools.product(*axes.values()))


def _type_of(values: Iterable[Any]) -> T.DataType:
    for v in values:
        if v is not None:
            return T.BooleanType() if isinstance(v, bool) else T.DoubleType() if isinstance(v, (int, float)) else T.StringType()
    return T.StringType()


def contexts(spark: SparkSession, program: Program, fields: Mapping[str, list] | None = None, variables: Mapping[str, Any] | None = None) -> DataFrame:
    """All distinguishable contexts with the program's decision for each."""
    names, rows = context_grid(program, fields, variables)
    kinds = [_type_of(r[k] for r in rows) for k in range(len(names))]
    rows = [tuple(float(v) if isinstance(k, T.DoubleType) and v is not None else v for v, k in zip(r, kinds)) for r in rows]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    return apply(spark.createDataFrame(rows, schema), program, variables)


def population(df: DataFrame, decided: DataFrame, keys: list[str], outputs: list[str]) -> DataFrame:
    """How many rows of ``df`` fall on each combination of outputs."""
    return decided.join(df.groupBy(*keys).agg(F.count("*").alias("population")), keys, "left").groupBy(*outputs).agg(F.coalesce(F.sum("population"), F.lit(0)).alias("population"))


def simulate(df: DataFrame, before: Program, after: Program, variables: Mapping[str, Any] | None = None, after_variables: Mapping[str, Any] | None = None) -> DataFrame:
    """``df`` with both programs' outputs as ``{output}_before`` and ``{output}_after`` and ``changed``."""
    names = [c for c in after.outputs() if c in before.outputs()]
    first = apply(df, before, variables).select(*[F.col(c) for c in df.columns if c not in names], *[F.col(c).alias(f"{c}_before") for c in names], F.struct(*df.columns).alias("__own"))
    again = apply(first.select("*", *[F.col(f"__own.`{c}`").alias(c) for c in df.columns if c in names]), after, after_variables if after_variables is not None else variables)
    out = again.withColumnsRenamed({c: f"{c}_after" for c in names}).drop("__own")
    changed = F.lit(False)
    for c in names:
        changed = changed | ~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    return out.withColumn("changed", changed)


def coverage(df: DataFrame, program: Program, variables: Mapping[str, Any] | None = None) -> DataFrame:
    """(pass, output, winner, n): how many rows each rule decides; 'default' and null (falls through) too.

    Rules that a sweep made of one count for it: what follows the @ of their ids is cut. One scan per pass: the winners of all outputs are stacked before they are counted.
    """
    found = None
    for table in program.tables:
        wins = [F.struct(F.lit(table.name).alias("pass"), F.lit(o).alias("output"), F.substring_index(winner(df, table, o, variables), "@", 1).alias("winner")) for o in table.outputs()]
        counts = df.select(F.explode(F.array(*wins)).alias("w")).groupBy("w.pass", "w.output", "w.winner").agg(F.count("*").alias("n"))
        found = counts if found is None else found.unionAll(counts)
        df = apply_table(df, table, variables)
    return found


def never_fired(covered: DataFrame, program: Program) -> list[tuple[str, str, str]]:
    """(pass, output, rule) of the rules that decided no row."""
    fired = {(r["pass"], r["output"], r["winner"]) for r in covered.collect()}
    return [(t.name, o, r.id) for t in program.tables for r in t.rules for o in r.sets if (t.name, o, r.id.partition("@")[0]) not in fired]


def trace(program: Program, row: Mapping[str, Any], variables: Mapping[str, Any] | None = None) -> list[dict]:
    """Every test of every rule on one row, and the rule that wins each output, pass by pass.

    Values that need Spark (transforms) aren't computed; their outputs stay as they are.
    """
    variables, state, steps = variables or {}, dict(row), []
    for table in program.tables:
        for output in table.outputs():
            won = None
            rules = []
            for rule in (r for r in table.rules if output in r.sets and is_enabled(r, variables)):
                results = [(t, holds("in" if t.op == "eq" and isinstance(v, (list, tuple)) else t.op, state.get(t.field), v)) for t in rule.tests for v in [variable(variables, t.value.name) if isinstance(t.value, Var) else t.value]]
                ok, value = all(r for _, r in results), _plain_value(rule.sets[output], state, variables)
                if ok and won is None and not (isinstance(rule.sets[output], dict) and ("$cascade" in rule.sets[output]) and value is None):
                    won = (rule.id, value)
                rules.append({"rule": rule.id, "holds": ok, "tests": [(t.field, t.op, t.value, r) for t, r in results]})
            if won is None and output in table.default:
                won = ("default", _plain_value(table.default[output], state, variables))
            if won:
                state[output] = won[1]
            steps.append({"pass": table.name, "output": output, "winner": won[0] if won else None, "value": state.get(output), "rules": rules})
    return steps


def _plain_value(value: Any, row: Mapping[str, Any], variables: Mapping[str, Any]) -> Any:
    if not isinstance(value, dict):
        return value
    if "$field" in value:
        return row.get(value["$field"])
    if "$var" in value:
        return variable(variables, value["$var"])
    if "$cascade" in value:
        return next((x for v in value["$cascade"] if (x := _plain_value(v, row, variables)) is not None), None)
    if "$lookup" in value and "map" in value:
        return value["map"].get(row.get(value["$lookup"]), value.get("default"))
    return None


def _implied(stronger: Test, weaker: Test) -> bool:
    """Whether a row that passes the first test is sure to pass the second; False if in doubt."""
    if stronger.field != weaker.field:
        return False
    if stronger == weaker:
        return True
    if any(isinstance(t.value, Var) for t in (stronger, weaker)):
        return False
    if stronger.op in ("eq", "in"):
        values = stronger.value if isinstance(stronger.value, list) else [stronger.value]
        return bool(values) and all(holds("in" if weaker.op == "eq" and isinstance(weaker.value, list) else weaker.op, v, weaker.value) for v in values)
    if weaker.op == "present":
        return stronger.op in NUMERIC
    if stronger.op in ("absent", "is_null"):
        return holds(weaker.op, None, weaker.value)
    if stronger.op in NUMERIC and weaker.op in NUMERIC and stronger.op[0] == weaker.op[0]:
        a, b = float(stronger.value), float(weaker.value)
        strict = weaker.op in ("lt", "gt") and stronger.op in ("le", "ge")
        return (a < b or (a == b and not strict)) if stronger.op[0] == "l" else (a > b or (a == b and not strict))
    return False


def unreachable(program: Program) -> list[tuple[str, str, str, str]]:
    """(pass, output, rule, earlier rule): rules that can't decide, since an earlier one takes all their rows.

    Cautious: only what follows test by test. Rules behind a switch shadow nothing.
    """
    out = []
    for t in program.tables:
        for output in t.outputs():
            earlier: list[Rule] = []
            for rule in (r for r in t.rules if output in r.sets):
                by = next((e for e in earlier if all(any(_implied(s, w) for s in rule.tests) for w in e.tests)), None)
                if by:
                    out.append((t.name, output, rule.id, by.id))
                always = not (isinstance(rule.sets[output], dict) and {"$cascade", "$lookup"} & set(rule.sets[output]))
                if rule.enabled is True and always:
                    earlier.append(rule)
    return out


def uncovered(spark: SparkSession, table: Table, fields: Mapping[str, list] | None = None, variables: Mapping[str, Any] | None = None) -> DataFrame:
    """(output, the fields): contexts in which no rule and no default sets an output."""
    program = Program(table.name, (table,))
    names, rows = context_grid(program, fields, variables)
    grid = contexts(spark, program, fields, variables).select(*names) if rows else None
    open_outputs = [o for o in table.outputs() if o not in table.default]
    gaps = F.filter(F.array(*[F.when(winner(grid, table, o, variables).isNull(), F.lit(o)) for o in open_outputs]) if open_outputs else F.array().cast("array<string>"), lambda x: x.isNotNull())
    return grid.select(F.explode(gaps).alias("output"), *names)


def problems(program: Program, catalog: Mapping[str, Mapping[str, Any]] | None = None) -> list[str]:
    """Unknown fields, values outside a field's domain, orders of what is no number, and repeated ids.

    catalog: field -> {type: str|int|float|bool|enum, domain: [...]}.
    """
    out, made = [], set()
    for t in program.tables:
        ids = [r.id for r in t.rules]
        out += [f"{t.name}: two rules are called {i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
        for r in t.rules:
            for x in r.tests:
                known = (catalog or {}).get(x.field)
                if catalog is not None and known is None and x.field not in made:
                    out.append(f"{t.name}/{r.id}: unknown field {x.field}")
                if known and x.op in NUMERIC and known.get("type") in ("str", "enum", "bool"):
                    out.append(f"{t.name}/{r.id}: {x.op} on {x.field}, which is no number")
                if known and known.get("domain") and x.op in ("eq", "ne", "in", "not_in") and not isinstance(x.value, Var):
                    values = x.value if isinstance(x.value, list) else [x.value]
                    out += [f"{t.name}/{r.id}: {v!r} is no value of {x.field}" for v in values if v not in known["domain"]]
        made |= set(t.outputs())
    return out


def unproduced(programs: Iterable[Program], given: Iterable[str]) -> list[tuple[str, str]]:
    """(program, field): fields that no earlier program makes and no input has."""
    have, out = set(given), []
    for p in programs:
        out += [(p.name, f) for f in sorted(p.fields() - have)]
        have |= set(p.outputs())
    return out


def variable_problems(programs: Iterable[Program], variables: Mapping[str, Any]) -> dict[str, list[str]]:
    """Variables that are used but not declared, declared but null, and declared but not used."""
    used = set().union(*(p.variables() for p in programs))
    return {
        "undeclared": sorted(used - set(variables)),
        "null": sorted(n for n in used & set(variables) if variables[n] is None),
        "unused": sorted(set(variables) - used),
    }


__all__ = ["cells", "contexts", "coverage", "never_fired", "population", "problems", "simulate", "trace", "uncovered", "unproduced", "unreachable", "value_fields", "variable_problems"]
