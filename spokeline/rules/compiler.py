"""Programs as Spark plans: one CASE per output column, so that whole programs stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeline.functions.parse import transform
from spokeline.rules.language import Program, Rule, Table, Test, Var
from spokeline.rules.ops import OPS


class MissingVariable(KeyError):
    pass


def variable(variables: Mapping[str, Any], name: str) -> Any:
    if name not in variables:
        raise MissingVariable(f"variable {name} is not declared")
    return variables[name]


def is_enabled(rule: Rule, variables: Mapping[str, Any]) -> bool:
    value = variable(variables, rule.enabled.name) if isinstance(rule.enabled, Var) else rule.enabled
    if value is None:
        return False
    if not isinstance(value, bool):
        raise ValueError(f"enabled of rule {rule.id} is neither true nor false: {value!r}")
    return value


def _column(df: DataFrame, name: str) -> tuple[Column, T.DataType | None]:
    """A column, or a null where the frame has none of that name."""
    if name in df.columns:
        return F.col(f"`{name}`"), df.schema[name].dataType
    return F.lit(None), None


def test_column(df: DataFrame, test: Test, variables: Mapping[str, Any]) -> Column:
    column, kind = _column(df, test.field)
    value = variable(variables, test.value.name) if isinstance(test.value, Var) else test.value
    op = "in" if test.op == "eq" and isinstance(value, (list, tuple, set)) else test.op
    return OPS[op](column, value, kind)


def all_of(df: DataFrame, tests: Sequence[Test], variables: Mapping[str, Any]) -> Column:
    return reduce(lambda a, b: a & b, [test_column(df, t, variables) for t in tests], F.lit(True))


def matcher(df: DataFrame, rows: Sequence[Sequence[Test]], variables: Mapping[str, Any] | None = None) -> Column:
    """Whether any alternative holds; without alternatives nothing does."""
    return reduce(lambda a, b: a | b, [all_of(df, r, variables or {}) for r in rows], F.lit(False))


def value_column(df: DataFrame, value: Any, variables: Mapping[str, Any]) -> tuple[Column, Column | None]:
    """A value as a column, and the condition on which it speaks at all (None: always)."""
    if not isinstance(value, dict):
        return F.lit(value), None
    if "$field" in value:
        return _column(df, value["$field"])[0], None
    if "$var" in value:
        return F.lit(variable(variables, value["$var"])), None
    if "$cascade" in value:
        tiers = [value_column(df, v, variables)[0] for v in value["$cascade"]]
        chosen = F.coalesce(*tiers)
        return chosen, chosen.isNotNull()
    if "$apply" in value:
        arguments = {k: variables.get(v["$var"]) if isinstance(v, dict) and "$var" in v else v for k, v in value.items() if k not in ("$apply", "to")}
        return transform(value["$apply"], _column(df, value["to"])[0].cast("string"), **arguments), None
    if "$lookup" in value:
        if "map" not in value:
            raise NotImplementedError("lookups in named tables; give the map in place")
        key, kind = _column(df, value["$lookup"])
        # a chain of comparisons: the map is written by hand and small
        found, known = F.lit(None), F.lit(False)
        for k, v in value["map"].items():
            hit = OPS["eq"](key, k, kind)
            found, known = F.when(hit, F.lit(v)).otherwise(found), known | hit
        default = value.get("default")
        return (F.when(known, found).otherwise(F.lit(default)), None) if default is not None else (found, known)
    raise ValueError(f"not a value: {value}")


def choose(df: DataFrame, table: Table, output: str, variables: Mapping[str, Any]) -> Column:
    """The first rule that sets ``output`` and holds; else the default, else the column as it is, else null."""
    branches: list[tuple[Column, Column]] = []
    for rule in table.rules:
        if output in rule.sets and is_enabled(rule, variables):
            value, speaks = value_column(df, rule.sets[output], variables)
            mask = all_of(df, rule.tests, variables)
            branches.append((mask if speaks is None else mask & speaks, value))
    if output in table.default:
        rest = value_column(df, table.default[output], variables)[0]
    else:
        rest = _column(df, output)[0]
    case = None
    for mask, value in branches:
        case = F.when(mask, value) if case is None else case.when(mask, value)
    return rest if case is None else case.otherwise(rest)


def apply_table(df: DataFrame, table: Table, variables: Mapping[str, Any] | None = None) -> DataFrame:
    """Outputs one after another: a later output's rules see the earlier one's new value.

    Neighbouring outputs that don't read each other go into one projection.
    """
    variables = variables or {}
    batch: dict[str, Column] = {}
    for output in table.outputs():
        reads = {f for r in table.rules if output in r.sets for f in r.fields()}
        if reads & set(batch):
            df, batch = df.withColumns(batch), {}
        batch[output] = choose(df, table, output, variables)
    return df.withColumns(batch) if batch else df


def apply(df: DataFrame, program: Program, variables: Mapping[str, Any] | None = None) -> DataFrame:
    """``df`` with the program's outputs, pass by pass. Works on streams as on tables: it is a projection."""
    for table in program.tables:
        df = apply_table(df, table, variables)
    return df


def winner(df: DataFrame, table: Table, output: str, variables: Mapping[str, Any] | None = None) -> Column:
    """The id of the rule that decides ``output``; 'default' or null (falls through) if none does."""
    case = None
    for rule in table.rules:
        if output in rule.sets and is_enabled(rule, variables or {}):
            speaks = value_column(df, rule.sets[output], variables or {})[1]
            mask = all_of(df, rule.tests, variables or {})
            mask = mask if speaks is None else mask & speaks
            case = F.when(mask, F.lit(rule.id)) if case is None else case.when(mask, F.lit(rule.id))
    rest = F.lit("default") if output in table.default else F.lit(None).cast("string")
    return rest if case is None else case.otherwise(rest)
