"""Reading rule documents.

A document is a dict (from YAML or code). It has ``passes`` or is one pass itself:

    sets: {busy: [primary, secondary]}              named lists, used as $busy
    predicates: {fast: {speed: {gt: 30}}}           named conditions, used as {use: fast}
    passes:
    - name: p                                       in order, or after: [names]
      for: {dir: [ft, tf]}                          repeated with <dir> replaced; a list of dicts pairs values
      rules:
      - id: r
        when: {class: $busy, lanes: {le: 2}, tag: present, use: fast}
        set: {<dir>_stress: 3}
        rules: [...]                                instead of set: rules inside the condition
      map: {field: f, to: out, table: {...}, default: x}
      first_non_null: {out: [a, {value: 3, when: {...}}]}
      default: {<dir>_stress: 2}

Reading gives a ``Program``: tables of flat rules, first match per output. Values may be literals,
``{$field: c}``, ``{$var: name}``, ``{$lookup: c, map: {...}, default: x}``, ``{$cascade: [...]}`` and
``{$apply: transform, to: c, ...}``.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

from spokeline.functions.parse import TRANSFORMS
from spokeline.rules.ops import OPS, UNARY

_LEFT_OVER = re.compile(r"<[A-Za-z_]\w*>|\{[^}]*\}")


@dataclass(frozen=True)
class Var:
    """A variable that gets its value when the program is applied."""

    name: str


@dataclass(frozen=True)
class Test:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Rule:
    id: str
    tests: tuple[Test, ...]
    sets: dict[str, Any]
    enabled: Any = True

    def fields(self) -> set[str]:
        return {t.field for t in self.tests} | {f for v in self.sets.values() for f in value_fields(v)}


@dataclass(frozen=True)
class Table:
    name: str
    rules: tuple[Rule, ...]
    default: dict[str, Any] = field(default_factory=dict)

    def outputs(self) -> list[str]:
        return list(dict.fromkeys([c for r in self.rules for c in r.sets] + list(self.default)))


@dataclass(frozen=True)
class Program:
    name: str
    tables: tuple[Table, ...]

    def outputs(self) -> list[str]:
        return list(dict.fromkeys(c for t in self.tables for c in t.outputs()))

    def fields(self) -> set[str]:
        """Columns that must come from outside."""
        made: set[str] = set()
        wanted: set[str] = set()
        for t in self.tables:
            wanted |= {f for r in t.rules for f in r.fields()} - made
            made |= set(t.outputs())
        return wanted

    def variables(self) -> set[str]:
        found: set[str] = set()
        for t in self.tables:
            for r in t.rules:
                found |= {x.value.name for x in r.tests if isinstance(x.value, Var)} | ({r.enabled.name} if isinstance(r.enabled, Var) else set())
                found |= {n for v in r.sets.values() for n in value_variables(v)}
            found |= {n for v in t.default.values() for n in value_variables(v)}
        return found

    def largest_output(self) -> int | None:
        """The largest whole number that any rule or default writes."""
        numbers = [v for t in self.tables for s in [*(r.sets for r in t.rules), t.default] for v in s.values() if isinstance(v, int) and not isinstance(v, bool)]
        return max(numbers, default=None)


def value_fields(value: Any) -> Iterator[str]:
    if isinstance(value, dict):
        for k in ("$field", "$lookup"):
            if k in value:
                yield value[k]
        if "$apply" in value:
            yield value["to"]
        for v in value.get("$cascade", []):
            yield from value_fields(v)


def value_variables(value: Any) -> Iterator[str]:
    if isinstance(value, dict):
        if "$var" in value:
            yield value["$var"]
        for v in value.get("$cascade", []):
            yield from value_variables(v)
        if "$apply" in value:
            for k, v in value.items():
                if k not in ("$apply", "to"):
                    yield from value_variables(v)


def _filled(part: Any, binding: dict[str, Any]) -> Any:
    """A part of a document with the placeholders of a sweep filled in."""
    match part:
        case str():
            for name, value in binding.items():
                part = part.replace(f"<{name}>", str(value))
            return part
        case dict():
            return {_filled(k, binding): _filled(v, binding) for k, v in part.items()}
        case list() | tuple():
            return [_filled(x, binding) for x in part]
    return part


def sweep(spec: Any) -> list[dict[str, Any]]:
    """The bindings of a ``for``: all combinations of a dict's lists, or a list of dicts as it stands."""
    if not spec and not isinstance(spec, list):
        return [{}]
    if isinstance(spec, list):
        if len({frozenset(b) for b in spec}) > 1:
            raise ValueError(f"the bindings of a paired sweep must have the same variables: {spec}")
        return [dict(b) for b in spec]
    return [dict(zip(spec, values)) for values in itertools.product(*spec.values())]


class _Reader:
    def __init__(self, document: dict):
        self.sets: dict[str, Any] = document.get("sets") or {}
        self.predicates: dict[str, Any] = document.get("predicates") or {}

    def operand(self, value: Any) -> Any:
        if isinstance(value, dict) and set(value) == {"$var"}:
            return Var(value["$var"])
        if isinstance(value, str) and value.startswith("$var:"):
            return Var(value[5:])
        if isinstance(value, str) and value.startswith("$"):
            if value[1:] not in self.sets:
                raise ValueError(f"no set named {value}")
            return list(self.sets[value[1:]])
        return value

    def tests(self, when: dict | None, inside: tuple[str, ...] = ()) -> list[Test]:
        out: list[Test] = []
        for name, spec in (when or {}).items():
            if name == "use":
                for used in spec if isinstance(spec, list) else [spec]:
                    if used in inside:
                        raise ValueError(f"predicate {used} uses itself")
                    if used not in self.predicates:
                        raise ValueError(f"no predicate named {used}")
                    out += self.tests(self.predicates[used], (*inside, used))
            elif isinstance(spec, dict) and "$var" not in spec:
                for op, value in spec.items():
                    if op not in OPS:
                        raise ValueError(f"no such test: {op}")
                    out.append(Test(name, op, None if op in UNARY else self.operand(value)))
            elif isinstance(spec, str) and spec in UNARY:
                out.append(Test(name, spec))
            else:
                value = self.operand(spec)
                out.append(Test(name, "in" if isinstance(value, list) else "eq", value))
        return out

    def rules(self, specs: list, outer: tuple[Test, ...], prefix: str) -> Iterator[Rule]:
        for number, spec in enumerate(specs):
            for binding in sweep(spec.get("for")):
                own = _filled({k: v for k, v in spec.items() if k != "for"}, binding)
                tests = (*outer, *self.tests(own.get("when")))
                if "rules" in own:
                    if "set" in own:
                        raise ValueError(f"a rule has either rules or set: {own}")
                    yield from self.rules(own["rules"], tests, f"{prefix}{number}.")
                    continue
                name = own.get("id", f"{prefix}{number}")
                suffix = "" if not binding or "<" in str(spec.get("id", "")) else "@" + ",".join(map(str, binding.values()))
                yield self.finished(Rule(f"{name}{suffix}", tests, self.values(own.get("set") or {}), self.switch(own.get("enabled", True))))

    def switch(self, enabled: Any) -> Any:
        return self.operand(enabled) if isinstance(enabled, (dict, str)) else enabled

    def values(self, sets: dict) -> dict:
        for v in sets.values():
            if isinstance(v, dict) and "$apply" in v and v["$apply"] not in TRANSFORMS:
                raise ValueError(f"no such transform: {v['$apply']}")
        return dict(sets)

    def finished(self, rule: Rule) -> Rule:
        for text in (rule.id, *(t.field for t in rule.tests), *rule.sets, *(t.value for t in rule.tests if isinstance(t.value, str)), *(v for v in rule.sets.values() if isinstance(v, str))):
            if _LEFT_OVER.search(text):
                raise ValueError(f"unfilled placeholder in rule {rule.id}: {text}")
        return rule

    def table(self, spec: dict, number: int) -> Table:
        rules: list[Rule] = []
        default: dict[str, Any] = {}
        for binding in sweep(spec.get("for")):
            own = _filled({k: v for k, v in spec.items() if k != "for"}, binding)
            found = list(self.rules(own.get("rules") or [], (), ""))
            if binding:
                found = [Rule(f"{r.id}@{','.join(map(str, binding.values()))}", r.tests, r.sets, r.enabled) for r in found]
            rules += found
            default |= own.get("default") or {}
            for out, chain in (own.get("first_non_null") or {}).items():
                rules += [self.link(out, k, entry) for k, entry in enumerate(chain)]
            if base := own.get("map"):
                gate = self.tests(base.get("when"))
                rules += [Rule(f"map:{base['to']}:{k}", (Test(base["field"], "eq", k), *gate), self.values({base["to"]: v})) for k, v in base["table"].items()]
                if "default" in base:
                    default.setdefault(base["to"], base["default"])
        return Table(str(spec.get("name", f"pass{number}")), tuple(rules), default)

    def link(self, out: str, k: int, entry: Any) -> Rule:
        name = f"{out}:{k}"
        if isinstance(entry, str):
            return Rule(name, (Test(entry, "present"),), {out: {"$field": entry}})
        if "value" in entry:
            return Rule(name, tuple(self.tests(entry.get("when"))), self.values({out: entry["value"]}))
        if "lookup" in entry:
            return Rule(name, (Test(entry["key"], "present"),), {out: {"$lookup": entry["key"], "key": entry["key"], "table": entry["lookup"]}})
        raise ValueError(f"not a link of a chain: {entry}")


def read_program(document: dict) -> Program:
    """The program of a document; raises ValueError for unknown names, left-over placeholders and cycles."""
    reader = _Reader(document)
    specs = document.get("passes") or [document]
    tables = {t.name: t for t in (reader.table(s, k) for k, s in enumerate(specs))}
    if len(tables) != len(specs):
        raise ValueError("two passes have the same name")
    names = list(tables)
    before: dict[str, list[str]] = {}
    for name, spec in zip(names, specs):
        after = spec.get("after") or []
        before[name] = [after] if isinstance(after, str) else list(after)
        if unknown := [a for a in before[name] if a not in tables]:
            raise ValueError(f"pass {name} comes after unknown {unknown}")
    sorter = TopologicalSorter(before)
    try:
        sorter.prepare()
    except CycleError as e:
        raise ValueError(f"passes wait for one another: {e.args[1]}") from e
    ordered: list[str] = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready(), key=names.index)
        ordered += ready
        sorter.done(*ready)
    return Program(str(document.get("name", "program")), tuple(tables[n] for n in ordered))


def read_matcher(rows: list[dict], document: dict | None = None) -> tuple[tuple[Test, ...], ...]:
    """Alternatives, each a set of tests that must all hold."""
    reader = _Reader(document or {})
    return tuple(tuple(reader.tests(r)) for r in rows)


def to_document(program: Program) -> dict:
    """A flat document that reads back as the same program."""

    def operand(value: Any) -> Any:
        return {"$var": value.name} if isinstance(value, Var) else value

    def when(tests: tuple[Test, ...]) -> dict:
        out: dict[str, Any] = {}
        for t in tests:
            out.setdefault(t.field, {})[t.op] = operand(t.value)
        return out

    def rule(r: Rule) -> dict:
        return {"id": r.id, "when": when(r.tests), "set": r.sets} | ({} if r.enabled is True else {"enabled": operand(r.enabled)})

    passes = [{"name": t.name, "rules": [rule(r) for r in t.rules], "default": t.default} for t in program.tables]
    for previous, now in zip(passes, passes[1:]):
        now["after"] = previous["name"]
    return {"name": program.name, "passes": passes}
