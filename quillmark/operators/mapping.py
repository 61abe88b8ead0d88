"""Declared tables: fields, rules that fill them, and what to do with history.

A table compiles to one select, so Catalyst sees each cell as an expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Field kinds, and the types of their columns.
KINDS = {"string": "string", "integer": "int", "float": "double", "number": "double", "boolean": "boolean", "array": "array<string>", "object": "variant"}

Expression = Callable[[DataFrame], Column]
MergeFunction = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Policy:
    """How a matched row's new and historical value become one.

    `over` says what new values that follow each other over one row come to, as an aggregate of the
    value and its position; without it they are folded one by one, which takes all rows of a key."""

    name: str
    combine: MergeFunction
    over: MergeFunction | None = None

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Policy) and (self.name, self.combine) == (other.name, other.combine)

    __hash__ = None


def _take_new(new: Column, old: Column) -> Column:
    return new


def _prefer_old(new: Column, old: Column) -> Column:
    return F.coalesce(old, new)


def _filled_old(new: Column, old: Column) -> Column:
    return F.when(old != "", old).otherwise(new)


def _last(value: Column, pos: Column) -> Column:
    return F.max_by(value, pos)


def _first_known(value: Column, pos: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), pos))


def _first_filled(value: Column, pos: Column) -> Column:
    return F.coalesce(F.min_by(value, F.when(value != "", pos)), F.max_by(value, pos))


OVERWRITE = Policy("overwrite", _take_new, _last)
PRESERVE = Policy("preserve history", _prefer_old, _first_known)
PREFER_NEW = Policy("merge, new first", _take_new, _last)
PREFER_OLD = Policy("merge, history first", _prefer_old, _first_known)
#: History wins if it is a string that is not empty.
KEEP_FILLED = Policy("custom: filled history", _filled_old, _first_filled)


def custom(combine: MergeFunction) -> Policy:
    return Policy("custom", combine)


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    titles: dict[str, str] = field(default_factory=dict)
    required: bool = False
    default: Any = None

    def column_type(self) -> str:
        return KINDS[self.kind]

    def missing(self) -> Column:
        """What stands for a value that is not there."""
        return F.lit(self.default).cast(self.column_type())

    def described(self) -> dict[str, Any]:
        """As in a tabular document: integers and floats are numbers, defaults and requirements stay inside."""
        kind = "number" if self.kind in {"integer", "float"} else self.kind
        return {"name": self.name, "type": kind, "title": self.titles or None}


@dataclass(frozen=True)
class Rule:
    """Fills one target column; without an expression its field's default stands."""

    target: str
    expression: Expression | None = None
    source: str | None = None
    direct: bool = False
    policy: Policy = OVERWRITE


@dataclass(frozen=True)
class Table:
    fields: tuple[Field, ...]
    rules: tuple[Rule, ...]
    key: str

    def rule(self, target: str) -> Rule | None:
        return next((r for r in self.rules if r.target == target), None)

    def cell(self, df: DataFrame, f: Field) -> Column:
        rule = self.rule(f.name)
        if rule is None or (rule.expression is None and not rule.direct):
            return f.missing()
        if rule.direct:
            return F.coalesce(F.col(rule.source).cast(f.column_type()), f.missing()) if rule.source in df.columns else f.missing()
        return rule.expression(df).cast(f.column_type())

    def map(self, df: DataFrame, *carry: str) -> DataFrame:
        """One row of declared columns for each row of df, and columns to carry along."""
        return df.select(*(self.cell(df, f).alias(f.name, metadata={"title": f.titles}) for f in self.fields), *carry)

    def policies(self) -> dict[str, Policy]:
        return {r.target: r.policy for r in self.rules}

    def schema(self) -> T.StructType:
        kinds = ", ".join(f"`{f.name}` {f.column_type()}" for f in self.fields)
        return T.StructType([replace_metadata(x, {"title": f.titles}) for x, f in zip(T.StructType.fromDDL(kinds), self.fields)])

    def names(self) -> list[str]:
        return [f.name for f in self.fields]


def replace_metadata(column: T.StructField, metadata: dict) -> T.StructField:
    return T.StructField(column.name, column.dataType, column.nullable, metadata)


class TableBuilder:
    """Declares a table step by step. `title`, `required` and `default` act on the last field;
    a policy for a target without a rule changes nothing."""

    def __init__(self):
        self._fields: list[Field] = []
        self._rules: list[Rule] = []
        self._key: str | None = None

    def field(self, name: str, kind: str) -> TableBuilder:
        if kind not in KINDS:
            raise ValueError(f"no field kind {kind!r}")
        self._fields.append(Field(name, kind))
        return self

    def _change(self, **values: Any) -> TableBuilder:
        if self._fields:
            self._fields[-1] = replace(self._fields[-1], **values)
        return self

    def title(self, **titles: str) -> TableBuilder:
        return self._change(titles=titles)

    def required(self) -> TableBuilder:
        return self._change(required=True)

    def default(self, value: Any) -> TableBuilder:
        return self._change(default=value)

    def key(self, name: str) -> TableBuilder:
        self._key = name
        return self

    def _rule(self, rule: Rule) -> TableBuilder:
        self._rules.append(rule)
        return self

    def direct(self, target: str, source: str) -> TableBuilder:
        return self._rule(Rule(target, source=source, direct=True))

    def transformed(self, target: str, source: str, expression: Expression) -> TableBuilder:
        return self._rule(Rule(target, expression, source))

    def computed(self, target: str, expression: Expression) -> TableBuilder:
        return self._rule(Rule(target, expression))

    def constant(self, target: str, value: Any) -> TableBuilder:
        return self._rule(Rule(target, lambda _: F.lit(value)))

    def filled(self, target: str, value: Any) -> TableBuilder:
        """A column that only ever has its default value."""
        return self.constant(target, value)

    def ignored(self, target: str) -> TableBuilder:
        return self._rule(Rule(target))

    def policy(self, target: str, policy: Policy) -> TableBuilder:
        self._rules = [replace(r, policy=policy) if r.target == target else r for r in self._rules]
        return self

    def build(self) -> Table:
        key = self._key if self._key is not None else (self._fields[0].name if self._fields else "")
        return Table(tuple(self._fields), tuple(self._rules), key)
