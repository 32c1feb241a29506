"""Filters as data: flat chains and nested trees of conditions, folded into one Column.

SQL's three-valued logic holds; AND binds tighter than OR in a chain. Values are strings and are cast to the column's
type; one that cannot be cast matches nothing. Unknown fields, operators and connectives raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any
    connective: str = "AND"  # what joins it to the condition before; ignored on the first
    value_2: Any = None


@dataclass(frozen=True)
class Group:
    op: str
    items: tuple[Condition | Group, ...]


_COMPARE = {
    "=": lambda c, v: c == v, "<>": lambda c, v: c != v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
}
_TEXT = {"contain": F.contains, "prefix": F.startswith}
OPERATORS = (*_COMPARE, *_TEXT, "LIKE", "IN", "between")


def _leaf(df: DataFrame, names: dict[str, str], c: Condition, ci: bool) -> Column:
    """One condition; ci ignores case in string columns, and other columns are compared as what they are."""
    if c.field not in names:
        raise ValueError(f"unknown field {c.field!r}")
    kind = df.schema[names[c.field]].dataType
    fold = F.lower if ci and isinstance(kind, StringType) else lambda x: x
    column = fold(df[names[c.field]])
    typed = lambda v: fold(F.lit(v if v is None else str(v)).try_cast(kind))
    shown = df[names[c.field]].cast("string")
    if c.op in _COMPARE:
        return _COMPARE[c.op](column, typed(c.value))
    if c.op == "LIKE":
        pattern = str(c.value)
        if (len(pattern) - len(pattern.rstrip("\\"))) % 2:  # a lone escape at the end stands for itself
            pattern += "\\"
        return F.lower(shown).like(pattern.lower()) if ci else shown.like(pattern)
    if c.op in _TEXT:
        value = F.lit(str(c.value))
        return _TEXT[c.op](F.lower(shown), F.lower(value)) if ci else _TEXT[c.op](shown, value)
    if c.op == "IN":
        values = list(c.value)
        return column.isin([typed(v) for v in values]) if values else F.lit(False)
    if c.op == "between":
        return (column >= typed(c.value)) & (column <= typed(c.value_2))
    raise ValueError(f"unknown operator {c.op!r}")


def _blank(c: Condition) -> bool:
    return c.value is None or (isinstance(c.value, str) and not c.value.strip())


def _trimmed(c: Condition) -> Condition:
    trim = lambda v: v.strip() if isinstance(v, str) else v
    return replace(c, value=trim(c.value), value_2=trim(c.value_2))


@dataclass(frozen=True)
class Conditions:
    """An editable list of conditions; each edit gives a new one."""

    items: tuple[Condition, ...] = ()

    def add(self, c: Condition) -> Conditions:
        return Conditions((*self.items, c))

    def remove(self, at: int) -> Conditions:
        """Without the condition at a place; a place that there is not changes nothing."""
        return Conditions(tuple(c for i, c in enumerate(self.items) if i != at))

    def reset(self) -> Conditions:
        return Conditions()


def chain(df: DataFrame, conditions: Iterable[Condition], names: dict[str, str] | None = None, ci: bool = False) -> Column:
    """A flat list of conditions; blank values are skipped and string values trimmed."""
    names = names or {c: c for c in df.columns}
    groups: list[list[Column]] = []
    for c in conditions:
        if c.connective.upper() not in ("AND", "OR"):
            raise ValueError(f"unknown connective {c.connective!r}")
        if _blank(c):
            continue
        leaf = _leaf(df, names, _trimmed(c), ci)
        if groups and c.connective.upper() == "AND":
            groups[-1].append(leaf)
        else:
            groups.append([leaf])
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, g) for g in groups)) if groups else F.lit(True)


def tree(df: DataFrame, node: Condition | Group, names: dict[str, str] | None = None, ci: bool = False) -> Column:
    """A nested condition; blank values are skipped and string values trimmed, as in a chain."""
    names = names or {c: c for c in df.columns}
    if isinstance(node, Condition):
        return F.lit(True) if _blank(node) else _leaf(df, names, _trimmed(node), ci)
    parts = [tree(df, n, names, ci) for n in node.items if not (isinstance(n, Condition) and _blank(n))]
    if node.op.upper() == "AND":
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    if node.op.upper() == "OR":
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    raise ValueError(f"unknown connective {node.op!r}")
