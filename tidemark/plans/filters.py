"""Predicates as columns, and a builder that chains them.

AND and OR nest to the right without precedence: ``a AND b OR c`` is
``a AND (b OR c)``.  With ``precedence="sql"`` AND binds tighter.  Strings
compare by length first, then by bytes; with ``string_order="lexical"`` by bytes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import QueryError
from tidemark.functions.codecs import Field, FieldType
from tidemark.plans import ast
from tidemark.plans.parser import parse_predicate


def _greater(kind: FieldType, left: Column, right: Column, string_order: str) -> Column:
    if kind.name == "STRING" and string_order == "shortlex":
        a, b = F.octet_length(left), F.octet_length(right)
        return (a > b) | ((a == b) & (left > right))
    return left > right


def condition_column(condition: ast.Condition, fields: Mapping[str, FieldType], string_order: str = "shortlex") -> Column:
    kind = fields.get(condition.field)
    if kind is None:
        raise QueryError(f"Unknown field {condition.field}")
    column = F.col(f"`{condition.field}`")
    literals = [kind.literal(v) for v in condition.values] if condition.op != "CONTAINS" else []
    match condition.op:
        case "=":
            found = column == literals[0]
        case ">":
            found = _greater(kind, column, literals[0], string_order)
        case "<":
            found = _greater(kind, literals[0], column, string_order)
        case "IN":
            found = column.isin(*literals)
        case "CONTAINS":
            needle = condition.values[0]
            found = kind.render(column).contains(F.lit(needle)) if needle else column.isNotNull() & F.lit(False)
        case _:
            raise QueryError(f"Unknown operator {condition.op}")
    return ~found if condition.negated else found


def predicate_column(predicate: ast.Predicate | None, fields: list[Field], precedence: str = "right", string_order: str = "shortlex") -> Column:
    kinds = {f.name: f.type for f in fields}
    if predicate is None:
        return F.lit(True)
    chain, ops = [], []
    while isinstance(predicate, ast.Logic):
        chain.append(condition_column(predicate.left, kinds, string_order))
        ops.append(predicate.op)
        predicate = predicate.right
    chain.append(condition_column(predicate, kinds, string_order))
    if precedence == "sql":
        groups = [chain[0]]
        for op, column in zip(ops, chain[1:]):
            if op == "AND":
                groups[-1] = groups[-1] & column
            else:
                groups.append(column)
        result = groups[0]
        for column in groups[1:]:
            result = result | column
        return result
    result = chain[-1]
    for op, column in zip(reversed(ops), reversed(chain[:-1])):
        result = (column & result) if op == "AND" else (column | result)
    return result


class FilterBuilder:
    """``where("a").greater_than("1").and_("b").contains("x")``; immutable, ends in ``predicate``."""

    def __init__(self, parts: tuple = (), field: str | None = None, negated: bool = False) -> None:
        self._parts, self._field, self._negated = parts, field, negated

    @classmethod
    def from_text(cls, text: str) -> "FilterBuilder":
        predicate, parts = parse_predicate(text), ()
        while isinstance(predicate, ast.Logic):
            parts += (predicate.left, predicate.op)
            predicate = predicate.right
        return cls(parts + ((predicate,) if predicate else ()))

    def _add(self, op: str, *values: object) -> "FilterBuilder":
        if self._field is None:
            raise QueryError("name a field first")
        condition = ast.Condition(self._field, op, tuple(str(v) for v in values), self._negated)
        return FilterBuilder(self._parts + (condition,))

    def not_(self) -> "FilterBuilder":
        return FilterBuilder(self._parts, self._field, not self._negated)

    def equals(self, value: object) -> "FilterBuilder":
        return self._add("=", value)

    def greater_than(self, value: object) -> "FilterBuilder":
        return self._add(">", value)

    def less_than(self, value: object) -> "FilterBuilder":
        return self._add("<", value)

    def contains(self, value: str) -> "FilterBuilder":
        return self._add("CONTAINS", value)

    def in_(self, *values: object) -> "FilterBuilder":
        return self._add("IN", *values)

    def _then(self, op: str, field: str) -> "FilterBuilder":
        if not self._parts or self._field is not None:
            raise QueryError(f"{op} must follow a condition")
        return FilterBuilder(self._parts + (op,), field)

    def and_(self, field: str) -> "FilterBuilder":
        return self._then("AND", field)

    def or_(self, field: str) -> "FilterBuilder":
        return self._then("OR", field)

    @property
    def predicate(self) -> ast.Predicate | None:
        if self._field is not None:
            raise QueryError("the last condition has no operator")
        if not self._parts:
            return None
        result = self._parts[-1]
        for condition, op in zip(self._parts[-3::-2], self._parts[-2::-2]):
            result = ast.Logic(op, condition, result)
        return result

    @property
    def fields(self) -> list[str]:
        """The fields that the filter reads, each once."""
        return list(dict.fromkeys(p.field for p in self._parts if isinstance(p, ast.Condition)))

    def __str__(self) -> str:
        return str(self.predicate) if self._parts else "*"


def where(field: str) -> FilterBuilder:
    return FilterBuilder(field=field)
