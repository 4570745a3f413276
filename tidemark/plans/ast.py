"""Statements as trees.  ``str`` of a node is a statement that parses to the same tree."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TableRef:
    keyspace: str
    name: str

    def __str__(self) -> str:
        return f"{self.keyspace}.{self.name}"


@dataclass(frozen=True)
class Condition:
    """``field [NOT] op value``; ``values`` has one member but for IN."""

    field: str
    op: str
    values: tuple[str, ...]
    negated: bool = False

    def __str__(self) -> str:
        values = [f"'{v}'" for v in self.values]
        right = f"({', '.join(values)})" if self.op == "IN" else values[0]
        return f"{self.field} {'NOT ' if self.negated else ''}{self.op} {right}"


@dataclass(frozen=True)
class Logic:
    """``left AND|OR right``, where right is all the rest."""

    op: str
    left: Condition
    right: "Predicate"

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


Predicate = Condition | Logic


@dataclass(frozen=True)
class Select:
    fields: tuple[str, ...]
    source: "TableRef | Frame"
    where: Predicate | None = None

    def __str__(self) -> str:
        source = f"({self.source})" if not isinstance(self.source, TableRef) else str(self.source)
        return f"SELECT {','.join(self.fields)} FROM {source}" + (f" WHERE {self.where}" if self.where else "")


@dataclass(frozen=True)
class Combine:
    """JOIN, UNION or INTERSECTION of two frames; the right one is all the rest."""

    op: str
    left: "Frame"
    right: "Frame"

    def __str__(self) -> str:
        left = f"({self.left})" if isinstance(self.left, Combine) else str(self.left)
        return f"{left} {self.op} {self.right}"


Frame = Select | Combine


@dataclass(frozen=True)
class Count:
    source: "TableRef | Frame"
    where: Predicate | None = None

    def __str__(self) -> str:
        source = f"({self.source})" if not isinstance(self.source, TableRef) else str(self.source)
        return f"COUNT {source}" + (f" WHERE {self.where}" if self.where else "")


@dataclass(frozen=True)
class Into:
    frame: Frame
    target: TableRef

    def __str__(self) -> str:
        return f"{self.frame} INTO {self.target}"


@dataclass(frozen=True)
class Create:
    table: TableRef
    schema: str
    memory: bool = False


@dataclass(frozen=True)
class Command:
    """DESCRIBE, STATS, CLUSTER, DROP, DELETE, HELP or CLOSE with its arguments."""

    name: str
    arguments: tuple[str, ...] = ()


Statement = Frame | Count | Into | Create | Command
