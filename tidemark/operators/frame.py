"""KeyedFrame: a DataFrame that carries its key, so that joins need no ON clause.

Besides its visible fields a frame has two hidden columns.  ``__key`` is the
first column of the table the rows come from, projected or not.  ``__order`` is
the place of a row in scan order within its key: the sort keys of all columns of
its table, preceded by the side it came from in a union, where the keys of both
sides are encoded alike.  Hidden columns are plain projections, so what no
operator uses is pruned from the scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import QueryError
from tidemark.functions.codecs import Field, FieldType, of_spark, schema_text
from tidemark.operators.spread import match_unique

KEY, ORDER = "__key", "__order"


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class KeyedFrame:
    rows: DataFrame
    fields: tuple[Field, ...]
    key_type: FieldType
    #: The visible field that equals the key, if one does.
    key_field: str | None
    #: Types of the parts of ``__order``; none if they are encoded.
    order_types: tuple[FieldType, ...] | None
    #: A frame of keys only with as many rows, where that is cheaper to count.
    keys: DataFrame | None = None
    #: Buckets by key of the table that the rows come from; 0 if it has none.
    placed: int = 0
    #: Keys that would fill a bucket of that table.
    hot: tuple = ()
    #: The same rows with all columns of their table, where they come from one.
    base: DataFrame | None = None

    @classmethod
    def table(cls, frame: DataFrame, fields: Iterable[Field] | None = None, placed: int = 0, hot: tuple = ()) -> "KeyedFrame":
        """A table scan; the key is the first column."""
        fields = tuple(fields) if fields else tuple(Field(f.name, of_spark(f.dataType)) for f in frame.schema.fields)
        if any(f.name.startswith("__") for f in fields):
            raise QueryError("Names that begin with two underscores are reserved")
        order = F.struct(*(f.type.sort_part(_quoted(f.name)).alias(f"o{i}") for i, f in enumerate(fields)))
        rows = frame.select(*(_quoted(f.name) for f in fields), _quoted(fields[0].name).alias(KEY), order.alias(ORDER))
        return cls(rows, fields, fields[0].type, fields[0].name, tuple(f.type for f in fields), placed=placed, hot=hot, base=frame.select(*(_quoted(f.name) for f in fields)))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def schema(self) -> str:
        return schema_text(list(self.fields))

    def project(self, names: Iterable[str]) -> "KeyedFrame":
        """Named columns in the given order, each once; ``*`` stands for all and expands last."""
        names = list(names)
        wanted = [n for n in names if n != "*"]
        if "*" in names:
            wanted += self.names
        known = {f.name: f for f in self.fields}
        for name in wanted:
            if name not in known:
                raise QueryError(f"Unknown field {name}")
        fields = tuple(known[n] for n in dict.fromkeys(wanted))
        kept = self.key_field if self.key_field in {f.name for f in fields} else None
        return replace(self, rows=self.rows.select(*(_quoted(f.name) for f in fields), KEY, ORDER), fields=fields, key_field=kept)

    def filter(self, condition: Column) -> "KeyedFrame":
        base = None if self.base is None else self.base.where(condition)  # which has every column the condition may name
        return replace(self, rows=self.rows.where(condition), keys=None, base=base)

    def _keys(self) -> DataFrame:
        return self.rows.select(KEY).where(F.col(KEY).isNotNull()).distinct()

    def _check_key(self, other: "KeyedFrame") -> None:
        if self.key_type.spark != other.key_type.spark:
            raise QueryError(f"Keys of type {self.key_type} and {other.key_type} do not match")

    def join(self, right: "KeyedFrame") -> "KeyedFrame":
        """Every right row whose key the left has, with the first left row of that key.

        Left fields come first and win over right fields of the same name.  The
        first left row is a grouped minimum with map-side combining, not a
        window.  Where the left shows nothing but its key, its keys suffice.
        """
        self._check_key(right)
        placed = 0 < self.placed == right.placed
        matched = match_unique(right.rows, self._keys(), KEY, "left_semi", placed, right.hot)
        shown = [f for f in self.fields if f.name != self.key_field]
        fields = (*self.fields, *(f for f in right.fields if f.name not in self.names))
        if shown:
            first = self._first(F.struct(*(_quoted(f.name) for f in shown)), [f.name for f in shown])
            rows = match_unique(right.rows, first, KEY, "inner", placed, right.hot)
        else:
            rows = matched
        left = {f.name: _quoted(KEY) if f.name == self.key_field else F.col("__left")[f.name] for f in self.fields}
        columns = [left.get(f.name, _quoted(f.name)).alias(f.name) for f in fields]
        return KeyedFrame(rows.select(*columns, KEY, ORDER), fields, self.key_type, self.key_field, right.order_types, matched.select(KEY), right.placed if placed and not right.hot else 0)

    def _first(self, payload: Column, shown: list[str]) -> DataFrame:
        """``__key, __left``: the payload of the first row of each key.

        In rows of a table those that agree up to the last column shown have the
        same payload, so columns behind it are not read.
        """
        if self.base is None:
            rows, order = self.rows, F.col(ORDER)
        else:
            names, rows = self.base.columns, self.base.withColumn(KEY, _quoted(self.base.columns[0]))
            last = max(names.index(name) for name in shown)
            order = F.struct(*(kind.sort_part(_quoted(name)).alias(f"o{i}") for i, (kind, name) in enumerate(zip(self.order_types[: last + 1], names))))
        first = rows.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.min(F.struct(order.alias("order"), payload.alias("payload"))).alias("first"))
        return first.select(KEY, F.col("first.payload").alias("__left"))

    def _united(self, right: "KeyedFrame") -> tuple[Field, ...]:
        known = {f.name: f for f in self.fields}
        for field in right.fields:
            if field.name in known and known[field.name].type.spark != field.type.spark:
                raise QueryError(f"Field {field.name} has type {known[field.name].type} on the left and {field.type} on the right")
        return (*self.fields, *(f for f in right.fields if f.name not in known))

    def union(self, right: "KeyedFrame") -> "KeyedFrame":
        """All rows of both, by column name; missing cells are null; left rows come first within a key."""
        self._check_key(right)
        fields = self._united(right)
        rows = self.rows.withColumn(ORDER, self._sided("0")).unionByName(right.rows.withColumn(ORDER, right._sided("1")), allowMissingColumns=True)
        key_field = self.key_field if self.key_field == right.key_field else None
        keys = (self.keys if self.keys is not None else self.rows.select(KEY)).unionByName(right.keys if right.keys is not None else right.rows.select(KEY))
        return KeyedFrame(rows.select(*(_quoted(f.name) for f in fields), KEY, ORDER), fields, self.key_type, key_field, None, keys)

    def _sided(self, side: str) -> Column:
        """``__order`` encoded, behind the side of a union."""
        parts = F.col(ORDER) if self.order_types is None else F.array(*(t.encoded(F.col(ORDER)[f"o{i}"]) for i, t in enumerate(self.order_types)))
        return F.concat(F.array(F.struct(F.lit(0).alias("length"), F.lit(side).alias("text"))), parts)

    def intersection(self, right: "KeyedFrame") -> "KeyedFrame":
        """All rows, of both sides, whose key is on both sides."""
        self._check_key(right)
        placed = 0 < self.placed == right.placed
        left_rows = match_unique(self.rows, right._keys(), KEY, "left_semi", placed, self.hot)
        right_rows = match_unique(right.rows, self._keys(), KEY, "left_semi", placed, right.hot)
        return replace(self, rows=left_rows, keys=None, base=None).union(replace(right, rows=right_rows, keys=None, base=None))

    def output(self, ordered: bool = False, descending: bool = False) -> DataFrame:
        """The visible columns; ``ordered`` by key and scan order, or ``descending``."""
        order = [self.key_type.sort_part(F.col(KEY)), F.col(ORDER)]
        if descending:
            order = [o.desc() for o in order]
        rows = self.rows.orderBy(*order) if ordered or descending else self.rows
        return rows.select(*(_quoted(n) for n in self.names))

    def counted(self) -> DataFrame:
        """One row, ``count``; reads keys only where rows are not needed."""
        return (self.keys if self.keys is not None else self.rows).agg(F.count(F.lit(1)).alias("count"))

    def grouped(self, *aggregates: Column) -> DataFrame:
        """One row per key: ``key``, ``n`` rows, and any aggregates over the visible fields, combined map-side.

        The rows of a key themselves, next to each other and in scan order, are
        ``output(ordered=True)``, which splits a hot key over tasks.
        """
        return self.rows.groupBy(F.col(KEY).alias("key")).agg(F.count(F.lit(1)).alias("n"), *aggregates)

    def as_text(self, separator: str = "\t", ordered: bool = False) -> DataFrame:
        """One column, ``line``: the rendered fields; a missing cell is a NUL character."""
        cells = [F.coalesce(f.type.render(_quoted(f.name)), F.lit("\0")) for f in self.fields]
        return self.output(ordered).select(F.concat_ws(separator, *cells).alias("line"))
