"""Keyspaces and tables over the session catalog.

A keyspace is a database, a table a Parquet table bucketed and sorted by its
first column, so that joins of tables with as many buckets need no shuffle.
What Spark's schema cannot tell is kept as table properties: the declared types,
and the keys that hold a good part of the rows, counted while they are written.
"""

from __future__ import annotations

import base64
import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import QueryError
from tidemark.functions.codecs import Field, of_name, parse_schema, schema_text
from tidemark.operators.frame import KeyedFrame
from tidemark.plans.ast import TableRef
from tidemark.sources.shared import written

DECLARED, MEMORY, BUCKETS, ORDERED = "tidemark.types", "tidemark.memory", "tidemark.buckets", "tidemark.ordered"
HOT, FED = "tidemark.hot", "tidemark.fed"
#: Keys that are kept as hot, at most, and the rows and the part of all rows that each of them holds, at least; also a quarter of a bucket's share.
HOT_KEYS, HOT_ROWS, HOT_SHARE = 32, 10_000, 1 / 400
#: Types whose keys are counted while they are written.
_COUNTED = ("STRING", "UUID", "INT", "LONG", "BYTE", "IPV4")
STATS_SCHEMA = "table string, region int, segments long, compressed long"


class Catalog:
    def __init__(self, spark: SparkSession, buckets: int | None = None, location: str | None = None) -> None:
        """``location`` is the folder of new tables, by default the session's warehouse; ``buckets`` of new tables are by default as many as tasks run at once, and at least 8."""
        self.spark, self.location = spark, location
        self.buckets = buckets or max(8, spark.sparkContext.defaultParallelism)
        self._views: dict[tuple[str, str], tuple[DataFrame, list[Field] | None]] = {}

    def register(self, keyspace: str, name: str, frame: DataFrame, fields: list[Field] | None = None) -> None:
        """A DataFrame as a table of this session; its first column is the key."""
        self._views[keyspace, name] = (frame, fields)

    def keyspaces(self) -> list[str]:
        stored = [d.name for d in self.spark.catalog.listDatabases() if d.name != "default"]
        return sorted({*stored, *(k for k, _ in self._views)})

    def tables(self, keyspace: str) -> list[str]:
        stored = []
        if self.spark.catalog.databaseExists(keyspace):
            stored = [t.name for t in self.spark.catalog.listTables(keyspace) if not t.isTemporary]
        return sorted({*stored, *(n for k, n in self._views if k == keyspace)})

    def exists(self, table: TableRef) -> bool:
        return (table.keyspace, table.name) in self._views or self._stored(table)

    def _stored(self, table: TableRef) -> bool:
        return self.spark.catalog.databaseExists(table.keyspace) and self.spark.catalog.tableExists(f"{table.keyspace}.{table.name}")

    def create(self, table: TableRef, schema: str, memory: bool = False, ordered: bool = True) -> None:
        """A new table; not ``ordered``, rows keep their load order within a bucket's files."""
        if self.exists(table):
            raise QueryError(f"Table already exists: {table}")
        if table.name.startswith("__"):
            raise QueryError("Names that begin with two underscores are reserved")
        fields = parse_schema(schema)
        columns = ", ".join(f"`{f.name}` {f.type.spark.simpleString()}" for f in fields)
        key = fields[0].name
        place = f"LOCATION '{self.location}/{table.keyspace}/{table.name}'" if self.location else ""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{table.keyspace}`" + (f" LOCATION '{self.location}/{table.keyspace}'" if self.location else ""))
        self.spark.sql(
            f"CREATE TABLE `{table.keyspace}`.`{table.name}` ({columns}) USING parquet OPTIONS (compression 'zstd') "
            f"CLUSTERED BY (`{key}`) {f'SORTED BY (`{key}`)' if ordered else ''} INTO {self.buckets} BUCKETS {place} "
            f"TBLPROPERTIES ('{DECLARED}' = '{",".join(str(f.type) for f in fields)}', '{MEMORY}' = '{str(memory).lower()}', '{BUCKETS}' = '{self.buckets}', '{ORDERED}' = '{str(ordered).lower()}')"
        )
        if memory:
            self.spark.catalog.cacheTable(f"{table.keyspace}.{table.name}")

    def properties(self, table: TableRef) -> dict[str, str]:
        if not self._stored(table):
            raise QueryError(f"Unknown table {table}")
        return {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES `{table.keyspace}`.`{table.name}`").collect()}

    def fields(self, table: TableRef) -> list[Field]:
        if (table.keyspace, table.name) in self._views:
            return list(self.frame(table).fields)
        declared, stored = self.properties(table).get(DECLARED), self.spark.table(f"`{table.keyspace}`.`{table.name}`")
        if declared is None:
            return list(KeyedFrame.table(stored).fields)
        return [Field(name, of_name(kind)) for name, kind in zip(stored.columns, declared.split(","))]

    def frame(self, table: TableRef) -> KeyedFrame:
        """The table as a scan; a table without rows gives an empty frame."""
        if (table.keyspace, table.name) in self._views:
            return KeyedFrame.table(*self._views[table.keyspace, table.name])
        rows, fields, properties = self.spark.table(f"`{table.keyspace}`.`{table.name}`"), self.fields(table), self.properties(table)
        if properties.get(MEMORY) == "true" and not self.spark.catalog.isCached(f"{table.keyspace}.{table.name}"):
            self.spark.catalog.cacheTable(f"{table.keyspace}.{table.name}")  # anew in each session
        return KeyedFrame.table(rows, fields, int(properties.get(BUCKETS, 0)), tuple(_told(properties)["keys"]))

    def drop(self, table: TableRef) -> None:
        if self._views.pop((table.keyspace, table.name), None) is None:
            if not self._stored(table):
                raise QueryError(f"Unknown table {table}")
            self.spark.sql(f"DROP TABLE `{table.keyspace}`.`{table.name}`")

    def append(self, table: TableRef, rows: DataFrame) -> int:
        """Adds rows that have the table's columns, sorted within its buckets; returns how many.

        Rows are rebalanced by key before the write: a bucket gets one file of a
        load rather than one of each task, and a bucket too large for a task,
        with a hot key say, is split over several.
        """
        if not self._stored(table):
            raise QueryError(f"Unknown table {table}")
        fields = self.fields(table)
        typed = rows.select(*(F.col(f"`{f.name}`").cast(f.type.spark).alias(f.name) for f in fields))
        counted, measures = Observation(), [F.count(F.lit(1)).alias("n")]
        key = F.col(f"`{fields[0].name}`")
        if fields[0].type.name in _COUNTED:
            measures.append(F.to_json(F.call_function("approx_top_k", key, F.lit(HOT_KEYS), F.lit(4096))).alias("top"))
        seen = typed.observe(counted, *measures)
        seen.hint("rebalance", self.buckets_of(table), key).write.insertInto(f"`{table.keyspace}`.`{table.name}`")
        self.spark.catalog.refreshTable(f"`{table.keyspace}`.`{table.name}`")
        try:
            told = counted.get
        except Py4JJavaError:  # rows that are known to be none before anything runs are not observed
            told = {}
        n = int(told.get("n") or 0)
        if n:
            self._note_hot(table, n, {t["item"]: t["count"] for t in json.loads(told.get("top") or "[]") if t.get("item") is not None})
        return n

    def _note_hot(self, table: TableRef, n: int, top: dict) -> None:
        """Adds a load's frequent keys to those of the table; what no longer holds HOT_SHARE of the rows goes."""
        properties = self.properties(table)
        told, share = _told(properties), max(HOT_SHARE, 1 / (4 * int(properties.get(BUCKETS, 1))))
        whole, keys = told["n"] + n, dict(zip(told["keys"], told["counts"]))
        for key, count in top.items():
            keys[key] = keys.get(key, 0) + count
        hot = sorted((-count, str(key), key) for key, count in keys.items() if count >= max(HOT_ROWS, share * whole))[:HOT_KEYS]
        hot = [(key, -count) for count, _, key in hot if len(str(key)) <= 60]  # a property is some 4,000 characters at most
        self.set_property(table, HOT, base64.b64encode(json.dumps({"n": whole, "keys": [k for k, _ in hot], "counts": [c for _, c in hot]}).encode()).decode())

    def set_property(self, table: TableRef, name: str, value: str) -> None:
        self.spark.sql(f"ALTER TABLE `{table.keyspace}`.`{table.name}` SET TBLPROPERTIES ('{name}' = '{value}')")

    def empty(self, table: TableRef) -> None:
        """Takes out all rows; what was noted of them goes too."""
        if not self._stored(table):
            raise QueryError(f"Unknown table {table}")
        full = f"`{table.keyspace}`.`{table.name}`"
        self.spark.createDataFrame([], self.spark.table(full).schema).write.insertInto(full, overwrite=True)  # also where the table has a folder of its own
        self.spark.catalog.refreshTable(full)
        self.spark.sql(f"ALTER TABLE `{table.keyspace}`.`{table.name}` UNSET TBLPROPERTIES IF EXISTS ('{HOT}')")

    def buckets_of(self, table: TableRef) -> int:
        return int(self.properties(table).get(BUCKETS, self.buckets))

    def compact(self, table: TableRef) -> None:
        """Rewrites a table with one sorted file for each bucket, by way of a copy in the shared folder.

        A table in load order has no other order to be rewritten in, and is refused.
        """
        if self.properties(table).get(ORDERED) == "false":
            raise QueryError(f"{table} keeps its load order and is not compacted")
        full = f"`{table.keyspace}`.`{table.name}`"
        held = written(self.spark.table(full), "compacting")
        held.hint("rebalance", self.buckets_of(table), F.col(f"`{self.fields(table)[0].name}`")).write.insertInto(full, overwrite=True)
        self.spark.catalog.refreshTable(full)

    def stats(self, keyspace: str | None = None) -> DataFrame:
        """``table, region, segments, compressed``: files and bytes per table and bucket, in order of table.

        Listed from the tables' folders; no file is opened.
        """
        parts = []
        for space in [keyspace] if keyspace else self.keyspaces():
            for name in self.tables(space):
                table = TableRef(space, name)
                if not self._stored(table):
                    continue
                described = self.spark.sql(f"DESCRIBE FORMATTED `{space}`.`{name}`").where("col_name = 'Location'").first()
                files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(described["data_type"]).select("path", "length")
                region = F.regexp_extract("path", r"_(\d{5})(?:\.c\d+)?\.[^/]*$", 1).try_cast("int")
                parts.append(files.groupBy(F.lit(str(table)).alias("table"), F.coalesce(region, F.lit(0)).alias("region")).agg(F.count(F.lit(1)).alias("segments"), F.sum("length").alias("compressed")))
        result = self.spark.createDataFrame([], STATS_SCHEMA)
        for part in parts:
            result = result.unionByName(part)
        return result.orderBy("table", "region")

    def describe(self, table: TableRef) -> list[str]:
        """What the table is, a line each: name, columns, how it is kept."""
        lines = [f"{table}", f"columns {schema_text(self.fields(table))}"]
        if not self._stored(table):
            return [*lines, "a registered frame"]
        properties = self.properties(table)
        order = "in load order" if properties.get(ORDERED) == "false" else "sorted by key"
        cached = ", cached" if properties.get(MEMORY) == "true" else ""
        return [*lines, f"kept as Parquet in {properties.get(BUCKETS)} buckets, {order}{cached}"]


def _told(properties: dict[str, str]) -> dict:
    """Rows and hot keys as noted at the last write."""
    noted = properties.get(HOT)
    return json.loads(base64.b64decode(noted)) if noted else {"n": 0, "keys": [], "counts": []}
