"""Engine: statements in, results out."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import Catalog
from tidemark.errors import QueryError
from tidemark.functions.codecs import Field
from tidemark.operators.frame import KeyedFrame
from tidemark.plans import ast
from tidemark.plans.lower import Options, lower_count, lower_frame
from tidemark.plans.parser import parse
from tidemark.shipping import ship
from tidemark.sources.ingest import Loaded, read_stdin, read_table, read_text

HELP = (
    "Reading:   select k.a,b,* from ks.t where a = 'x' and b not in (1, 2)",
    "           a source may be a statement in parentheses; frames combine by join, union, intersection",
    "Counting:  count ks.t where ...    count (select ...)",
    "Storing:   select ... into ks.t    create [mem] table ks.t key(UUID),n(INT),text",
    "Removing:  delete ks.t empties a table, drop ks.t removes it",
    "Looking:   describe, describe ks, describe ks.t, stats, stats ks, cluster",
    "Setting:   cluster numNodes 64 gives new tables 64 buckets",
    "Leaving:   close, or cluster down",
)


@dataclass
class Result:
    """Rows (``frame``), a ``count`` or lines of ``info``, by the kind of statement."""

    kind: str
    frame: KeyedFrame | None = None
    count: int | None = None
    info: tuple[str, ...] = ()
    closed: bool = False
    seconds: float = field(default=0.0, compare=False)

    @property
    def df(self) -> DataFrame:
        """The result rows, not yet run."""
        if self.frame is None:
            raise QueryError("the statement gives no rows")
        return self.frame.output()

    @property
    def schema(self) -> str:
        return self.frame.schema if self.frame is not None else ""

    def rows(self, ordered: bool = True) -> Iterator[Row]:
        """Typed rows, fetched partition by partition."""
        return self.frame.output(ordered).toLocalIterator() if self.frame is not None else iter(())

    def records(self, ordered: bool = True) -> Iterator[list[str | None]]:
        """Rendered cells of each row; a missing cell is None."""
        if self.frame is None:
            return
        cells = (f.type.render(F.col(f"`{f.name}`")).alias(f.name) for f in self.frame.fields)
        for row in self.frame.output(ordered).select(*cells).toLocalIterator():
            yield list(row)

    def lines(self, separator: str = "\t", ordered: bool = True) -> Iterator[str]:
        """Text of the result, whatever its kind."""
        if self.count is not None:
            yield str(self.count)
        yield from self.info
        if self.frame is not None:
            for row in self.frame.as_text(separator, ordered).toLocalIterator():
                yield row["line"]

    def export(self, path: str, separator: str = "\t", compression: str = "none") -> None:
        """Rendered text files, written by all tasks; no rows pass the driver."""
        if self.frame is None:
            raise QueryError("the statement gives no rows")
        self.frame.as_text(separator).write.option("compression", compression).text(path)


class Engine:
    """``sql`` runs statements over keyspaces of the session catalog and registered frames."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, options: Options = Options(), location: str | None = None) -> None:
        ship(spark)
        self.spark, self.options = spark, options
        self.catalog = Catalog(spark, buckets, location)

    def register(self, name: str, frame: DataFrame, fields: list[Field] | None = None) -> "Engine":
        """A DataFrame as ``keyspace.table``; its first column is the key."""
        keyspace, _, table = name.partition(".")
        self.catalog.register(keyspace, table, frame, fields)
        return self

    def parse(self, statement: str) -> ast.Statement:
        return parse(statement)

    def frame(self, statement: str) -> KeyedFrame:
        """The rows of a SELECT as a KeyedFrame; errors surface before anything runs."""
        node = parse(statement)
        if not isinstance(node, ast.Select | ast.Combine):
            raise QueryError("not a SELECT")
        return lower_frame(node, self._resolve, self.options)

    def df(self, statement: str) -> DataFrame:
        """The rows of a SELECT, or the one row ``count`` of a COUNT, not yet run."""
        node = parse(statement)
        if isinstance(node, ast.Count):
            return lower_count(node, self._resolve, self.options)
        return self.frame(statement).output()

    def _resolve(self, table: ast.TableRef) -> KeyedFrame:
        if not self.catalog.exists(table):
            raise QueryError(f"Unknown table {table}")
        return self.catalog.frame(table)

    def sql(self, statement: str) -> Result:
        began = time.monotonic()
        result = self._run(parse(statement))
        result.seconds = time.monotonic() - began
        return result

    def _run(self, node: ast.Statement) -> Result:
        match node:
            case ast.Count():
                return Result("count", count=lower_count(node, self._resolve, self.options).first()[0])
            case ast.Into(frame, target):
                return Result("count", count=self.insert(lower_frame(frame, self._resolve, self.options), target))
            case ast.Create(table, schema, memory):
                self.catalog.create(table, schema, memory)
                return Result("info", info=tuple(self.catalog.describe(table)))
            case ast.Command():
                return self._command(node)
        return Result("rows", frame=lower_frame(node, self._resolve, self.options))

    def insert(self, frame: KeyedFrame, target: ast.TableRef) -> int:
        """Appends rows by position, keyed anew by the target's first column.

        Selected columns only.  Types must be castable; columns the frame lacks
        at the end, and missing cells, become zero values; extra columns are an
        error.
        """
        if not self.catalog.exists(target):
            raise QueryError(f"Unknown table {target}")
        fields = self.catalog.fields(target)
        if len(frame.fields) > len(fields):
            raise QueryError(f"{target} has {len(fields)} columns, not {len(frame.fields)}")
        given = frame.output()
        columns = []
        for i, to in enumerate(fields):
            if i >= len(frame.fields):
                columns.append(to.type.zero().alias(to.name))
                continue
            of = frame.fields[i]
            value = F.col(f"`{of.name}`")
            same = of.type == to.type or of.type.spark == to.type.spark and to.type.name not in ("UUID", "IPV4")
            value = value if same else to.type.parse(of.type.render(value))
            columns.append(F.coalesce(value, to.type.zero()).alias(to.name))
        return self.catalog.append(target, given.select(*columns))

    def _command(self, node: ast.Command) -> Result:
        match node.name, node.arguments:
            case "HELP", _:
                return Result("info", info=HELP)
            case "CLOSE", _:
                return Result("info", info=("Bye",), closed=True)
            case "DESCRIBE", ():
                return Result("info", info=self.cluster_info())
            case "DESCRIBE", (keyspace,):
                return Result("info", info=(f"{keyspace} has {', '.join(self.catalog.tables(keyspace)) or 'no tables'}",))
            case "DESCRIBE", (keyspace, table):
                ref = ast.TableRef(keyspace, table)
                if not self.catalog.exists(ref):
                    raise QueryError(f"Unknown table {ref}")
                return Result("info", info=tuple(self.catalog.describe(ref)))
            case "STATS", arguments:
                return Result("rows", frame=KeyedFrame.table(self.catalog.stats(*arguments)))
            case "CLUSTER", ():
                return Result("info", info=self.cluster_info())
            case "CLUSTER", (word,) if word.upper() == "DOWN":
                return Result("info", info=("Down",), closed=True)
            case "CLUSTER", (word, number) if word.upper() == "NUMNODES" and number.isdigit() and int(number) > 0:
                self.catalog.buckets = int(number)
                return Result("info", info=self.cluster_info())
            case "DROP", (keyspace, table):
                self.catalog.drop(ast.TableRef(keyspace, table))
                return Result("info", info=(f"Dropped {keyspace}.{table}",))
            case "DELETE", (keyspace, table):
                self.catalog.empty(ast.TableRef(keyspace, table))
                return Result("info", info=(f"Emptied {keyspace}.{table}",))
        raise QueryError(f"Invalid query: {node.name} {' '.join(node.arguments)}")

    def cluster_info(self) -> tuple[str, ...]:
        context = self.spark.sparkContext
        return (
            f"Spark {context.version} at {context.master}, application {context.applicationId}",
            f"{context.defaultParallelism} tasks at once",
            f"{self.catalog.buckets} buckets for new tables",
            f"keyspaces {', '.join(self.catalog.keyspaces()) or 'none'}",
        )

    def load(self, table: str, path: str | list[str] | None, separator: str = "\t", layout: str | None = None, gzip: bool = False) -> tuple[int, DataFrame]:
        """Loads separated text into a table; from standard input if there is no path.  Returns the count and the rejects."""
        ref = _table(table)
        layout = layout or ("stream" if separator == "\n" else "lines")
        fields = self.catalog.fields(ref)
        loaded = read_text(self.spark, path, fields, separator, layout) if path else read_stdin(self.spark, fields, separator, layout, gzip)
        return self._append(ref, loaded)

    def load_table(self, table: str, source: DataFrame, mapping: dict[str, str], partition_filter: str | None = None, row_filter: str | None = None) -> tuple[int, DataFrame]:
        """Loads rows of another (Hive) table, with filters and a column mapping."""
        ref = _table(table)
        return self._append(ref, read_table(source, self.catalog.fields(ref), mapping, partition_filter, row_filter))

    def _append(self, table: ast.TableRef, loaded: Loaded) -> tuple[int, DataFrame]:
        return self.catalog.append(table, loaded.rows), loaded.rejects


def _table(name: str) -> ast.TableRef:
    keyspace, _, table = name.partition(".")
    return ast.TableRef(keyspace, table)


def cluster_session(master: str, shared: str, warehouse: str | None = None, app: str = "tidemark", settings: dict[str, str] | None = None) -> SparkSession:
    """A session on a cluster; ``shared`` is a folder that all executors see, where costly results are written.

    Further ``settings`` win over the ones given here.  Shuffle files are kept
    through the loss of executors where the cluster has a service for it.
    """
    builder = SparkSession.builder.master(master).appName(app)
    given = {
        "spark.checkpoint.dir": shared,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **({"spark.sql.warehouse.dir": warehouse} if warehouse else {}),
        **(settings or {}),
    }
    for name, value in given.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def local_session(cores: str = "*", warehouse: str | None = None, app: str = "tidemark") -> SparkSession:
    """A local session with the settings that results rely on.

    With a warehouse folder its tables outlive the session: the metastore lies
    in that folder and is opened again by the next session.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if warehouse:
        folder = os.path.abspath(warehouse)
        os.makedirs(folder, exist_ok=True)
        builder = (
            builder.config("spark.sql.warehouse.dir", folder)
            .config("spark.hadoop.javax.jdo.option.ConnectionURL", f"jdbc:derby:;databaseName={folder}/metastore;create=true")
            .config("spark.driver.extraJavaOptions", f"-Dderby.stream.error.file={folder}/metastore.log")
            .enableHiveSupport()
        )
    return builder.getOrCreate()
