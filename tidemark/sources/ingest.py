"""Separated text, gzip, Hive tables and stdin into typed rows, with rejects.

Two layouts.  ``lines``: a line is a record, its values separated.  ``stream``:
the separator or a line end ends a value, and a record is the next n values
whatever the lines are, as with one value to a line.  Values are trimmed of
leading blanks and carriage returns and of trailing blanks, carriage returns and
NULs.  There is no quoting.  ``.gz`` files are read as such.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.codecs import Field
from tidemark.sources.shared import discard, scratch


@dataclass(frozen=True)
class Loaded:
    """Typed rows, and the records that are not of the schema with the first field at fault."""

    rows: DataFrame
    rejects: DataFrame


def trimmed(value: Column) -> Column:
    return F.rtrim(F.ltrim(value, F.lit(" \r")), F.lit(" \r\0"))


def typed(records: DataFrame, fields: list[Field]) -> Loaded:
    """Trims and parses ``values array<string>``; a record with too few or too many values is a reject.

    Lines are split once and values parsed once: each result leaves through a
    one-row generator, past which the planner pushes no filter that would
    compute it again.
    """
    values = F.col("values")
    cells = F.struct(*(f.type.parse(trimmed(F.get(values, F.lit(i)))).alias(f.name) for i, f in enumerate(fields)))
    parsed = _once(_once(records, values, "values"), cells, "row", "values")
    wrong = F.when(F.size("values") != len(fields), F.lit("number of values"))
    for f in fields:
        wrong = wrong.when(F.col("row")[f.name].isNull(), F.lit(f.name))
    checked = parsed.withColumn("fault", wrong)
    rows = checked.where(F.col("fault").isNull()).select(*(F.col("row")[f.name].alias(f.name) for f in fields))
    return Loaded(rows, checked.where(F.col("fault").isNotNull()).select("fault", "values"))


def _once(rows: DataFrame, value: Column, name: str, *kept: str) -> DataFrame:
    return rows.select(*kept, F.explode(F.array(value)).alias(name))


def line_records(lines: DataFrame, separator: str) -> DataFrame:
    """``values`` of one record a line; a last empty line is none."""
    return lines.where(trimmed(F.col("value")) != "").select(F.split("value", re.escape(separator), -1).alias("values"))


def stream_records(files: DataFrame, separator: str, n: int) -> DataFrame:
    """``values`` of the next n values each, in file order; what is left at a file's end is dropped.

    ``files`` has value, and the file path and block start of its line.  Values
    are numbered by prefix sums: within a block, then over the blocks of a file,
    so no file is read by one task unless it is one block.
    """
    parts = F.split("value", re.escape(separator), -1) if separator != "\n" else F.array("value")
    lines = files.select("file", "block", F.monotonically_increasing_id().alias("line"), parts.alias("parts")).withColumn("size", F.size("parts"))
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbered = lines.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    blocks = lines.groupBy("file", "block").agg(F.sum("size").alias("sizes")).select("file", "block", F.coalesce(F.sum("sizes").over(before), F.lit(0)).alias("offset"))
    values = numbered.join(blocks, ["file", "block"]).select("file", (F.col("offset") + F.col("within")).alias("first"), F.posexplode("parts").alias("at", "text"))
    ordinal = F.col("first") + F.col("at")
    grouped = values.groupBy("file", F.call_function("div", ordinal, F.lit(n)).alias("record")).agg(F.sort_array(F.collect_list(F.struct(F.pmod(ordinal, F.lit(n)).alias("place"), "text"))).alias("cells"))
    return grouped.where(F.size("cells") == n).select(F.transform("cells", lambda c: c["text"]).alias("values"))


def read_text(spark: SparkSession, path: str | list[str], fields: list[Field], separator: str = "\t", layout: str = "lines") -> Loaded:
    lines = spark.read.text(path)
    if layout == "lines":
        return typed(line_records(lines, separator), fields)
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return typed(stream_records(placed, separator, len(fields)), fields)


def read_stdin(spark: SparkSession, fields: list[Field], separator: str = "\t", layout: str = "lines", gzip: bool = False) -> Loaded:
    """Standard input by way of a file in the shared folder, as the executors cannot read it; the file goes when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "stdin") + (".gz" if gzip else ".txt"))
    spool = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        while chunk := sys.stdin.buffer.read(1 << 20):
            spool.write(bytearray(chunk))
    finally:
        spool.close()
    discard(spark, path.toString())
    return read_text(spark, path.toString(), fields, separator, layout)


def read_table(source: DataFrame, fields: list[Field], mapping: Mapping[str, str], partition_filter: str | None = None, row_filter: str | None = None) -> Loaded:
    """Rows of an existing (Hive) table: ``mapping`` names the source column or expression of each field.

    The partition filter comes first and prunes partitions.  Null cells become
    the zero value of their type, as text and as typed columns alike.
    """
    rows = source.where(partition_filter) if partition_filter else source
    rows = rows.where(row_filter) if row_filter else rows
    cells = F.array(*(F.coalesce(F.expr(mapping.get(f.name, f.name)).cast("string"), F.lit("")) for f in fields))
    return typed(rows.select(cells.alias("values")), fields)
