"""Continuous ingest: a stream of text lines, or of JSON events, appended to a table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.catalog import FED, Catalog
from tidemark.functions.codecs import Field
from tidemark.plans.ast import TableRef
from tidemark.sources.ingest import line_records, typed


def text_stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """Lines of the files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket; for trials, as a socket cannot be read again after a failure."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def json_lines(lines: DataFrame, fields: list[Field], paths: dict[str, str]) -> DataFrame:
    """``values`` of JSON events; ``paths`` gives the JSON path of each field, by default its name."""
    cells = (F.coalesce(F.get_json_object("value", paths.get(f.name, f"$.{f.name}")), F.lit("")) for f in fields)
    return lines.select(F.array(*cells).alias("values"))


def rejects_folder(checkpoint: str) -> str:
    return checkpoint.rstrip("/") + "-rejects"


def batch_writer(catalog: Catalog, table: TableRef, checkpoint: str, separator: str = "\t", json_paths: dict[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """Writes a batch of lines once, whatever how often it comes."""
    fields = catalog.fields(table)
    mark = f"{FED}.{hashlib.blake2b(checkpoint.encode(), digest_size=8).hexdigest()}"

    def write(batch: DataFrame, number: int) -> None:
        if number <= int(catalog.properties(table).get(mark, -1)):
            return
        records = line_records(batch, separator) if json_paths is None else json_lines(batch, fields, json_paths)
        loaded = typed(records, fields)
        loaded.rejects.write.mode("overwrite").parquet(f"{rejects_folder(checkpoint)}/batch={number}")
        catalog.append(table, loaded.rows)
        catalog.set_property(table, mark, str(number))

    return write


def feed(catalog: Catalog, table: TableRef, lines: DataFrame, checkpoint: str, separator: str = "\t", json_paths: dict[str, str] | None = None, available_now: bool = False) -> StreamingQuery:
    """Appends a stream of lines to a table, batch by batch; rejects go to a folder beside the checkpoint.

    The last batch written is noted at the table, by checkpoint, and a batch that
    comes again is not written again.  A batch that failed half way left nothing,
    as files are committed together; only a failure between that and the note
    would repeat a batch.  Rejects of a batch replace those of its first try.
    """
    writer = lines.writeStream.foreachBatch(batch_writer(catalog, table, checkpoint, separator, json_paths)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
