"""Per-entity feature table: sorted runs of (entity, type) streamed into wide rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import reading
from tidemark.operators.records import event_records

WIDE = "user_uid string, n_records long, types array<string>, counts array<long>, totals array<long>, last_ms array<long>"
_NEVER = np.iinfo(np.int64).min


def _widen(table: pa.Table) -> tuple[pa.RecordBatch, int]:
    """Wide rows of all complete entities of a sorted block; and where its last entity begins."""
    block = table.combine_chunks()
    entity, kind = (block.column(i).combine_chunks() if isinstance(block.column(i), pa.ChunkedArray) else block.column(i) for i in (0, 1))
    same_entity = pc.equal(entity.slice(1), entity.slice(0, len(entity) - 1)).to_numpy(zero_copy_only=False)
    text = pc.fill_null(kind, "")
    same_kind = pc.equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
    run = np.flatnonzero(np.concatenate([[True], ~(same_entity & same_kind)]))
    first = np.flatnonzero(np.concatenate([[True], ~same_entity]))
    timed, total = (block.column(i).to_numpy() for i in (2, 3))
    last = pc.fill_null(block.column(4), _NEVER).to_numpy()
    counts, totals, latest = np.add.reduceat(timed, run), np.add.reduceat(total, run), np.maximum.reduceat(last, run)
    kinds = kind.take(pa.array(run))
    typed = kinds.is_valid().to_numpy(zero_copy_only=False)
    owner = np.searchsorted(first, run, side="right") - 1
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[typed], minlength=len(first)))]).astype(np.int32)
    spans = pa.array(offsets)
    keep = pa.array(typed)
    lists = [
        pa.ListArray.from_arrays(spans, kinds.filter(keep)),
        pa.ListArray.from_arrays(spans, pa.array(counts[typed])),
        pa.ListArray.from_arrays(spans, pa.array(totals[typed])),
        pa.ListArray.from_arrays(spans, pa.array(latest[typed], mask=latest[typed] == _NEVER)),
    ]
    rows = [entity.take(pa.array(first)), pa.array(np.add.reduceat(total, first)), *lists]
    return pa.RecordBatch.from_arrays(rows, names=["user_uid", "n_records", "types", "counts", "totals", "last_ms"]), int(first[-1])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = pa.Table.from_batches([batch])
        block = block if held is None else pa.concat_tables([held, block])
        wide, tail = _widen(block)
        held = block.slice(tail)
        if wide.num_rows > 1:
            yield wide.slice(0, wide.num_rows - 1)
    if held is not None:
        yield _widen(held)[0]


def feature_table(
    events: DataFrame,
    user: str = "user_uid",
    time: str = "timestamp",
    kind: str = "event_type",
    url: str = "url",
) -> DataFrame:
    """One wide row per entity, its types in ascending order.

    ``user_uid``, ``n_records`` (all records, see ``event_records``), and four
    arrays side by side: ``types``, ``counts`` (records of the type that have a
    time), ``totals`` (all records of the type) and ``last_ms`` (latest time in
    epoch ms, null if no record of the type has one).  Records without a type
    count in ``n_records`` only; types an entity never had take no room.  An
    empty table gives no rows.

    Records are counted per (entity, hour, type) where they were made distinct,
    so an entity with a third of all rows reaches the entity buckets as at most
    one row per hour and type.  Buckets are sorted by (entity, type) and
    streamed; wide rows leave without another shuffle.
    """
    partial = (
        event_records(events, user, time, kind, url)
        .groupBy("entity", "cell", "kind")
        .agg(F.count("us").alias("timed"), F.count(F.lit(1)).alias("total"), reading.to_ms(F.max("us")).alias("last"))
    )
    buckets = partial.select("entity", "kind", "timed", "total", "last").repartition("entity").sortWithinPartitions("entity", "kind")
    return buckets.mapInArrow(_stream, WIDE)


def feature_columns(features: DataFrame, types: Sequence[str], as_of_ms: int) -> DataFrame:
    """The wide row with real columns: ``count__t, total__t, recency_ms__t`` for each named type.

    An absent type gives count and total 0 and a null recency.  Columns are read
    off the arrays in place; there is no shuffle.
    """
    columns = [F.col("user_uid"), F.col("n_records")]
    for name in types:
        at = F.array_position("types", F.lit(name)).cast("int")
        value = lambda field, at=at: F.get(F.col(field), at - 1)
        columns += [
            F.coalesce(value("counts"), F.lit(0)).alias(f"count__{name}"),
            F.coalesce(value("totals"), F.lit(0)).alias(f"total__{name}"),
            (F.lit(as_of_ms) - value("last_ms")).alias(f"recency_ms__{name}"),
        ]
    return features.select(*columns)


def feature_pairs(features: DataFrame) -> DataFrame:
    """``user_uid, event_type, n_timed, n_total, last_ms``: a row per entity and type it had."""
    return features.select("user_uid", F.explode(F.arrays_zip("types", "counts", "totals", "last_ms")).alias("f")).select(
        "user_uid",
        F.col("f.types").alias("event_type"),
        F.col("f.counts").alias("n_timed"),
        F.col("f.totals").alias("n_total"),
        F.col("f.last_ms").alias("last_ms"),
    )
