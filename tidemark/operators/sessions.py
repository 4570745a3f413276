"""Sessions by inactivity: morphological closing of per-entity occupancy bitmaps.

An entity's occupancy bitmap has one bit per millisecond, set where it has an
event.  Two events belong to one session when no more than ``gap_ms`` lie
between them, that is when closing the bitmap with a structuring element of
``gap_ms`` bits joins them.  Two months at this resolution are 5e9 bits an
entity, nearly all zero, so the bitmaps are kept run-length coded: a bitmap is
its sorted runs of set bits.  Dilation by ``gap_ms`` bits is done by doubling
shifts, ``B |= B << 1; B |= B << 2; ...``, which on runs lengthens every run and
coalesces those that now touch; erosion by the same element trims the ends.

Closing is done twice.  First over (entity, hour) placed events, so that no
entity needs one task; what is left of an entity is bounded by the time spanned,
not by its rows.  Then over the runs of each entity, to join across hours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import reading
from tidemark.operators.records import event_records

RUNS = "entity string, start_ms long, end_ms long, n_records long"


def _running_stop(entity: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The largest end so far of each entity, for runs that lie within others; ranks are compared, so that no number overflows."""
    n = len(stop)
    if n < 2 or ((stop[1:] >= stop[:-1]) | (entity[1:] != entity[:-1])).all():
        return stop
    order = np.argsort(stop, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    offset = n * np.concatenate([[0], np.cumsum(entity[1:] != entity[:-1])])
    return stop[order][np.maximum.accumulate(rank + offset) - offset]


def close_runs(entity: np.ndarray, first: np.ndarray, last: np.ndarray, weight: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Close run-length coded bitmaps with an element of ``gap`` bits.

    ``entity`` is a nondecreasing number per run, ``first`` and ``last`` the
    inclusive ends of runs in ascending order of ``first`` within an entity; with
    gaps of more than an hour runs of the first closing may lie within others.
    ``weight`` is the events under the run.  Returns the position of each closed
    run's first input run, its ends and its weight.
    """
    at = np.arange(len(first))
    stop = _running_stop(entity, last + 1)  # exclusive while bits are being shifted
    reach = 1  # every run has been dilated to cover this many bits per set bit
    while True:
        if len(at) > 1:
            apart = np.empty(len(at), bool)
            apart[0] = True
            apart[1:] = (entity[1:] != entity[:-1]) | (first[1:] > stop[:-1])
            if not apart.all():
                head = np.flatnonzero(apart)
                tail = np.append(head[1:], len(at)) - 1
                at, entity, first, stop = at[head], entity[head], first[head], stop[tail]
                weight = np.add.reduceat(weight, head)
        if reach >= gap:
            return at, first, stop - reach, weight  # erosion leaves the last set bit, inclusive
        shift = min(reach, gap - reach)
        stop = stop + shift
        reach += shift


def _run_numbers(keys: pa.Array) -> np.ndarray:
    """0, 0, 1, 1, 1, 2 ... : a number per run of equal neighbours."""
    if len(keys) < 2:
        return np.zeros(len(keys), np.int64)
    changes = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(changes)])


def closing_kernel(gap_ms: int):
    """Closes a partition sorted by (entity, start_ms); the open run is carried between batches."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        schema = pa.schema([("entity", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("n_records", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            number = _run_numbers(batch.column(0))
            first, last, weight = (batch.column(i).to_numpy() for i in (1, 2, 3))
            at, first, last, weight = close_runs(number, first, last, weight, gap_ms)
            closed = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(first), pa.array(last), pa.array(weight)], schema=schema)
            held = closed.slice(closed.num_rows - 1)
            if closed.num_rows > 1:
                yield closed.slice(0, closed.num_rows - 1)
        if held is not None:
            yield held

    return close


def sessionize(
    events: DataFrame,
    gap_ms: int = 1_800_000,
    user: str = "user_uid",
    time: str = "timestamp",
    kind: str = "event_type",
    url: str = "url",
) -> DataFrame:
    """One row per session: ``user_uid, start_ms, end_ms, duration_ms, n_records``.

    Records (see ``event_records``) with a user and a time count.  A session
    starts at an entity's first record and at each one more than ``gap_ms``
    after the one before; exactly ``gap_ms`` apart is the same session, records
    at the same time are too.  An empty table gives no sessions.
    """
    if gap_ms < 1:
        raise ValueError("gap_ms must be at least 1")
    records = event_records(events, user, time, kind, url).where(F.col("us").isNotNull())
    ms = reading.to_ms(F.col("us"))
    occupied = records.groupBy("entity", "cell", ms.alias("start_ms")).agg(F.count(F.lit(1)).alias("n_records"))
    runs = (
        occupied.select("entity", "start_ms", F.col("start_ms").alias("end_ms"), "n_records")
        .sortWithinPartitions("entity", "start_ms")
        .mapInArrow(closing_kernel(gap_ms), RUNS)
    )
    joined = runs.repartition("entity").sortWithinPartitions("entity", "start_ms").mapInArrow(closing_kernel(gap_ms), RUNS)
    return joined.select(
        F.col("entity").alias("user_uid"),
        "start_ms",
        "end_ms",
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        "n_records",
    )
