"""Totals over trailing periods by binary doubling.

Sums of 1, 2, 4, 8 ... days are built from each other, ``S2n[d] = Sn[d] +
Sn[d-n]``; a window of any length is the sum of the shifted blocks named by its
binary digits, 7 = 4 + 2 + 1 and 30 = 16 + 8 + 4 + 2.  A window costs as many
additions as its length has digits, whatever the length is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import reading
from tidemark.operators.records import event_records

EPOCH = date(1970, 1, 1)
#: Cells of the dense entity-by-day matrix worked on at once.
MATRIX_CELLS = 2_000_000


def trailing_sums(daily: np.ndarray, windows: Sequence[int]) -> list[np.ndarray]:
    """Trailing sums of each window along the last axis; days before the first count 0."""

    def shifted(block: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(block)
        if by < block.shape[-1]:
            out[..., by:] = block[..., : block.shape[-1] - by] if by else block
        return out

    blocks = [daily]
    while 2 ** len(blocks) <= max(windows):
        half = blocks[-1]
        blocks.append(half + shifted(half, 2 ** (len(blocks) - 1)))
    sums = []
    for window in windows:
        total, passed = np.zeros_like(daily), 0
        for digit in range(len(blocks)):
            if window >> digit & 1:
                total += shifted(blocks[digit], passed)
                passed += 2**digit
        sums.append(total)
    return sums


def _kernel(first: int, n_days: int, windows: tuple[int, ...]):
    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MATRIX_CELLS // n_days)
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                lists = batch.column(1)
                pairs = lists.flatten()
                day = pairs.field(0).to_numpy(zero_copy_only=False)
                count = pairs.field(1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                daily = np.zeros((batch.num_rows, n_days), np.int64)
                daily[row, day - first] = count
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n_days)
                rows = [daily, *trailing_sums(daily, windows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in rows)],
                    names=["entity", "n", *(f"sum_{w}" for w in windows)],
                )

    return dense


def rolling_totals(
    events: DataFrame,
    first_day: date,
    last_day: date,
    windows: Sequence[int] = (7, 30),
    user: str = "user_uid",
    time: str = "timestamp",
    kind: str = "event_type",
    url: str = "url",
) -> DataFrame:
    """``user_uid, day_utc, n_records`` and per window ``total_<w>d, average_<w>d``.

    One row for every entity that has a record (see ``event_records``) and every
    day from ``first_day`` to ``last_day``, days without records included.
    Records outside those days, or without a time, count in no total, but their
    entity has its rows, all zero if need be.  The average is the total over the
    window's length.  An empty table gives no rows.

    Records are counted per (entity, hour) where they were made distinct, so
    the shuffle by entity moves at most one narrow row per active hour.
    """
    windows = tuple(int(w) for w in windows)
    if not windows or min(windows) < 1:
        raise ValueError("windows must be at least one day long")
    first, n_days = (first_day - EPOCH).days, (last_day - first_day).days + 1
    if n_days < 1:
        raise ValueError("last_day lies before first_day")
    day = reading.day_number(F.col("us"))
    inside = F.when(day.between(first, first + n_days - 1), day)
    per_cell = event_records(events, user, time, kind, url).groupBy("entity", "cell", inside.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    per_day = per_cell.repartition("entity").groupBy("entity", "day").agg(F.sum("n").alias("n"))
    per_entity = per_day.groupBy("entity").agg(F.collect_list(F.when(F.col("day").isNotNull(), F.struct("day", "n"))).alias("days"))
    schema = "entity string, n array<long>, " + ", ".join(f"sum_{w} array<long>" for w in windows)
    matrix = per_entity.mapInArrow(_kernel(first, n_days, windows), schema)
    names = ["n", *(f"sum_{w}" for w in windows)]
    rows = matrix.select("entity", F.posexplode(F.arrays_zip(*names)).alias("at", "cell"))
    return rows.select(
        F.col("entity").alias("user_uid"),
        F.date_from_unix_date(F.col("at") + F.lit(first)).cast("string").alias("day_utc"),
        F.col("cell.n").alias("n_records"),
        *(x for w in windows for x in (F.col(f"cell.sum_{w}").alias(f"total_{w}d"), (F.col(f"cell.sum_{w}") / F.lit(float(w))).alias(f"average_{w}d"))),
    )
