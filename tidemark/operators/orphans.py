"""References whose parent is missing, deleted or arrives later: a co-partitioned linear merge.

Parents shrink to one validity interval per key, ``[valid_from, deleted_at)``,
with map-side combining.  References and intervals are placed by key, sorted by
(key, interval before references, time) and merged in one linear pass.

Hot references are salted (see ``spread``) and the interval of a hot key goes to
each of its salts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.spread import SALT, hot_keys, replicated, salted

MISSING, LATE, DELETED = "missing", "late", "deleted"
_NONE = np.iinfo(np.int64).min


def validity_intervals(parents: DataFrame, key: Column, us: Column, deletes: Column | None = None) -> DataFrame:
    """``key, valid_from, deleted_at``: one row per key with a dated parent row.

    ``deletes`` is a condition on the rows that take the key out from their time
    on; such rows are also rows of the key.  Keyless and undated rows go.
    """
    read = parents.select(key.alias("key"), us.alias("us"), (F.lit(False) if deletes is None else F.coalesce(deletes, F.lit(False))).alias("deletes"))
    dated = read.where(F.col("key").isNotNull() & F.col("us").isNotNull())
    return dated.groupBy("key").agg(F.min("us").alias("valid_from"), F.min(F.when(F.col("deletes"), F.col("us"))).alias("deleted_at"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, salt, us, valid_from, deleted_at``; a row with valid_from is an interval, and comes first."""
    names = np.array([MISSING, LATE, DELETED], object)
    carried: tuple[str, int, int, int] | None = None
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        keys, salt = batch.column(0), batch.column(1).to_numpy()
        us, start, stop = (pc.fill_null(batch.column(i), int(_NONE)).to_numpy() for i in (2, 3, 4))
        head = np.ones(size, bool)
        if size > 1:
            head[1:] = pc.not_equal(keys.slice(1), keys.slice(0, size - 1)).to_numpy(zero_copy_only=False) | (salt[1:] != salt[:-1])
        at = np.flatnonzero(head)
        valid, gone = start[at].copy(), stop[at].copy()
        if carried is not None and carried[:2] == (keys[0].as_py(), int(salt[0])) and valid[0] == _NONE:
            valid[0], gone[0] = carried[2:]
        run = np.cumsum(head) - 1
        carried = (keys[size - 1].as_py(), int(salt[-1]), int(valid[-1]), int(gone[-1]))
        since, until = valid[run], gone[run]
        verdict = np.select([since == _NONE, us < since, (until != _NONE) & (us >= until)], [1, 2, 3], 0)
        found = np.flatnonzero((verdict > 0) & (start == _NONE))
        if len(found):
            take = pa.array(found)
            yield pa.RecordBatch.from_arrays([keys.take(take), pa.array(us[found]), pa.array(list(names[verdict[found] - 1]), pa.string())], names=["key", "us", "verdict"])


def orphan_references(references: DataFrame, key: Column, us: Column, intervals: DataFrame) -> DataFrame:
    """``key, us, verdict``: one row per reference that no parent backs at its time.

    Rows without key or time are no references.  Verdicts: ``missing``, no dated
    parent row has the key; ``late``, the first one comes after the reference;
    ``deleted``, the key was taken out at or before it.  A parent at the very
    time of the reference backs it.  Repeated references are reported as often
    as they occur.  ``intervals`` is what ``validity_intervals`` gives.
    """
    read = references.select(key.alias("key"), us.alias("us")).where(F.col("key").isNotNull() & F.col("us").isNotNull())
    hot = hot_keys(read, "key")
    spread = salted(read, hot, "key", ["us"]).select("key", SALT, "us", F.lit(None).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("deleted_at"))
    known = replicated(intervals, hot, "key").select("key", SALT, F.lit(None).cast("long").alias("us"), "valid_from", "deleted_at")
    merged = known.unionByName(spread).repartition("key", SALT).sortWithinPartitions("key", SALT, F.col("us").asc_nulls_first())
    return merged.mapInArrow(_merge, "key string, us long, verdict string")
