"""Per-key results that do not care how rows are spread over keys.

Input splits are equal whatever the keys are.  Each split dictionary-encodes its
keys and reduces into dense accumulator arrays, one cell per code (bincount for
sums, scatter-minimum and -maximum for times).  A key with a third of all rows
is one cell of every split.  The accumulators leave as blocks, one per hash
range of the keys, and blocks are summed in a distributed reduction: what is
shuffled is distinct keys per split, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.spread import planned_bytes

#: Rows of a split reduced at once; bounds a worker's memory.
ROWS_AT_ONCE = 400_000
#: Bytes of input for each block of keys; a block holds no more keys than so much input has.
BLOCK_BYTES = 32_000_000
_LATE, _EARLY = np.iinfo(np.int64).max, np.iinfo(np.int64).min
BLOCKS = "block int, keys array<string>, n array<long>, timed array<long>, first array<long>, last array<long>"
PER_KEY = "key string, n_rows long, n_timed long, first_ms long, last_ms long"


def _encode(keys: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes and dictionary; null is a dictionary entry like any other."""
    flat = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    coded = flat.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _accumulate(codes: np.ndarray, size: int, n: np.ndarray | None, timed: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Dense accumulators over dictionary codes; integer sums stay exact."""
    if n is None:
        total = np.bincount(codes, minlength=size)
    else:
        total = np.zeros(size, np.int64)
        np.add.at(total, codes, n)
    dated = np.zeros(size, np.int64)
    np.add.at(dated, codes, timed)
    early, late = np.full(size, _LATE), np.full(size, _EARLY)
    np.minimum.at(early, codes, first)
    np.maximum.at(late, codes, last)
    return [total.astype(np.int64), dated, early, late]


def _split_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        codes, dictionary = _encode(table.column(0))
        ms = table.column(1)
        timed = ms.is_valid().to_numpy().astype(np.int64)
        first = pc.fill_null(ms, int(_LATE)).to_numpy()
        last = pc.fill_null(ms, int(_EARLY)).to_numpy()
        cells = _accumulate(codes, len(dictionary), None, timed, first, last)
        block = np.zeros(len(dictionary), np.int32)
        block[codes] = table.column(2).to_numpy()
        order = np.argsort(block, kind="stable")
        ids, begin = np.unique(block[order], return_index=True)
        spans = pa.array(np.append(begin, len(order)).astype(np.int32))
        arrays = [dictionary.take(pa.array(order)), *(pa.array(c[order]) for c in cells)]
        return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), *(pa.ListArray.from_arrays(spans, a) for a in arrays)], names=["block", "keys", "n", "timed", "first", "last"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS_AT_ONCE:
            yield blocks(held)
            held = []
    if held:
        yield blocks(held)


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the blocks of a partition sorted by block; of one block at a time, its keys once and a bounded number of parts are held."""

    class Block:
        def __init__(self) -> None:
            self.parts: list[list[pa.Array]] = []
            self.waiting = self.known = 0

        def append(self, part: pa.RecordBatch) -> None:
            self.parts.append([part.column(i).flatten() for i in range(1, 6)])
            self.waiting += len(self.parts[-1][0])
            if self.waiting > max(ROWS_AT_ONCE, self.known):  # so each key is folded a bounded number of times
                self.fold()

        def fold(self) -> list[pa.Array]:
            flat = [pa.concat_arrays(column) for column in zip(*self.parts)]
            codes, dictionary = _encode(flat[0])
            sums = _accumulate(codes, len(dictionary), *(x.to_numpy() for x in flat[1:]))
            self.parts = [[dictionary, *(pa.array(x) for x in sums)]]
            self.waiting, self.known = 0, len(dictionary)
            return self.parts[0]

    def total(block: Block) -> pa.RecordBatch:
        keys, n, timed, first, last = block.fold()
        never = timed.to_numpy() == 0
        columns = [keys, n, timed, *(pa.array(x.to_numpy(), mask=never) for x in (first, last))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "n_rows", "n_timed", "first_ms", "last_ms"])

    held: Block | None = None
    current = None
    for batch in batches:
        ids = batch.column(0).to_numpy()
        edges = [*np.flatnonzero(np.diff(ids)) + 1, len(ids)]
        begin = 0
        for end in edges:
            if end == begin:
                continue
            if held is not None and ids[begin] != current:
                yield total(held)
                held = None
            current = ids[begin]
            held = held or Block()
            held.append(batch.slice(begin, end - begin))
            begin = end
    if held is not None:
        yield total(held)


def per_key_totals(rows: DataFrame, key: Column, ms: Column) -> DataFrame:
    """``key, n_rows, n_timed, first_ms, last_ms``: one row per key.

    ``key`` and ``ms`` are expressions over ``rows``.  Rows whose key is null
    are summed under the null key, so that the rows of all keys add up to the
    table; ``n_timed`` counts rows whose ``ms`` is not null, ``first_ms`` and
    ``last_ms`` are null where there are none.  An empty table gives no rows.
    There is a block for each task of a shuffle, and for each BLOCK_BYTES of
    input by the planner's estimate; the number changes no result.
    """
    n_blocks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(planned_bytes(rows) // BLOCK_BYTES, 2**31 - 1))
    read = rows.select(key.cast("string").alias("key"), ms.cast("long").alias("ms"))
    placed = read.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int"))
    blocks = placed.mapInArrow(_split_kernel, BLOCKS)
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_sum_blocks, PER_KEY)


def heavy_keys(rows: DataFrame, key: Column, ms: Column, share: float) -> DataFrame:
    """The keys of ``per_key_totals`` that hold at least ``share`` of all rows, keyless rows counted in the whole."""
    totals = per_key_totals(rows, key, ms)
    whole = totals.agg(F.sum("n_rows")).scalar()  # of the same reduction: its exchange is reused
    return totals.where(F.col("key").isNotNull() & (F.col("n_rows") >= F.lit(share) * whole))
