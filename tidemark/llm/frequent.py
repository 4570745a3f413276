"""Most frequent values by a majority-vote sketch.

The sketch is ``depth`` rows of ``width`` cells.  A value falls into one cell of
each row, by separate bits of its 64-bit hash.  A cell keeps the total of what
fell into it, a candidate, and the candidate's vote surplus, as in majority
voting: other values cancel votes.  For a cell with total V and surplus C

    count(candidate) <= (V + C) / 2,   count(any other) <= (V - C) / 2,
    count(candidate) >= C.

Weighted votes are cast together: of the parts cast for each value, the largest,
A of all T votes, survives with ``max(0, 2 A - T)``.  The same rule merges
sketches, and the inequalities hold in whatever order cells are merged.

Memory is depth x width cells for each task, whatever the data is.  Candidates
are 64-bit hashes; the values themselves are read back in a second pass.  That
pass leaves out every value that the inequalities rule out in any row of cells,
and counts the rest.  So it ends after two reads and misses nothing, however many
values are frequent and however they share cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import written

DEPTH = 4
#: Cells of a row, as bits of the hash, at most: 25 MB of cells for a task.
MOST_BITS = 18
#: Hashes gathered before they are voted on together.
VOTES_AT_ONCE = 200_000


def _vote(cell: np.ndarray, value: np.ndarray, votes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell arrays (total of votes, candidate, surplus) of weighted votes; one entry per (cell, value)."""
    total = np.zeros(width, np.int64)
    np.add.at(total, cell, votes)
    order = np.lexsort((value, votes, cell))
    last = np.flatnonzero(np.append(cell[order][1:] != cell[order][:-1], True))
    best = order[last]
    candidate, most = np.zeros(width, np.int64), np.zeros(width, np.int64)
    candidate[cell[best]], most[cell[best]] = value[best], votes[best]
    return total, candidate, np.maximum(0, 2 * most - total)


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """A row's cell of each hash, by bits of its own; half of the rows use one hash, the others another."""
    return ((hashes.view(np.uint64) >> np.uint64(row % 2 * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _cell(row: int, bits: int) -> Column:
    hashed = F.col("h") if row < 2 else F.col("h2")
    return F.shiftrightunsigned(hashed, row % 2 * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _second(h: Column) -> Column:
    return F.xxhash64(h, F.lit(1))


def _sketch_kernel(bits: int):
    width = 1 << bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, candidate, surplus = (np.zeros((DEPTH, width), np.int64) for _ in range(3))
        seen = False

        def cast(held: list[pa.RecordBatch]) -> None:
            value, at, votes = np.unique(np.concatenate([b.column(0).to_numpy() for b in held]), return_index=True, return_counts=True)
            second, votes = np.concatenate([b.column(1).to_numpy() for b in held])[at], votes.astype(np.int64)
            for row in range(DEPTH):
                v, c, s = _vote(_cells(value if row < 2 else second, row, bits), value, votes, width)
                total[row] += v
                same = candidate[row] == c
                wins = ~same & (s > surplus[row])
                surplus[row] = np.where(same, surplus[row] + s, np.abs(surplus[row] - s))
                candidate[row][wins] = c[wins]

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                seen = True
                held.append(batch)
            if sum(b.num_rows for b in held) >= VOTES_AT_ONCE:
                cast(held)
                held = []
        if held:
            cast(held)
        if seen:
            row, cell = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (row.astype(np.int32), cell.astype(np.int32), total[row, cell], candidate[row, cell], surplus[row, cell])],
                names=["row", "cell", "total", "candidate", "surplus"],
            )

    return build


def sketch(hashes: DataFrame, bits: int) -> DataFrame:
    """``row, cell, total, candidate, surplus`` of a one-column table of 64-bit hashes; at most DEPTH << bits rows."""
    parts = hashes.toDF("h").select("h", _second(F.col("h")).alias("h2")).mapInArrow(_sketch_kernel(bits), "row int, cell int, total long, candidate long, surplus long")
    return merge_sketches(parts)


def merge_sketches(parts: DataFrame) -> DataFrame:
    """Merges the cells of any number of sketches by vote cancellation."""
    voted = parts.groupBy("row", "cell", "candidate").agg(F.sum("total").alias("total"), F.sum("surplus").alias("votes"))
    merged = voted.groupBy("row", "cell").agg(F.sum("total").alias("total"), F.sum("votes").alias("cast"), F.max(F.struct("votes", "candidate")).alias("best"))
    return merged.select("row", "cell", "total", F.col("best.candidate").alias("candidate"), F.greatest(F.lit(0), 2 * F.col("best.votes") - F.col("cast")).cast("long").alias("surplus"))


def frequent_values(rows: DataFrame, value: Column, share: float) -> DataFrame:
    """``item, n_rows, lower_bound, upper_bound``: every value with at least ``share`` of the rows that have one.

    ``value`` is text as stored; null and blank values are no values and repeated
    rows count.  The sketch has at least 16 / share cells a row, but no more than
    2 ** MOST_BITS; it is written, DEPTH x width rows of five numbers, whatever
    the data is.  Only cells that can hold a value of that share are live, at most
    1 / share a row; they are broadcast.  A value that lies, in every row, in a
    live cell, as its candidate or where the others can reach the share too, is
    counted exactly, with map-side combining.  With 16 / share cells a row
    that leaves a value that is not frequent, by chance alone, fewer than one
    time in 10,000; a share below 16 / 2 ** MOST_BITS, some 6e-5, is exact all
    the same, but counts more values on the way.  No rows with a value: no items.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    present = rows.select(value.alias("item")).where(F.btrim("item", F.lit(" \t\r\n")) != "")
    bits = min(MOST_BITS, max(4, int(np.ceil(np.log2(16 / share)))))
    cells = written(sketch(present.select(F.xxhash64("item")), bits), "sketch")
    whole = F.lit(share) * F.coalesce(cells.where("row = 0").agg(F.sum("total")).scalar(), F.lit(0))
    alone, beside = (F.call_function("div", F.col("total") + sign * F.col("surplus"), F.lit(2)) for sign in (1, -1))
    likely = present.select("item", F.xxhash64("item").alias("h")).withColumn("h2", _second(F.col("h")))
    for row in range(DEPTH):
        names = (f"candidate_{row}", f"surplus_{row}", f"alone_{row}", f"beside_{row}")
        live = cells.where((F.col("row") == row) & (alone >= whole)).select("cell", *(c.alias(n) for c, n in zip((F.col("candidate"), F.col("surplus"), alone, beside), names)))
        mine = F.col(names[0]) == F.col("h")
        likely = likely.withColumn("cell", _cell(row, bits)).join(F.broadcast(live), "cell").drop("cell")
        likely = likely.withColumn(f"lower_{row}", F.when(mine, F.col(names[1])).otherwise(0)).withColumn(f"upper_{row}", F.when(mine, F.col(names[2])).otherwise(F.col(names[3]))).drop(*names)
        likely = likely.where(F.col(f"upper_{row}") >= whole)
    bounds = F.greatest(*(f"lower_{r}" for r in range(DEPTH))).alias("lower_bound"), F.least(*(f"upper_{r}" for r in range(DEPTH))).alias("upper_bound")
    counted = likely.select("item", *bounds).groupBy("item", "lower_bound", "upper_bound").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(F.col("n_rows") >= whole).select("item", "n_rows", "lower_bound", "upper_bound")
