"""Distinct counts from membership patterns: exact, mergeable, for any combination of groups.

Every identifier is reduced to the set of group cells that contain it, its
membership pattern.  Identifiers with the same pattern are interchangeable, so
patterns are counted; the number of distinct identifiers in any combination of
groups is the sum over the patterns that satisfy it.  The error bound is 0.

The membership table is the mergeable partial result: partial tables are merged
by uniting the cells of each identifier.  Pattern totals of disjoint identifier
sets simply add.

Where the sets are too large even for that, ``cell_sketches`` keeps a sketch of
fixed size per group cell instead; sketches of the finest cells unite to those of
any coarser group, with a stated error bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Cells of patterns answered at once; a single pattern is taken whole, it has at most the cells that exist.
CELLS_AT_ONCE = 500_000
#: Buckets of a sketch, as a power of two, and its error bound in standard errors.
SKETCH_BITS, STANDARD_ERRORS = 12, 3


def membership(rows: DataFrame, identifier: Column, groups: Mapping[str, Column]) -> DataFrame:
    """``identifier, cells``: per identifier the sorted set of its group cells.

    A cell is a struct of the group values, as text; a null value is in no group
    of that name.  Rows without identifier go.  Repeated cells are dropped
    before the shuffle, and the first shuffle is by identifier and cell, so an
    identifier with a third of all rows is spread; its set holds at most the
    cells that exist.
    """
    names = list(groups)
    read = rows.select(identifier.alias("identifier"), F.struct(*(groups[n].cast("string").alias(n) for n in names)).alias("cell"))
    distinct = read.where(F.col("identifier").isNotNull()).distinct()
    return distinct.groupBy("identifier").agg(F.sort_array(F.collect_list("cell")).alias("cells"))


def merge_memberships(*partials: DataFrame) -> DataFrame:
    """One membership table from partial ones whose identifiers may overlap."""
    cells = reduce(DataFrame.unionByName, partials).select("identifier", F.explode("cells").alias("cell")).distinct()
    return cells.groupBy("identifier").agg(F.sort_array(F.collect_list("cell")).alias("cells"))


def pattern_totals(members: DataFrame) -> DataFrame:
    """``cells, n``: how many identifiers share each pattern."""
    return members.groupBy("cells").agg(F.count(F.lit(1)).alias("n"))


def merge_patterns(*partials: DataFrame) -> DataFrame:
    """Pattern totals of disjoint identifier sets, added."""
    return reduce(DataFrame.unionByName, partials).groupBy("cells").agg(F.sum("n").alias("n"))


def _cube_kernel(n_groups: int):
    levels = list(product((False, True), repeat=n_groups))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(0).offsets.to_numpy()
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + CELLS_AT_ONCE, side="right")) - 1)
                yield batch.slice(begin, end - begin)
                begin = end

    def cube(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            lists, n = batch.column(0), batch.column(1).to_numpy()
            flat = lists.flatten()
            pattern = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            coded = [flat.field(i).dictionary_encode() for i in range(n_groups)]
            codes = [np.nan_to_num(c.indices.to_numpy(zero_copy_only=False), nan=-1).astype(np.int64) for c in coded]
            for number, level in enumerate(levels):
                used = [i for i in range(n_groups) if level[i]]
                known = np.flatnonzero(np.logical_and.reduce([codes[i] >= 0 for i in used])) if used else np.arange(len(flat))
                cell = np.zeros(len(known), np.int64)
                for i in used:  # numbered anew after each group, so that no number can overflow
                    cell = np.unique(cell * (len(coded[i].dictionary) + 1) + codes[i][known], return_inverse=True)[1]
                span = int(cell.max(initial=0)) + 1
                # once per pattern and cell; then the totals of the patterns are added per cell
                once = np.unique(pattern[known] * span + cell)
                cells, where = np.unique(once % span, return_inverse=True)
                total = np.zeros(len(cells), np.int64)
                np.add.at(total, where, n[once // span])
                shown = known[np.unique(cell, return_index=True)[1]]
                columns = [flat.field(i).take(pa.array(shown)).cast(pa.string()) if level[i] else pa.nulls(len(cells), pa.string()) for i in range(n_groups)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cells), number, np.int32)), *columns, pa.array(total)],
                    names=["level", *(f"g{i}" for i in range(n_groups)), "n"],
                )

    return cube


def distinct_cube(patterns: DataFrame, names: Sequence[str]) -> DataFrame:
    """``level, <names>, n_distinct, error_bound``: distinct identifiers of every combination of groups.

    ``level`` has a bit per group, the first group the highest; a group whose
    bit is not set is null and stands for all its values.  Identifiers without
    a value for a group are in none of its rows but count where it is not set.
    Answered from pattern totals alone; each batch adds up its patterns before
    anything is shuffled.
    """
    schema = "level int, " + ", ".join(f"g{i} string" for i in range(len(names))) + ", n long"
    partial = patterns.select("cells", "n").mapInArrow(_cube_kernel(len(names)), schema)
    keys = ["level", *(f"g{i}" for i in range(len(names)))]
    totals = partial.groupBy(*keys).agg(F.sum("n").alias("n_distinct"))
    return totals.select("level", *(F.col(f"g{i}").alias(n) for i, n in enumerate(names)), "n_distinct", F.lit(0).cast("long").alias("error_bound"))


def count_matching(patterns: DataFrame, all_of: Sequence = (), any_of: Sequence = (), none_of: Sequence = ()) -> DataFrame:
    """``n_distinct``: identifiers with a cell for each of ``all_of``, for one of ``any_of``, for none of ``none_of``.

    Each member is a function from a cell to a condition.  No identifiers: 0.
    """
    has = lambda test: F.exists("cells", lambda cell: F.coalesce(test(cell), F.lit(False)))
    wanted = reduce(Column.__and__, (has(t) for t in all_of), F.lit(True))
    if any_of:
        wanted &= reduce(Column.__or__, (has(t) for t in any_of))
    for test in none_of:
        wanted &= ~has(test)
    return patterns.where(wanted).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_distinct"))


def cell_sketches(rows: DataFrame, identifier: Column, groups: Mapping[str, Column], bits: int = SKETCH_BITS) -> DataFrame:
    """``<groups>, sketch``: a HyperLogLog sketch of the identifiers of each finest cell, 2 ** bits buckets at most.

    The mergeable partial result: partial tables unite by ``merge_cell_sketches``.
    A null group value is a cell of its own; rows without identifier go.
    """
    read = rows.select(identifier.alias("identifier"), *(c.cast("string").alias(n) for n, c in groups.items()))
    return read.where(F.col("identifier").isNotNull()).groupBy(*groups).agg(F.hll_sketch_agg("identifier", F.lit(bits)).alias("sketch"))


def merge_cell_sketches(*partials: DataFrame) -> DataFrame:
    """One table of cell sketches from partial ones, whose identifiers and cells may overlap."""
    names = [n for n in partials[0].columns if n != "sketch"]
    return reduce(DataFrame.unionByName, partials).groupBy(*names).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated_cube(cells: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """``level, <names>, n_distinct, error_bound``: the rows of ``distinct_cube``, estimated from cell sketches.

    ``error_bound`` is STANDARD_ERRORS standard errors of a merged sketch, 1.04 /
    sqrt(2 ** bits) of the count each, rounded up; about one count in 370 may lie
    beyond it.
    """
    names = [n for n in cells.columns if n != "sketch"]
    level = (F.lit((1 << len(names)) - 1) - F.grouping_id()).cast("int")
    merged = cells.cube(*names).agg(level.alias("level"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
    known = reduce(Column.__and__, ((F.col("level").bitwiseAND(F.lit(1 << len(names) - 1 - i)) == 0) | F.col(n).isNotNull() for i, n in enumerate(names)))
    bound = F.ceil(F.col("n_distinct") * (STANDARD_ERRORS * 1.04 / 2 ** (bits / 2)))
    return merged.where(known).where(F.col("n_distinct") > 0).select("level", *names, "n_distinct", bound.alias("error_bound"))
