"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, repeated as often as
it may be.  A document's virtual finish time is the source's cumulative tokens,
this document included, divided by the source's target share.  Served in order
of virtual finish time, sources keep their shares at every point; the mixture is
the beginning of that order that fits the total budget.

Cumulative tokens are a prefix sum over (source, slice of the shuffle), then
over the slices of a source, so that a source with a third of all rows is never
sorted in one task.  The uses are range-sorted by virtual finish time into parts
and written; the budget is cut by the parts' sums and, inside the one part that it
falls into, by a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import VOCABULARY, token_count
from tidemark.sources.shared import written

#: Slices of the shuffle, as bits of the shuffling hash.
SLICE_BITS = 12


def source_name(column: str):
    """Sources are compared in lower case after trimming; empty is none."""
    name = F.lower(F.trim(column))
    return F.when(name != "", name)


def sized_documents(documents: DataFrame, seed: int = 7, vocabulary: str = VOCABULARY, size: Column | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, place``: sizes counted once and written to the shared folder; ``place`` shuffles.

    ``size`` measures a document by something else than the tokens of its text.
    """
    place = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 1)
    measured = token_count(F.col("text"), vocabulary) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    sized = documents.select("doc_id", source_name("source").alias("source"), measured.alias("n_tokens"), place.alias("place"))
    return written(sized, "sizes")


def read_targets(targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats``: one row per named source; rows of one source add up their shares.

    A null share is 0 and a null number of repeats is 1.
    """
    read = targets.select(source_name("source").alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("repeats"))
    return read.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("share").alias("target_share"), F.max("repeats").alias("max_repeats"))


ORDER = ("virtual_finish", "source", "doc_id", "repeat")


def schedule(sized: DataFrame, targets: DataFrame, until: float = float("inf")) -> DataFrame:
    """``doc_id, source, n_tokens, repeat, virtual_finish``: the uses of documents of sources with a target that finish by ``until``.

    A document is repeated only as often as its source comes round by then.
    """
    wanted = read_targets(targets).where((F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    queued = sized.join(wanted, "source").withColumn("slice", F.shiftright("place", 63 - SLICE_BITS)).repartition("source", "slice")
    inside = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    running = queued.withColumn("running", F.sum("n_tokens").over(inside))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sized.withColumn("slice", F.shiftright("place", 63 - SLICE_BITS))
        .groupBy("source", "slice")
        .agg(F.sum("n_tokens").alias("tokens"))
        .select("source", "slice", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"), F.sum("tokens").over(Window.partitionBy("source")).alias("whole"))
    )
    tokens = F.col("before") + F.col("running")
    last = F.col("max_repeats")
    if until != float("inf"):
        rounds = F.floor((F.lit(until) * F.col("target_share") - tokens) / F.col("whole")) + 2  # one to spare, for rounding
        last = F.when(F.col("whole") > 0, F.least(last.cast("long"), rounds).cast("int")).otherwise(last)
    repeats = F.when(last > 0, F.sequence(F.lit(1), last))
    uses = running.join(offsets, ["source", "slice"]).withColumn("repeat", F.explode(repeats))
    finish = ((F.col("repeat") - 1) * F.col("whole") + tokens) / F.col("target_share")
    return uses.select("doc_id", "source", "n_tokens", "repeat", finish.alias("virtual_finish")).where(F.col("virtual_finish") <= F.lit(until))


def _served_by(sized: DataFrame, targets: DataFrame, budget: int) -> float:
    """Virtual time by which the queues have surely served the budget; reads one driver row per target source."""
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.max("n_tokens").alias("longest"))
    queues = []  # (end of the queue in virtual time, share, longest document)
    for row in read_targets(targets).join(sizes, "source").where((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).collect():
        queues.append((row["max_repeats"] * row["size"] / row["target_share"], row["target_share"], row["longest"]))
    # what a queue has not served of its due is less than one document of it
    return _served_at(queues, budget + 2 * sum(n for _, _, n in queues))


def _served_at(queues: list[tuple[float, float, int]], tokens: float) -> float:
    """Virtual time by which ``tokens`` are due in all; infinite if the queues end before."""
    served, now = 0.0, 0.0
    waiting = sorted(queues)
    while waiting:
        rate, end = sum(share for _, share, _ in waiting), waiting[0][0]
        if served + rate * (end - now) >= tokens:
            return now + (tokens - served) / rate
        served, now = served + rate * (end - now), end
        waiting.pop(0)
    return float("inf")


def budget_of(sized: DataFrame) -> int:
    """The size of all documents, those of sources without a target included."""
    return sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]


def served(sized: DataFrame, targets: DataFrame, budget: int) -> DataFrame:
    """The uses of documents that fit the budget, not in order.

    Uses are range-sorted by ORDER, which no two share but repeated rows, so that
    parts are even whatever ties there are; and written with the number of their
    part.  Parts that end within the budget are served whole.
    """
    uses = schedule(sized, targets, _served_by(sized, targets, budget)).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    queue = written(uses.withColumn("part", F.spark_partition_id()), "queue")
    sums = queue.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))  # a row per part
    through = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    parts = written(sums.select("part", (through - F.col("tokens")).alias("before"), through.alias("through")), "parts")
    cut = parts.where(F.col("through") > budget).agg(F.min("part")).scalar()
    whole = queue.where(F.coalesce(F.col("part") < cut, F.lit(True)))
    before = parts.where(F.col("part") == cut).agg(F.min("before")).scalar()
    running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    last = queue.where(F.col("part") == cut).withColumn("running", running).where(F.col("running") + before <= budget).drop("running")
    return whole.unionByName(last).drop("part")


def mixture(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """The uses of documents that make up the mixture, in order of virtual finish time.

    ``sized`` comes from ``sized_documents``.  The budget is in tokens, by
    default the size of all documents, those of sources without a target
    included.  Queues that run dry leave their turn to the others.  The order is
    ``virtual_finish, source, doc_id, repeat``; the mixture ends before the first
    use that would exceed the budget.
    """
    return served(sized, targets, budget_of(sized) if budget is None else budget).orderBy(*ORDER)


def mixture_report(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """Per target source what it has, should give and gives in the mixture.

    ``source, target_share, max_repeats, size, available, actual_tokens,
    actual_share, runs_dry``.  ``available`` is the size times the repeats allowed.
    ``runs_dry``: the mixture serves all that the source has, as often as it may
    be used, and that is less than its share of the budget.  Shares that add up to
    1 or less are given in full where they can be; with more a source may have
    too little and yet not be served to its end.  Sources without documents have
    size 0 and run dry if they have a share.
    """
    if budget is None:
        budget = budget_of(sized)
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    given = served(sized, targets, budget).groupBy("source").agg(F.sum("n_tokens").alias("given"))
    whole = F.sum("given").over(Window.partitionBy())  # a row per target source
    rows = read_targets(targets).join(sizes, "source", "left").join(given, "source", "left")
    size, actual = F.coalesce("tokens", F.lit(0)), F.coalesce("given", F.lit(0))
    available = size * F.greatest("max_repeats", F.lit(0))
    return rows.select(
        "source",
        "target_share",
        "max_repeats",
        size.alias("size"),
        available.alias("available"),
        actual.alias("actual_tokens"),
        F.coalesce(F.col("given") / whole, F.lit(0.0)).alias("actual_share"),
        ((actual == available) & (available < F.col("target_share") * F.lit(budget))).alias("runs_dry"),
    )
