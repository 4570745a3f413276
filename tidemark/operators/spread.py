"""Joining rows to a side that has one row per key, whatever a hot key holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts that the rows are thought to be in, at least: a key with more rows than a part is hot.
HOT_PARTS = 400
#: Keys that the search for hot ones keeps track of, for each part.
TRACKED = 16
HOT, SALT = "__hot", "__salt"
_COUNTED = (T.StringType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType, T.DateType, T.TimestampType)


def _parts(spark: SparkSession) -> int:
    """As many as the session has tasks for a shuffle, so that a larger cluster splits hot keys further."""
    return max(HOT_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """``<key>, __hot``: the keys with more rows than a part, fewer than there are parts, and over how many tasks to spread each.

    One pass keeps bounded counters, a sketch of frequent items, so that no row
    and no key is shuffled to find them.  A key near the limit may be judged
    either way; what is joined does not depend on it.
    """
    parts = _parts(rows.sparkSession)
    present = rows.select(key).where(F.col(key).isNotNull())
    if isinstance(present.schema[0].dataType, _COUNTED):
        tracked = min(TRACKED * parts, 1_000_000)
        told = present.agg(F.count(F.lit(1)).alias("whole"), F.call_function("approx_top_k", F.col(key), F.lit(min(parts, tracked)), F.lit(tracked)).alias("top"))
        counted = told.select("whole", F.explode("top").alias("top")).select(F.col("top.item").alias(key), F.col("top.count").alias("n"), "whole")
    else:
        each = present.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        counted = each.withColumn("whole", each.agg(F.sum("n")).scalar())
    salts = F.ceil(2 * F.col("n") * parts / F.col("whole")).cast("int")
    return counted.where(F.col("n") * parts > F.col("whole")).select(key, salts.alias(HOT))


def salted(rows: DataFrame, hot: DataFrame, key: str, by) -> DataFrame:
    """``rows`` with ``__salt``: spread by the hash of ``by`` for hot keys, 0 for others."""
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col(HOT)).cast("int"), F.lit(0))
    return rows.join(F.broadcast(hot), key, "left").withColumn(SALT, salt).drop(HOT)


def replicated(unique: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``unique`` with ``__salt``: the row of a hot key once for every salt, at most three rows a part in all, others once."""
    spread = F.sequence(F.lit(0), F.coalesce(F.col(HOT) - 1, F.lit(0)))
    return unique.join(F.broadcast(hot), key, "left").withColumn(SALT, F.explode(spread)).drop(HOT)


def planned_bytes(frame: DataFrame) -> int:
    """The planner's size estimate."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which the planner broadcasts a side; below 0 if never."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if threshold.startswith("-"):
        return -1
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(threshold))


def match_unique(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner", co_placed: bool = False, hot: Sequence = ()) -> DataFrame:
    """``rows`` joined to ``unique``, which has one row per key.

    If the planner's size estimate of ``unique`` lies below the broadcast
    threshold a plain join is best.  Beyond that hot keys are salted.  Where both
    sides are already placed by key in as many buckets (``co_placed``) nothing is
    shuffled: ``hot`` names the keys that would fill a bucket, and their rows
    meet the few rows that these keys have in ``unique`` by broadcast.
    """
    if planned_bytes(unique) <= _broadcast_limit(rows.sparkSession) or co_placed and not hot:
        return rows.join(unique, key, how)
    if co_placed:
        is_hot = F.coalesce(F.col(key).isin(*hot), F.lit(False))
        few = unique.where(is_hot)  # a row per hot key at most
        return rows.where(~is_hot).join(unique.where(~is_hot), key, how).unionByName(rows.where(is_hot).join(F.broadcast(few), key, how))
    hottest = hot_keys(rows.select(key), key)
    others = [c for c in rows.columns if c != key]
    left = salted(rows, hottest, key, others or [key])
    return left.join(replicated(unique, hottest, key), [key, SALT], how).drop(SALT)
