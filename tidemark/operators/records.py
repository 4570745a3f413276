"""Event records: usable rows, each record once, laid out so that no key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import reading

HOUR_US = 3_600_000_000
#: Records without a time share no hour; they are spread over this many cells.
TIMELESS_CELLS = 64


def event_records(
    events: DataFrame,
    user: str = "user_uid",
    time: str = "timestamp",
    kind: str = "event_type",
    url: str = "url",
) -> DataFrame:
    """Distinct records as ``(entity, cell, us, kind)``, hash-placed by (entity, cell).

    Rows without a usable user are no records of anyone and go.  ``us`` is null
    where the time is missing, ``kind`` where the type is.  Rows alike in user,
    time, type and url (null equals null) are one record; all other columns of
    the input, whatever their names, are dropped before the shuffle.

    ``cell`` is the UTC hour of the record, so that an entity with a third of
    all rows is spread over as many tasks as it has hours; every copy of a
    record falls into the same cell.  The result keeps that placement: any
    aggregation by (entity, cell, ...) needs no further shuffle.
    """
    read = events.select(
        # a one-row generator: the filter below is not pushed past it, which would read each user twice
        F.explode(F.array(reading.user_id(F.col(user)))).alias("entity"),
        reading.instant_us(F.col(time)).alias("us"),
        reading.event_type(F.col(kind)).alias("kind"),
        F.col(url).alias("url"),
    ).where(F.col("entity").isNotNull())
    timeless = -1 - F.pmod(F.xxhash64("kind", "url"), F.lit(TIMELESS_CELLS))
    placed = read.withColumn("cell", F.coalesce(reading.floor_div(F.col("us"), HOUR_US), timeless)).repartition("entity", "cell")
    return placed.distinct().select("entity", "cell", "us", "kind")
