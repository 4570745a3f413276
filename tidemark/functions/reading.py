"""How raw event columns are read: users, text keys, event types, instants.

All of these are built-in expressions, so they stay inside whole-stage code
generation, and none depends on the session time zone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NIL_UUID = "00000000-0000-0000-0000-000000000000"
#: One pass over the text decides: hex groups of 8-4-4-4-12, any separators, not all zero.
_USABLE = r"(?s)^(?!0{8}.0{4}.0{4}.0{4}.0{12}\z)[0-9a-fA-F]{8}.[0-9a-fA-F]{4}.[0-9a-fA-F]{4}.[0-9a-fA-F]{4}.[0-9a-fA-F]{12}\z"
DAY_US = 86_400_000_000


def user_id(raw: Column) -> Column:
    """Lower-case hyphenated UUID, or null where there is no usable user.

    Surrounding blanks go; 36 characters with hex groups 8-4-4-4-12 in either
    case count, whatever the four separators are.  Null, anything else and the
    nil UUID give null.
    """
    text = F.trim(raw)
    hyphens = reduce(Column.__and__, (F.substring(text, at, 1) == "-" for at in (9, 14, 19, 24)))
    groups = (F.substring(text, at, n) for at, n in ((1, 8), (10, 4), (15, 4), (20, 4), (25, 12)))
    return F.when(text.rlike(_USABLE), F.lower(F.when(hyphens, text).otherwise(F.concat_ws("-", *groups))))


def text_key(raw: Column) -> Column:
    """Exact text after trimming blanks and carriage returns; empty is null."""
    text = F.btrim(raw, F.lit(" \r"))
    return F.when(text != "", text)


def event_type(raw: Column) -> Column:
    """Lower-case trimmed type; null (and empty) is no type."""
    text = F.lower(F.trim(raw))
    return F.when(text != "", text)


def instant_us(raw: Column) -> Column:
    """Epoch microseconds; null for a null time and for the epoch itself."""
    us = F.unix_micros(raw)
    return F.when(us != 0, us)


def floor_div(value: Column, by: int) -> Column:
    """Integer floor division, also below zero, without a detour through doubles."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def to_ms(us: Column) -> Column:
    return floor_div(us, 1000)


def day_number(us: Column) -> Column:
    """Days since the epoch, UTC."""
    return floor_div(us, DAY_US).cast("int")


def day_text(us: Column) -> Column:
    """``YYYY-MM-DD`` of an instant, UTC."""
    return F.date_from_unix_date(day_number(us)).cast("string")
