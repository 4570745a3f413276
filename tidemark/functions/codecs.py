"""The nine column types: schema text, parsing, rendering, literals and zero values.

Parsing and rendering are built-in column expressions.  A parse gives null for
a text that is not a value of the type; ingest routes such records to its
rejects.  Times are UTC whatever the session time zone is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import QueryError
from tidemark.functions.reading import floor_div

NAMES = ("BOOL", "BYTE", "INT", "LONG", "STRING", "UUID", "IPV4", "TIME")
_SPARK = {
    "BOOL": T.BooleanType(),
    "BYTE": T.ShortType(),
    "INT": T.IntegerType(),
    "LONG": T.LongType(),
    "STRING": T.StringType(),
    "BYTEARRAY": T.BinaryType(),
    "UUID": T.StringType(),
    "IPV4": T.LongType(),
    "TIME": T.TimestampType(),
}
NIL = "00000000-0000-0000-0000-000000000000"


@dataclass(frozen=True)
class FieldType:
    """A column type; ``PLAIN`` passes any other Spark type through."""

    name: str
    size: int = 0
    plain: T.DataType | None = None

    def __str__(self) -> str:
        return f"BYTEARRAY[{self.size}]" if self.name == "BYTEARRAY" else self.name

    @property
    def spark(self) -> T.DataType:
        return self.plain if self.plain is not None else _SPARK[self.name]

    @property
    def quoted(self) -> bool:
        """Whether the values of the type are quoted in statements."""
        return self.name in ("STRING", "UUID", "IPV4", "BYTEARRAY")

    def parse(self, text: Column) -> Column:
        """Value of a text; null if it is none.  Null and empty text are the zero value."""
        if self.name == "STRING":
            return F.coalesce(text, F.lit(""))
        empty = text.isNull() | (text == "")
        return F.when(empty, self.zero()).otherwise(self._parse(text))

    def _parse(self, text: Column) -> Column:
        match self.name:
            case "BOOL":
                return F.when(F.octet_length(text) == 4, True).when(F.octet_length(text) == 1, text != "0").otherwise(False)
            case "BYTE":
                number = F.when(text.rlike("^[0-9]{1,18}$"), text.try_cast("long"))
                return F.when(number <= 255, number.cast("short"))
            case "INT":
                return F.when(text.rlike("^-?[0-9]+$"), text.try_cast("int"))
            case "LONG":
                return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))
            case "UUID":
                parts = [F.substring(text, a, n) for a, n in ((1, 8), (10, 4), (15, 4), (20, 4), (25, 12))]
                canonical = F.lower(F.concat_ws("-", *parts))
                return F.when((F.length(text) == 36) & canonical.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), canonical)
            case "IPV4":
                octets = F.split(text, r"\.")
                number = sum((F.get(octets, F.lit(i)).try_cast("long") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0))
                return F.when(text.rlike(r"^((25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.|$)){4}") & ~text.endswith("."), number)
            case "TIME":
                dated = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.concat(text, F.lit("Z")).try_cast("timestamp"))
                millis = F.when(text.rlike("^[0-9]{1,15}$"), F.timestamp_millis(text.try_cast("long")))
                return F.when(F.substring(text, 5, 1) == "-", dated).otherwise(millis)
            case "BYTEARRAY":
                raw = F.encode(text, "UTF-8")
                return F.when(F.octet_length(raw) == self.size, raw)
        return text.try_cast(self.spark)

    def render(self, value: Column) -> Column:
        """Text of a value; null stays null."""
        match self.name:
            case "BOOL":
                return F.when(value.isNotNull(), F.when(value, "true").otherwise("false"))
            case "IPV4":
                return F.when(value.isNotNull(), F.concat_ws(".", *(F.pmod(F.shiftright(value, 8 * i), F.lit(256)).cast("string") for i in (3, 2, 1, 0))))
            case "TIME":
                second = floor_div(F.unix_micros(value), 1_000_000)
                clock = F.pmod(second, F.lit(86_400))
                two = lambda n: F.lpad(n.cast("string"), 2, "0")
                parts = [two(floor_div(clock, 3600)), two(F.pmod(floor_div(clock, 60), F.lit(60))), two(F.pmod(clock, F.lit(60)))]
                day = F.date_from_unix_date(floor_div(second, 86_400).cast("int")).cast("string")
                return F.when(value.isNotNull(), F.concat(day, F.lit(" "), F.concat_ws(":", *parts)))
            case "BYTEARRAY":
                return F.decode(value, "UTF-8")
        return value.cast("string")

    def literal(self, text: str) -> Column:
        """A statement's literal, typed once by the column it is compared with; an error if it is no value of the type.

        Text columns take any text.  A LONG may have a sign here, as columns of
        other sources may hold negative numbers.
        """
        if not self._is_value(text):
            raise QueryError(f"{text!r} is no {self}")
        if self.name == "LONG" and text:
            return F.lit(int(text)).cast(self.spark)
        return self.parse(F.lit(text)).cast(self.spark)

    def _is_value(self, text: str) -> bool:
        if text == "":
            return True  # stands for the zero value
        whole = re.fullmatch(r"-?[0-9]{1,40}", text)
        match self.name:
            case "BYTE" | "INT" | "LONG":
                low, high = {"BYTE": (0, 255), "INT": (-(2**31), 2**31 - 1), "LONG": (-(2**63), 2**63 - 1)}[self.name]
                return bool(whole) and low <= int(text) <= high
            case "UUID":
                return re.fullmatch(r"(?s)[0-9a-fA-F]{8}.[0-9a-fA-F]{4}.[0-9a-fA-F]{4}.[0-9a-fA-F]{4}.[0-9a-fA-F]{12}", text) is not None
            case "IPV4":
                return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text) is not None and all(int(part) < 256 for part in text.split("."))
            case "TIME":
                if text[4:5] != "-":
                    return re.fullmatch(r"[0-9]{1,15}", text) is not None
                try:
                    return len(text) == 19 and datetime.strptime(text, "%Y-%m-%d %H:%M:%S") is not None
                except ValueError:
                    return False
            case "BYTEARRAY":
                return len(text.encode()) == self.size
            case "PLAIN" if isinstance(self.plain, T.NumericType):
                return re.fullmatch(r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?", text) is not None
        return True

    def escape(self, text: str) -> str:
        """The text of a value as it stands in a statement."""
        return f"'{text}'" if self.quoted else text

    def zero(self) -> Column:
        """What stands for nothing in storage, where there are no nulls."""
        match self.name:
            case "BOOL":
                value = F.lit(False)
            case "STRING":
                value = F.lit("")
            case "UUID":
                value = F.lit(NIL)
            case "TIME":
                value = F.timestamp_millis(F.lit(0))
            case "BYTEARRAY":
                value = F.lit(bytes(self.size))
            case "PLAIN":
                value = F.lit(None)
            case _:
                value = F.lit(0)
        return value.cast(self.spark)

    def sort_part(self, value: Column) -> Column:
        """What the type orders by: strings by length first, then bytes; others as they are."""
        if self.name == "STRING":
            return F.when(value.isNotNull(), F.struct(F.octet_length(value).alias("length"), value.alias("text")))
        if self.name == "PLAIN" and not isinstance(self.plain, T.AtomicType):
            return F.to_json(F.struct(value))
        return value

    def encoded(self, part: Column) -> Column:
        """A sort part as a (length, text) pair that orders the same, so that unlike columns can be mixed."""
        if self.name == "STRING":
            return part
        if self.name in ("UUID", "PLAIN"):
            text = part.cast("string")
        elif self.name == "BYTEARRAY":
            text = F.hex(part)
        elif self.name == "BOOL":
            text = F.when(part, "1").otherwise("0")
        else:
            number = F.unix_micros(part) if self.name == "TIME" else part.cast("long")
            text = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
        return F.when(part.isNotNull(), F.struct(F.lit(0).alias("length"), text.alias("text")))


def of_spark(kind: T.DataType) -> FieldType:
    """The column type for an existing Spark column."""
    for name in ("BOOL", "BYTE", "INT", "LONG", "STRING", "TIME"):
        if isinstance(kind, type(_SPARK[name])):
            return FieldType(name)
    return FieldType("PLAIN", plain=kind)


def of_name(text: str) -> FieldType:
    if text in NAMES:
        return FieldType(text)
    sized = re.fullmatch(r"BYTEARRAY\[(\d+)\]", text)
    if sized and int(sized[1]) > 0:
        return FieldType("BYTEARRAY", int(sized[1]))
    raise QueryError(f"Unknown type {text}")


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType


_DECLARED = re.compile(r"\s*([A-Za-z_][A-Za-z_0-9]*)\s*(?:\(\s*([A-Z0-9]+(?:\s*\[\s*\d+\s*\])?)\s*\))?\s*")


def parse_schema(text: str) -> list[Field]:
    """``name(TYPE),name(TYPE)``; a bare name is a STRING; type words are upper case."""
    fields, at = [], 0
    while True:
        found = _DECLARED.match(text, at)
        if not found:
            raise QueryError(f"Invalid schema near {text[at:]!r}")
        fields.append(Field(found[1], of_name(re.sub(r"\s", "", found[2] or "STRING"))))
        at = found.end()
        if at == len(text):
            break
        if text[at] != ",":
            raise QueryError(f"Invalid schema near {text[at:]!r}")
        at += 1
    names = [f.name for f in fields]
    if len(set(names)) < len(names):
        raise QueryError("A field is declared twice")
    if any(n.startswith("__") for n in names):
        raise QueryError("Names that begin with two underscores are reserved")
    return fields


def schema_text(fields: list[Field]) -> str:
    return ",".join(f"{f.name}({f.type})" for f in fields)


def struct_type(fields: list[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.type.spark) for f in fields])
