"""The documented placement of a key among n partitions, per type.

Spark places rows with its own hash; these values are for comparing counts per
partition with another system that follows the same formulas.  All of them are
built-in expressions but the two that fold over bytes, which are Arrow-batched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import QueryError
from tidemark.functions.codecs import FieldType

# Fixed values of the checksum: its start and its reflected polynomial.
CRC_START, CRC_POLYNOMIAL = 0xFFFF, 0xA001


def _columns_of_bytes(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Texts as a padded matrix of signed bytes, and their lengths."""
    raw = [v.encode() if isinstance(v, str) else bytes(v or b"") for v in values]
    lengths = np.array([len(r) for r in raw], np.int64)
    matrix = np.zeros((len(raw), int(lengths.max(initial=0))), np.int8)
    for i, r in enumerate(raw):
        matrix[i, : len(r)] = np.frombuffer(r, np.int8)
    return matrix, lengths


def checksum_values(values: pd.Series) -> pd.Series:
    """16-bit reflected CRC over bytes taken as signed 32-bit numbers."""
    matrix, lengths = _columns_of_bytes(values)
    state = np.full(len(lengths), CRC_START, np.int32)
    for at in range(matrix.shape[1]):
        fed = state ^ matrix[:, at].astype(np.int32)
        for _ in range(8):
            fed = np.where(fed & 1, (fed >> 1) ^ CRC_POLYNOMIAL, fed >> 1).astype(np.int32)
        state = np.where(at < lengths, fed, state)
    return pd.Series(state.astype(np.int64), index=values.index)


def folded_values(values: pd.Series) -> pd.Series:
    """Exclusive or of all bytes, as a signed number."""
    matrix, _ = _columns_of_bytes(values)
    return pd.Series(np.bitwise_xor.reduce(matrix, axis=1, initial=0).astype(np.int64), index=values.index)


def checksum(value: Column) -> Column:
    @F.pandas_udf("long")
    def of(values: pd.Series) -> pd.Series:
        return checksum_values(values)

    return of(value)


def byte_fold(value: Column) -> Column:
    @F.pandas_udf("long")
    def of(values: pd.Series) -> pd.Series:
        return folded_values(values)

    return of(value)


def _signed_int(number: Column) -> Column:
    """Low 32 bits as a signed number."""
    low = number.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 2**31, low - F.lit(2**32)).otherwise(low)


def partition(kind: FieldType, value: Column, n: int) -> Column:
    """Partition number 0 .. n-1 of a key; never negative."""
    if n < 1:
        raise QueryError("there must be at least one partition")
    match kind.name:
        case "STRING":
            number = F.abs(checksum(value))
        case "UUID":
            digits = F.replace(value, F.lit("-"), F.lit(""))
            words = [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
            mixed = words[0].bitwiseXOR(words[1]).bitwiseXOR(words[2]).bitwiseXOR(words[3])
            size = F.abs(_signed_int(mixed))
            number = F.when(size == 2**31, 2**31 - 1).otherwise(size)
        case "INT":
            number = F.abs(value.cast("long"))
        case "LONG" | "IPV4":
            number = _signed_int(value)
        case "TIME":
            number = _signed_int(F.unix_millis(value))
        case "BOOL" | "BYTE":
            number = value.cast("long")
        case "BYTEARRAY":
            number = byte_fold(value)
        case _:
            raise QueryError(f"{kind} has no placement")
    return F.pmod(number, F.lit(n)).cast("int")
