"""The data model: options, codecs, comparators, errors, result columns.

A series table has an int64 time column `ts_ns` (nanoseconds), any number of key
columns, and numeric value columns, which count as doubles. Null and non-finite
values take no part in any aggregate; a null time drops the row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 4096
#: Codec ids of the block format.
CODEC_IDS = {"PLA_LINEAR": 0, "PLA_CHEB": 1, "RAW_STATS": 3, "RLE": 5, "DECIMAL": 6, "QUANT8": 7, "QUANT16": 8, "RAW": 9}
LOSSLESS = frozenset({"RAW_STATS", "DECIMAL", "RLE"})
STATUS = {
    "ok": "OK",
    "not_found": "no rows in range",
    "unknown_column": "no such column",
    "corrupt": "data does not match its checksum",
    "codec": "codec cannot hold these values",
    "version": "unknown format version",
    "argument": "invalid argument",
}
RESULT = "value double, error_bound double, rows_scanned long, pct_data_read double, pct_algebraic double"
_COMPARE = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "==": Column.__eq__}
NAMED = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=="}


class EngineError(Exception):
    """Any failure of the engine; `status` is a key of STATUS."""

    status = "argument"


class UnknownColumn(EngineError):
    status = "unknown_column"


class CodecError(EngineError):
    status = "codec"


class Corrupt(EngineError):
    status = "corrupt"


def status_text(status: str) -> str:
    return STATUS.get(status, "unknown status")


@dataclass(frozen=True)
class Options:
    """Error bounds and codec choices. An epsilon of 0 in a column means the global one; a global 0 means a thousandth of each block's range."""

    epsilon: float = 0.01
    col_epsilon: dict[str, float] = field(default_factory=dict)
    skip: frozenset[str] = frozenset()
    codecs: dict[str, str] = field(default_factory=dict)
    block_rows: int = BLOCK_ROWS

    def epsilon_of(self, column: str) -> float:
        return self.col_epsilon.get(column) or self.epsilon


def numeric_columns(df: DataFrame, apart: tuple[str, ...] = ("ts_ns",)) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in apart]


def value_of(df: DataFrame, column: str) -> Column:
    """The column as finite doubles, null where it is null, NaN or infinite; text and other columns are refused."""
    kinds = {f.name: f.dataType for f in df.schema}
    if column not in kinds:
        raise UnknownColumn(column)
    if not isinstance(kinds[column], T.NumericType):
        raise UnknownColumn(f"{column} holds {kinds[column].simpleString()}, not numbers")
    v = F.col(column).cast("double")
    return v if isinstance(kinds[column], T.IntegralType) else F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def resolve(df: DataFrame, columns: list[str] | None, apart: tuple[str, ...] = ("ts_ns",)) -> list[str]:
    """The columns asked for, or all value columns."""
    if columns is None:
        return numeric_columns(df, apart)
    for c in columns:
        if c not in df.columns:
            raise UnknownColumn(c)
    return list(columns)


def predicate(value: Column, op: str, threshold: float) -> Column:
    """value OP threshold for > >= < <= == or gt gte lt lte eq; exact."""
    symbol = NAMED.get(op, op)
    if symbol not in _COMPARE:
        raise EngineError(f"unknown comparison {op}")
    return _COMPARE[symbol](value, F.lit(float(threshold)))


def in_range(ts: Column, t_from: int | None, t_to: int | None) -> Column:
    """Both ends inclusive; None is an open end, and 0 is an instant like any other."""
    bounds = ([ts >= F.lit(t_from)] if t_from is not None else []) + ([ts <= F.lit(t_to)] if t_to is not None else [])
    return reduce(Column.__and__, bounds) if bounds else F.lit(True)


def open_ends(t_from: int, t_to: int) -> tuple[int | None, int | None]:
    """For callers that write 0 for an open end."""
    return t_from or None, t_to or None
