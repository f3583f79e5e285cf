"""Scalar functions as column expressions, and the few that need bytes as Arrow functions."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EngineError

#: Seconds of a period.
PERIOD_SECONDS = {"hour": 3600, "day": 86_400, "month": 30 * 86_400}


def zigzag(n: Column) -> Column:
    """Signed to unsigned, small magnitudes first; as a long whose bits are the unsigned value."""
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(F.lit(1)))


def varint_size(n: Column) -> Column:
    """Bytes that an unsigned 64-bit value, given as a long, takes with 7 bits a byte."""
    bits = F.when(n < 0, F.lit(64)).when(n == 0, F.lit(1)).otherwise(F.length(F.bin(n)))
    return F.ceil(bits / 7).cast("int")


def varint_bytes(value: int) -> bytes:
    out = bytearray()
    value &= (1 << 64) - 1
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """Value and the place after it; raises where the data end too soon or go on for more than ten bytes."""
    value = 0
    for i in range(10):
        if at + i >= len(data):
            break
        value |= (data[at + i] & 127) << 7 * i
        if data[at + i] < 128:
            return value & (1 << 64) - 1, at + i + 1
    raise EngineError("unfinished varint")


def varint(n: Column) -> Column:
    """The bytes of each value, by an Arrow function."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else varint_bytes(int(x)))

    return F.pandas_udf(run, "binary")(n)


def period_key(ts_ns: Column, period: str) -> Column:
    """Number of the hour, day or 30-day month since the epoch; division truncates toward zero."""
    if period not in PERIOD_SECONDS:
        raise EngineError(f"unknown period {period}")
    return truncated_div(ts_ns, PERIOD_SECONDS[period] * 1_000_000_000)


def truncated_div(a: Column, b: int) -> Column:
    """Integer division toward zero, exact for all longs: b divides a less its remainder, and decimals hold both."""
    return ((a - a % F.lit(b)).cast("decimal(19,0)") / F.lit(b).cast("decimal(19,0)")).cast("long")


def auto_epsilon(low: Column, high: Column) -> Column:
    """The bound that stands for an epsilon of 0: a thousandth of the range, a millionth for a flat one."""
    return F.when(high - low < 1e-12, F.lit(1e-6)).otherwise(0.001 * (high - low))


def cheb3_eval(c: list[Column], u: Column) -> Column:
    """c0 T0(u) + ... + c3 T3(u)."""
    return c[0] + c[1] * u + c[2] * (2 * u * u - 1) + c[3] * (4 * u * u * u - 3 * u)


def cheb3_values(c, n: int) -> np.ndarray:
    """Values at the n places of a segment, -1 at the first and 1 at the last."""
    u = np.linspace(-1.0, 1.0, n) if n > 1 else np.zeros(1)
    return np.polynomial.chebyshev.chebval(u, np.asarray(c, float))


def linear_to_cheb(slope: Column, offset: Column, length: Column) -> list[Column]:
    half = slope * (length - 1) / 2
    return [offset + half, half, F.lit(0.0), F.lit(0.0)]


def _crc32c_table() -> np.ndarray:
    """For the reflected polynomial 0x82F63B78."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0x82F63B78), t >> 1)
    return t


_TABLE = _crc32c_table().tolist()


def crc32c_bytes(data: bytes, crc: int = 0) -> int:
    """CRC-32C; give the result so far to go on with more data."""
    crc ^= 0xFFFFFFFF
    for b in data:
        crc = _TABLE[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def crc32c(data: Column) -> Column:
    """CRC-32C of binary values, by an Arrow function; Spark's own crc32 has another polynomial."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else crc32c_bytes(x))

    return F.pandas_udf(run, "long")(data)


def shuffle_bytes(data: bytes, width: int = 8) -> bytes:
    """Bytes of equal place in their items side by side."""
    return np.frombuffer(data, np.uint8).reshape(-1, width).T.tobytes()


def unshuffle_bytes(data: bytes, width: int = 8) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.tobytes()
