"""Codecs that are column expressions: delta-of-delta times, run-length, decimal and quantised values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import varint_size, zigzag
from ..model import predicate, value_of
from .ordered import neighbours, positions, running_sum

MOST_RUN_VALUES = 64
MOST_DIGITS = 7


def dod_encode(df: DataFrame, ts: str = "ts_ns", by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Times in order with delta and delta of deltas; the first row's are null and the second's dod is its delta. n_bytes: what the row takes as zigzag varints."""
    ordered = positions(df.filter(F.col(ts).isNotNull()).select(*dict.fromkeys([*by, ts, *tie])), [ts, *tie], by)
    near = neighbours(ordered, {"_1": (ts, -1), "_2": (ts, -2)}, by)
    delta = F.col(ts) - F.col("_1")
    dod = F.coalesce(delta - (F.col("_1") - F.col("_2")), delta)
    sized = F.when(F.col("pos") == 0, F.lit(8)).otherwise(varint_size(zigzag(dod)))
    return near.select(*by, "pos", ts, delta.alias("delta"), dod.alias("dod"), sized.alias("n_bytes"))


def dod_decode(encoded: DataFrame, ts: str = "ts_ns", by: Sequence[str] = ()) -> DataFrame:
    """Times from the first time and the dods: two running sums."""
    deltas = running_sum(encoded.select(*by, "pos", "dod", F.when(F.col("pos") == 0, F.col(ts)).alias("_t0")), F.coalesce("dod", F.lit(0)), "_delta", by)
    return running_sum(deltas, F.coalesce(F.col("_t0"), F.lit(0)) + F.col("_delta"), ts, by).select(*by, "pos", ts)


def runs(df: DataFrame, column: str, order: Sequence[str] = ("ts_ns",), by: Sequence[str] = ()) -> DataFrame:
    """Runs of equal values in order: run (from 0), start position, value, length. Nulls are left out before."""
    kinds = dict(df.dtypes)
    v = F.col(column) if kinds[column] == "string" else value_of(df, column)
    rows = positions(df.select(*dict.fromkeys([*by, *order]), v.alias("_value")).filter("_value IS NOT NULL"), order, by)
    turned = neighbours(rows, {"_before": ("_value", -1)}, by).withColumn("_turn", (~F.col("_before").eqNullSafe(F.col("_value"))).cast("long"))
    numbered = running_sum(turned, F.col("_turn"), "_run", by)
    return numbered.groupBy(*by, (F.col("_run") - 1).alias("run")).agg(F.min("pos").alias("start"), F.first("_value").alias("value"), F.count("*").alias("length"))


def runs_stats(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """count, sum, mean, min, max and population variance from runs alone."""
    v, n = F.col("value"), F.col("length")
    m = found.groupBy(*by).agg(F.sum(n).alias("count"), F.sum(v * n).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), (F.sum(v * n) / F.sum(n)).alias("mean"))
    centred = found.join(m.select(*by, "mean"), list(by)) if by else found.join(F.broadcast(m.select("mean")), F.lit(True))
    var = centred.groupBy(*by).agg((F.sum(n * (v - F.col("mean")) ** 2) / F.sum(n)).alias("variance"))
    return m.join(var, list(by)) if by else m.join(F.broadcast(var), F.lit(True))


def runs_count_where(found: DataFrame, op: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    return found.groupBy(*by).agg(F.coalesce(F.sum(F.when(predicate(F.col("value"), op, threshold), F.col("length"))), F.lit(0)).alias("n"))


def runs_decode(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return found.select(*by, F.posexplode(F.expr("array_repeat(value, int(length))")).alias("_k", "value"), "start").select(*by, (F.col("start") + F.col("_k")).alias("pos"), "value")


def scaled(v: Column, digits: int) -> Column:
    """v * 10^digits rounded half away from zero."""
    x = v * float(10**digits)
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def _fits(v: Column, digits: int) -> Column:
    back = scaled(v, digits) / float(10**digits)
    return (F.abs(v * float(10**digits)) < 9e15) & (F.abs(back - v) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(v)))


def decimal_detect(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Fewest decimal places, 0 to 7, with which every value comes back within 1e-9 (relative above 1); null if none."""
    v = value_of(df, column)
    some = F.count(v) > 0
    every = [F.when(some & F.coalesce(F.bool_and(_fits(v, d)), F.lit(False)), F.lit(d)) for d in range(MOST_DIGITS + 1)]
    return df.groupBy(*by).agg(F.coalesce(*every).alias("digits"))


def decimal_encode(df: DataFrame, column: str, digits: int, order: Sequence[str] = ("ts_ns",), by: Sequence[str] = ()) -> DataFrame:
    """q, the scaled integer, and its delta to the row before (the first row's to 0). Deltas are whole longs, none is cut off."""
    rows = positions(df.select(*dict.fromkeys([*by, *order]), value_of(df, column).alias("_value")).filter("_value IS NOT NULL"), order, by)
    near = neighbours(rows.withColumn("q", scaled(F.col("_value"), digits)), {"_1": ("q", -1)}, by)
    return near.select(*by, "pos", "q", (F.col("q") - F.coalesce("_1", F.lit(0))).alias("delta"))


def decimal_decode(encoded: DataFrame, digits: int, by: Sequence[str] = ()) -> DataFrame:
    return running_sum(encoded.select(*by, "pos", "delta"), F.col("delta"), "_q", by).select(*by, "pos", (F.col("_q") / float(10**digits)).alias("value"))


def quantise(v: Column, low: Column, high: Column, bits: int) -> Column:
    """Step number, 0 to 2^bits - 1; 0 for a flat range."""
    top = (1 << bits) - 1
    span = high - low
    return F.when(span <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(top), F.floor((v - low) * top / span + 0.5)))).cast("int")


def dequantise(q: Column, low: Column, high: Column, bits: int) -> Column:
    return low + q * (high - low) / float((1 << bits) - 1)


def quant_encode(df: DataFrame, column: str, bits: int, block: Sequence[str]) -> DataFrame:
    """df with q and the value it stands for, by the minimum and maximum of each block (columns `block`)."""
    v = value_of(df, column)
    ends = df.groupBy(*block).agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    rows = df.join(ends, list(block))
    q = quantise(v, F.col("_a"), F.col("_b"), bits)
    return rows.withColumn("q", q).withColumn("decoded", dequantise(F.col("q"), F.col("_a"), F.col("_b"), bits)).withColumn("step", (F.col("_b") - F.col("_a")) / float((1 << bits) - 1)).drop("_a", "_b")
