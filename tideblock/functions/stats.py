"""Statistics of a series that codec choice rests on, as DataFrames of one row (or one for each key)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import value_of
from ..operators.ordered import neighbours, positions


def _ordered(df: DataFrame, column: str, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    rows = df.select(*by, *(c for c in order if c not in by), value_of(df, column).alias("_value")).filter("_value IS NOT NULL")
    return positions(rows, order, by)


def _joined(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """right has one row for each key, or one in all."""
    return left.join(right, list(by)) if by else left.join(F.broadcast(right), F.lit(True))


def autocorrelation(df: DataFrame, column: str, order: Sequence[str] = ("ts_ns",), by: Sequence[str] = ()) -> DataFrame:
    """Lag-1 autocorrelation; null for fewer than two values or a flat series."""
    pairs = neighbours(_ordered(df, column, order, by), {"_next": ("_value", 1)}, by)
    m = pairs.groupBy(*by).agg(F.avg("_value").alias("_m"))
    d = F.col("_value") - F.col("_m")
    sums = _joined(pairs, m, by).groupBy(*by).agg(F.sum(d * (F.col("_next") - F.col("_m"))).alias("top"), F.sum(d * d).alias("bottom"), F.count("*").alias("n"))
    return sums.select(*by, F.when((F.col("n") >= 2) & (F.col("bottom") >= 1e-15), F.col("top") / F.col("bottom")).alias("autocorr"))


def entropy(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Bits of the histogram of 256 equal bins; 0 for a flat series, null for fewer than two values."""
    rows = df.select(*by, value_of(df, column).alias("_value")).filter("_value IS NOT NULL")
    ends = rows.groupBy(*by).agg(F.min("_value").alias("_a"), F.max("_value").alias("_b"), F.count("*").alias("_n"))
    span = F.col("_b") - F.col("_a")
    place = F.when(span < 1e-15, F.lit(0)).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("_value") - F.col("_a")) * 255 / span))))
    counts = _joined(rows, ends, by).groupBy(*by, place.alias("_bin")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    p = F.col("_c") / F.col("_n")
    return counts.groupBy(*by).agg(F.first("_n").alias("_n"), F.sum(-p * F.log2(p)).alias("_h")).select(*by, F.when(F.col("_n") >= 2, F.col("_h") + 0.0).alias("entropy"))


def curvature(df: DataFrame, column: str, order: Sequence[str] = ("ts_ns",), by: Sequence[str] = ()) -> DataFrame:
    """Variance of second differences over variance of values; null for fewer than three values or a flat series."""
    near = neighbours(_ordered(df, column, order, by), {"_1": ("_value", 1), "_2": ("_value", 2)}, by)
    second = F.col("_2") - 2 * F.col("_1") + F.col("_value")
    got = near.groupBy(*by).agg(F.var_pop(second).alias("top"), F.var_pop("_value").alias("bottom"), F.count("*").alias("n"))
    return got.select(*by, F.when((F.col("n") >= 3) & (F.col("bottom") >= 1e-30), F.col("top") / F.col("bottom")).alias("curvature"))


def unique_capped(df: DataFrame, column: str, cap: int = 64, by: Sequence[str] = ()) -> DataFrame:
    """How many values differ, cap + 1 where they are more."""
    v = value_of(df, column)
    return df.groupBy(*by).agg(F.least(F.count_distinct(v), F.lit(cap + 1)).alias("n_unique"))


def _partials(values, kept: list[float]) -> list[float]:
    """Add values to a sum kept as doubles that do not overlap, so that nothing is lost."""
    for x in values:
        out = []
        for y in kept:
            if abs(x) < abs(y):
                x, y = y, x
            high = x + y
            low = y - (high - x)
            if low:
                out.append(low)
            x = high
        kept = [*out, x]
    return kept


def exact_sum(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The sum rounded once, whatever the order of rows: each task keeps a short list of doubles for each key, and the lists are added exactly."""
    rows = df.select(*by, value_of(df, column).alias("_value")).filter("_value IS NOT NULL")
    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in by)

    def run(batches):
        sums: dict[tuple, list[float]] = {}
        types = None
        for batch in batches:
            types = batch.schema
            keys = list(zip(*(batch.column(k).to_pylist() for k in by), strict=True)) if by else [()] * batch.num_rows
            own: dict[tuple, list[float]] = {}
            for key, v in zip(keys, batch.column("_value").to_pylist(), strict=True):
                own.setdefault(key, []).append(v)
            for key, values in own.items():
                sums[key] = _partials(values, sums.get(key, []))
        if sums:
            columns = [pa.array([k[i] for k in sums], types.field(name).type) for i, name in enumerate(by)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), pa.list_(pa.float64()))], [*by, "_parts"])

    total = F.udf(lambda parts: math.fsum(parts) if parts else None, "double")
    return rows.mapInArrow(run, f"{kinds}_parts array<double>").groupBy(*by).agg(F.flatten(F.collect_list("_parts")).alias("_parts")).select(*by, total("_parts").alias("sum"))
