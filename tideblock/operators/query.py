"""Queries over rows: aggregates of a time range, scan, point lookup, downsample.

Every aggregate takes `by`: none gives one row, as for a single series. All answers
are exact, so error_bound is 0; rows_scanned counts the rows that qualify. A range
without rows gives a null value, except count, which gives 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import EngineError, in_range, predicate, resolve, value_of
from .ordered import positions, running_last

AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "variance": F.var_pop}


def aggregate(df: DataFrame, kind: str, column: str | None = None, t_from: int | None = None, t_to: int | None = None, by: Sequence[str] = (), where: tuple[str, float] | None = None, ts: str = "ts_ns") -> DataFrame:
    """`kind` is mean, sum, min, max, variance (of the population) or count; `where` is a comparison of the column with a number."""
    if kind != "count" and kind not in AGGREGATES:
        raise EngineError(f"unknown aggregate {kind}")
    if column is None and (kind != "count" or where):
        raise EngineError(f"{kind} needs a column")
    rows = df.filter(in_range(F.col(ts), t_from, t_to) & F.col(ts).isNotNull())
    v = value_of(df, column) if column is not None else F.lit(1.0)
    if where:
        rows = rows.filter(predicate(v, *where))
    value = F.count(v).cast("double") if kind == "count" else AGGREGATES[kind](v)
    total = df.agg(F.count("*")).scalar()
    return rows.groupBy(*by).agg(value.alias("value"), F.count(v).alias("rows_scanned")).select(
        *by, "value", F.lit(0.0).alias("error_bound"), "rows_scanned", F.when(total > 0, 100.0 * F.col("rows_scanned") / total).otherwise(0.0).alias("pct_data_read"), F.lit(0.0).alias("pct_algebraic")
    )


def mean(df, column, t_from=None, t_to=None, by=()):
    return aggregate(df, "mean", column, t_from, t_to, by)


def sum_(df, column, t_from=None, t_to=None, by=()):
    return aggregate(df, "sum", column, t_from, t_to, by)


def min_(df, column, t_from=None, t_to=None, by=()):
    return aggregate(df, "min", column, t_from, t_to, by)


def max_(df, column, t_from=None, t_to=None, by=()):
    return aggregate(df, "max", column, t_from, t_to, by)


def variance(df, column, t_from=None, t_to=None, by=()):
    return aggregate(df, "variance", column, t_from, t_to, by)


def count(df, t_from=None, t_to=None, by=()):
    return aggregate(df, "count", None, t_from, t_to, by)


def mean_where(df, column, op, threshold, t_from=None, t_to=None, by=()):
    return aggregate(df, "mean", column, t_from, t_to, by, (op, threshold))


def count_where(df, column, op, threshold, t_from=None, t_to=None, by=()):
    return aggregate(df, "count", column, t_from, t_to, by, (op, threshold))


def scan(df: DataFrame, columns: list[str] | None = None, t_from: int | None = None, t_to: int | None = None, max_rows: int | None = None, ts: str = "ts_ns", tie: Sequence[str] = ()) -> DataFrame:
    """Rows of a range in time order, the first `max_rows` of them; `tie` orders rows of one time."""
    rows = df.filter(in_range(F.col(ts), t_from, t_to) & F.col(ts).isNotNull()).orderBy(ts, *tie)
    rows = rows.limit(max_rows) if max_rows is not None else rows
    return rows.select(ts, *resolve(df, columns, (ts,)))


def value_at(df: DataFrame, at: int, columns: list[str] | None = None, exact: bool = False, tolerance: int | None = None, ts: str = "ts_ns", tie: Sequence[str] = ()) -> DataFrame:
    """The first row at or after an instant, at most `tolerance` later; with `exact`, only at it. No row gives no rows."""
    end = at if exact else None if tolerance is None else at + tolerance
    return scan(df, columns, at, end, 1, ts, tie)


def values_at(df: DataFrame, probes: DataFrame, columns: list[str] | None = None, by: Sequence[str] = (), tolerance: int | None = None, exact: bool = False, ts: str = "ts_ns", probe: str = "probe_ns", tie: Sequence[str] = ()) -> DataFrame:
    """For each probe the first row at or after it (a forward as-of join); null columns where there is none.

    Probes and rows are put in one order, from the last time to the first, and each probe
    takes the last row met before it: one sort by range and one running pass over
    buckets of equally many positions, however the times are spread.
    """
    names = resolve(df, columns, (ts, *by))
    rows = df.filter(F.col(ts).isNotNull()).select(*by, F.col(ts).alias("_t"), F.lit(1).alias("_kind"), F.struct(F.col(ts).alias("at"), *names).alias("_row"), F.struct(*[F.col(c) for c in tie] or [F.lit(0).alias("tie")]).alias("_tie"))
    asked = probes.filter(F.col(probe).isNotNull()).select(*by, F.col(probe).alias("_t"), F.lit(0).alias("_kind"))
    placed = positions(asked.unionByName(rows, allowMissingColumns=True), [F.desc("_t"), F.desc("_kind"), F.desc("_tie")], by)
    found = running_last(placed, "_row", "_next", by).filter("_kind = 0")
    row = F.col("_next")
    late = F.lit(0) if exact else F.lit(tolerance)
    fits = F.lit(True) if tolerance is None and not exact else (row["at"] - F.col("_t") <= late)
    return found.withColumn("_hit", F.when(fits, row)).select(*by, F.col("_t").alias(probe), F.col("_hit.at").alias(ts), *(F.col("_hit")[c].alias(c) for c in names))


def grid(t0: int, t1: int, n: int) -> Column:
    """Instant i of n equidistant ones from t0 to t1, from a column `i`: t0 + truncated(step * i)."""
    step = (t1 - t0) / (n - 1) if n > 1 else 0.0
    return F.lit(t0) + F.floor(F.lit(step) * F.col("i")).cast("long")


def downsample(df: DataFrame, column: str, n_points: int, t_from: int | None = None, t_to: int | None = None, block_rows: int = 4096, ts: str = "ts_ns", tie: Sequence[str] = ()) -> DataFrame:
    """n equidistant instants from the first to the last time of the range, each with the value of the row at its proportional place in the block that covers it; null where no block does.

    Where blocks overlap, the later one counts. The row at fraction f of a block of n
    rows is floor(f * (n - 1) + 0.5).
    """
    if n_points < 1:
        raise EngineError("downsample needs a point at least")
    rows = df.filter(F.col(ts).isNotNull()).select(F.col(ts).alias("ts"), value_of(df, column).alias("v"), *tie)
    placed = positions(rows, ["ts", *tie]).withColumns({"block": F.floor(F.col("pos") / block_rows).cast("long"), "ordinal": F.col("pos") % block_rows})
    blocks = placed.groupBy("block").agg(F.min("ts").alias("b0"), F.max("ts").alias("b1"), F.count("*").alias("n"))
    fence = placed.filter(in_range(F.col("ts"), t_from, t_to)).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    spark = df.sparkSession
    if fence["a"] is None:
        return spark.createDataFrame([], "i long, ts_ns long, value double")
    points = spark.range(n_points).select(F.col("id").alias("i")).withColumn("t", grid(fence["a"], fence["b"], n_points))
    # the covering block is the last that starts at or before the instant: as blocks follow in time, an as-of join on their starts
    starts = blocks.select(F.col("b0").alias("t"), F.struct("block", "b0", "b1", "n").alias("_b"))
    order = Window.partitionBy("_bucket").orderBy("t", "_kind", "_block")
    span = max(1, (fence["b"] - fence["a"]) // 64 + 1)
    both = points.withColumn("_kind", F.lit(1)).unionByName(starts.withColumns({"_kind": F.lit(0), "_block": F.col("_b.block")}), allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("t") / span).cast("long"))
    inside = both.withColumn("_last", F.last("_b", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lasts = both.groupBy("_bucket").agg(F.max_by("_b", F.when(F.col("_kind") == 0, F.struct("t", "_block"))).alias("_l"))
    before = lasts.select("_bucket", F.last("_l", ignorenulls=True).over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row per bucket, about 64
    covered = inside.filter("_kind = 1").join(before, "_bucket", "left").withColumn("_b", F.coalesce("_last", "_before")).withColumn("_b", F.when(F.col("_b.b1") >= F.col("t"), F.col("_b")))
    share = F.when(F.col("_b.b1") > F.col("_b.b0"), (F.col("t") - F.col("_b.b0")) / (F.col("_b.b1") - F.col("_b.b0"))).otherwise(0.0)
    wanted = covered.select("i", "t", F.col("_b.block").alias("block"), F.floor(share * (F.col("_b.n") - 1) + 0.5).cast("long").alias("ordinal"))
    return wanted.join(placed.select("block", "ordinal", "v"), ["block", "ordinal"], "left").select("i", F.col("t").alias("ts_ns"), F.col("v").alias("value"))
