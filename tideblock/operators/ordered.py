"""Operations along an order, without a task that sees all rows.

`positions` sorts by range, writes the sorted rows once, and numbers them from the
counts of the range partitions. What looks at neighbours or accumulates then works
on buckets of consecutive positions: neighbours over a bucket's edge are copied
into it, and running values carry over from a small table with a row per bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

BUCKET = 1 << 15


def positions(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """df with the position (from 0) of each row among those with its keys `by`, in the given order.

    Rows that tie in `order` may stand either way round; name enough columns.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    table = written(placed, "ordered").withColumns({"_part": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = {r["_part"]: r["n"] for r in table.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    starts, total = [], 0
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(total)]
        total += sizes[part]
    base = F.create_map(*starts)[F.col("_part")] if starts else F.lit(0)
    numbered = table.withColumn(name, (base + F.col("_nth")).cast("long")).drop("_at", "_part", "_nth")
    if not by:
        return numbered
    first = numbered.groupBy(*by).agg(F.min(name).alias("_first"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    joined = numbered.alias("l").join(first.alias("r"), same)
    return joined.select(*(F.col(f"l.{c}") for c in numbered.columns if c != name), (F.col(f"l.{name}") - F.col("r._first")).alias(name))


def _bucketed(df: DataFrame, pos: str, back: int, ahead: int) -> DataFrame:
    """A bucket for each row, and copies of rows near an edge in the bucket beyond it."""
    b = F.col(pos)
    own = F.floor(b / BUCKET).cast("long")
    places = [F.struct(own.alias("bucket"), F.lit(True).alias("own"))]
    if back:
        places.append(F.when(b % BUCKET >= BUCKET - back, F.struct((own + 1).alias("bucket"), F.lit(False).alias("own"))))
    if ahead:
        places.append(F.when(b % BUCKET < ahead, F.struct((own - 1).alias("bucket"), F.lit(False).alias("own"))))
    listed = F.filter(F.array(*places), lambda x: x.isNotNull()) if len(places) > 1 else F.array(*places)
    return df.withColumn("_p", F.explode(listed)).withColumns({"_bucket": F.col("_p.bucket"), "_own": F.col("_p.own")}).drop("_p")


def neighbours(df: DataFrame, wanted: dict[str, tuple[str, int]], by: Sequence[str] = (), pos: str = "pos") -> DataFrame:
    """Add columns: name -> (column, steps), steps below 0 looking back, above 0 ahead; null beyond the ends."""
    back, ahead = max([0, *(-n for _, n in wanted.values())]), max([0, *(n for _, n in wanted.values())])
    w = Window.partitionBy(*by, "_bucket").orderBy(pos)
    looked = _bucketed(df, pos, back, ahead).withColumns({k: F.lag(c, -n).over(w) if n < 0 else F.lead(c, n).over(w) for k, (c, n) in wanted.items()})
    return looked.filter("_own").drop("_bucket", "_own")


def _before(totals: DataFrame, over: Callable[[Column | str], Column], by: Sequence[str]) -> DataFrame:
    """Of each bucket what `over` makes of the column _t of all buckets before it; buckets are looked at BUCKET at a time, and those groups once more, so that no task sees all of them."""
    rows = totals.withColumn("_group", F.floor(F.col("_bucket") / BUCKET).cast("long"))
    inside = Window.partitionBy(*by, "_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by, "_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = rows.withColumns({"_near": over("_t").over(inside), "_all": over("_t").over(whole)})
    groups = own.groupBy(*by, "_group").agg(F.first("_all").alias("_t"))
    far = groups.select(*by, "_group", over("_t").over(Window.partitionBy(*by).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)).alias("_far"))
    return own.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_bucket").alias("_of"), "_near", "_group").join(
        far.select(*(F.col(c).alias(f"_key_{c}") for c in by), F.col("_group").alias("_in"), "_far"), reduce(Column.__and__, [F.col(f"_by_{c}").eqNullSafe(F.col(f"_key_{c}")) for c in by], F.col("_group") == F.col("_in"))
    ).select(*(f"_by_{c}" for c in by), "_of", "_near", "_far")


def _carried(rows: DataFrame, before: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.join(before, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_bucket") == F.col("_of"))).drop("_of", *(f"_by_{c}" for c in by))


def running_sum(df: DataFrame, value: Column, name: str, by: Sequence[str] = (), pos: str = "pos") -> DataFrame:
    """Add the sum of `value` up to and with each row."""
    rows = df.withColumns({"_v": value, "_bucket": F.floor(F.col(pos) / BUCKET).cast("long")})
    before = _before(rows.groupBy(*by, "_bucket").agg(F.sum("_v").alias("_t")), F.sum, by)
    own = F.sum("_v").over(Window.partitionBy(*by, "_bucket").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    zero = F.lit(0)
    return _carried(rows.withColumn("_own", own), before, by).withColumn(name, F.col("_own") + F.coalesce("_near", zero) + F.coalesce("_far", zero)).drop("_v", "_bucket", "_own", "_near", "_far")


def running_last(df: DataFrame, column: str, name: str, by: Sequence[str] = (), pos: str = "pos") -> DataFrame:
    """Add the last value that is not null up to and with each row (last observation carried forward)."""
    rows = df.withColumn("_bucket", F.floor(F.col(pos) / BUCKET).cast("long"))
    lasts = rows.groupBy(*by, "_bucket").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(pos))).alias("_t"))
    last = lambda c: F.last(c, ignorenulls=True)
    own = last(column).over(Window.partitionBy(*by, "_bucket").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return _carried(rows.withColumn("_own", own), _before(lasts, last, by), by).withColumn(name, F.coalesce("_own", "_near", "_far")).drop("_bucket", "_own", "_near", "_far")
