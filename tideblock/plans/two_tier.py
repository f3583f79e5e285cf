"""Aggregates of a time range from block statistics where a block is covered whole, and from rows only in blocks at its edges."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import NAMED, EngineError, in_range, predicate, value_of

#: Edge blocks up to this many become time ranges that reach the scan; with more (many series), a semi-join picks their rows.
MOST_FENCES = 64
KINDS = ("mean", "sum", "min", "max", "variance", "count")


def two_tier(rows: DataFrame, blocks: DataFrame, kind: str, column: str, t_from: int | None = None, t_to: int | None = None, by: Sequence[str] = (), ts: str = "ts_ns", where: tuple[str, float] | None = None) -> DataFrame:
    """mean, sum, min, max, variance or count of the range: value, error_bound, rows_scanned, pct_data_read (rows touched of all), pct_algebraic (rows answered from statistics, of those that qualify).

    rows carry block_id as the block table does. Values equal those of the query over
    rows alone, up to the order of additions.
    """
    parts, total = block_parts(rows, blocks, column, t_from, t_to, by, (), ts, where)
    return merge(parts, kind, by, total)


def block_parts(
    rows: DataFrame, blocks: DataFrame, column: str | None, t_from: int | None = None, t_to: int | None = None, by: Sequence[str] = (), within: Sequence[str] = (), ts: str = "ts_ns", where: tuple[str, float] | None = None
) -> tuple[DataFrame, Column]:
    """Partial results (by, n, sum, min, max, mean, m2, touched) of blocks that count whole and of rows in the others, and the number of all rows.

    `within` are columns that tell apart blocks of one number besides `by`. Without a
    column rows are counted. A comparison `where` on the column that all of a block's values pass
    leaves it whole, one that none passes leaves it out, by its minimum and maximum.
    """
    if column is None:
        if where:
            raise EngineError("a comparison needs a column")
        first = blocks.agg(F.min("col")).scalar()
        own = blocks.filter(F.col("col") == first)
        v, one = F.lit(1.0), F.col("num_rows").cast("long")
        s = {"count": one, "sum": one.cast("double"), "min": F.lit(1.0), "max": F.lit(1.0), "mean": F.lit(1.0), "m2": F.lit(0.0)}
    else:
        own, v, stats = blocks.filter(F.col("col") == column), value_of(rows, column), F.col("stats")
        s = {x: stats[x] for x in ("count", "sum", "min", "max", "mean", "m2")}
    first, last = F.col("ts_first"), F.col("ts_last")
    meets = (last >= t_from if t_from is not None else F.lit(True)) & (first <= t_to if t_to is not None else F.lit(True))
    whole = (first >= t_from if t_from is not None else F.lit(True)) & (last <= t_to if t_to is not None else F.lit(True))
    if where:
        op, k = NAMED.get(where[0], where[0]), F.lit(float(where[1]))
        every = predicate(s["min"], *where) & predicate(s["max"], *where)
        some = (s["min"] <= k) & (s["max"] >= k) if op == "==" else predicate(s["max"] if op in (">", ">=") else s["min"], *where)
        meets, whole = meets & F.coalesce(some, F.lit(False)), whole & every
    covered = own.filter(meets & whole)
    from_blocks = covered.select(*by, s["count"].alias("n"), s["sum"].alias("sum"), s["min"].alias("min"), s["max"].alias("max"), s["mean"].alias("mean"), s["m2"].alias("m2"), F.lit(0).cast("long").alias("touched"))
    inside = _edge_rows(rows, own.filter(meets & ~whole), [*by, *within], ts, t_from, t_to).filter(in_range(F.col(ts), t_from, t_to))
    if where:
        v = F.when(predicate(v, *where), v)
    return from_blocks.unionByName(row_parts(inside, v, by)), own.agg(F.sum("num_rows")).scalar()


def row_parts(rows: DataFrame, column: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Partial results of rows that were read."""
    v = value_of(rows, column) if isinstance(column, str) else column
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.count("*").alias("touched"))


def edge_spans(edges: DataFrame, t_from: int | None, t_to: int | None) -> Callable[[Column], Column] | None:
    """A condition on a time that holds inside the range for all rows of edges (ts_first, ts_last), which straddle its ends, and for few others; None if there are no edges. One row comes to the driver."""
    low = F.when(F.col("ts_first") < t_from, F.col("ts_last")) if t_from is not None else F.lit(None)
    high = F.when(F.col("ts_last") > t_to, F.col("ts_first")) if t_to is not None else F.lit(None)
    got = edges.agg(F.count("*").alias("n"), F.max(low).alias("low"), F.min(high).alias("high"), F.count_if(low.isNull() & high.isNull()).alias("inside")).first()
    if not got["n"]:
        return None
    ends = ([lambda t: t <= got["low"]] if got["low"] is not None else []) + ([lambda t: t >= got["high"]] if got["high"] is not None else [])
    # what lies whole in the range, but is an edge for another reason, may stand anywhere
    return (lambda t: F.lit(True)) if got["inside"] else lambda t: in_range(t, t_from, t_to) & reduce(Column.__or__, [x(t) for x in ends])


def _edge_rows(rows: DataFrame, edges: DataFrame, keys: Sequence[str], ts: str, t_from: int | None, t_to: int | None) -> DataFrame:
    fences = edges.select(*keys, "block_id", "ts_first", "ts_last").limit(MOST_FENCES + 1).collect()
    if len(fences) > MOST_FENCES:
        spans = edge_spans(edges, t_from, t_to)
        return rows.filter(spans(F.col(ts))).join(edges.select(*keys, "block_id").distinct(), [*keys, "block_id"], "left_semi")
    each = [F.col(ts).between(r["ts_first"], r["ts_last"]) & (F.col("block_id") == r["block_id"]) & reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(r[k])) for k in keys], F.lit(True)) for r in fences]
    return rows.filter(reduce(Column.__or__, each, F.lit(False)))


def merge(parts: DataFrame, kind: str, by: Sequence[str], total: Column) -> DataFrame:
    """One answer from (n, sum, min, max, mean, m2): means and second moments merge as in a parallel variance."""
    if kind not in KINDS:
        raise EngineError(f"unknown aggregate {kind}")
    parts = parts.filter("n > 0")
    n = F.sum("n")
    grand = parts.groupBy(*by).agg((F.sum("sum") / n).alias("_m"))
    key = list(by) if by else F.lit(True)
    centred = parts.join(grand if by else F.broadcast(grand), key)
    m2 = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_m")) ** 2)
    value = {"mean": F.sum("sum") / n, "sum": F.sum("sum"), "min": F.min("min"), "max": F.max("max"), "variance": m2 / n, "count": F.coalesce(n, F.lit(0)).cast("double")}[kind]
    got = centred.groupBy(*by).agg(value.alias("value"), F.coalesce(n, F.lit(0)).alias("rows_scanned"), F.coalesce(F.sum("touched"), F.lit(0)).alias("_touched"))
    scanned = F.col("rows_scanned")
    return got.select(
        *by, "value", F.lit(0.0).alias("error_bound"), "rows_scanned", F.coalesce(F.try_divide(100.0 * F.col("_touched"), total), F.lit(0.0)).alias("pct_data_read"),
        F.when(scanned > 0, 100.0 * (scanned - F.least(scanned, F.col("_touched"))) / scanned).otherwise(0.0).alias("pct_algebraic"),
    )


def from_blocks(blocks: DataFrame, kind: str, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The aggregate of everything, from statistics alone."""
    s = F.col("stats")
    own = blocks.filter(F.col("col") == column)
    parts = own.select(*by, s["count"].alias("n"), s["sum"].alias("sum"), s["min"].alias("min"), s["max"].alias("max"), s["mean"].alias("mean"), s["m2"].alias("m2"), F.lit(0).cast("long").alias("touched"))
    return merge(parts, kind, by, own.agg(F.sum("num_rows")).scalar())
