"""Sums, moments, extremes and predicates of pieces in closed form, as column expressions.

A piece is a column `p` of the pieces struct: LINEAR with slope p[0] and offset p[1]
at its own places 0 to length - 1, CHEB with c0 to c3 over u = -1 to 1 at even places.
Chebyshev moments are those of the even places themselves, so they are exact, not
those of the Chebyshev weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import predicate
from .scalar import cheb3_eval

#: Rows that one task decodes and joins at most, on average.
TASK_ROWS = 250_000


def linear_partial_sum(slope: Column, offset: Column, s: Column, e: Column) -> Column:
    """Sum over places s to e, both included."""
    n = e - s + 1
    return F.when(n > 0, offset * n + slope * (s + e) * n / 2).otherwise(0.0)


def linear_sum(slope: Column, offset: Column, n: Column) -> Column:
    return offset * n + slope * n * (n - 1) / 2


def linear_variance(slope: Column, n: Column) -> Column:
    return slope * slope * (n * n - 1) / 12


def linear_min(slope: Column, offset: Column, n: Column) -> Column:
    return F.least(offset, offset + slope * (n - 1))


def linear_max(slope: Column, offset: Column, n: Column) -> Column:
    return F.greatest(offset, offset + slope * (n - 1))


def linear_where(slope: Column, offset: Column, n: Column, op: str, threshold: float) -> tuple[Column, Column]:
    """Sum and count of the places whose value satisfies the comparison; exact.

    The crossing gives the place where the answer turns to within one; the places
    beside it are compared as values, so a value that equals the threshold counts as
    the comparison says.
    """
    line = lambda t: offset + slope * t
    at = F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), F.try_divide(F.lit(float(threshold)) - offset, slope))))
    flat = slope == 0
    if op in ("==", "eq"):
        hits = [F.when((at + d >= 0) & (at + d < n) & predicate(line(at + d), op, threshold), F.lit(1)).otherwise(0) for d in (-1, 0, 1, 2)]
        count = F.when(flat, F.when(predicate(offset, op, threshold), n).otherwise(0)).otherwise(sum(hits[1:], hits[0]))
        return count * F.lit(float(threshold)), count.cast("long")
    # the first place (of a rising answer) or the last (of a falling one) lies among four around the crossing, or at the end nearest to it
    rising = (slope > 0) if op in (">", ">=", "gt", "gte") else (slope < 0)
    near = F.transform(F.sequence(at - 1, at + 2), lambda t: F.greatest(F.lit(0).cast("long"), F.least(n.cast("long") - 1, t)))
    hits = F.filter(near, lambda t: predicate(line(t), op, threshold))
    first, last = F.coalesce(F.array_min(hits), n.cast("long")), F.coalesce(F.array_max(hits), F.lit(-1).cast("long"))
    all_or_none = predicate(offset, op, threshold)
    s = F.when(flat, F.when(all_or_none, 0).otherwise(n)).when(rising, first).otherwise(0)
    e = F.when(flat, n - 1).when(rising, n - 1).otherwise(last)
    count = F.greatest(F.lit(0).cast("long"), e - s + 1)
    return F.when(count > 0, linear_partial_sum(slope, offset, s, e)).otherwise(0.0), count.cast("long")


def _places(n: Column, s: Column | None = None, e: Column | None = None) -> Column:
    return F.sequence(F.lit(0) if s is None else s, n - 1 if e is None else e)


def cheb_values(c: Sequence[Column], n: Column, s: Column | None = None, e: Column | None = None) -> Column:
    """Array of the values at places s to e (all if not given)."""
    step = F.coalesce(F.try_divide(F.lit(2.0), n - 1), F.lit(0.0))
    return F.transform(_places(n, s, e), lambda j: cheb3_eval(list(c), F.lit(-1.0) + j * step))


def _even_moments(n: Column) -> list[Column]:
    """Means of u^0, u^2, u^4, u^6 over n even places from -1 to 1."""
    m = n - 1.0
    two = F.when(n > 1, (n + 1.0) / (3 * m)).otherwise(1.0)
    four = F.when(n > 1, (n + 1.0) * (3.0 * n * n - 7) / (15 * m * m * m)).otherwise(1.0)
    six = F.when(n > 1, (n + 1.0) * (3.0 * n * n * n * n - 18.0 * n * n + 31) / (21 * m * m * m * m * m)).otherwise(1.0)
    return [F.lit(1.0), two, four, six]


def _powers(c: Sequence[Column]) -> list[Column]:
    """Coefficients of 1, u, u^2, u^3."""
    return [c[0] - c[2], c[1] - 3 * c[3], 2 * c[2], 4 * c[3]]


def cheb_mean(c: Sequence[Column], n: Column) -> Column:
    a, m = _powers(c), _even_moments(n)
    return F.when(n > 1, a[0] + a[2] * m[1]).otherwise(a[0] - a[1] + a[2] - a[3])


def cheb_sum(c: Sequence[Column], n: Column) -> Column:
    return cheb_mean(c, n) * n


def cheb_variance(c: Sequence[Column], n: Column) -> Column:
    """Population variance over the even places."""
    a, m = _powers(c), _even_moments(n)
    even = a[0] * a[0] + 2 * a[0] * a[2] * m[1] + a[2] * a[2] * m[2]
    odd = a[1] * a[1] * m[1] + 2 * a[1] * a[3] * m[2] + a[3] * a[3] * m[3]
    mean = cheb_mean(c, n)
    return F.when(n > 1, F.greatest(F.lit(0.0), even + odd - mean * mean)).otherwise(0.0)


def cheb_min_max(c: Sequence[Column], n: Column) -> tuple[Column, Column]:
    """Smallest and largest of the values at all places."""
    values = cheb_values(c, n)
    return F.array_min(values), F.array_max(values)


def cheb_partial_sum(c: Sequence[Column], n: Column, s: Column, e: Column) -> Column:
    return F.when(e >= s, F.aggregate(cheb_values(c, n, s, e), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def cheb_where(c: Sequence[Column], n: Column, op: str, threshold: float) -> tuple[Column, Column]:
    kept = F.filter(cheb_values(c, n), lambda x: predicate(x, op, threshold))
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept).cast("long")


def pieces_of(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each piece: keys, epsilon, start, length, kind, p."""
    return blocks.select(*keys, "epsilon", F.inline("pieces"))


def _both(kind_linear: Column, linear: Column, cheb: Column) -> Column:
    return F.when(kind_linear, linear).otherwise(cheb)


def piece_moments(pieces: DataFrame) -> DataFrame:
    """pieces with sum, variance, min, max of each."""
    n, p = F.col("length"), F.col("p")
    line, c = F.col("kind") == "LINEAR", [F.get(p, F.lit(i)) for i in range(4)]
    low, high = cheb_min_max(c, n)
    return pieces.withColumns(
        {
            "sum": _both(line, linear_sum(c[0], c[1], n), cheb_sum(c, n)), "variance": _both(line, linear_variance(c[0], n), cheb_variance(c, n)),
            "min": _both(line, linear_min(c[0], c[1], n), low), "max": _both(line, linear_max(c[0], c[1], n), high),
        }
    )


def pieces_aggregate(pieces: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sum, min, max, population variance of the approximated values, and epsilon, the largest bound: mean, min and max are within it."""
    m = piece_moments(pieces)
    n, mu = F.col("length"), F.col("sum") / F.col("length")
    total = m.groupBy(*by).agg(F.sum(n).alias("count"), (F.sum("sum") / F.sum(n)).alias("mean"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.max("epsilon").alias("epsilon"))
    key = list(by) if by else F.lit(True)
    centred = m.join(F.broadcast(total.select("mean")) if not by else total.select(*by, "mean"), key)
    var = centred.groupBy(*by).agg((F.sum(n * (F.col("variance") + (mu - F.col("mean")) ** 2)) / F.sum(n)).alias("variance"))
    return total.join(F.broadcast(var) if not by else var, key)


def pieces_where(pieces: DataFrame, op: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """sum, n and mean of the approximated values that satisfy a comparison. Values within epsilon of the threshold can fall on either side of it, so rows are the place for exact answers."""
    n, p = F.col("length"), F.col("p")
    c = [F.get(p, F.lit(i)) for i in range(4)]
    ls, lc = linear_where(c[0], c[1], n, op, threshold)
    cs, cc = cheb_where(c, n, op, threshold)
    line = F.col("kind") == "LINEAR"
    got = pieces.select(*by, F.when(line, ls).otherwise(cs).alias("_s"), F.when(line, lc).otherwise(cc).alias("_n"))
    return got.groupBy(*by).agg(F.sum("_s").alias("sum"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), (F.sum("_s") / F.sum("_n")).alias("mean"))


def pieces_decode(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ordinal, value of every approximated row."""
    n, c = F.col("length"), [F.get(F.col("p"), F.lit(i)) for i in range(4)]
    values = F.when(F.col("kind") == "LINEAR", F.transform(F.sequence(F.lit(0), n - 1), lambda j: c[1] + c[0] * j)).otherwise(cheb_values(c, n))
    return pieces.select(*keys, "start", F.posexplode(values).alias("_j", "value")).select(*keys, (F.col("start") + F.col("_j")).alias("ordinal"), "value")


def decoded_beside(rows: DataFrame, pieces: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """rows, which have keys and `ordinal`, with the approximated value as `name`; no piece, no row.

    A piece stands for many rows, but Spark takes the decoded table to be about as
    small as the file of pieces: one task would decode it all for a broadcast. So the
    pieces are dealt out by the number of rows, and the join sorts both sides.
    """
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    on = [*keys, "ordinal"]
    back = pieces_decode(pieces.repartition(n, *keys), keys).withColumnRenamed("value", name)
    return rows.repartition(n, *on).join(back.repartition(n, *on).hint("merge"), on)


def pieces_value_at(pieces: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The approximated value and its bound at given ordinals: wanted has keys and `ordinal`; no piece, no row."""
    n, c = F.col("length"), [F.get(F.col("p"), F.lit(i)) for i in range(4)]
    j = F.col("ordinal") - F.col("start")
    u = F.when(n > 1, -1.0 + j * F.try_divide(F.lit(2.0), n - 1)).otherwise(-1.0)
    value = F.when(F.col("kind") == "LINEAR", c[1] + c[0] * j).otherwise(cheb3_eval(c, u))
    return wanted.join(pieces, list(keys)).filter((F.col("ordinal") >= F.col("start")) & (F.col("ordinal") < F.col("start") + n)).select(*keys, "ordinal", value.alias("value"), "epsilon")
