"""Sources of series: Parquet, delimited text, and unions of several."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import EngineError, in_range
from ..operators.ordered import positions, running_last

#: Texts that stand for a missing value.
MISSING = ("", "?", "nan", "NaN", "NA", "N/A", "null")


def read_series(spark: SparkSession, path: str, ts: str = "ts_ns", unit_ns: int = 1, t_from: int | None = None, t_to: int | None = None) -> DataFrame:
    """A Parquet table as a series: ts_ns from the column `ts`, a long in units of unit_ns nanoseconds or a time of microseconds.

    t_from and t_to (nanoseconds, inclusive) become bounds on the stored column, which reach the Parquet scan, as bounds on ts_ns cannot.
    """
    df = spark.read.parquet(path)
    kind = df.schema[ts].dataType
    if t_from is not None or t_to is not None:
        df = df.filter(in_range(F.col(ts), *(None if t is None else stored_instant(t, kind, unit_ns, up) for t, up in ((t_from, True), (t_to, False)))))
    if isinstance(kind, T.IntegralType):
        at = F.col(ts).cast("long") * F.lit(unit_ns)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        at = micros(ts, kind) * F.lit(1000)
    else:
        raise EngineError(f"{ts} is {kind.simpleString()}, no time")
    return df.withColumn("ts_ns", at)


def stored_instant(t_ns: int, kind: T.DataType, unit_ns: int, up: bool) -> Column:
    """The first stored time at or after an instant, or with `up` false the last at or before it, as a literal of the column's kind."""
    unit = unit_ns if isinstance(kind, T.IntegralType) else 1000
    units = -(-t_ns // unit) if up else t_ns // unit
    if isinstance(kind, T.IntegralType):
        return F.lit(units)
    at = datetime(1970, 1, 1) + timedelta(microseconds=units)
    return F.timestamp_micros(F.lit(units)) if isinstance(kind, T.TimestampType) else F.lit(at.isoformat(" ", "microseconds")).cast("timestamp_ntz")


def micros(column: str, kind: T.DataType) -> Column:
    """Microseconds since the epoch; a time without zone counts as UTC, whatever the session's zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(column))
    c = f"`{column}`"
    return F.expr(f"datediff(CAST({c} AS DATE), DATE'1970-01-01') * 86400000000L + hour({c}) * 3600000000L + minute({c}) * 60000000L + CAST(extract(SECOND FROM {c}) * 1000000 AS BIGINT)")


def _header(spark: SparkSession, path: str, sep: str | None) -> tuple[list[str], str]:
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise EngineError(f"{path} has no header")
    line = first[0][0]
    sep = sep or (";" if line.count(";") > line.count(",") else ",")
    return [x.strip() for x in line.split(sep)], sep


def read_csv(spark: SparkSession, path: str, missing: str = "drop") -> DataFrame:
    """Header, then an integer time and numbers, split at commas without quoting.

    Blank lines, rows whose time is no integer and rows with too few fields are left
    out; further fields are ignored. A field that is no number drops the row; with
    missing="zero" it counts 0, with missing="null" it stays null.
    """
    if missing not in ("drop", "zero", "null"):
        raise EngineError(f"unknown rule {missing}")
    names, sep = _header(spark, path, ",")
    fields = F.split("value", sep, -1)
    lines = spark.read.text(path).select(fields.alias("f")).filter(F.size("f") >= len(names))
    at = F.expr("try_cast(trim(f[0]) AS BIGINT)")
    values = {n: F.expr(f"try_cast(trim(f[{i}]) AS DOUBLE)") for i, n in enumerate(names) if i}
    rows = lines.select(at.alias("ts_ns"), *(v.alias(n) for n, v in values.items())).filter("ts_ns IS NOT NULL")
    if missing == "drop":
        return rows.dropna(subset=list(values))
    return rows.fillna(0.0, subset=list(values)) if missing == "zero" else rows


def read_csv_carried(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Delimited text (`,` or `;`), its columns that hold a number in the first data row, each missing value replaced by the last one before it in the file; `row` is a row's place. Values missing before the first stay null."""
    names, sep = _header(spark, path, sep)
    lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id()).filter("_line > 0 AND trim(value) != ''")
    split = lines.select("_line", F.split("value", sep, -1).alias("f"))
    head = split.orderBy("_line").limit(1).collect()
    number = lambda i: F.expr(f"try_cast(trim(f[{i}]) AS DOUBLE)")
    if not head:
        return spark.createDataFrame([], "row long")
    first = spark.createDataFrame([(list(head[0]["f"]),)], "f array<string>").select(*[number(i).alias(str(i)) for i in range(min(len(names), len(head[0]["f"])))]).first()
    kept = [(i, n) for i, n in enumerate(names) if i < len(first) and first[i] is not None]
    value = lambda i: F.when(F.get("f", F.lit(i)).isNotNull() & ~F.trim(F.get("f", F.lit(i))).isin(*MISSING), F.expr(f"try_cast(trim(get(f, {i})) AS DOUBLE)"))
    out = positions(split.select("_line", *[value(i).alias(n) for i, n in kept]), ["_line"], name="row")
    for _, n in kept:
        out = running_last(out, n, "_filled", pos="row").drop(n).withColumnRenamed("_filled", n)
    return out.select("row", *[n for _, n in kept])


def union_series(*parts: DataFrame) -> DataFrame:
    """Cold and warm rows, or several files, as one series; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
