"""Command line: compress, query, inspect, verify.

  python -m tideblock compress in.csv STORE [EPSILON]
  python -m tideblock query STORE FN [COLUMN] [--from N] [--to N] [WHERE col OP value]
  python -m tideblock inspect STORE [--blocks]
  python -m tideblock verify STORE
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import EngineError, Options, predicate, value_of
from .operators import query as q
from .plans.two_tier import KINDS
from .sources.readers import read_csv
from .sources.store import SeriesStore

FUNCTIONS = ("mean", "count", "sum", "min", "max", "variance", "downsample", "value_at", "scan")
MOST_PRINTED = 10_000


def column_list(text: str | None) -> list[str] | None:
    return [x.strip() for x in text.split(",") if x.strip()] if text else None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tideblock")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress")
    c.add_argument("source")
    c.add_argument("store")
    c.add_argument("epsilon", nargs="?", type=float, default=0.01)
    r = sub.add_parser("query")
    r.add_argument("store")
    r.add_argument("function", choices=FUNCTIONS)
    r.add_argument("columns", nargs="?")
    r.add_argument("--from", dest="t_from", type=int)
    r.add_argument("--to", dest="t_to", type=int)
    r.add_argument("--at", type=int)
    r.add_argument("--points", type=int, default=100)
    r.add_argument("--limit", type=int, default=MOST_PRINTED)
    r.add_argument("--where", nargs=3, metavar=("COLUMN", "OP", "VALUE"))
    i = sub.add_parser("inspect")
    i.add_argument("store")
    i.add_argument("--blocks", action="store_true")
    v = sub.add_parser("verify")
    v.add_argument("store")
    return p


def _print(df: DataFrame, out, most: int | None = None) -> bool:
    """Header and rows; True if there are more than the `most` shown."""
    print(",".join(df.columns), file=out)
    for i, row in enumerate(df.toLocalIterator()):
        if i == most:
            return True
        print(",".join("" if x is None else str(x) for x in row), file=out)
    return False


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    argv = ["--where" if x.upper() == "WHERE" else x for x in (sys.argv[1:] if argv is None else argv)]
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tideblock").getOrCreate()
    store = SeriesStore(spark, args.store, options=Options(epsilon=getattr(args, "epsilon", 0.01)))
    try:
        if args.command == "compress":
            store.append(read_csv(spark, args.source))
            return 0
        if args.command == "inspect":
            _print((store.blocks().select("batch", "period_key", "block_id", "col", "codec", "num_rows", "ts_first", "ts_last", "n_bytes").orderBy("batch", "period_key", "block_id", "col") if args.blocks else store.inspect().withColumn("codecs", F.concat_ws("+", "codecs")).orderBy("col")), out)
            return 0
        if args.command == "verify":
            got = store.verify().agg(F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("corrupt")).first()
            print(f"checked {got['checked']}, corrupt {got['corrupt']}", file=out)
            return int(got["corrupt"] > 0)
        rows, names = store.rows(args.t_from, args.t_to), column_list(args.columns)
        # statistics answer an aggregate alone or with a comparison of its own column
        own = args.where and names == [args.where[0]]
        if args.function in KINDS and (names or args.function == "count") and (own or not args.where):
            for c in names or []:
                value_of(rows, c)
            _print(store.query(args.function, names[0] if names else None, args.t_from, args.t_to, (args.where[1], float(args.where[2])) if own else None), out)
            return 0
        if args.where:
            column, op, value = args.where
            rows = rows.filter(predicate(value_of(rows, column), op, float(value)))
        if args.function == "count":
            got = q.count(rows, args.t_from, args.t_to)
        elif args.function == "scan":
            got = q.scan(rows.drop("period_key", "block_id", "ordinal", "batch"), names, args.t_from, args.t_to, args.limit + 1)
        elif args.function == "value_at":
            got = q.value_at(rows.drop("period_key", "block_id", "ordinal", "batch"), args.at if args.at is not None else args.t_from, names)
        elif not names:
            raise EngineError(f"{args.function} needs a column")
        elif args.function == "downsample":
            got = q.downsample(rows, names[0], args.points, args.t_from, args.t_to).orderBy("i").drop("i")
        else:
            got = q.aggregate(rows, args.function, names[0], args.t_from, args.t_to)
        if _print(got, out, args.limit if args.function == "scan" else None):
            print(f"only the first {args.limit} rows are shown; --limit shows more", file=sys.stderr)
        return 0
    except EngineError as e:
        print(f"error: {type(e).__name__}: {e}", file=sys.stderr)
        return 1
