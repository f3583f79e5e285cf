"""The block table: for each series, block of consecutive rows and column, mergeable statistics and an encoding.

Blocks are numbered by position in time order. Statistics are one native
aggregate; only fitting pieces and choosing codecs runs in an Arrow function, which
sees one block at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Options, resolve, value_of
from . import pla, routing
from .ordered import positions

STATS = "struct<sum:double,min:double,max:double,sum_sq:double,mean:double,m2:double,count:bigint,nz_count:bigint>"
PIECES = "array<struct<start:int,length:int,kind:string,p:array<double>>>"


def block_rows(df: DataFrame, options: Options = Options(), by: Sequence[str] = (), ts: str = "ts_ns", tie: Sequence[str] = ()) -> DataFrame:
    """df in time order with `pos`, `block_id` and `ordinal` (place in the block)."""
    n = options.block_rows
    placed = positions(df.filter(F.col(ts).isNotNull()), [ts, *tie], by)
    return placed.withColumns({"block_id": F.floor(F.col("pos") / n).cast("long"), "ordinal": (F.col("pos") % n).cast("int")})


def melted(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = (), ts: str = "ts_ns") -> DataFrame:
    """A row for each row and value column: by, block_id, ordinal, ts, col, v."""
    each = F.array(*[F.struct(F.lit(c).alias("col"), value_of(rows, c).alias("v")) for c in columns])
    return rows.select(*by, "block_id", "ordinal", F.col(ts).alias("ts"), F.inline(each))


def block_stats(rows: DataFrame, columns: list[str] | None = None, by: Sequence[str] = (), ts: str = "ts_ns") -> DataFrame:
    """by, block_id, col, ts_first, ts_last, num_rows, stats of each block and column; rows come from block_rows."""
    names = resolve(rows, columns, (ts, "pos", "block_id", "ordinal", *by))
    v = F.col("v")
    return (
        melted(rows, names, by, ts)
        .groupBy(*by, "block_id", "col")
        .agg(
            F.min("ts").alias("ts_first"), F.max("ts").alias("ts_last"), F.count("*").cast("int").alias("num_rows"),
            F.struct(
                F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("sum_sq"), F.avg(v).alias("mean"),
                F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"), F.count(v).alias("count"), F.count_if(v != 0).alias("nz_count"),
            ).alias("stats"),
        )
    )


def encode_blocks(rows: DataFrame, options: Options = Options(), columns: list[str] | None = None, by: Sequence[str] = (), ts: str = "ts_ns", cheb_below: int = 32) -> DataFrame:
    """by, block_id, col, codec, epsilon (the effective bound; 0 for lossless codecs), n_bytes, max_error, pieces of each block and column.

    A codec that is asked for but does not hold a block's values gives way to the
    plain one in that block. A column of `skip` is stored plain.
    """
    names = resolve(rows, columns, (ts, "pos", "block_id", "ordinal", *by))
    keys = [*by, "block_id", "col"]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*by, "block_id"])

    def run(key, table):
        col = key[-1].as_py()
        order = np.argsort(table.column("ordinal").to_numpy(), kind="stable")
        v = table.column("v").to_numpy(zero_copy_only=False).astype(np.float64)[order]
        v = v[~np.isnan(v)]
        asked = options.epsilon_of(col)
        codec = "RAW_STATS" if col in options.skip else options.codecs.get(col) or routing.route(v, asked)
        if not routing.holds(v, codec, asked):
            codec = "RAW_STATS"
        pieces, bound, worst = [], 0.0, 0.0
        if codec.startswith("PLA") and len(v):
            bound = pla.effective_epsilon(v, asked)
            pieces = pla.fit(v, bound, cheb_below if codec == "PLA_LINEAR" else len(v) + 1)
            worst = float(np.abs(pla.decode(pieces) - v).max())
        elif codec in ("QUANT8", "QUANT16") and len(v):
            top, low, span = (1 << int(codec[5:])) - 1, v.min(), v.max() - v.min()
            back = low + np.clip(np.floor((v - low) * top / span + 0.5), 0, top) * span / top if span > 0 else v
            bound, worst = asked, float(np.abs(back - v).max())
        size = routing.encoded_bytes(v, codec, pieces) if len(v) else 0
        made = {"codec": pa.array([codec]), "epsilon": pa.array([bound], pa.float64()), "n_bytes": pa.array([size], pa.int64()), "max_error": pa.array([worst], pa.float64())}
        made["pieces"] = pa.array([[{"start": s, "length": n, "kind": k, "p": p} for s, n, k, p in pieces]], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string()), ("p", pa.list_(pa.float64()))])))
        return pa.table({**{k: pa.array([x.as_py()], x.type) for k, x in zip(keys, key, strict=True)}, **made})

    return melted(rows, names, by, ts).select(*keys, "ordinal", "v").groupBy(*keys).applyInArrow(run, f"{kinds}, col string, codec string, epsilon double, n_bytes long, max_error double, pieces {PIECES}")


def build_blocks(rows: DataFrame, options: Options = Options(), columns: list[str] | None = None, by: Sequence[str] = (), ts: str = "ts_ns") -> DataFrame:
    """Statistics and encoding of each block and column."""
    keys = [*by, "block_id", "col"]
    left, right = block_stats(rows, columns, by, ts).alias("l"), encode_blocks(rows, options, columns, by, ts).alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return left.join(right, same).select("l.*", "r.codec", "r.epsilon", "r.n_bytes", "r.max_error", "r.pieces")
