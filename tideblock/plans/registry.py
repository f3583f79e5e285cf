"""Names of the time-series queries over the test tables, with their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import algebra, scalar, stats
from ..model import NAMED, Options
from ..operators import blocks as B
from ..operators import codecs, ordered, query
from ..scratch import path_for, written
from ..sources.readers import read_csv, read_series
from ..sources.store import SeriesStore
from ..streaming import tier
from . import two_tier

LO, HI = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
#: The same instants in nanoseconds.
LO_NS, HI_NS = 1_704_412_800_000_000_000, 1_705_752_000_000_000_000
THRESHOLD = 40.0
CUT_NS = 1_705_276_800_000_000_000  # 2024-01-15, where the second batch of a store begins

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = f
    if sql:
        _SQL[name] = sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def series(spark: SparkSession, sf_dir: str, t_from: int | None = None, t_to: int | None = None) -> DataFrame:
    return read_series(spark, f"{sf_dir}/events.parquet", "ts", t_from=t_from, t_to=t_to).select("ts_ns", "value", "user_id", "event_type")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type: mean, min, max, count and population variance of a time range."""
    rows = events(spark, sf_dir).filter(F.col("ts").between(instant(LO), instant(HI)))
    return rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("n"), F.round(F.var_pop("value"), 4).alias("var_value"))


_add(
    "flagship",
    flagship,
    f"SELECT event_type, round(avg(value), 6) AS mean_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n, round(var_pop(value), 4) AS var_value FROM events WHERE ts BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}' GROUP BY event_type",
)

# aggregates of a range, over rows

_AGG_SQL = {"mean": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "variance": "var_pop(value)", "count": "CAST(count(value) AS DOUBLE)"}
_DIGITS = {"variance": 4, "sum": 4}
_RANGE = f"ts BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'"


def _result_sql(kind: str, where: str, by: str = "") -> str:
    keys, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return (
        f"SELECT {keys}round({_AGG_SQL[kind]}, {_DIGITS.get(kind, 6)}) AS value, CAST(0 AS DOUBLE) AS error_bound, count(value) AS rows_scanned, "
        f"round(100.0 * count(value) / (SELECT count(*) FROM events), 6) AS pct_data_read, CAST(0 AS DOUBLE) AS pct_algebraic FROM events WHERE {where}{group}"
    )


def _shown(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumns({"value": F.round("value", _DIGITS.get(kind, 6)), "pct_data_read": F.round("pct_data_read", 6), "pct_algebraic": F.round("pct_algebraic", 6)})


def _range_query(kind: str, t_from: str | None = LO, t_to: str | None = HI, where=None, by=()):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ends = [None if t is None else instant(t) for t in (t_from, t_to)]
        return _shown(query.aggregate(events(spark, sf_dir), kind, "value", *ends, by=by, where=where, ts="ts"), kind)

    return run


for _kind in _AGG_SQL:
    _add(f"range_{_kind}", _range_query(_kind), _result_sql(_kind, _RANGE))
    _add(f"all_{_kind}", _range_query(_kind, None, None), _result_sql(_kind, "TRUE"))
for _name, _op in NAMED.items():
    _sign = "=" if _op == "==" else _op
    _k = 6.55 if _name == "eq" else THRESHOLD
    _add(f"mean_where_{_name}", _range_query("mean", where=(_op, _k)), _result_sql("mean", f"{_RANGE} AND value {_sign} {_k}"))
    _add(f"count_where_{_name}", _range_query("count", where=(_op, _k)), _result_sql("count", f"{_RANGE} AND value {_sign} {_k}"))
_add("open_from", _range_query("mean", None, HI), _result_sql("mean", f"ts <= TIMESTAMP '{HI}'"))
_add("open_to", _range_query("mean", LO, None), _result_sql("mean", f"ts >= TIMESTAMP '{LO}'"))
_add("empty_range_count", _range_query("count", "2031-01-01", "2031-01-02"), _result_sql("count", "ts > TIMESTAMP '2031-01-01'"))
_add("empty_range_mean", _range_query("mean", "2031-01-01", "2031-01-02"), _result_sql("mean", "ts > TIMESTAMP '2031-01-01'"))
_add("range_mean_by_type", _range_query("mean", by=("event_type",)), _result_sql("mean", _RANGE, "event_type"))
_add("range_variance_by_user", _range_query("variance", by=("user_id",)), _result_sql("variance", _RANGE, "user_id"))

# scan, point lookups, downsample

_NS = "epoch_us(ts) * 1000"
_add(
    "scan_range_limit",
    lambda spark, d: query.scan(series(spark, d, LO_NS, HI_NS), ["value", "user_id"], LO_NS, HI_NS, 1000),
    f"SELECT {_NS} AS ts_ns, value, user_id FROM events WHERE {_RANGE} ORDER BY ts LIMIT 1000",
)
_add("value_at", lambda spark, d: query.value_at(series(spark, d, LO_NS), LO_NS, ["value", "user_id"]), f"SELECT {_NS} AS ts_ns, value, user_id FROM events WHERE ts >= TIMESTAMP '{LO}' ORDER BY ts LIMIT 1")
_add("value_at_exact", lambda spark, d: query.value_at(series(spark, d, LO_NS, LO_NS), LO_NS, ["value"], exact=True), f"SELECT {_NS} AS ts_ns, value FROM events WHERE ts = TIMESTAMP '{LO}'")
_PROBES = 500
_STEP_NS = 5_400_000_000_000
_FIRST_NS = 1_703_980_800_000_000_000


def probes(spark: SparkSession) -> DataFrame:
    return spark.range(_PROBES).select((F.lit(_FIRST_NS) + F.col("id") * F.lit(_STEP_NS)).alias("probe_ns"))


_PROBE_SQL = f"SELECT {_FIRST_NS} + i * {_STEP_NS} AS probe_ns FROM range({_PROBES}) r(i)"
_add(
    "value_at_many",
    lambda spark, d: query.values_at(series(spark, d), probes(spark), ["value", "user_id"]),
    f"WITH e AS (SELECT {_NS} AS ts_ns, value, user_id FROM events), p AS ({_PROBE_SQL}) SELECT p.probe_ns, e.ts_ns, e.value, e.user_id FROM p ASOF LEFT JOIN e ON p.probe_ns <= e.ts_ns",
)
_add(
    "value_at_many_tolerance",
    lambda spark, d: query.values_at(series(spark, d), probes(spark), ["value"], tolerance=60_000_000_000),
    f"WITH e AS (SELECT {_NS} AS ts_ns, value FROM events), p AS ({_PROBE_SQL}), j AS (SELECT p.probe_ns, e.ts_ns, e.value FROM p ASOF LEFT JOIN e ON p.probe_ns <= e.ts_ns) "
    "SELECT probe_ns, CASE WHEN ts_ns - probe_ns <= 60000000000 THEN ts_ns END AS ts_ns, CASE WHEN ts_ns - probe_ns <= 60000000000 THEN value END AS value FROM j",
)
_ORDERED = f"o AS (SELECT {_NS} AS ts_ns, value, user_id, event_type, row_number() OVER (ORDER BY ts) - 1 AS pos FROM events)"
_BLOCKED = _ORDERED + ", k AS (SELECT *, pos // 4096 AS block_id, pos % 4096 AS ordinal FROM o)"
_add(
    "downsample",
    lambda spark, d: query.downsample(series(spark, d), "value", 200, LO_NS, HI_NS),
    f"""WITH {_BLOCKED}, b AS (SELECT block_id, min(ts_ns) AS b0, max(ts_ns) AS b1, count(*) AS n FROM k GROUP BY block_id),
f AS (SELECT min(ts_ns) AS t0, max(ts_ns) AS t1 FROM o WHERE ts_ns BETWEEN {LO_NS} AND {HI_NS}),
g AS (SELECT i, t0 + CAST(floor(CAST(t1 - t0 AS DOUBLE) / 199 * i) AS BIGINT) AS ts_ns FROM f, range(200) r(i)),
c AS (SELECT g.i, g.ts_ns, arg_max(b.block_id, b.block_id) AS block_id FROM g LEFT JOIN b ON g.ts_ns BETWEEN b.b0 AND b.b1 GROUP BY g.i, g.ts_ns),
w AS (SELECT c.i, c.ts_ns, c.block_id, CAST(floor(CASE WHEN b.b1 > b.b0 THEN CAST(c.ts_ns - b.b0 AS DOUBLE) / CAST(b.b1 - b.b0 AS DOUBLE) ELSE 0 END * (b.n - 1) + 0.5) AS BIGINT) AS ordinal FROM c LEFT JOIN b USING (block_id))
SELECT w.i, w.ts_ns, k.value FROM w LEFT JOIN k ON k.block_id = w.block_id AND k.ordinal = w.ordinal""",
)

# blocks


def _memo(f):
    """One table for each session and data folder: several queries read it."""
    kept: dict[tuple[str, str], object] = {}

    @functools.wraps(f)
    def get(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in kept:
            kept[key] = f(spark, sf_dir)
        return kept[key]

    return get


@_memo
def blocked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(B.block_rows(series(spark, sf_dir)).sortWithinPartitions("ts_ns"), "rows")


@_memo
def stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(B.block_stats(blocked_rows(spark, sf_dir), ["value"]), "stats")


@_memo
def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(B.build_blocks(blocked_rows(spark, sf_dir), Options(epsilon=0.5, codecs={"value": "PLA_LINEAR"}), ["value"]), "blocks")


@_memo
def cheb_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(B.encode_blocks(blocked_rows(spark, sf_dir), Options(epsilon=0.5, codecs={"value": "PLA_CHEB"}), ["value"]), "cheb")


_add("block_index", lambda spark, d: blocked_rows(spark, d).select("ts_ns", "pos", "block_id", F.col("ordinal").cast("long").alias("ordinal")), f"WITH {_BLOCKED} SELECT ts_ns, pos, block_id, ordinal FROM k")
_add(
    "block_stats",
    lambda spark, d: stats_table(spark, d).select(
        "block_id", "col", "ts_first", "ts_last", "num_rows", *(F.round(f"stats.{x}", 4).alias(x) for x in ("sum", "min", "max", "sum_sq", "mean", "m2")), F.col("stats.count").alias("count"), F.col("stats.nz_count").alias("nz_count")
    ),
    f"WITH {_BLOCKED} SELECT block_id, 'value' AS col, min(ts_ns) AS ts_first, max(ts_ns) AS ts_last, CAST(count(*) AS INT) AS num_rows, round(sum(value), 4) AS sum, round(min(value), 4) AS min, round(max(value), 4) AS max, round(sum(value * value), 4) AS sum_sq, "
    "round(avg(value), 4) AS mean, round(var_pop(value) * count(value), 4) AS m2, count(value) AS count, count(*) FILTER (value != 0) AS nz_count FROM k GROUP BY block_id",
)


def _value_only(df: DataFrame, kind: str) -> DataFrame:
    return df.select(F.round("value", _DIGITS.get(kind, 6)).alias("value"), "rows_scanned")


for _kind in _AGG_SQL:
    _own = f"SELECT round({_AGG_SQL[_kind]}, {_DIGITS.get(_kind, 6)}) AS value, count(value) AS rows_scanned FROM events"
    _add(f"blocks_{_kind}", lambda spark, d, kind=_kind: _value_only(two_tier.from_blocks(stats_table(spark, d), kind, "value"), kind), _own)
    _add(f"two_tier_range_{_kind}", lambda spark, d, kind=_kind: _value_only(two_tier.two_tier(blocked_rows(spark, d), stats_table(spark, d), kind, "value", LO_NS, HI_NS), kind), f"{_own} WHERE {_RANGE}")

# codecs

_add(
    "dod_encode",
    lambda spark, d: codecs.dod_encode(series(spark, d).select("ts_ns")).select("pos", "ts_ns", "delta", "dod"),
    f"WITH {_ORDERED}, x AS (SELECT pos, ts_ns, ts_ns - lag(ts_ns) OVER (ORDER BY pos) AS delta FROM o) SELECT pos, ts_ns, delta, coalesce(delta - lag(delta) OVER (ORDER BY pos), delta) AS dod FROM x",
)
_add("dod_roundtrip", lambda spark, d: codecs.dod_decode(codecs.dod_encode(series(spark, d).select("ts_ns"))).select("pos", F.col("ts_ns").cast("long").alias("ts_ns")), f"WITH {_ORDERED} SELECT pos, ts_ns FROM o")
_RUNS = f"{_ORDERED}, t AS (SELECT pos, floor(value / 20) AS v FROM o), g AS (SELECT *, pos - row_number() OVER (PARTITION BY v ORDER BY pos) AS island FROM t), q AS (SELECT min(pos) AS start, v AS value, count(*) AS length FROM g GROUP BY v, island)"


def stepped(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).select("ts_ns", F.floor(F.col("value") / 20).cast("double").alias("level"), "event_type")


_add("rle_runs", lambda spark, d: codecs.runs(stepped(spark, d), "level"), f"WITH {_RUNS} SELECT row_number() OVER (ORDER BY start) - 1 AS run, start, value, length FROM q")
_add(
    "rle_runs_text",
    lambda spark, d: codecs.runs(stepped(spark, d), "event_type"),
    f"WITH {_ORDERED}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY event_type ORDER BY pos) AS island FROM o), q AS (SELECT min(pos) AS start, event_type AS value, count(*) AS length FROM g GROUP BY event_type, island) SELECT row_number() OVER (ORDER BY start) - 1 AS run, start, value, length FROM q",
)
_add(
    "rle_stats",
    lambda spark, d: codecs.runs_stats(codecs.runs(stepped(spark, d), "level")).select("count", *(F.round(c, 6).alias(c) for c in ("sum", "mean", "min", "max", "variance"))),
    "SELECT count(*) AS count, round(sum(v), 6) AS sum, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(var_pop(v), 6) AS variance FROM (SELECT floor(value / 20) AS v FROM events)",
)
_add("rle_count_where", lambda spark, d: codecs.runs_count_where(codecs.runs(stepped(spark, d), "level"), ">", 2.0), "SELECT count(*) AS n FROM events WHERE floor(value / 20) > 2")
_add("rle_roundtrip", lambda spark, d: codecs.runs_decode(codecs.runs(stepped(spark, d), "level")), f"WITH {_ORDERED} SELECT pos, floor(value / 20) AS value FROM o")
_add("decimal_detect", lambda spark, d: codecs.decimal_detect(series(spark, d), "value"), "SELECT CAST(min(d) AS INT) AS digits FROM (SELECT d FROM events, range(8) r(d) GROUP BY d HAVING bool_and(abs(round(value * pow(10, d)) / pow(10, d) - value) <= 1e-9 * greatest(1, abs(value))))")
_add("decimal_encode", lambda spark, d: codecs.decimal_encode(series(spark, d), "value", 2), f"WITH {_ORDERED}, x AS (SELECT pos, CAST(round(value * 100) AS BIGINT) AS q FROM o) SELECT pos, q, q - coalesce(lag(q) OVER (ORDER BY pos), 0) AS delta FROM x")
_add("decimal_roundtrip", lambda spark, d: codecs.decimal_decode(codecs.decimal_encode(series(spark, d), "value", 2), 2).select("pos", F.round("value", 6).alias("value")), f"WITH {_ORDERED} SELECT pos, round(value, 6) AS value FROM o")
for _bits in (8, 16):
    _top = (1 << _bits) - 1
    _q = f"{_BLOCKED}, e AS (SELECT block_id, min(value) AS a, max(value) AS b FROM k GROUP BY block_id), q AS (SELECT pos, value, a, b, CAST(CASE WHEN b - a <= 0 THEN 0 ELSE greatest(0, least({_top}, floor((value - a) * {_top} / (b - a) + 0.5))) END AS INT) AS q FROM k JOIN e USING (block_id))"
    _add(f"quant{_bits}", lambda spark, d, bits=_bits: codecs.quant_encode(blocked_rows(spark, d), "value", bits, ["block_id"]).select("pos", "q", F.round("decoded", 6).alias("decoded")), f"WITH {_q} SELECT pos, q, round(a + q * (b - a) / {_top}, 6) AS decoded FROM q")
    _add(
        f"quant{_bits}_within_step",
        lambda spark, d, bits=_bits: codecs.quant_encode(blocked_rows(spark, d), "value", bits, ["block_id"]).agg(F.bool_and(F.abs(F.col("decoded") - F.col("value")) <= F.col("step") / 2 + 1e-9).alias("within"), F.round(F.max(F.abs(F.col("decoded") - F.col("value"))), 6).alias("max_error")),
        f"WITH {_q} SELECT bool_and(abs(a + q * (b - a) / {_top} - value) <= (b - a) / {_top} / 2 + 1e-9) AS within, round(max(abs(a + q * (b - a) / {_top} - value)), 6) AS max_error FROM q",
    )
_add(
    "codec_sizes",
    lambda spark, d: B.encode_blocks(blocked_rows(spark, d), Options(epsilon=0.01), ["value"]).groupBy("col", "codec").agg(F.count("*").alias("n_blocks"), F.bool_and(F.col("n_bytes") < 8 * 4096 + 48).alias("smaller_than_raw")),
    "SELECT 'value' AS col, 'DECIMAL' AS codec, CAST(ceil(count(*) / 4096.0) AS BIGINT) AS n_blocks, TRUE AS smaller_than_raw FROM events",
)

# pieces: invariants, as SQL has no twin of the fit

_add(
    "pla_error_within_epsilon",
    lambda spark, d: block_table(spark, d).groupBy("col", "codec").agg(F.bool_and(F.col("max_error") <= F.col("epsilon") + 1e-9).alias("within"), F.sum(F.expr("aggregate(pieces, 0L, (a, x) -> a + x.length)")).alias("n")),
    "SELECT 'value' AS col, 'PLA_LINEAR' AS codec, TRUE AS within, count(*) AS n FROM events",
)
_add(
    "cheb_error_within_epsilon",
    lambda spark, d: cheb_table(spark, d).groupBy("col", "codec").agg(F.bool_and(F.col("max_error") <= F.col("epsilon") + 1e-9).alias("within"), F.sum(F.expr("aggregate(pieces, 0L, (a, x) -> a + x.length)")).alias("n")),
    "SELECT 'value' AS col, 'PLA_CHEB' AS codec, TRUE AS within, count(*) AS n FROM events",
)


def _decoded_error(table: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        both = algebra.decoded_beside(blocked_rows(spark, d).select("block_id", "ordinal", "value"), algebra.pieces_of(table(spark, d), ["block_id"]), ["block_id"], "approx")
        return both.agg(F.count("*").alias("n"), F.bool_and(F.abs(F.col("approx") - F.col("value")) <= 0.5 + 1e-9).alias("within"))

    return run


_add("pla_decode_within_epsilon", _decoded_error(block_table), "SELECT count(*) AS n, TRUE AS within FROM events")
_add("cheb_decode_within_epsilon", _decoded_error(cheb_table), "SELECT count(*) AS n, TRUE AS within FROM events")


def _moments(table: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """Closed forms agree with the decoded values, and with the rows within the bound."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        pieces = algebra.pieces_of(table(spark, d), ["block_id"])
        got = algebra.pieces_aggregate(pieces)
        back = algebra.pieces_decode(pieces, ["block_id"]).agg(F.avg("value").alias("a"), F.var_pop("value").alias("v"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        rows = blocked_rows(spark, d).agg(F.avg("value").alias("ra"), F.min("value").alias("rlo"), F.max("value").alias("rhi"))
        x = got.join(F.broadcast(back), F.lit(True)).join(F.broadcast(rows), F.lit(True))
        near = lambda a, b, e: F.abs(F.col(a) - F.col(b)) <= e
        return x.select(
            "count", (near("mean", "a", 1e-6) & near("variance", "v", 1e-4) & near("min", "lo", 1e-9) & near("max", "hi", 1e-9)).alias("closed_form_exact"),
            (near("mean", "ra", F.col("epsilon") + 1e-9) & near("min", "rlo", F.col("epsilon") + 1e-9) & near("max", "rhi", F.col("epsilon") + 1e-9)).alias("within_epsilon"),
        )

    return run




def _value_at_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Every position of every block is looked up; a position without an answer is not within."""
    wanted = blocked_rows(spark, d).select("block_id", "ordinal", "value")
    got = algebra.pieces_value_at(algebra.pieces_of(block_table(spark, d), ["block_id"]), wanted.select("block_id", "ordinal"), ["block_id"]).withColumnRenamed("value", "approx")
    near = F.coalesce(F.abs(F.col("approx") - F.col("value")) <= F.col("epsilon") + 1e-9, F.lit(False))
    return wanted.join(got, ["block_id", "ordinal"], "left").agg(F.count("*").alias("n"), F.bool_and(near).alias("within"))


_add("pla_value_at", _value_at_ordinal, "SELECT count(*) AS n, TRUE AS within FROM events")
_add("pla_algebra", _moments(block_table), "SELECT count(*) AS count, TRUE AS closed_form_exact, TRUE AS within_epsilon FROM events")
_add("cheb_algebra", _moments(cheb_table), "SELECT count(*) AS count, TRUE AS closed_form_exact, TRUE AS within_epsilon FROM events")


def _pieces_where(spark: SparkSession, d: str) -> DataFrame:
    pieces = algebra.pieces_of(block_table(spark, d), ["block_id"])
    back = written(algebra.pieces_decode(pieces, ["block_id"]), "decoded")
    got = None
    for name, op in NAMED.items():
        if name == "eq":
            continue
        a = algebra.pieces_where(pieces, op, THRESHOLD)
        b = back.filter(query.predicate(F.col("value"), op, THRESHOLD)).agg(F.count("*").alias("m"), F.sum("value").alias("t"))
        row = a.join(F.broadcast(b), F.lit(True)).select(F.lit(name).alias("op"), (F.col("n") == F.col("m")).alias("same_count"), (F.abs(F.col("sum") - F.col("t")) < 1e-3).alias("same_sum"))
        got = row if got is None else got.unionByName(row)
    return got


_add("pla_predicates", _pieces_where, "SELECT op, TRUE AS same_count, TRUE AS same_sum FROM (VALUES ('gt'), ('gte'), ('lt'), ('lte')) t(op)")

# statistics

_add(
    "autocorr",
    lambda spark, d: stats.autocorrelation(series(spark, d), "value").select(F.round("autocorr", 6).alias("autocorr")),
    f"WITH {_ORDERED}, m AS (SELECT avg(value) AS m FROM o), p AS (SELECT value - m AS a, lead(value) OVER (ORDER BY pos) - m AS b FROM o, m) SELECT round(sum(a * b) / sum(a * a), 6) AS autocorr FROM p",
)
_add(
    "entropy",
    lambda spark, d: stats.entropy(series(spark, d), "value").select(F.round("entropy", 6).alias("entropy")),
    "WITH r AS (SELECT min(value) AS a, max(value) AS b, count(*) AS n FROM events), c AS (SELECT floor((value - a) * 255 / (b - a)) AS bin, count(*) AS c, any_value(n) AS n FROM events, r GROUP BY 1) SELECT round(-sum(c / n * log2(c / n)), 6) AS entropy FROM c",
)
_add(
    "curvature",
    lambda spark, d: stats.curvature(series(spark, d), "value").select(F.round("curvature", 6).alias("curvature")),
    f"WITH {_ORDERED}, p AS (SELECT value, lead(value, 2) OVER (ORDER BY pos) - 2 * lead(value) OVER (ORDER BY pos) + value AS s FROM o) SELECT round(var_pop(s) / var_pop(value), 6) AS curvature FROM p",
)
_add("unique_capped", lambda spark, d: stats.unique_capped(series(spark, d), "value"), "SELECT least(count(DISTINCT value), 65) AS n_unique FROM events")
_add("unique_capped_by_type", lambda spark, d: stats.unique_capped(series(spark, d), "user_id", 1000, ["event_type"]), "SELECT event_type, least(count(DISTINCT user_id), 1001) AS n_unique FROM events GROUP BY event_type")
_add(
    "discount_quantity_unique",
    lambda spark, d: stats.unique_capped(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", 64, ["l_returnflag"]),
    "SELECT l_returnflag, least(count(DISTINCT l_quantity), 65) AS n_unique FROM lineitem GROUP BY l_returnflag",
)

_add("exact_sum", lambda spark, d: stats.exact_sum(series(spark, d), "value").select(F.round("sum", 6).alias("sum")), "SELECT round(fsum(value), 6) AS sum FROM events")
_add("exact_sum_by_type", lambda spark, d: stats.exact_sum(series(spark, d), "value", ["event_type"]).select("event_type", F.round("sum", 6).alias("sum")), "SELECT event_type, round(fsum(value), 6) AS sum FROM events GROUP BY event_type")

# scalar functions

_ZIG = "WITH x AS (SELECT event_id, user_id - 7 * event_id AS n FROM events), z AS (SELECT event_id, n, CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END AS z FROM x)"


def _integers(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", (F.col("user_id") - 7 * F.col("event_id")).alias("n"))


_add(
    "zigzag_varint",
    lambda spark, d: _integers(spark, d).withColumn("z", scalar.zigzag(F.col("n"))).select("event_id", "z", scalar.unzigzag(F.col("z")).alias("n"), scalar.varint_size(F.col("z")).alias("size")),
    f"{_ZIG} SELECT event_id, z, n, CAST(CASE WHEN z < 128 THEN 1 WHEN z < 16384 THEN 2 WHEN z < 2097152 THEN 3 ELSE 4 END AS INT) AS size FROM z",
)
_add(
    "period_keys",
    lambda spark, d: series(spark, d).select("ts_ns", *[scalar.period_key(F.col("ts_ns"), p).alias(p) for p in ("hour", "day", "month")], scalar.period_key(-F.col("ts_ns"), "day").alias("day_before")),
    f"SELECT t AS ts_ns, t // 3600000000000 AS hour, t // 86400000000000 AS day, t // 2592000000000000 AS month, -(t // 86400000000000) AS day_before FROM (SELECT {_NS} AS t FROM events)",
)
_add(
    "cheb3_eval",
    lambda spark, d: events(spark, d).select("event_id", F.round(scalar.cheb3_eval([F.lit(1.0), F.lit(0.5), F.lit(-0.25), F.lit(2.0)], F.col("value") / 1000), 9).alias("y")),
    "SELECT event_id, round(1 + 0.5 * u - 0.25 * (2 * u * u - 1) + 2 * (4 * u * u * u - 3 * u), 9) AS y FROM (SELECT event_id, value / 1000 AS u FROM events)",
)
_add(
    "auto_epsilon",
    lambda spark, d: events(spark, d).groupBy("event_type").agg(F.round(scalar.auto_epsilon(F.min("value"), F.max("value")), 9).alias("epsilon")),
    "SELECT event_type, round(CASE WHEN max(value) - min(value) < 1e-12 THEN 1e-6 ELSE 0.001 * (max(value) - min(value)) END, 9) AS epsilon FROM events GROUP BY event_type",
)
_add("crc32c_check", lambda spark, d: spark.range(1).select(scalar.crc32c(F.lit("123456789").cast("binary")).alias("crc")), "SELECT CAST(3808858755 AS BIGINT) AS crc")

# stores, partitions, tiers


@_memo
def store(spark: SparkSession, sf_dir: str) -> SeriesStore:
    """Events in two batches, split at a time."""
    s = SeriesStore(spark, path_for(spark, "store"), "day", Options(epsilon=0.01))
    rows = series(spark, sf_dir).select("ts_ns", "value")
    s.append(rows.filter(F.col("ts_ns") < CUT_NS))
    s.append(rows.filter(F.col("ts_ns") >= CUT_NS))
    return s


@_memo
def compacted(spark: SparkSession, sf_dir: str) -> SeriesStore:
    s = SeriesStore(spark, path_for(spark, "compacted"), "day", Options(epsilon=0.01))
    rows = series(spark, sf_dir).select("ts_ns", "value")
    s.append(rows.filter(F.col("ts_ns") < CUT_NS))
    s.append(rows.filter(F.col("ts_ns") >= CUT_NS))
    s.compact()
    return s


@_memo
def tiered(spark: SparkSession, sf_dir: str) -> tier.TieredSeries:
    """Three pushes into a warm tier that holds a few blocks, so that the oldest has gone to the cold store."""
    rows = series(spark, sf_dir).select("ts_ns", "value")
    ends = [None, LO_NS, CUT_NS, None]
    t = tier.TieredSeries(spark, path_for(spark, "tiered"), warm_blocks=2)
    for a, b in zip(ends, ends[1:], strict=False):
        t.push(rows.filter((F.col("ts_ns") >= a if a else F.lit(True)) & (F.col("ts_ns") < b if b else F.lit(True))))
    return t


_add(
    "period_partition_stats",
    lambda spark, d: store(spark, d).manifest().groupBy("period_key", "col").agg(F.min("ts_first").alias("ts_first"), F.max("ts_last").alias("ts_last"), F.sum("num_rows").alias("num_rows"), F.min("stats.min").alias("min_value"), F.max("stats.max").alias("max_value"), F.round(F.sum("stats.sum"), 4).alias("sum_value")),
    f"SELECT t // 86400000000000 AS period_key, 'value' AS col, min(t) AS ts_first, max(t) AS ts_last, CAST(count(*) AS BIGINT) AS num_rows, min(value) AS min_value, max(value) AS max_value, round(sum(value), 4) AS sum_value FROM (SELECT {_NS} AS t, value FROM events) GROUP BY 1",
)
for _kind in _AGG_SQL:
    _own = f"SELECT round({_AGG_SQL[_kind]}, {_DIGITS.get(_kind, 6)}) AS value, count(value) AS rows_scanned FROM events"
    _add(f"manifest_{_kind}", lambda spark, d, kind=_kind: _value_only(store(spark, d).manifest_query(kind, "value", LO_NS, HI_NS), kind), f"{_own} WHERE {_RANGE}")
    _add(f"partition_{_kind}", lambda spark, d, kind=_kind: _value_only(query.aggregate(store(spark, d).rows(LO_NS, HI_NS), kind, "value", LO_NS, HI_NS), kind), f"{_own} WHERE {_RANGE}")
    _add(f"store_query_{_kind}", lambda spark, d, kind=_kind: _value_only(store(spark, d).query(kind, "value", LO_NS, HI_NS), kind), f"{_own} WHERE {_RANGE}")
    _add(f"union_warm_cold_{_kind}", lambda spark, d, kind=_kind: _value_only(tiered(spark, d).query(kind, "value"), kind), _own)
for _name, _op in NAMED.items():
    _sign, _k = ("=", 6.55) if _op == "==" else (_op, THRESHOLD)
    _add(
        f"store_mean_where_{_name}",
        lambda spark, d, where=(_op, _k): _value_only(store(spark, d).query("mean", "value", LO_NS, HI_NS, where), "mean"),
        f"SELECT round(avg(value), 6) AS value, count(value) AS rows_scanned FROM events WHERE {_RANGE} AND value {_sign} {_k}",
    )
_add("compaction_equivalence", lambda spark, d: compacted(spark, d).rows().select("ts_ns", "value"), f"SELECT {_NS} AS ts_ns, value FROM events")
_add("compaction_batches", lambda spark, d: compacted(spark, d).manifest().agg(F.count_distinct("batch").alias("batches"), F.sum("num_rows").alias("num_rows")), "SELECT CAST(1 AS BIGINT) AS batches, count(*) AS num_rows FROM events")
_add(
    "inspect",
    lambda spark, d: store(spark, d).inspect().select("col", F.concat_ws("+", "codecs").alias("codecs"), "num_rows", "ts_first", "ts_last"),
    f"SELECT 'value' AS col, 'DECIMAL' AS codecs, CAST(count(*) AS BIGINT) AS num_rows, min({_NS}) AS ts_first, max({_NS}) AS ts_last FROM events",
)
_add("verify", lambda spark, d: store(spark, d).verify().agg(F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("corrupt")), f"SELECT CAST(sum(ceil(n / 4096.0)) AS BIGINT) AS checked, CAST(0 AS BIGINT) AS corrupt FROM (SELECT t // 86400000000000 AS day, t < {CUT_NS} AS early, count(*) AS n FROM (SELECT {_NS} AS t FROM events) GROUP BY ALL)")
_add(
    "warm_info",
    lambda spark, d: spark.createDataFrame([tiered(spark, d).info()], "blocks long, bytes long, rows long, oldest long, newest long").select("blocks", "rows", "oldest", "newest", (F.col("bytes") > 0).alias("has_bytes")),
    f"""WITH g AS (SELECT CASE WHEN t < {LO_NS} THEN 0 WHEN t < {CUT_NS} THEN 1 ELSE 2 END AS seg, count(*) AS n, min(t) AS a, max(t) AS b, CAST(ceil(count(*) / 4096.0) AS BIGINT) AS k FROM (SELECT {_NS} AS t FROM events) GROUP BY 1),
w AS (SELECT *, sum(k) OVER (ORDER BY seg DESC) AS upto FROM g)
SELECT CAST(sum(k) AS BIGINT) AS blocks, CAST(sum(n) AS BIGINT) AS "rows", min(a) AS oldest, max(b) AS newest, TRUE AS has_bytes FROM w WHERE upto <= 2 OR seg = (SELECT max(seg) FROM g)""",
)


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = path_for(spark, "csv")
    series(spark, sf_dir).select("ts_ns", "value").coalesce(1).write.option("header", True).csv(path)
    return read_csv(spark, path)


_add("csv_roundtrip", _csv, f"SELECT {_NS} AS ts_ns, value FROM events")


def _locf(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = series(spark, sf_dir).select("ts_ns", F.when(F.col("value") < THRESHOLD, F.col("value")).alias("value"))
    return ordered.running_last(ordered.positions(gaps, ["ts_ns"]), "value", "filled").select("pos", "ts_ns", "filled")


_add("locf_fill", _locf, f"WITH {_ORDERED} SELECT pos, ts_ns, last_value(CASE WHEN value < {THRESHOLD} THEN value END IGNORE NULLS) OVER (ORDER BY pos) AS filled FROM o")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(events(spark, sf_dir).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SeriesStore(spark, path_for(spark, "streamed"), "day", Options(epsilon=0.01))
    from ..sources.readers import micros

    source = _stream(spark, sf_dir)
    rows = source.select((micros("ts", source.schema["ts"].dataType) * 1000).alias("ts_ns"), "value")
    tier.ingest(rows, s, path_for(spark, "checkpoint")).awaitTermination()
    return s.rows().groupBy("period_key").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("sum_value"))


_add("stream_ingest", _stream_ingest, f"SELECT {_NS} // 86400000000000 AS period_key, count(*) AS n, round(sum(value), 4) AS sum_value FROM events GROUP BY 1")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("event_time", F.col("ts"))
    got = tier.windowed(rows, "value", "6 hours", by=["event_type"])
    return got.select("window_start", "event_type", "n", F.round("mean", 6).alias("mean"), "min", "max")


_add("window_stats", _windows, "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
