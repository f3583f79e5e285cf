"""The engine against numpy brute force: series shapes, ranges, defects that must not come back."""

import io
import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideblock import cli
from tideblock.functions import algebra, scalar, stats
from tideblock.model import CodecError, EngineError, Options, UnknownColumn, open_ends, resolve, status_text, value_of
from tideblock.operators import blocks as B
from tideblock.operators import codecs, ordered, pla, query, routing
from tideblock.plans import two_tier
from tideblock.scratch import path_for, written
from tideblock.sources.readers import read_csv, read_csv_carried, union_series
from tideblock.sources.store import SeriesStore, upsert
from tideblock.streaming import tier


def series(spark, values, ts=None, **more):
    values = np.asarray(values, float)
    ts = range(len(values)) if ts is None else ts
    return spark.createDataFrame([(int(t), float(v)) for t, v in zip(ts, values, strict=True)], "ts_ns long, v double")


def signals(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    i = np.arange(n)
    spike = np.full(n, 20.0)
    spike[500:510] = 100
    return {
        "ramp": i * 100 / n, "sine": 22 + 5 * np.sin(0.002 * i), "spike": spike, "falling": 1000 - 0.5 * i, "zigzag": 50.0 * (-1.0) ** i, "plateau": np.where(i // 700 % 2, 90.0, 10.0), "noise": rng.uniform(0, 1, n), "walk": np.round(np.cumsum(rng.normal(size=n)), 1),
    }


@pytest.mark.parametrize("epsilon", [0.001, 0.01, 0.1, 1.0, 0.0])
@pytest.mark.parametrize("cheb", [0, 32, 10**9])
def test_pieces_stay_within_epsilon(epsilon, cheb):
    for name, v in signals().items():
        bound = pla.effective_epsilon(v, epsilon)
        pieces = pla.fit(v, epsilon, cheb)
        assert sum(p[1] for p in pieces) == len(v) and [p[0] for p in pieces] == np.cumsum([0, *(p[1] for p in pieces)])[:-1].tolist()
        approx = pla.decode(pieces)
        assert np.abs(approx - v).max() <= bound * (1 + 1e-9) + 1e-12, name
        assert np.abs(approx + pla.residuals(v, pieces) / 1e6 - v).max() <= 5.1e-7


def test_straight_pieces_are_as_long_as_can_be():
    v = signals()["sine"]
    for start, length, _, _ in pla.fit(v, 0.05)[:-1]:
        t = np.arange(1, length + 1)
        d = v[start + 1 : start + length + 1] - v[start]
        assert ((d - 0.05) / t).max() > ((d + 0.05) / t).min()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=200), st.sampled_from([1e-3, 0.1, 10.0]), st.sampled_from([0, 20, 1000]))
def test_any_values_stay_within_epsilon(values, epsilon, cheb):
    v = np.array(values)
    assert np.abs(pla.decode(pla.fit(v, epsilon, cheb)) - v).max() <= epsilon + 1e-9 * np.abs(v).max()


def test_routes():
    s = signals()
    assert routing.route(np.arange(1000) // 100, 0.01) == "RLE"
    assert routing.route(s["ramp"], 0.01) in ("PLA_LINEAR", "PLA_CHEB")
    assert routing.route(s["noise"], 0.001) == "QUANT16"
    assert routing.route(s["noise"], 1e-9) == "RAW_STATS"
    assert routing.route(np.round(s["noise"] * 50, 1) + np.arange(3000) % 7, 0.01) in ("DECIMAL",)
    assert routing.decimal_digits(np.array([20.1, 20.3, 20.5, 20.4])) == 1
    assert routing.decimal_digits(np.array([np.pi, np.e, np.sqrt(2)])) is None
    assert not routing.holds(np.array([0.0, 1e9]), "QUANT16", 0.01)


@pytest.mark.parametrize("op", [">", ">=", "<", "<=", "=="])
def test_closed_forms_of_straight_pieces(spark, op):
    rng = np.random.default_rng(1)
    rows = [(float(rng.choice([0, 0.5, -0.25, 1, -3, 0.1])), float(rng.integers(-20, 20)), int(rng.integers(1, 60)), float(t)) for t in (0, 5, 5.5, -7) for _ in range(60)] + [(1.0, 0.0, 10, 5.0)]
    for t in {r[3] for r in rows}:
        own = [r for r in rows if r[3] == t]
        df = spark.createDataFrame([r[:3] for r in own], "s double, o double, n int").coalesce(1)
        a, b = algebra.linear_where(F.col("s"), F.col("o"), F.col("n"), op, t)
        for r in df.select("*", a.alias("a"), b.alias("b")).collect():
            v = r.o + r.s * np.arange(r.n)
            hit = v[{">": v > t, ">=": v >= t, "<": v < t, "<=": v <= t, "==": v == t}[op]]
            assert r.b == len(hit) and abs(r.a - hit.sum()) < 1e-6, (r, op, t)


def test_closed_forms_of_cubic_pieces(spark):
    rng = np.random.default_rng(2)
    rows = [([float(x) for x in rng.normal(size=4) * 5], n) for n in [1, 2, 3, 4, 5, 8, 33, 128, 400] for _ in range(4)]
    df = spark.createDataFrame(rows, "c array<double>, n int").coalesce(1)
    c, n = [F.col("c")[i] for i in range(4)], F.col("n")
    low, high = algebra.cheb_min_max(c, n)
    wh = algebra.cheb_where(c, n, ">", 1.0)
    got = df.select("*", algebra.cheb_mean(c, n).alias("mean"), algebra.cheb_sum(c, n).alias("sum"), algebra.cheb_variance(c, n).alias("var"), low.alias("low"), high.alias("high"), algebra.cheb_partial_sum(c, n, F.lit(0), F.least(n - 1, F.lit(2))).alias("part"), wh[0].alias("ws"), wh[1].alias("wn")).collect()
    for r in got:
        v = pla.piece_values((0, r.n, pla.CHEB, r.c)) if r.n > 1 else np.polynomial.chebyshev.chebval([-1.0], r.c)
        assert np.allclose([r["mean"], r["sum"], r["var"], r.low, r.high, r.part, r.ws, r.wn], [v.mean(), v.sum(), v.var(), v.min(), v.max(), v[:3].sum(), v[v > 1].sum(), (v > 1).sum()], atol=1e-7), r


RANGES = [(None, None), (1000, 1999), (0, 0), (-5, 10), (4095, 4096), (None, 5000), (20_000, 30_000), (100, 50)]


def test_two_tiers_agree_with_rows_and_numpy(spark):
    v = np.sin(np.arange(10_000) * 0.01) * 10 + np.arange(10_000) * 0.5
    df = series(spark, v)
    rows = written(B.block_rows(df), "t")
    table = written(B.block_stats(rows, ["v"]), "t")
    assert table.count() == 3
    brute = {"mean": np.mean, "sum": np.sum, "min": np.min, "max": np.max, "variance": np.var, "count": len}
    for a, b in RANGES:
        own = v[max(0, a if a is not None else 0) : (b if b is not None else 10_000) + 1] if (a or 0) <= (b if b is not None else 10_000) else v[:0]
        for kind, f in brute.items():
            got = [query.aggregate(df, kind, "v", a, b).first(), two_tier.two_tier(rows, table, kind, "v", a, b).first()]
            for r in got:
                assert r.rows_scanned == len(own) and r.error_bound == 0
                want = f(own) if len(own) else (0 if kind == "count" else None)
                assert r.value == want if want is None else np.isclose(r.value, want), (kind, a, b)
    full = two_tier.two_tier(rows, table, "mean", "v").first()
    assert full.pct_algebraic == 100 and full.pct_data_read == 0
    part = two_tier.two_tier(rows, table, "mean", "v", 1000, 9000).first()
    assert 40 < part.pct_algebraic < 60


def test_two_tiers_with_keys_and_many_edges(spark, monkeypatch):
    df = spark.createDataFrame([(f"s{k}", i * (k + 1), float(i % 97) if i % 11 else None) for k in range(5) for i in range(700)], "series string, ts_ns long, v double")
    rows = written(B.block_rows(df, Options(block_rows=100), ["series"]), "t")
    table = written(B.block_stats(rows, ["v"], ["series"]), "t")
    for most in (64, 1):
        monkeypatch.setattr(two_tier, "MOST_FENCES", most)
        for kind in ("mean", "variance", "count"):
            want = {r.series: r for r in query.aggregate(df, kind, "v", 150, 1333, by=["series"]).collect()}
            got = {r.series: r for r in two_tier.two_tier(rows, table, kind, "v", 150, 1333, by=["series"]).collect()}
            assert set(got) == set(want)
            assert all(np.isclose(got[k].value, want[k].value) and got[k].rows_scanned == want[k].rows_scanned for k in got)


def test_scan_reaches_the_files(spark):
    path = path_for(spark, "plan")
    series(spark, np.arange(1000)).withColumn("w", F.col("v")).write.parquet(path)
    plan = query.aggregate(spark.read.parquet(path), "mean", "v", 10, 20)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts_ns,10)" in plan and "LessThanOrEqual(ts_ns,20)" in plan and "w:double" not in plan.split("ReadSchema")[1]


def test_predicates_on_exact_thresholds(spark):
    df = series(spark, np.arange(10))
    want = {">": 4, ">=": 5, "<": 5, "<=": 6, "==": 1}
    for op, n in want.items():
        assert query.count_where(df, "v", op, 5.0).first().value == n
    assert query.mean_where(df, "v", ">", 5.0, 0, 7).first().value == 6.5
    assert query.mean_where(df, "v", ">", 99.0).first().value is None
    with pytest.raises(EngineError):
        query.count_where(df, "v", "!=", 1.0)


def test_nulls_nan_and_infinity_take_no_part(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (1, float("nan"), "a"), (2, None, "a"), (3, float("inf"), "a"), (4, 3.0, "a"), (None, 100.0, "a")], "ts_ns long, v double, s string")
    got = query.mean(df, "v").first()
    assert (got.value, got.rows_scanned) == (2.0, 2) and query.max_(df, "v").first().value == 3.0
    assert query.count(df).first().value == 5
    for bad in ("missing", "s"):
        with pytest.raises(UnknownColumn):
            query.mean(df, bad)
    with pytest.raises(UnknownColumn):
        resolve(df, ["nope"])
    assert resolve(df, None) == ["v"] and open_ends(0, 5) == (None, 5) and status_text("corrupt") and issubclass(CodecError, EngineError)


def test_value_at_and_many_probes(spark, monkeypatch):
    ts = [0, 5, 10, 250, 255, 256, 300, 9000]
    df = series(spark, np.arange(len(ts)) * 10.0, ts)
    assert [tuple(r) for r in query.value_at(df, 6, ["v"]).collect()] == [(10, 20.0)]
    assert query.value_at(df, 6, ["v"], exact=True).count() == 0 and query.value_at(df, 6, ["v"], tolerance=3).count() == 0
    probes = spark.createDataFrame([(p,) for p in [-5, 0, 1, 5, 251, 256, 257, 301, 9000, 9001]], "probe_ns long")
    for bucket in (1 << 15, 1, 3):
        monkeypatch.setattr(ordered, "BUCKET", bucket)
        got = {r.probe_ns: r.ts_ns for r in query.values_at(df, probes, ["v"]).collect()}
        assert got == {p: min((t for t in ts if t >= p), default=None) for p in got} and len(got) == 10
    near = {r.probe_ns: r.v for r in query.values_at(df, probes, ["v"], tolerance=4).collect()}
    assert near[1] == 10.0 and near[257] is None and near[-5] is None
    assert {r.ts_ns for r in query.values_at(df, probes, exact=True).collect()} == {None, 0, 5, 256, 9000}


def test_many_probes_in_a_burst(spark, monkeypatch):
    """Nearly all rows within one microsecond, keys with and without rows, ties."""
    monkeypatch.setattr(ordered, "BUCKET", 64)
    rng = np.random.default_rng(5)
    rows = [(k, int(t), i, float(i)) for k in ("a", "b", None) for i, t in enumerate([*rng.integers(10**6, 10**6 + 300, 700), 0, 10**12])]
    asked = [(k, int(p)) for k in ("a", "b", None, "none") for p in [*rng.integers(10**6 - 5, 10**6 + 310, 120), -1, 10**12 + 1]]
    df, probes = spark.createDataFrame(rows, "k string, ts_ns long, n long, v double"), spark.createDataFrame(asked, "k string, probe_ns long")
    got = sorted((str(r.k), r.probe_ns, r.ts_ns, r.v) for r in query.values_at(df, probes, ["v"], by=["k"], tie=["n"]).collect())
    first = {(k, p): min(((t, n, v) for o, t, n, v in rows if o == k and t >= p), default=(None, None, None)) for k, p in asked}
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(((str(k), p, first[k, p][0], first[k, p][2]) for k, p in asked), key=key)


def test_bounds_reach_the_scan(spark, small, tmp_path):
    from tideblock.sources.readers import read_series

    at = 1_704_412_800_000_000_000
    plan = query.value_at(read_series(spark, f"{small}/events.parquet", "ts", t_from=at), at, ["value"])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan
    spark.createDataFrame([(i, float(i)) for i in range(10)], "s long, v double").selectExpr("s", "v", "timestamp_micros(s) AS z").write.parquet(str(tmp_path / "t"))
    for ts, unit in (("s", 1000), ("z", 1)):
        for a, b in ((2500, 6999), (3000, 7000), (None, 0), (8001, None)):
            own = [r.v for r in read_series(spark, str(tmp_path / "t"), ts, unit, a, b).collect()]
            assert sorted(own) == [i for i in range(10) if (a is None or 1000 * i >= a) and (b is None or 1000 * i <= b)]


def test_downsample(spark):
    df = series(spark, np.arange(1000))
    got = query.downsample(df, "v", 11).orderBy("i").collect()
    assert [r.ts_ns for r in got] == [int(99.9 * i) for i in range(11)] and all(abs(r.value - r.ts_ns) <= 1 for r in got)
    assert [tuple(r) for r in query.downsample(df, "v", 1).collect()] == [(0, 0, 0.0)]
    assert query.downsample(df, "v", 5, 5000, 6000).count() == 0
    ts = [*range(0, 100), *range(1000, 1100)]
    gap = query.downsample(series(spark, np.arange(200), ts), "v", 12, block_rows=100).orderBy("i").collect()
    assert [r.value is None for r in gap] == [not (t <= 99 or t >= 1000) for t in (r.ts_ns for r in gap)]
    start = query.downsample(series(spark, np.arange(3), [0, 4096, 8192]), "v", 3, block_rows=1).orderBy("i").collect()
    assert [r.ts_ns for r in start] == [0, 4096, 8192]


def test_ordered_operations_over_bucket_edges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET", 7)
    rng = np.random.default_rng(3)
    v = [None if rng.random() < 0.4 else float(x) for x in rng.integers(0, 5, 100)]
    df = spark.createDataFrame([("ab"[i % 2], i, x) for i, x in enumerate(v)], "k string, ts_ns long, v double").repartition(5)
    placed = written(ordered.positions(df, ["ts_ns"], ["k"]), "t")
    near = ordered.neighbours(placed, {"a": ("ts_ns", -2), "b": ("ts_ns", 1)}, ["k"])
    total = ordered.running_sum(near, F.coalesce("v", F.lit(0.0)), "s", ["k"])
    rows = ordered.running_last(total, "v", "l", ["k"]).collect()
    for key, odd in (("a", 0), ("b", 1)):
        own = sorted((r for r in rows if r.k == key), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(50)) and [r.ts_ns for r in own] == list(range(odd, 100, 2))
        last, s = None, 0.0
        for i, r in enumerate(own):
            last = r.v if r.v is not None else last
            s += r.v or 0.0
            assert (r.a, r.b, r.s, r.l) == (own[i - 2].ts_ns if i > 1 else None, own[i + 1].ts_ns if i < 49 else None, s, last)


def test_codecs_come_back(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET", 16)
    for ts in ([0, 100, 350, 1000, 1001, 9999], [-5000, -4000, -3000, -2000], list(np.cumsum(np.random.default_rng(4).integers(0, 1 << 40, 400))), [7]):
        df = spark.createDataFrame([(int(t),) for t in ts], "ts_ns long")
        back = codecs.dod_decode(codecs.dod_encode(df)).orderBy("pos").collect()
        assert [int(r.ts_ns) for r in back] == sorted(int(t) for t in ts)
    v = np.repeat(np.random.default_rng(5).integers(0, 4, 60), np.random.default_rng(6).integers(1, 9, 60)).astype(float)
    df = series(spark, v)
    runs = written(codecs.runs(df, "v"), "t")
    assert [r.value for r in codecs.runs_decode(runs).orderBy("pos").collect()] == v.tolist()
    assert runs.count() == 1 + np.count_nonzero(np.diff(v))
    s = codecs.runs_stats(runs).first()
    assert np.allclose([s["count"], s["sum"], s["mean"], s["min"], s["max"], s["variance"]], [len(v), v.sum(), v.mean(), v.min(), v.max(), v.var()])
    assert codecs.runs_count_where(runs, ">=", 2.0).first().n == (v >= 2).sum()
    w = np.round(np.random.default_rng(7).normal(size=200) * 1e9, 2)
    df = series(spark, w)
    assert codecs.decimal_detect(df, "v").first().digits == routing.decimal_digits(w) == 2
    assert codecs.decimal_detect(series(spark, [np.pi]), "v").first().digits is None
    assert np.allclose([r.value for r in codecs.decimal_decode(codecs.decimal_encode(df, "v", 2), 2).orderBy("pos").collect()], w, rtol=0, atol=1e-6)


def test_codec_choice_is_checked_in_every_block(spark):
    v = np.concatenate((np.random.default_rng(8).uniform(0, 1, 4096), np.random.default_rng(9).uniform(0, 1e9, 4096)))
    rows = B.block_rows(series(spark, v))
    got = {r.block_id: r for r in B.encode_blocks(rows, Options(epsilon=0.001, codecs={"v": "QUANT16"})).collect()}
    assert got[0].codec == "QUANT16" and got[0].max_error <= 0.001 and got[1].codec == "RAW_STATS" and got[1].max_error == 0
    skipped = B.encode_blocks(rows, Options(epsilon=0.5, skip=frozenset({"v"}))).collect()
    assert {r.codec for r in skipped} == {"RAW_STATS"}
    auto = B.encode_blocks(B.block_rows(series(spark, np.arange(5000) ** 1.5)), Options(epsilon=0.0, codecs={"v": "PLA_CHEB"})).collect()
    assert all(0 < r.epsilon and r.max_error <= r.epsilon * (1 + 1e-9) for r in auto)


@pytest.mark.parametrize("name,floor", [("ramp", 3.0), ("slow_sine", 1.5), ("iot", 1.4), ("steps", 2.0)])
def test_compression_floors(name, floor):
    i = np.arange(20_000)
    rng = np.random.default_rng(10)
    v = {"ramp": i * 1.0, "slow_sine": 20 + 5 * np.sin(0.0005 * i), "iot": np.round(np.clip(22 + np.cumsum(rng.uniform(-0.1, 0.1, len(i))), 20, 26), 1), "steps": np.where(i // 500 % 2, 100.0, 0.0)}[name]
    size = 0
    for s in range(0, len(v), 4096):
        own = v[s : s + 4096]
        codec = routing.route(own, 0.01)
        pieces = pla.fit(own, 0.01, 32 if codec == "PLA_LINEAR" else len(own) + 1) if codec.startswith("PLA") else None
        size += routing.encoded_bytes(own, codec, pieces)
    assert 8 * len(v) / size > floor


def test_statistics(spark):
    rng = np.random.default_rng(11)
    for v in (np.arange(500.0), rng.normal(size=500), np.full(50, 3.0), np.array([1.0])):
        df = series(spark, v)
        flat = len(v) < 2 or v.var() == 0
        d = v - v.mean()
        a, c, e = stats.autocorrelation(df, "v").first(), stats.curvature(df, "v").first(), stats.entropy(df, "v").first()
        assert a.autocorr is None if flat else np.isclose(a.autocorr, (d[:-1] * d[1:]).sum() / (d * d).sum())
        assert c.curvature is None if flat or len(v) < 3 else np.isclose(c.curvature, np.diff(v, 2).var() / v.var())
        if not flat:
            n = np.bincount(((v - v.min()) * 255 / np.ptp(v)).astype(int))
            p = n[n > 0] / len(v)
            assert np.isclose(e.entropy, -(p * np.log2(p)).sum())
        assert stats.unique_capped(df, "v").first().n_unique == min(65, len(set(v)))


def test_scalars(spark):
    values = [0, 1, -1, 63, 64, -64, -65, 2**31, -(2**31), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(x,) for x in values], "n long").coalesce(1).withColumn("z", scalar.zigzag(F.col("n")))
    for r in df.select("n", "z", scalar.unzigzag(F.col("z")).alias("u"), scalar.varint_size(F.col("z")).alias("size"), scalar.varint(F.col("z")).alias("b")).collect():
        assert r.u == r.n and r.z % (1 << 64) == (2 * r.n if r.n >= 0 else -2 * r.n - 1)
        assert len(r.b) == r["size"] and scalar.read_varint(bytes(r.b)) == (r.z % (1 << 64), len(r.b))
    with pytest.raises(EngineError):
        scalar.read_varint(b"\x80\x80")
    assert scalar.crc32c_bytes(b"123456789") == 0xE3069283 == scalar.crc32c_bytes(b"6789", scalar.crc32c_bytes(b"12345"))
    data = np.arange(24, dtype=np.uint8).tobytes()
    assert scalar.unshuffle_bytes(scalar.shuffle_bytes(data)) == data
    keys = spark.createDataFrame([(t,) for t in (-1, 0, 86_399_999_999_999, -86_400_000_000_000, 2**63 - 1)], "t long").select("t", scalar.period_key(F.col("t"), "day").alias("d")).collect()
    assert {r.t: r.d for r in keys} == {-1: 0, 0: 0, 86_399_999_999_999: 0, -86_400_000_000_000: -1, 2**63 - 1: 106_751}
    c = scalar.linear_to_cheb(F.lit(2.0), F.lit(1.0), F.lit(5))
    line = spark.range(1).select(*[scalar.cheb3_eval(c, F.lit(-1.0 + 0.5 * j)).alias(str(j)) for j in range(5)]).first()
    assert list(line) == [1.0, 3.0, 5.0, 7.0, 9.0]


def test_exact_sum_and_reports(spark, tmp_path):
    from tideblock.sources import reports

    v = [1e16, 1.0, -1e16, 1e-8] * 500 + [0.1] * 10
    df = spark.createDataFrame([("ab"[i % 2], x) for i, x in enumerate(v)], "k string, v double").repartition(7)
    import math

    assert stats.exact_sum(df, "v").first()["sum"] == math.fsum(v)
    assert {r.k: r["sum"] for r in stats.exact_sum(df, "v", ["k"]).collect()} == {"a": math.fsum(v[::2]), "b": math.fsum(v[1::2])}
    assert stats.exact_sum(df.limit(0), "v").first()["sum"] is None
    small = spark.createDataFrame([(1, 0.5, "x|y"), (None, 2.0, "z,z")], "a int, b double, c string").coalesce(1)
    assert reports.csv_text(small) == 'a,b,c\n1,0.5,x|y\n,2.0,"z,z"\n'
    assert reports.markdown(small) == "| a | b | c |\n| - | - | - |\n| 1 | 0.5 | x\\|y |\n|  | 2 | z,z |\n"
    reports.write_csv(small, f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == 2


def test_csv_sources(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("ts,a,b\n1,1.5,2\n\nx,1,1\n2,3\n3,,5\n4,6,seven\n5,7,8,9\n")
    url = f"file://{p}"
    assert sorted(map(tuple, read_csv(spark, url).collect())) == [(1, 1.5, 2.0), (5, 7.0, 8.0)]
    assert sorted(map(tuple, read_csv(spark, url, "zero").collect())) == [(1, 1.5, 2.0), (3, 0.0, 5.0), (4, 6.0, 0.0), (5, 7.0, 8.0)]
    q = tmp_path / "b.csv"
    q.write_text("d;x;y\nmonday;1;2\ntuesday;?;3\n\nw;NA;\nt;4;nan\n")
    assert [tuple(r) for r in read_csv_carried(spark, f"file://{q}").orderBy("row").collect()] == [(0, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 3.0), (3, 4.0, 3.0)]


DAY = 86_400_000_000_000


def test_store_rollover_manifest_compaction_verify(spark):
    s = SeriesStore(spark, path_for(spark, "store"), "day", Options(epsilon=0.5), max_rows_per_file=150)
    rows = [(d * DAY + i * 1_000_000, 1.0 + 0.01 * i) for d in (10, 11, 12) for i in range(200)]
    df = spark.createDataFrame(rows, "ts_ns long, x double")
    s.append(df.filter(F.col("ts_ns") < 12 * DAY))
    again = SeriesStore(spark, s.path, "day", Options(epsilon=0.5))  # a reopened store goes on
    again.append(df.filter(F.col("ts_ns") >= 12 * DAY))
    late = spark.createDataFrame([(10 * DAY + 5, 77.0)], "ts_ns long, x double")
    again.append(late)
    assert s.rows().count() == 601 and s.num_parts() >= 6
    v = np.array([x for _, x in rows] + [77.0])
    t = np.array([a for a, _ in rows] + [10 * DAY + 5])
    for a, b in ((None, None), (10 * DAY + 5, 11 * DAY + 10**8), (11 * DAY, None)):
        own = v[(t >= (a or 0)) & (t <= (b or 2**62))]
        for kind, f in (("sum", np.sum), ("count", len), ("mean", np.mean), ("min", np.min), ("max", np.max), ("variance", np.var)):
            assert np.isclose(s.manifest_query(kind, "x", a, b).first().value, f(own))
            assert np.isclose(query.aggregate(s.rows(a, b), kind, "x", a, b).first().value, f(own))
    assert all(r.ok for r in s.verify().collect())
    files = s.rows(11 * DAY, 11 * DAY + 10).select(F.col("_metadata.file_path")).distinct().count()
    assert 1 <= files <= 2
    assert s.compact(12 * DAY, None, within=True) == 0
    assert s.compact() == 3 and s.rows().count() == 601 and s.manifest().select("batch").distinct().count() == 1
    assert all(r.ok for r in s.verify().collect()) and s.inspect().first().num_rows == 601


def test_verify_notices_changed_rows(spark):
    s = SeriesStore(spark, path_for(spark, "store"))
    s.append(series(spark, np.arange(2000) * 0.5))
    rows = written(spark.read.parquet(f"{s.path}/rows/batch=0").withColumn("v", F.when(F.col("ts_ns") == 100, -1.0).otherwise(F.col("v"))), "bad")
    rows.write.mode("overwrite").partitionBy("period_key").parquet(f"{s.path}/rows/batch=0")
    assert [r.ok for r in s.verify().collect()] == [False]


def test_a_store_shows_batches_whole_or_not_at_all(spark, monkeypatch):
    s = SeriesStore(spark, path_for(spark, "commits"))
    first, second = series(spark, np.arange(100) * 0.5), series(spark, np.arange(50) * 0.25, range(1000, 1050))
    with pytest.raises(EngineError):
        s.rows()
    s.append(first, batch="a")
    s._write(second, ())  # a writer that died before its commit
    with monkeypatch.context() as m:
        m.setattr(s, "_file_entries", lambda *_: 1 / 0)  # and one before its manifest rows
        with pytest.raises(ZeroDivisionError):
            s.append(second)
    assert s.rows().count() == 100 and s.manifest().agg(F.sum("num_rows")).first()[0] == 100 and len(s.verify().collect()) == 1
    s.append(second, batch="b")
    s.append(second, batch="b")
    assert s.rows().count() == 150
    with monkeypatch.context() as m:
        m.setattr(s.commits, "commit", lambda *_: 1 / 0)  # compaction dies before its commit
        with pytest.raises(ZeroDivisionError):
            s.compact()
    assert s.rows().count() == 150 and s.manifest().agg(F.sum("num_rows")).first()[0] == 150
    old = s.rows()  # a query that began before
    assert s.compact() == 2 and old.count() == s.rows().count() == 150
    s.append(second, batch="b")  # its name outlives the compaction
    assert s.rows().count() == 150 and s.vacuum() == 0 and s.vacuum(keep_hours=-1) >= 4 and s.rows().count() == 150
    with pytest.raises(EngineError):
        s.commits.commit(99, remove=[0])  # that batch has ended


def test_commits_meet(spark, monkeypatch):
    from tideblock.sources import commits

    monkeypatch.setattr(commits, "SNAPSHOT", 4)
    path = path_for(spark, "log")
    a, b = commits.Commits(spark, path), commits.Commits(spark, path)
    assert [a.claim(), b.claim(), a.claim()] == [0, 1, 2]
    late, _ = b.live()
    assert a.commit(0, ["x"]) and not b.commit(1, ["x"])
    real, tries = b.live, []
    monkeypatch.setattr(b, "live", lambda: (late, -1) if not tries.append(1) and len(tries) == 1 else real())  # b has not seen a's commit
    assert b.commit(1, ["y"]) and len(tries) == 2
    for i in range(2, 11):
        assert a.commit(i, [str(i)], remove=[i - 1] if i % 3 == 0 else [])
    want = {0: ["x"], 1: ["y"], **{i: [str(i)] for i in range(2, 11)}}
    assert a.live() == ({k: v for k, v in want.items() if k not in (2, 5, 8)}, 10)


def test_store_answers_from_statistics_first(spark):
    rng = np.random.default_rng(3)
    s = SeriesStore(spark, path_for(spark, "statistics"), options=Options(block_rows=100))
    t, v = np.arange(3000) * 40_000_000_000, np.sort(rng.normal(size=3000))
    for k in (0, 1):
        s.append(series(spark, v[k::2], t[k::2]))
    kinds = itertools.cycle(("mean", "variance", "count", "max", "min"))
    for a, b in ((None, None), (int(t[150]) + 1, int(t[2700])), (10**18, None)):
        for where in (None, (">", float(v[1700])), ("<=", 0.0), ("==", float(v[200])), ("<", -99.0)):
            for kind in (next(kinds),):
                own = query.aggregate(s.rows(a, b), kind, "v", a, b, where=where).first()
                got = s.query(kind, "v", a, b, where).first()
                assert (got.value if got else 0) == pytest.approx(own.value if own.value is not None else got.value, nan_ok=True) and got.rows_scanned == own.rows_scanned, (a, b, where, kind)
    assert s.query("count", None, int(t[150]), int(t[2700])).first().value == 2551
    assert s.query("sum", "v").first().pct_data_read == 0 and s.query("sum", "v", where=(">", float(v[1700]))).first().pct_data_read <= 10
    # many edges: the rows come by a semi-join within the spans of the range's ends
    from tideblock.plans import two_tier

    few, two_tier.MOST_FENCES = two_tier.MOST_FENCES, 0
    try:
        assert s.query("sum", "v", int(t[150]), int(t[2700])).first().value == pytest.approx(v[150:2701].sum())
        assert s.query("count", "v", where=(">", 0.1)).first().value == (v > 0.1).sum()
    finally:
        two_tier.MOST_FENCES = few


def test_a_moved_segment_is_read_once(spark, monkeypatch):
    t = tier.TieredSeries(spark, path_for(spark, "moved"), warm_blocks=1)
    t.push(series(spark, np.arange(100)))
    path = t._segments()[0][0]
    t.cold.append(spark.read.parquet(path), batch=path.rsplit("/", 1)[1])  # died before the segment was deleted
    assert t.query("count", "v").first().value == 100 and t.rows().count() == 100
    t.push(series(spark, np.arange(5), range(200, 205)))
    assert t.query("sum", "v").first().value == 4950 + 10 and t.info()["rows"] == 5


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "file string, n int")
    assert sorted(map(tuple, upsert(old, spark.createDataFrame([("b", 3), ("c", 4)], "file string, n int")).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_warm_and_cold_tiers(spark):
    gone = []
    t = tier.TieredSeries(spark, path_for(spark, "tiers"), warm_blocks=2, on_evict=lambda df: gone.append(df.count()))
    v = np.arange(12_288) % 1000
    for s in range(0, len(v), 4096):
        t.push(series(spark, v[s : s + 4096], range(s, s + 4096)))
    assert gone == [4096] and t.info()["blocks"] == 2 and t.info()["oldest"] == 4096
    assert t.query("count").first().value == len(v) and t.query("mean", "v").first().value == v.mean()
    again = tier.TieredSeries(spark, t.path, warm_blocks=2)
    assert again.query("max", "v", 0, 5000).first().value == 999.0
    again.sync()
    assert again.info()["rows"] == 0 and again.query("sum", "v").first().value == v.sum() and again.cold.rows().count() == len(v)
    assert union_series(series(spark, [1.0]), series(spark, [2.0])).count() == 2


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(i * 10**9, float(i), "ab"[i % 2]) for i in range(100)], "ts_ns long, v double, k string")
    df.filter("ts_ns < 50000000000").write.parquet(src)
    s = SeriesStore(spark, path_for(spark, "stream"))
    check = path_for(spark, "check")
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)
    tier.ingest(stream().select("ts_ns", "v"), s, check).awaitTermination()
    assert s.rows().count() == 50
    df.filter("ts_ns >= 50000000000").write.mode("append").parquet(src)
    tier.ingest(stream().select("ts_ns", "v"), s, check).awaitTermination()
    assert s.rows().count() == 100 and s.rows().agg(F.sum("v")).first()[0] == 4950
    s.append(df.select("ts_ns", "v").filter("ts_ns >= 50000000000"), batch=1)  # a repeated batch changes nothing
    assert s.rows().count() == 100 and s.manifest().agg(F.sum("num_rows")).first()[0] == 100
    timed = stream().withColumn("event_time", F.timestamp_micros((F.col("ts_ns") / 1000).cast("long")))
    q = tier.windowed(timed, "v", "10 seconds", by=["k"]).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n), count(*) from w").first()[:] == (100, 20)
    q = tier.ring(stream(), "k", "v", 30).writeStream.outputMode("append").format("memory").queryName("ring").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select k, count(*) n, max(ts_ns) t from ring group by k order by k").collect()[0].n == 20
    got = tier.sessions(df.withColumn("event_time", F.timestamp_micros((F.col("ts_ns") / 1000).cast("long"))), "v", "5 seconds").collect()
    assert len(got) == 1 and got[0].n == 100


def test_command_line(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("ts,temp,hum\n" + "".join(f"{i * 1000},{20 + i % 10 / 10},{50 - i % 7}\n" for i in range(500)))
    store = f"file://{tmp_path}/store"

    def run(*args):
        out = io.StringIO()
        assert cli.main([str(a) for a in args], spark, out) == 0
        return out.getvalue().splitlines()

    run("compress", f"file://{p}", store, 0.05)
    assert run("query", store, "count")[1].startswith("500.0,")
    assert float(run("query", store, "mean", "temp", "--from", 0, "--to", 9000)[1].split(",")[0]) == pytest.approx(20.45)
    assert float(run("query", store, "max", "hum", "WHERE", "temp", ">", 20.85)[1].split(",")[0]) == 50
    assert run("query", store, "scan", "temp,hum", "--from", 5000, "--limit", 2) == ["ts_ns,temp,hum", "5000,20.5,45.0", "6000,20.6,44.0"]
    assert run("query", store, "value_at", "hum", "--at", 4500) == ["ts_ns,hum", "5000,45.0"]
    assert len(run("query", store, "downsample", "temp")) == 101 and run("query", store, "variance", "temp")
    assert len(run("inspect", store)) == 3 and len(run("inspect", store, "--blocks")) == 3
    assert run("verify", store) == ["checked 2, corrupt 0"]
    assert cli.main(["query", store, "mean", "nope"], spark, io.StringIO()) == 1


def test_entry_and_some_queries(spark, small):
    import duckdb

    import __spark_entry__ as entry
    from tideblock.plans import registry

    assert entry.entry(spark).count() == 5 and value_of
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name in ("flagship", "range_mean", "mean_where_gte", "downsample", "dod_encode", "rle_runs", "manifest_variance", "block_stats", "value_at_many", "entropy"):
        a, b = registry.queries()[name](spark, small).toArrow(), con.execute(registry.oracle_sql()[name]).to_arrow_table()
        names = sorted(a.column_names)
        rows = lambda t: sorted(str([r[c] for c in names]) for r in t.to_pylist())  # noqa: B023, E731
        assert names == sorted(b.column_names) and rows(a) == rows(b), name


def test_the_library_does_not_import_the_corpus_operators():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "tideblock"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_pla_value_at_sees_every_position(spark, small, monkeypatch):
    from tideblock.functions import algebra
    from tideblock.plans import registry

    assert [tuple(r)[1] for r in registry.queries()["pla_value_at"](spark, small).collect()] == [True]
    whole = algebra.pieces_value_at
    for wrong in (lambda x: x.withColumn("value", F.when(F.col("ordinal") == 5, 1e9).otherwise(F.col("value"))), lambda x: x.filter("ordinal != 5")):
        monkeypatch.setattr(algebra, "pieces_value_at", lambda *a, wrong=wrong: wrong(whole(*a)))
        assert [tuple(r)[1] for r in registry.queries()["pla_value_at"](spark, small).collect()] == [False]


@pytest.mark.parametrize("name", ["pla_decode_within_epsilon", "cheb_decode_within_epsilon"])
def test_decoded_rows_are_not_broadcast(spark, small, name, monkeypatch):
    from tideblock.plans import registry

    monkeypatch.setattr(algebra, "TASK_ROWS", 100, raising=False)
    got = registry.queries()[name](spark, small)
    assert [tuple(r) for r in got.collect()] == [(1000, True)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert "hashpartitioning(block_id" in plan and ", 10), REPARTITION_BY_NUM" in plan


def test_decoded_rows_beside_their_own(spark):
    v = signals(700)["walk"]
    rows = B.block_rows(series(spark, v), Options(block_rows=256))
    pieces = algebra.pieces_of(B.encode_blocks(rows, Options(epsilon=0.5, codecs={"v": "PLA_LINEAR"}, block_rows=256), ["v"]), ["block_id"])
    got = algebra.decoded_beside(rows.select("block_id", "ordinal", "pos", "v"), pieces.filter("block_id != 1"), ["block_id"], "approx").collect()
    assert sorted(r["pos"] for r in got) == [*range(256), *range(512, 700)]
    assert all(abs(r["approx"] - r["v"]) <= 0.5 + 1e-9 and r["v"] == v[r["pos"]] for r in got)
