"""Quality classifier: naive Bayes support vectors.

Indicators of 1- and 2-grams of tokens (words and runs of marks), of 1- to 3-grams
of their forms, and of the share of repeated lines and tokens are hashed to 2**BITS features, scaled by the log ratio of their class counts, made
unit length, and separated by a linear hinge-loss model fitted by dual coordinate
descent. A logistic curve through margins of held-out folds turns margins into
scores from 0 to 1.

The fit takes at most `most` labelled rows, those with the smallest hash of their
id: a documented bound, so that it fits one task however many labels there are.
Every row is scored, on its whole text, which is the only input. Null and empty
texts get the score of no features. Rows whose label is null take no part, an id
labelled twice counts with its smallest label, an id with several texts with the one
whose features come first; each id is one row before anything is gathered. Without labels every score is 0.5;
with one class alone it is that class. Repeated rows each give a row.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, sliced

BITS = 18
#: Tokens: words, numbers, runs of other marks, whose length beyond 3 does not count.
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]{1,3}")


def _shapes(tokens: list[bytes]) -> list[bytes]:
    """Each token's form: marks as they are; words by their case; a token that repeats the one before."""
    out, last = [], None
    for t in tokens:
        if t == last:
            out.append(b"=")
        elif t[0] >= 0x80 or 0x41 <= t[0] <= 0x5A or 0x61 <= t[0] <= 0x7A:
            out.append(b"U" if len(t) > 1 and t.isupper() else b"T" if t[:1].isupper() else b"l")
        else:
            out.append(b"0" if t.isdigit() else t)
        last = t
    return out


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Sorted hashed indicators of a text's 1- and 2-grams of tokens, 1- to 3-grams of their forms, and how much of it repeats."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.empty(0, np.int32)
    n = np.uint64(0x9E3779B97F4A7C15)
    h = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    s = np.fromiter(map(zlib.crc32, _shapes(tokens)), np.uint64, len(tokens)) + np.uint64(1 << 40)
    two = s[:-1] * n ^ s[1:]
    lines = text.split(b"\n")
    repeats = 8 * (len(lines) - len(set(lines))) // len(lines), 8 * len(set(tokens)) // len(tokens), len(tokens).bit_length()
    more = np.array([(1 << 41) + 64 * i + x for i, x in enumerate(repeats)], np.uint64)
    every = np.concatenate((h, (h[:-1] * n ^ h[1:]) * n, np.unique(s), np.unique(two), np.unique(two[:-1] * n ^ s[2:]), more))
    every = (every ^ every >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(every >> np.uint64(64 - bits)).astype(np.int32)


def ratios(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, least: int = 3) -> np.ndarray:
    """Log of how much likelier each feature is in class 1; 0 for features of fewer than `least` rows."""
    counts = np.zeros((2, 1 << bits))
    for x, y in zip(rows, labels, strict=True):
        counts[int(y), x] += 1
    seen = counts.sum(axis=0) >= least
    smooth = counts + 1
    r = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    return np.where(seen, r, 0.0)


def scaled(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features with a ratio, and their values at unit length."""
    v = r[x]
    keep = v != 0
    x, v = x[keep], v[keep]
    return x, v / max(1e-12, float(np.sqrt(v @ v)))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, c: float = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights and, last, bias of the hinge-loss model, by dual coordinate descent; the rarer class's rows cost as much in all as the others."""
    rng = np.random.default_rng(seed)
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.array([np.mean(labels == 0), np.mean(labels == 1)])
    cap = c * 0.5 / share[labels.astype(int)]
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i]
            slope = sign[i] * (w[x] @ v + w[-1]) - 1.0
            new = min(cap[i], max(0.0, alpha[i] - slope / norm[i]))
            if (step := new - alpha[i]) != 0.0:
                alpha[i] = new
                w[x] += step * sign[i] * v
                w[-1] += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def margins(rows: list[np.ndarray], r: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for i, x in enumerate(rows):
        ids, v = scaled(x, r)
        out[i] = w[ids] @ v + w[-1]
    return out


def curve(m: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """a, b of the logistic curve 1 / (1 + exp(-(a m + b))) by Newton steps on smoothed targets."""
    up, down = float((labels == 1).sum()), float((labels == 0).sum())
    t = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * m).sum(), (p - t).sum()])
        h = np.array([[(s * m * m).sum() + 1e-6, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        scale = min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.0)), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, folds: int = 3) -> dict:
    """The model: a weight for each feature before the scaling, the ratios, bias and curve."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return {"constant": float(labels[0]) if len(labels) else 0.5}
    out = np.empty(len(rows))
    fold = np.arange(len(rows)) % folds

    def one(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [rows[i] for i in at]
        r = ratios(own, labels[at], bits)
        return r, descend([scaled(x, r) for x in own], labels[at], 1 << bits)

    for k in range(folds):
        rest, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(test) == 0 or len(set(labels[rest].tolist())) < 2:
            out[test] = 0.0
            continue
        r, w = one(rest)
        out[test] = margins([rows[i] for i in test], r, w)
    r, w = one(np.arange(len(rows)))
    a, b = curve(out, labels)
    return {"ratios": r.astype(np.float32), "weights": w, "a": a, "b": b}


def score(model: dict, rows: list[np.ndarray]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(rows), model["constant"])
    m = margins(rows, model["ratios"].astype(np.float64), model["weights"])
    return 1 / (1 + np.exp(-np.clip(model["a"] * m + model["b"], -30, 30)))


def pack(model: dict) -> bytes:
    import io

    buffer = io.BytesIO()
    np.savez_compressed(buffer, **{k: np.asarray(v) for k, v in model.items()})
    return buffer.getvalue()


def unpack(data: bytes) -> dict:
    import io

    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] if f[k].ndim else float(f[k]) for k in f.files}


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = 10_000) -> bytes:
    """Fit on rows of docs with a label where `usable` holds of the id, at most `most` labels; the packed model (about a megabyte) comes to the driver."""
    chosen = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & usable)
        .groupBy(id_col)
        .agg(F.min(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(most)
    )
    some = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # `most` ids at most

    def indicators(batches):
        for part in sliced(batches, text_col):
            rows = [features(x).tobytes() for x in bytes_of(part.column(text_col))]
            yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("_label"), pa.array(rows, pa.binary())], ["_id", "_label", "_features"])

    def learn(batches):
        found = [(i, y, x) for batch in batches for i, y, x in zip(*(batch.column(k).to_pylist() for k in ("_id", "_label", "_features")), strict=True)]
        found.sort(key=lambda z: (zlib.crc32(str(z[0]).encode()), str(z[0]), z[2]))
        found = found[:most]
        model = fit([np.frombuffer(x, np.int32) for _, _, x in found], np.array([y for _, y, _ in found], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pack(model)], pa.binary())], ["model"])

    rows = some.select(id_col, text_col, "_label").mapInArrow(indicators, f"_id {docs.schema[id_col].dataType.simpleString()}, _label int, _features binary")
    rows = rows.groupBy("_id").agg(F.min("_label").alias("_label"), F.min("_features").alias("_features"))  # `most` rows at most
    made = rows.repartition(1).mapInArrow(learn, "model binary").collect()
    return made[0]["model"] if made else pack({"constant": 0.5})


def score_quality(docs: DataFrame, model: bytes, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of `keep`, score and predicted of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys([id_col, *keep]))

    def run(batches):
        own = unpack(shipped.value)
        for part in sliced(batches, text_col):
            s = score(own, [features(x) for x in bytes_of(part.column(text_col))])
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], [*names, "score", "predicted"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in names)
    return docs.select(*dict.fromkeys([*names, text_col])).mapInArrow(run, f"{kinds}, score double, predicted int")


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
