"""Ingest and tiering: streams into a store, a bounded warm tier before it, windows with late data."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import BLOCK_ROWS, Options, in_range, predicate, value_of
from ..operators.query import aggregate
from ..plans.two_tier import merge, row_parts
from ..sources.readers import union_series
from ..sources.store import SeriesStore


def ingest(stream: DataFrame, store: SeriesStore, checkpoint: str, tie: Sequence[str] = (), trigger: dict | None = None) -> StreamingQuery:
    """Append a stream of series rows to a store, each micro-batch once: a batch that is there is not added again."""

    def add(df: DataFrame, epoch: int) -> None:
        if not df.isEmpty():
            store.append(df, tie, batch=epoch)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(stream: DataFrame, column: str, width: str, slide: str | None = None, late: str = "10 minutes", event_time: str = "event_time", by: Sequence[str] = ()) -> DataFrame:
    """n, mean, min, max of tumbling or sliding windows; rows later than `late` behind the watermark are left out."""
    w = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    got = stream.withWatermark(event_time, late).groupBy(w, *by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
    return got.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "mean", "min", "max")


def sessions(stream: DataFrame, column: str, gap: str, late: str = "10 minutes", event_time: str = "event_time", by: Sequence[str] = ()) -> DataFrame:
    """n and sum of sessions that end after `gap` without a row."""
    w = F.session_window(event_time, gap)
    got = stream.withWatermark(event_time, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(column).alias("sum"))
    return got.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n", "sum")


def ring(stream: DataFrame, key: str, column: str, most: int, ts: str = "ts_ns") -> DataFrame:
    """First in, first out: of each key the last `most` rows stay in the state, older ones come out as rows of key, ts, value."""
    kind = stream.schema[key].dataType.simpleString()

    def evict(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values = (list(x) for x in state.get) if state.exists else ([], [])
        for f in frames:
            times += f[ts].tolist()
            values += f[column].tolist()
        order = sorted(range(len(times)), key=lambda i: times[i])
        gone, kept = order[: max(0, len(order) - most)], order[max(0, len(order) - most) :]
        state.update(([times[i] for i in kept], [values[i] for i in kept]))
        yield pd.DataFrame({key: [keys[0]] * len(gone), ts: [times[i] for i in gone], column: [values[i] for i in gone]})

    rows = stream.select(key, ts, F.col(column).cast("double").alias(column)).filter(F.col(ts).isNotNull())
    return rows.groupBy(key).applyInPandasWithState(evict, f"`{key}` {kind}, {ts} long, `{column}` double", "times array<long>, items array<double>", "append", GroupStateTimeout.NoTimeout)


class TieredSeries:
    """A warm tier of the newest segments before a cold store.

    A push is a segment, written to the warm folder, so that it outlives the session
    and is read by every query. Beyond `warm_blocks` blocks or `warm_bytes` bytes the
    oldest segments move to the cold store; `on_evict` gets each segment's rows first.
    A segment is cold from the commit on that names it, and warm until then: one that
    a writer died before deleting is not read again, and goes with the next eviction.
    """

    def __init__(self, spark: SparkSession, path: str, warm_blocks: int = 256, warm_bytes: int = 16 << 20, period: str = "day", options: Options = Options(), on_evict: Callable[[DataFrame], None] | None = None):
        self.spark, self.path, self.warm_blocks, self.warm_bytes, self.on_evict = spark, path.rstrip("/"), warm_blocks, warm_bytes, on_evict
        self.cold = SeriesStore(spark, f"{self.path}/cold", period, options)

    def _segments(self) -> list[tuple[str, int, int]]:
        """Path, rows and bytes of each warm segment, oldest first; its name holds its place and its rows."""
        commits, out = self.cold.commits, []
        cold = {x for names in commits.live()[0].values() for x in names}
        for name in commits.children(f"{self.path}/warm"):
            fs, p = commits._at(f"{self.path}/warm/{name}")
            if name in cold:
                fs.delete(p, True)  # moved before, by a writer that did not live to delete it
            elif not name.startswith("."):
                out.append((f"{self.path}/warm/{name}", int(name.split("-")[1]), fs.getContentSummary(p).getLength()))
        return out

    def push(self, df: DataFrame) -> None:
        have = self._segments()
        place = 1 + max([int(p.rsplit("/", 1)[1].split("-")[0]) for p, _, _ in have], default=-1)
        rows = df.filter("ts_ns IS NOT NULL")
        n = rows.count()
        if not n:
            return
        name = f"{place:012d}-{n}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/warm/.{name}")
        fs, beside = self.cold.commits._at(f"{self.path}/warm/.{name}")
        fs.rename(beside, self.cold.commits._at(f"{self.path}/warm/{name}")[1])  # whole from its first sight on
        self._evict()

    def _evict(self) -> None:
        have = self._segments()
        blocks = lambda: sum(-(-n // BLOCK_ROWS) for _, n, _ in have)
        while len(have) > 1 and (blocks() > self.warm_blocks or sum(b for _, _, b in have) > self.warm_bytes):
            self._to_cold(have.pop(0)[0])

    def _to_cold(self, path: str) -> None:
        df = self.spark.read.parquet(path)
        if self.on_evict:
            self.on_evict(df)
        self.cold.append(df, batch=path.rsplit("/", 1)[1])
        fs, p = self.cold.commits._at(path)
        fs.delete(p, True)

    def warm_rows(self) -> DataFrame | None:
        have = self._segments()
        return union_series(*[self.spark.read.parquet(p) for p, _, _ in have]) if have else None

    def rows(self, t_from: int | None = None, t_to: int | None = None) -> DataFrame:
        """Cold and warm rows."""
        warm = self.warm_rows()
        cold = None if self.cold.is_empty() else self.cold.rows(t_from, t_to).drop("period_key", "block_id", "ordinal", "batch")
        return union_series(*[x for x in (cold, warm) if x is not None])

    def query(self, kind: str, column: str | None = None, t_from: int | None = None, t_to: int | None = None, where: tuple[str, float] | None = None) -> DataFrame:
        """An aggregate of cold and warm rows; the cold ones are answered from statistics first."""
        warm = self.warm_rows()
        if self.cold.is_empty() or column is None:
            return aggregate(self.rows(t_from, t_to), kind, column, t_from, t_to, where=where)
        if warm is None:
            return self.cold.query(kind, column, t_from, t_to, where)
        parts, total = self.cold.parts(column, t_from, t_to, where)
        inside = warm.filter(in_range(F.col("ts_ns"), t_from, t_to))
        v = value_of(inside, column)
        parts = parts.unionByName(row_parts(inside, F.when(predicate(v, *where), v) if where else v))
        return merge(parts, kind, (), total + warm.agg(F.count("*")).scalar())

    def sync(self) -> None:
        """Move every warm segment to the cold store."""
        for path, _, _ in self._segments():
            self._to_cold(path)

    def info(self) -> dict:
        """blocks, bytes, rows, oldest and newest time of the warm tier."""
        have = self._segments()
        ends = self.warm_rows().agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b")).first() if have else {"a": None, "b": None}
        return {"blocks": sum(-(-n // BLOCK_ROWS) for _, n, _ in have), "bytes": sum(b for _, _, b in have), "rows": sum(n for _, n, _ in have), "oldest": ends["a"], "newest": ends["b"]}
