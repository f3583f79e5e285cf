"""Stored series: rows in Parquet by period, their block table, and a manifest.

A store is a folder: rows/batch=.../period_key=.../ holds the rows, sorted by time
within a file; blocks/batch=.../ the block table, with a checksum for each block and
column; entries/batch=.../ one manifest row for each file and column. Files are
written once and never changed. A batch counts from its commit on, which is one step
and ends those it replaces in the same one: appending, compaction and what dies
between two steps never show a row twice or leave part of a batch to be seen.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import PERIOD_SECONDS, period_key
from ..model import EngineError, Options, in_range, numeric_columns, value_of
from ..operators.blocks import block_rows, build_blocks, melted
from ..operators.query import aggregate
from ..plans.two_tier import block_parts, edge_spans, merge, row_parts
from ..scratch import written
from .commits import Commits

RESERVED = ("ts_ns", "period_key", "pos", "block_id", "ordinal", "batch")


def checksum(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, block_id, col, digest, num_values: a sum over hashes of (ordinal, time, value), so it needs no order and merges over parts of a block."""
    h = F.xxhash64("ordinal", "ts", "v").cast("decimal(20,0)")
    return melted(rows, columns, by).groupBy(*by, "block_id", "col").agg(F.sum(h).cast("string").alias("digest"), F.count("v").alias("num_values"))


class SeriesStore:
    """A partitioned, append-only series with block statistics."""

    def __init__(self, spark: SparkSession, path: str, period: str = "day", options: Options = Options(), max_rows_per_file: int = 0):
        if period not in PERIOD_SECONDS:
            raise EngineError(f"unknown period {period}")
        self.spark, self.path, self.period, self.options, self.max_rows = spark, path.rstrip("/"), period, options, max_rows_per_file
        self.commits = Commits(spark, f"{self.path}/commits")

    def append(self, df: DataFrame, tie: Sequence[str] = (), batch: int | str | None = None) -> None:
        """Add rows. Each call is a batch: its blocks are its own, rows late or out of order are welcome. Null times are dropped.

        A batch given by number or name is added once: where it is there already, nothing changes, so a stream's batches can be repeated.
        """
        names = [] if batch is None else [str(batch)]
        if not self.holds(*names):
            self.commits.commit(self._write(df, tie), names)

    def holds(self, *names: str) -> bool:
        """Whether one of the names is that of a batch that counts."""
        return bool(names) and bool(set(names) & {x for n in self.commits.live()[0].values() for x in n})

    def _write(self, df: DataFrame, tie: Sequence[str]) -> int:
        """The files of a batch that does not count yet; its number."""
        batch = self.commits.claim()
        placed = written(block_rows(df.withColumn("period_key", period_key(F.col("ts_ns"), self.period)), self.options, ["period_key"], tie=tie), "batch")
        columns = numeric_columns(df, RESERVED)
        sums = checksum(placed, columns, ["period_key"])
        keys = ["period_key", "block_id", "col"]
        blocks = build_blocks(placed, self.options, columns, ["period_key"]).join(sums, keys)
        blocks.write.parquet(f"{self.path}/blocks/batch={batch}")
        # by ranges of time and not by period alone, so that no task has all of a long one
        out = placed.drop("pos").repartitionByRange("period_key", "ts_ns").sortWithinPartitions("period_key", "ts_ns")
        writer = out.write.partitionBy("period_key")
        if self.max_rows:
            writer = writer.option("maxRecordsPerFile", self.max_rows)
        writer.parquet(f"{self.path}/rows/batch={batch}")
        self._file_entries(batch, columns).coalesce(1).write.parquet(f"{self.path}/entries/batch={batch}")
        return batch

    def _live(self, kind: str) -> DataFrame:
        """The table `kind` of all batches that count."""
        live, _ = self.commits.live()
        if not live:
            raise EngineError(f"{self.path} holds no batch")
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/batch={b}" for b in sorted(live)])

    def is_empty(self) -> bool:
        return not self.commits.live()[0]

    def rows(self, t_from: int | None = None, t_to: int | None = None) -> DataFrame:
        """Rows of a range; partitions are pruned by the period keys of its ends, files by their time statistics."""
        df = self._live("rows").filter(in_range(F.col("ts_ns"), t_from, t_to))
        ns = PERIOD_SECONDS[self.period] * 1_000_000_000
        key = lambda t: None if t is None else (abs(t) // ns) * (1 if t >= 0 else -1)  # noqa: E731  a later time never has a smaller key
        return df.filter(in_range(F.col("period_key"), key(t_from), key(t_to))).withColumn("period_key", F.col("period_key").cast("long"))

    def blocks(self) -> DataFrame:
        return self._live("blocks")

    # queries

    def parts(self, column: str | None, t_from: int | None = None, t_to: int | None = None, where: tuple[str, float] | None = None) -> tuple[DataFrame, Column]:
        """Partial results of the range, statistics of blocks that lie whole in it and of rows at its edges, and the number of all rows."""
        rows, blocks = self.rows(t_from, t_to), self.blocks()
        return block_parts(rows, blocks, column, t_from, t_to, within=("batch", "period_key"), where=where)

    def query(self, kind: str, column: str | None = None, t_from: int | None = None, t_to: int | None = None, where: tuple[str, float] | None = None) -> DataFrame:
        """mean, sum, min, max, variance or count of a range, from statistics first: only blocks that an end of the range cuts, or of which a comparison holds for some values, are read. A store without number columns counts its rows."""
        columns = numeric_columns(self.rows(), RESERVED)
        if not columns or (column is None and kind != "count"):
            return aggregate(self.rows(t_from, t_to), kind, column, t_from, t_to, where=where)
        parts, total = self.parts(column, t_from, t_to, where)
        return merge(parts, kind, (), total)

    # manifest

    def manifest(self) -> DataFrame:
        """file, batch, period_key, ts_first, ts_last, num_rows, file_size, col, stats of each file and column."""
        return self._live("entries")

    def _file_entries(self, batch: int, columns: Sequence[str]) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/rows/batch={batch}")
        df = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("period_key").cast("long").alias("period_key"), "ts_ns", *columns)
        each = F.array(*[F.struct(F.lit(c).alias("col"), value_of(rows, c).alias("v")) for c in columns])
        v = F.col("v")
        stats = F.struct(F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.count(v).alias("count"))
        return df.select("file", "file_size", "period_key", "ts_ns", F.inline(each)).groupBy("file", "file_size", "period_key", "col").agg(F.min("ts_ns").alias("ts_first"), F.max("ts_ns").alias("ts_last"), F.count("*").alias("num_rows"), stats.alias("stats"))

    def manifest_query(self, kind: str, column: str, t_from: int | None = None, t_to: int | None = None) -> DataFrame:
        """An aggregate from the manifest where a file lies whole in the range, and from rows of the files at its edges."""
        own = self.manifest().filter(F.col("col") == column)
        whole = (F.col("ts_first") >= t_from if t_from is not None else F.lit(True)) & (F.col("ts_last") <= t_to if t_to is not None else F.lit(True))
        meets = (F.col("ts_last") >= t_from if t_from is not None else F.lit(True)) & (F.col("ts_first") <= t_to if t_to is not None else F.lit(True))
        s = F.col("stats")
        parts = own.filter(meets & whole).select(s["count"].alias("n"), s["sum"].alias("sum"), s["min"].alias("min"), s["max"].alias("max"), s["mean"].alias("mean"), s["m2"].alias("m2"), F.lit(0).cast("long").alias("touched"))
        edges = own.filter(meets & ~whole).select("file", "ts_first", "ts_last")
        if (spans := edge_spans(edges, t_from, t_to)) is not None:
            rows = self.rows(t_from, t_to).filter(spans(F.col("ts_ns"))).withColumn("_file", F.col("_metadata.file_path"))
            parts = parts.unionByName(row_parts(rows.join(edges.select(F.col("file").alias("_file")), "_file", "left_semi"), column))
        return merge(parts, kind, (), own.agg(F.sum("num_rows")).scalar())

    def num_parts(self) -> int:
        return self.manifest().select("file").distinct().count()

    # maintenance

    def compact(self, t_from: int | None = None, t_to: int | None = None, within: bool = False, tie: Sequence[str] = ()) -> int:
        """Rewrite the batches whose rows meet the range (or, with `within`, lie in it) as one batch, rows copied as they are, in one commit; returns how many batches went in. One batch or none is left as it is. Their files stay until `vacuum`, as running queries may read them."""
        spans = self.manifest().groupBy("batch").agg(F.min("ts_first").alias("a"), F.max("ts_last").alias("b"))
        lo, hi = (F.col("a"), F.col("b")) if within else (F.col("b"), F.col("a"))
        hit = sorted(r["batch"] for r in spans.filter((lo >= t_from if t_from is not None else F.lit(True)) & (hi <= t_to if t_to is not None else F.lit(True))).collect())
        if len(hit) < 2:
            return 0
        live, _ = self.commits.live()
        df = self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/batch={b}" for b in hit]).drop("batch", "period_key", "block_id", "ordinal")
        self.commits.commit(self._write(df, tie), [x for b in hit for x in live[b]], hit)
        return len(hit)

    def vacuum(self, keep_hours: float = 24.0) -> int:
        """Delete the files of batches that do not count and have not changed for so many hours, which running queries and writers may still need; returns how many batches went."""
        live, _ = self.commits.live()
        fs, _ = self.commits._at(self.path)
        before, gone = (time.time() - 3600 * keep_hours) * 1000, set()
        for kind in ("rows", "blocks", "entries"):
            for name in self.commits.children(f"{self.path}/{kind}"):
                _, p = self.commits._at(f"{self.path}/{kind}/{name}")
                if name.startswith("batch=") and int(name[6:]) not in live and fs.getFileStatus(p).getModificationTime() <= before:
                    fs.delete(p, True)
                    gone.add(name)
        return len(gone)

    def inspect(self) -> DataFrame:
        """col, codecs, n_blocks, num_rows, epsilon, ts_first, ts_last, n_bytes of each column, as its blocks have them."""
        return self.blocks().groupBy("col").agg(
            F.array_sort(F.collect_set("codec")).alias("codecs"), F.count("*").alias("n_blocks"), F.sum("num_rows").alias("num_rows"), F.max("epsilon").alias("epsilon"), F.min("ts_first").alias("ts_first"), F.max("ts_last").alias("ts_last"), F.sum("n_bytes").alias("n_bytes")
        )

    def verify(self) -> DataFrame:
        """batch, period_key, block_id, col, ok of each block and column: the checksum of its rows is the stored one."""
        columns = [r["col"] for r in self.blocks().select("col").distinct().collect()]
        rows = self._live("rows")
        keys = ["batch", "period_key", "block_id", "col"]
        found = checksum(rows, columns, ["batch", "period_key"]).select(*keys, F.col("digest").alias("_found"))
        return self.blocks().select(*keys, "digest").join(found, keys, "full").select(*keys, F.coalesce(F.col("digest") == F.col("_found"), F.lit(False)).alias("ok"))


def upsert(entries: DataFrame, new: DataFrame, key: str = "file") -> DataFrame:
    """Entries with those of the same key replaced."""
    return entries.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
