"""Shared pieces: scratch tables in the shared folder, byte-balanced Arrow slices, words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one Python step handles at once.
SLICE_BYTES = 4 << 20

#: A-Z become a-z, bytes outside [0-9a-z\x80-\xff] become spaces: a text's words are then its pieces between spaces.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, as in local tests, a temporary one that is then set for the session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tideblock-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tideblock/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, rows: int, most: int = 250_000) -> int:
    """Tasks for so many short rows: one for each `most`, and at least two a core. To coalesce to more than there are changes nothing."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // most))


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_bytes(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> Iterator[None]:
    """While it lasts, Arrow batches between executors and their Python workers are smaller than the session's, as both sides hold some of them at once."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def give_back() -> None:
    """What this process has freed goes back to the system, as far as the C library can (glibc; elsewhere nothing happens)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: What operators keep in a Python worker from task to task, by name; a worker serves many of them.
KEPT: dict[str, dict] = {}


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES, keep: str = "") -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `most` bytes of the column, one row at least.

    A worker keeps only what `keep` names of KEPT, so that one operator's memory does
    not stay under the next, nor with the C library; what Arrow has freed goes back to the system after each batch.
    """
    for name, kept in KEPT.items():
        if name != keep and kept:
            kept.clear()
            give_back()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
        pa.default_memory_pool().release_unused()


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text after lower-casing A-Z, as UTF-8."""
    return text.translate(WORD_BYTES).split()
