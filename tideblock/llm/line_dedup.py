"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that are not blank, compared with white
space collapsed. A repeated run is a run of lines that stands at an earlier place too,
by document and then by line, as far as it agrees with that place to either side,
and has `least_lines` lines or `least_words` words. Its lines go; the first occurrence stays.

Windows are the shortest runs that have enough, from each line on and up to each line.
Of each, the smallest line hash is selected (the last of equals), so two places that share
a run with enough in it have selected the same line of it: the selected lines, about
half of all, are the fingerprints that are stored and joined. At those that stand at several
places the match is extended line by line to the left and to the right, to each window
that selected the line; windows are told apart by a 128-bit hash of their lines, and each
is matched to the earliest place that has it, never to all of them. As every line of a
repeated run lies in such a window within the run, their union is the run, whole.

Null texts stay null, empty ones empty. Documents come by id, null ids first; those of one
id by a 64-bit hash of id and text. A row repeated with the same id and text is
one document given twice: its copies keep the same lines.
Lines are those between "\\n"; blank ones stay where they are. Very long texts need
memory for themselves alone. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, fresh, sliced, written

LEAST_LINES, LEAST_WORDS = 3, 50
_PRINT = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("whole", pa.binary())])


def lines_of(text: bytes) -> list[tuple[int, list[bytes]]]:
    """Number and words of each line that is not blank."""
    return [(i, words) for i, line in enumerate(text.split(b"\n")) if (words := line.split())]


def windows_of(sizes: list[int], least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Start and end of the shortest runs with enough in them from each line on, then of those up to each line that are not among them; sizes are words in lines."""
    upto = [0, *accumulate(sizes)]
    spans, n, end = [], len(sizes), 0
    for start in range(n):
        end = max(end, start + 1)
        while end < n and end - start < least_lines and upto[end] - upto[start] < least_words:
            end += 1
        if end - start < least_lines and upto[end] - upto[start] < least_words:
            break
        spans.append((start, end))
    known, start = set(spans), 0
    for end in range(1, n + 1):
        while end - start > 1 and (end - start > least_lines or upto[end] - upto[start + 1] >= least_words):
            start += 1
        if (end - start >= least_lines or upto[end] - upto[start] >= least_words) and (start, end) not in known:
            spans.append((start, end))
    return spans


def prints_of(lines: list[list[bytes]], least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> dict[int, tuple[int, list[tuple[int, int, bytes]]]]:
    """Of each selected line: its hash, and start, length and 128-bit hash of the windows that selected it."""
    spans = windows_of([len(x) for x in lines], least_lines, least_words)
    if not spans:
        return {}
    digests = [xxhash.xxh3_128_digest(b" ".join(x)) for x in lines]
    joined = b"".join(digests)
    low = [int.from_bytes(x[:8], "little", signed=True) for x in digests]
    found: dict[int, tuple[int, list[tuple[int, int, bytes]]]] = {}
    for s, e in spans:
        at = s
        for i in range(s + 1, e):
            if low[i] <= low[at]:
                at = i
        whole = digests[s] if e - s == 1 else xxhash.xxh3_128_digest(joined[16 * s : 16 * e])
        found.setdefault(at, (low[at], []))[1].append((s, e - s, whole))
    return found


def _prints(docs: DataFrame, id_col: str, text_col: str, least_lines: int, least_words: int) -> DataFrame:
    """A row for each selected line: _id, _key, line, print (its hash) and the windows that selected it."""

    def run(batches):
        for part in sliced(batches, text_col):
            at, line, low, counts, rows = [], [], [], [0], []
            for i, text in enumerate(bytes_of(part.column(text_col))):
                for k, (h, own) in prints_of([w for _, w in lines_of(text)], least_lines, least_words).items():
                    at.append(i)
                    line.append(k)
                    low.append(h)
                    rows += own
                    counts.append(len(rows))
            start, length, whole = zip(*rows, strict=True) if rows else ((), (), ())
            spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(whole, pa.binary())], fields=list(_PRINT))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(id_col).take(at), part.column("_key").take(at), pa.array(line, pa.int32()), pa.array(low, pa.int64()), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans)], ["_id", "_key", "line", "print", "spans"])

    keyed = docs.select(id_col, F.xxhash64(id_col, text_col).alias("_key"), text_col)
    return keyed.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _key long, line int, print long, spans array<struct<start:int,length:int,whole:binary>>")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """_id, _key, start, length of each window that stands earlier too."""
    prints = written(_prints(docs, id_col, text_col, least_lines, least_words), "prints")
    place = F.struct("_id", "_key", "start")
    several = lambda df, key, spot: df.groupBy(key).agg(F.min(spot).alias("low"), F.max(spot).alias("high")).filter("NOT (low <=> high)")
    # the repeated ones are written, so that either side of a join is dealt for the join alone and a hot key's part can be split
    shared = written(several(prints, "print", F.struct("_id", "_key", "line")).select("print"), "shared")
    near = written(prints.join(shared, "print", "left_semi").selectExpr("_id", "_key", "inline(spans)"), "windows")
    first = written(several(near, "whole", place).select("whole", "low"), "first")
    return near.join(first, "whole").filter(place > F.col("low")).select("_id", "_key", "start", "length")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """All columns of docs, the text without its repeated runs, and n_lines and n_deleted (lines that are not blank), before which input columns of these names give way."""
    docs = docs.drop("n_lines", "n_deleted")
    key, lost, lost_id, lost_key = (fresh(docs, x) for x in ("_key", "_lost", "_lost_id", "_lost_key"))
    gone = repeated_windows(docs, id_col, text_col, least_lines, least_words).groupBy("_id", "_key").agg(F.collect_set(F.struct("start", "length")).alias(lost)).withColumnsRenamed({"_id": lost_id, "_key": lost_key})
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    joined = keyed.join(gone, (F.col(key) == F.col(lost_key)) & F.col(id_col).eqNullSafe(F.col(lost_id)), "left").select(*docs.columns, lost)
    names = docs.columns

    def run(batches):
        for part in sliced(batches, text_col):
            kept, n_lines, n_deleted = [], [], []
            for text, old, found in zip(bytes_of(part.column(text_col)), part.column(text_col).is_null().to_pylist(), part.column(lost).to_pylist(), strict=True):
                lines = lines_of(text)
                n_lines.append(len(lines))
                drop = {lines[i][0] for x in found or () for i in range(x["start"], x["start"] + x["length"])}
                n_deleted.append(len(drop))
                if drop:
                    text = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in drop)
                kept.append(None if old else text)
            made = {text_col: pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_deleted": pa.array(n_deleted, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[k] if k in made else part.column(k) for k in [*names, "n_lines", "n_deleted"]], [*names, "n_lines", "n_deleted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{kinds}, n_lines long, n_deleted long")
