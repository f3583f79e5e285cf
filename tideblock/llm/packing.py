"""Best-fit packing with exact complements.

Token sequences of documents are packed into rows of at most `capacity` tokens;
only longer documents are cut. The lengths' histogram, at most `capacity` numbers,
goes to the driver. There, for each length from the longest on, the gap it leaves
is looked up among the sums of one, two and three available lengths, and as many
exact fillings are taken at once as the counts allow; what has no exact filling is
placed by best fit, longest first. The plan has far fewer entries than there are
pieces, its size depending on `capacity` alone. Each piece then finds its place by
its rank among the pieces of its length, counted partition by partition: no task
sees all pieces of one length.

Null and empty texts are documents of the end id alone. Repeated rows are packed
once each; an empty table gives no pieces.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, written
from .tokens import SLICE_BYTES, token_ids


class Available:
    """Counts of lengths, and bit sets of those left: `up` has bit n for length n, `down` bit capacity - n."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts, self.capacity = Counter(counts), capacity
        self.up = sum(1 << n for n, c in counts.items() if c)
        self.down = sum(1 << (capacity - n) for n, c in counts.items() if c)

    def take(self, lengths: tuple[int, ...]) -> int:
        """Use the combination as often as its counts allow."""
        need = Counter(lengths)
        times = min(self.counts[n] // k for n, k in need.items())
        for n, k in need.items():
            self.counts[n] -= k * times
            if not self.counts[n]:
                self.up &= ~(1 << n)
                self.down &= ~(1 << (self.capacity - n))
        return times

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if total > 0 and self.up >> total & 1 else None

    def pair(self, total: int) -> tuple[int, ...] | None:
        """Two available lengths of this sum, the longer as long as can be."""
        if total < 2:
            return None
        shift = self.capacity - total  # bit n of down >> shift is set where total - n is available
        both = self.up & (self.down >> shift if shift >= 0 else self.down << -shift) & ((1 << total) - 2)
        while both:
            a = both.bit_length() - 1
            b = total - a
            if a != b or self.counts[a] > 1:
                return a, b
            both &= ~(1 << a)
        return None

    def triple(self, total: int) -> tuple[int, ...] | None:
        left = self.up & ((1 << max(0, total - 1)) - 1)
        while left:
            a = left.bit_length() - 1
            if 3 * a < total:
                return None  # the longest of three is a third at least
            left &= ~(1 << a)
            # one of a is set aside, so that a pair that needs one more than there is gives way to the next pair
            self.counts[a] -= 1
            gone = not self.counts[a]
            if gone:
                self.up &= ~(1 << a)
                self.down &= ~(1 << (self.capacity - a))
            rest = self.pair(total - a)
            self.counts[a] += 1
            if gone:
                self.up |= 1 << a
                self.down |= 1 << (self.capacity - a)
            if rest:
                return a, *rest
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how many rows are filled with each."""
    left = Available(histogram, capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    for n in sorted(histogram, reverse=True):
        for fill in (left.single, left.pair, left.triple):
            while left.counts[n]:
                if n == capacity:
                    combination = (n,)
                else:
                    # one of n is set aside, so that it is not found as its own partner unless another is there
                    left.counts[n] -= 1
                    gone = not left.counts[n]
                    if gone:
                        left.up &= ~(1 << n)
                        left.down &= ~(1 << (capacity - n))
                    found = fill(capacity - n)
                    left.counts[n] += 1
                    if gone:
                        left.up |= 1 << n
                        left.down |= 1 << (capacity - n)
                    if found is None:
                        break
                    combination = (n, *found)
                out.append((combination, left.take(combination)))
    return out + best_fit({n: c for n, c in left.counts.items() if c}, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first into the fullest rows that have room, equal rows and pieces together."""
    rows: dict[int, list[list]] = defaultdict(list)  # room -> [combination, rows]
    rooms = 0  # bit set of rooms in use
    for n in sorted(histogram, reverse=True):
        count = histogram[n]
        while count:
            fitting = rooms >> n
            if not fitting:
                per = capacity // n
                full, rest = divmod(count, per)
                for k, times in ((per, full), (rest, 1)):
                    if k and times:
                        rows[capacity - k * n].append([(n,) * k, times])
                        rooms |= 1 << (capacity - k * n)
                break
            room = n + (fitting & -fitting).bit_length() - 1
            entry = rows[room][-1]
            per = min(room // n, count)
            times = min(entry[1], count // per)
            entry[1] -= times
            if not entry[1]:
                rows[room].pop()
                if not rows[room]:
                    rooms &= ~(1 << room)
            rows[room - per * n].append([entry[0] + (n,) * per, times])
            rooms |= 1 << (room - per * n)
            count -= per * times
    return [(combination, times) for entries in rows.values() for combination, times in entries]


def places(combinations: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its intervals, and the first sequence and the offset of each."""
    used: Counter[int] = Counter()
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for combination, times in combinations:
        offset = 0
        for n in combination:
            found[n].append((used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in found.items()}


def tokenized_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece, with the partition it was made in (part) and its rank there among pieces of its length (nth)."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def run(batches):
        part, seen = TaskContext.get().partitionId(), Counter()
        for rows in sliced(batches, text_col, SLICE_BYTES, "tokens"):
            at, piece, start, length, crc, nth = [], [], [], [], [], []
            ids, bounds = token_ids(vocabulary, rows.column(text_col))
            raw, bounds = memoryview(ids).cast("B"), bounds.tolist()
            for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                size = b - a + 1  # with the end id
                for k, s in enumerate(range(0, size, capacity)):
                    n = min(capacity, size - s)
                    last = s + n == size
                    got = zlib.crc32(raw[4 * (a + s) : 4 * (a + s + n - last)])
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(end, got) if last else got)
                    nth.append(seen[n])
                    seen[n] += 1
            made = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(at), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays([rows.column(id_col).take(pa.array(at, pa.int64())), *made], [id_col, "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    pieces = written(tokenized_pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    found = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32"]

    def run(batches):
        own = found.value
        for rows in batches:
            lengths, ranks = rows.column("length").to_numpy(), rows.column("rank").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            values, starts = np.unique(lengths[order], return_index=True)
            for n, at in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
                first, base, place = own[n]
                k = np.searchsorted(first, ranks[at], "right") - 1
                sequence[at] = base[k] + ranks[at] - first[k]
                offset[at] = place[k]
            yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = pieces.join(before, ["part", "length"]).select(*names, (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
