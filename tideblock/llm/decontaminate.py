"""Benchmark decontamination by winnowing.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Of every
window of 8 words, the k-gram with the smallest hash is its fingerprint, so any 8
words that a document shares with an item have a fingerprint in common. Shared
fingerprints are extended to every window that holds them and those are compared
word by word: the result is exact.

An item of fewer than 8 words, but not none, is one window. Items with null id or
null text have no windows. Null and empty documents have no words. Repeated
documents each give a row; an empty benchmark leaves all documents clean. The
benchmark is handled in blocks of about BLOCK_BYTES of text, each small enough
for a worker; with more than one block the documents are read once for each,
one block after the other: the driver holds one at a time, and what it found is written.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, sliced, words_of, written

BLOCK_BYTES = 8 << 20
#: Places in a window where its fingerprint can stand.
PLACES = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k ids from each place on."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ ids[j : j + n].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def winnow(ids: np.ndarray, k: int, places: int) -> np.ndarray:
    """Places of the k-grams that are the smallest, the last of equals, in any run of `places` k-grams."""
    h = grams(ids, k)
    n = len(h) - places + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = h[:n].copy(), np.arange(n)
    for j in range(1, places):
        lower = h[j : j + n] <= best
        best[lower] = h[j : j + n][lower]
        at[lower] = np.nonzero(lower)[0] + j
    return np.unique(at)


class Index:
    """Windows and fingerprints of benchmark items; kept by the workers."""

    def __init__(self, items: list[tuple[str, bytes]], span: int = 8):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        known: dict[str, int] = {}
        self.windows: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
        prints: dict[int, set[int]] = defaultdict(set)
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            if name not in known:
                known[name] = len(self.names)
                self.names.append(name)
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
            n = min(span, len(ids))
            for s in range(len(ids) - n + 1):
                self.windows[n][ids[s : s + n].tobytes()].add(known[name])
            k, places = self.gram(n)
            prints[n].update(grams(ids, k)[winnow(ids, k, places)].tolist())
        self.windows = {n: dict(x) for n, x in self.windows.items()}
        self.prints = {n: np.array(sorted(x), np.uint64) for n, x in prints.items()}

    @staticmethod
    def gram(span: int) -> tuple[int, int]:
        k = max(1, span - PLACES + 1)
        return k, span - k + 1

    def hits(self, documents: list[list[bytes]]) -> list[tuple[list[int], set[int]]]:
        """For each document's words: runs of hit words as start, end, start, end, ...; and the items found."""
        sizes = np.array([len(x) for x in documents], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        ids = np.zeros(int(sizes.sum()) + len(sizes), np.int64)  # 0 stands between documents and for words of no item
        for x, at in zip(documents, starts.tolist(), strict=True):
            ids[at : at + len(x)] = np.fromiter(map(self.vocabulary.get, x, repeat(0)), np.int64, len(x))
        covered = np.zeros(len(ids), bool)
        found: list[set[int]] = [set() for _ in documents]
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, windows in self.windows.items():
            k, places = self.gram(n)
            h = grams(ids, k)
            last = len(ids) - n + 1
            if last <= 0:
                continue
            whole = unknown[n : n + last] == unknown[:last]  # windows of known words only
            # a fingerprint counts where some window of known words chose it
            best, at = h[:last].copy(), np.zeros(last, np.int64)
            for j in range(1, places):
                lower = h[j : j + last] <= best
                best[lower] = h[j : j + last][lower]
                at[lower] = j
            chosen = np.unique((np.arange(last) + at)[whole])
            shared = chosen[np.isin(h[chosen], self.prints[n])]
            around = np.unique((shared[:, None] - np.arange(places)[None, :]).ravel())  # extend to each window that holds one
            around = around[(around >= 0) & (around < last)]
            for s in around[whole[around]].tolist():
                if items := windows.get(ids[s : s + n].tobytes()):
                    covered[s : s + n] = True
                    found[int(np.searchsorted(starts, s, "right")) - 1] |= items
        turns = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))  # no run crosses the gap between documents
        of = np.searchsorted(starts, turns, "right") - 1
        of[1::2] = of[0::2]
        runs: list[list[int]] = [[] for _ in documents]
        for d, place in zip(of.tolist(), (turns - starts[of]).tolist() if len(turns) else [], strict=True):
            runs[d].append(place)
        return list(zip(runs, found, strict=True))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    items = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("item_text")).filter("name IS NOT NULL AND item_text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("item_text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    return [items.filter(F.pmod(F.xxhash64("name", "item_text"), F.lit(n)) == i) for i in range(n)]


def _matched(docs: DataFrame, items: DataFrame, row: str, id_col: str, text_col: str, span: int) -> tuple[Broadcast, DataFrame]:
    """The index of the items, and of each row: n_words, runs of hit words, names of the items found."""
    index = docs.sparkSession.sparkContext.broadcast(Index([(r["name"], r["item_text"].encode()) for r in items.collect()], span))
    keys = list(dict.fromkeys([row, id_col]))

    def run(batches):
        own = index.value
        for part in sliced(batches, text_col):
            words = [words_of(x) for x in bytes_of(part.column(text_col))]
            runs, names = [], []
            for places, found in own.hits(words):
                runs.append(places)
                names.append(sorted(own.names[i] for i in found))
            made = [pa.array([len(x) for x in words], pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *made], [*keys, "n_words", "runs", "items"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return index, docs.select(*keys, text_col).mapInArrow(run, f"{kinds}, n_words long, runs array<bigint>, items array<string>")


_LENGTH = """aggregate(sequence(1, size({0}) div 2), named_struct('total', 0L, 'end', 0L),
  (x, i) -> named_struct('total', x.total + greatest(0L, {0}[2*i-1] - greatest({0}[2*i-2], x.end)), 'end', greatest(x.end, {0}[2*i-1])),
  x -> x.total)"""


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 8, least_items: int = 2) -> DataFrame:
    """id, n_words, n_hit, n_items, items (names), items_sha256, contaminated of each row of docs."""
    blocks = _blocks(benchmark, item_col, item_text_col)
    if len(blocks) == 1:
        _, found = _matched(docs, blocks[0], id_col, id_col, text_col, span)
    else:  # rows are numbered once, in a written table, so that each block's finds meet again
        rows = written(docs.select(F.monotonically_increasing_id().alias("_row"), id_col, text_col), "documents")
        both = None
        for x in blocks:
            index, matched = _matched(rows, x, "_row", id_col, text_col, span)
            part = written(matched, "found")
            index.destroy()  # the written table needs it no more
            both = part if both is None else both.unionByName(part)
        pairs = "transform(sequence(1, size(runs) div 2), i -> struct(runs[2*i-2] AS s, runs[2*i-1] AS e))"
        both = both.withColumn("pairs", F.expr(f"if(size(runs) = 0, array(), {pairs})"))
        found = both.groupBy("_row", id_col, "n_words").agg(
            F.expr("flatten(transform(array_sort(flatten(collect_list(pairs))), p -> array(p.s, p.e)))").alias("runs"), F.expr("array_sort(array_distinct(flatten(collect_list(items))))").alias("items")
        )
    n_hit = F.expr("if(size(runs) = 0, 0L, " + _LENGTH.format("runs") + ")").alias("n_hit")
    return found.select(id_col, "n_words", n_hit, F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") >= least_items).alias("contaminated"))
