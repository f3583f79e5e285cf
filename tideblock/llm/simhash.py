"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two fingerprints at
most 3 bits apart differ in at most one bit of one segment, so each distinct
fingerprint looks up, for either segment, the segment itself and those one bit
above it (the pair with the bit the other way round is found from its other
end), and complete distances are verified in the join. Where a segment is shared by
more than CROWDED fingerprints, they meet only if one of four pieces of the other
segment is equal too, as it must be with 3 differing bits.

Where a Jaccard similarity is asked for too, texts are also linked whose sets of
5-word shingles (or whole texts, where shorter) are that similar. Candidates share
one of BANDS bands of ROWS MinHash values: a pair at 0.8 is missed once in 4500.
The whole sets of candidates are compared, as 64-bit hashes of their shingles. In a
band's bucket of up to CROWD texts all meet. In one beyond that some are asked against the rest, first those
with most company, then more of those outside the bucket's largest component, until all
of these have been asked: what was not compared lies in one component already. Asked
texts are compared with those of whose SIGNED further MinHash values enough agree: a
pair at 0.8 is missed less than once in 100,000. Their number is that of asked texts
times the bucket's, so a bucket of many texts that are nearly, but not, similar is the dear case.

Null and empty texts have fingerprint zero, which links like any other. Exact
copies share one node, so a group of copies of any size costs one row; repeated
rows and ties are each returned with their component. An empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, sliced, tasks, written
from .components import connected

#: Shingles that are unpacked to bits at once.
BLOCK = 1 << 15
#: Fingerprints that share a segment and all meet.
CROWDED = 512
#: MinHash bands, values in a band, texts of a bucket that all meet, and those asked first in larger ones.
BANDS, ROWS, CROWD, ASKED = 16, 4, 16, 4
#: MinHash values by which texts of large buckets are told apart, four bits of each, and how many may differ.
SIGNED, DIFFER = 512, 136
_MULTIPLY = np.random.default_rng(1).integers(0, 1 << 63, BANDS * ROWS + SIGNED, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes, k: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash over all k-word shingles of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - k + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(k, len(words)) - 1 :].tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), ">u8", n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        counts += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """id and fp (signed long) of each row."""

    def run(batches):
        for part in sliced(batches, text_col):
            fps = pa.array([fingerprint(x, k, seed) for x in bytes_of(part.column(text_col))], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(id_col), fps], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def shingles(text: bytes, k: int = 5) -> set[bytes]:
    """All runs of k words, or the whole of a shorter text that has words."""
    words = text.lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def shingle_hashes(text: bytes, k: int = 5) -> np.ndarray:
    found = shingles(text, k)
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def minima(hashes: np.ndarray, multiply: np.ndarray) -> np.ndarray:
    """MinHash values of a set of hashes, one for each multiplier."""
    least = np.full(len(multiply), np.iinfo(np.uint64).max)
    step = max(1, (BLOCK << 3) // len(multiply))
    for i in range(0, len(hashes), step):
        mixed = hashes[i : i + step, None] * multiply
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(axis=0))
    return least


def bands(text: bytes, k: int = 5) -> list[int]:
    """BANDS hashes, each of ROWS MinHash values of the shingles; none for a text without words."""
    hashes = shingle_hashes(text, k)
    if not len(hashes):
        return []
    least = minima(hashes, _MULTIPLY[: BANDS * ROWS])
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The last four bits of SIGNED MinHash values, in columns of 64: bit 0 of the first 64 values, bit 1 of them, and so on."""
    least = minima(hashes, _MULTIPLY[BANDS * ROWS :])
    bits = (least[:, None] >> np.arange(4, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).reshape(-1, 64, 4)
    return np.packbits(bits.transpose(0, 2, 1).reshape(-1, 64), axis=1).view(">i8").ravel().astype(np.int64)


_SIGNS = [f"s{i}" for i in range(SIGNED // 16)]


def _sets(wanted: DataFrame, texts: DataFrame, k: int, name: str) -> DataFrame:
    """text_id, size and hashes of the shingles of the texts wanted, and their signatures."""
    needed = texts.join(wanted, "text_id", "left_semi").groupBy("text_id").agg(F.first("body").alias("body"))

    def run(batches):
        for part in sliced(batches, "body"):
            found = [shingle_hashes(x, k) for x in bytes_of(part.column("body"))]
            signs = np.array([signature(x) for x in found], np.int64).reshape(-1, len(_SIGNS))
            yield pa.RecordBatch.from_arrays([part.column("text_id"), pa.array([len(x) for x in found], pa.int32()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), *(pa.array(x) for x in signs.T)], ["text_id", "size", "hashes", *_SIGNS])

    return written(needed.mapInArrow(run, "text_id long, size int, hashes array<long>, " + ", ".join(f"{x} long" for x in _SIGNS)), name)


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs text_id, other of texts and their fingerprints fp, other_fp: a, b, the fingerprints of those as similar as asked."""
    both = pairs.join(sets.select("text_id", "size", "hashes"), "text_id").join(sets.selectExpr("text_id AS other", "size AS other_size", "hashes AS other_hashes"), "other")
    shared = both.withColumn("n", F.size(F.array_intersect("hashes", "other_hashes")))
    return written(shared.filter(F.col("n") >= F.lit(least) * (F.col("size") + F.col("other_size") - F.col("n"))).selectExpr("fp AS a", "other_fp AS b"), "alike")


def similar(docs: DataFrame, near: DataFrame, text_col: str = "text", least: float = 0.8, most: int = 3, k: int = 5) -> DataFrame:
    """Components (node, root) of fingerprints over links near (a, b) and those of texts whose sets of k-word shingles have a Jaccard similarity of `least` or more."""
    texts = docs.select(F.xxhash64(text_col).alias("text_id"), F.col(text_col).alias("body")).filter("body IS NOT NULL")

    def sketch(batches):
        for part in sliced(batches, "body"):
            bodies = bytes_of(part.column("body"))
            yield pa.RecordBatch.from_arrays([part.column("text_id"), pa.array([fingerprint(x) for x in bodies], pa.int64()), pa.array([bands(x, k) for x in bodies], pa.list_(pa.int64()))], ["text_id", "fp", "bands"])

    sketches = texts.mapInArrow(sketch, "text_id long, fp long, bands array<long>")
    # one row of each text: a fingerprint and the bands follow from it
    members = written(sketches.selectExpr("text_id", "fp", "explode(bands) AS band").distinct(), "bands")
    buckets = members.groupBy("band").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    buckets = written(buckets.filter("n > 1 AND low != high").select("band", "n"), "buckets")
    placed = written(members.join(buckets, "band"), "placed")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) > most
    few = placed.filter(F.col("n") <= CROWD).select("text_id", "fp", "band")
    met = few.join(few.selectExpr("text_id AS other", "fp AS other_fp", "band"), "band").filter("text_id < other").filter(far)
    pairs = written(met.select("text_id", "fp", "other", "other_fp").distinct(), "pairs")
    wanted = pairs.select("text_id").unionByName(pairs.selectExpr("other AS text_id")).distinct()
    groups = written(connected(near.unionByName(_alike(pairs, _sets(wanted, texts, k, "sets"), least))), "groups")

    crowd = placed.filter(F.col("n") > CROWD)
    weights = written(crowd.groupBy("text_id", "fp").agg(F.sum("n").alias("weight")), "weights")
    if weights.isEmpty():
        return groups
    sets = _sets(weights, texts, k, "crowd-sets")
    # the rounds see short rows of crowded buckets alone: as many tasks as these need
    parts = tasks(docs.sparkSession, crowd.count())
    crowd = written(crowd.select("band", "text_id").join(weights, "text_id").join(sets.drop("hashes"), "text_id").coalesce(parts), "crowd")
    asked = crowd.select("band", "text_id").limit(0)
    ask, by_weight = ASKED, Window.partitionBy("band").orderBy(F.desc("weight"), "text_id")
    while True:
        now = written(crowd.join(groups.withColumnsRenamed({"node": "fp", "root": "label"}), "fp", "left").withColumn("label", F.coalesce("label", "fp")).coalesce(parts), "now")
        largest = now.groupBy("band", "label").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).coalesce(parts)
        opened = largest.filter("labels > 1").select("band", F.col("top.label").alias("main"))
        left = now.join(opened, "band").coalesce(parts).join(asked, ["band", "text_id"], "left_anti").coalesce(parts)
        if ask > ASKED:  # at first those with most company are asked, whatever their component
            left = left.filter("label != main")
        picked = written(left.withColumn("nth", F.row_number().over(by_weight)).filter(F.col("nth") <= ask).select("band", "text_id", "fp", "label", "size", *_SIGNS).coalesce(parts), "asked")
        if picked.isEmpty():
            return groups
        others = picked.select("band", F.col("text_id").alias("other"), F.col("fp").alias("other_fp"), F.col("label").alias("other_label"), F.col("size").alias("other_size"), *(F.col(x).alias(f"o{x}") for x in _SIGNS))
        differ = [F.col(x).bitwiseXOR(F.col(f"o{x}")) for x in _SIGNS]
        unlike = reduce(Column.__add__, [F.bit_count(reduce(Column.bitwiseOR, differ[i : i + 4])) for i in range(0, len(differ), 4)])
        sized = F.least("size", "other_size") >= F.lit(least) * F.greatest("size", "other_size")
        met = now.join(others, "band").filter("label != other_label").filter(sized & far).filter(unlike <= DIFFER)
        found = _alike(written(met.select("text_id", "fp", "other", "other_fp").distinct(), "pairs"), sets, least)
        if not found.isEmpty():
            groups = written(connected(groups.selectExpr("node AS a", "root AS b").unionByName(found)).coalesce(parts), "groups")
        asked = asked.unionByName(picked.select("band", "text_id"))
        ask *= 16


def links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Pairs a, b of distinct fingerprints in column fp at most `most` (up to 3) bits apart; a pair can come twice."""
    if not 0 <= most <= 3:
        raise ValueError("two segments with balls of one bit reach 3 bits at most")
    halves = "array(struct(0 AS seg, fp & 4294967295L AS half), struct(1 AS seg, shiftrightunsigned(fp, 32) AS half))"
    parts = nodes.selectExpr("fp", f"inline({halves})")
    above = "filter(transform(sequence(0, 31), i -> half | shiftleft(1L, i)), x -> x != half)"
    probes = parts.selectExpr("fp AS a", "seg", "half AS own", f"explode(concat(array(half), {above})) AS half").selectExpr("a", "seg", "half", "own = half AS same")
    close = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most) & (F.col("a") != F.col("b")) & (~F.col("same") | (F.col("a") < F.col("b")))
    met = lambda left, right, key: left.join(right.withColumnRenamed("fp", "b").hint("merge"), key).filter(close).select("a", "b")
    crowded = written(parts.groupBy("seg", "half").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select("seg", "half"), "crowded")
    if crowded.isEmpty():
        return met(probes, parts, ["seg", "half"])
    # a crowded segment's fingerprints are told apart by pieces of the other segment
    pieces = "posexplode(transform(sequence(0, 3), i -> shiftrightunsigned({0}, 32 * (1 - seg) + 8 * i) & 255)) AS (nth, piece)"
    apart = lambda df: df.join(crowded, ["seg", "half"], "left_anti")
    split = lambda df, fp: df.join(crowded, ["seg", "half"], "left_semi").selectExpr("*", pieces.format(fp))
    return met(apart(probes), apart(parts), ["seg", "half"]).unionByName(met(split(probes, "a"), split(parts, "fp"), ["seg", "half", "nth", "piece"]))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3, least: float | None = None) -> DataFrame:
    """Of each row: id, fp and component_id, the smallest id reachable over links of `most` bits or fewer (null ids give no name), and over those of a Jaccard similarity of `least` or more where that is given.

    The fingerprints are kept as a table, as hashing all shingles is the dear part. Those
    of more than a thousandth of the rows, a thousand at most, are broadcast to
    their rows at the end, so that no task sees all rows of one.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")), "nodes")
    near = links(nodes.select("fp"), most)
    groups = connected(near) if least is None else similar(docs, near, text_col, least, most)
    # few fingerprints have links: the component's smallest id is found among those alone
    named = groups.join(nodes, groups.node == nodes.fp).groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = groups.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    owners = written(nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id")), "owners")
    total = owners.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(owners.filter(F.col("n") * 1000 > total).select("fp", "component_id"))
    rest = fps.join(hot.select("fp"), "fp", "left_anti").join(owners.filter(F.col("n") * 1000 <= total).select("fp", "component_id"), "fp")
    return fps.join(hot, "fp").unionByName(rest).select(id_col, "fp", "component_id")
