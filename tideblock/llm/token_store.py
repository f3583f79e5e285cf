"""Token-ID output: a content-addressed store of id streams.

Format. A store is a folder of Parquet tables, so that any file system Spark can
reach will hold it:

  packs/kind=doc     one row per document, in ascending id order over the files:
                     id, row, file, local_start, n_tokens, sizes (ids in each of its
                     chunks), shared (place and hash of those that stand elsewhere
                     too), payload (the ids of its other chunks, as a Zstandard
                     frame), root
  packs/kind=chunk   one row per chunk that several places share: hash, payload
                     (its ids, as a Zstandard frame)
  manifest           one row per file of documents: file, start (ids before it),
                     n_tokens, n_docs, root
  head               version, width (bytes an id takes), n_tokens, root

Ids are little-endian unsigned integers of `width` bytes, 2 where the vocabulary
allows. A document's stream is cut where the rolling hash of its last WINDOW ids
has its top bits zero, so streams that agree for a while cut alike; a chunk has
LEAST to MOST ids. A chunk's address is the SHA-256 of its ids' bytes. A document's root
is the Merkle root over the addresses of all its chunks, a file's over its documents' roots, the
store's over its files'. Sizes and shared addresses are the recipe; the addresses of
chunks that a document has alone follow from its payload and are not stored. Reading
fetches shared chunks by address, computes every address and every root, and fails
where one differs.

Repeated chunks are found by the first 128 bits of their addresses. Documents are
moved once, by range of id and row, into files of about FILE_BYTES; besides them only
the few chunks that repeat are. Null and empty texts are documents of the end id alone.
Repeated rows are stored as documents of their own, their chunks once; null ids come
first. An empty table gives a store without rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, give_back, path_bytes, scratch_path, sliced, small_batches, written
from .tokens import SLICE_BYTES, token_ids

WINDOW, LEAST, MOST, CUT_BITS = 16, 64, 4096, 8
VERSION = 2
#: Encoded bytes that go to one file of documents.
FILE_BYTES = 128 << 20
#: Places whose windows are hashed at once.
HASHED = 1 << 15
_POWERS = np.array([pow(0x9E3779B1, WINDOW - j, 1 << 32) for j in range(WINDOW)], np.uint32)
_SHARED = pa.struct([("place", pa.int32()), ("hash", pa.binary())])
_KEY = pa.struct([("a", pa.int64()), ("b", pa.int64())])
_DOC = "n_tokens long, sizes array<int>, shared array<struct<place:int,hash:binary>>, payload binary, root binary"


def marks_of(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW ids allows a cut, over any stretch of ids."""
    found = [np.empty(0, np.int64)]
    for s in range(0, len(ids) - WINDOW + 1, HASHED):  # so that what is hashed stays in a core's cache
        mixed = ids[s : s + HASHED + WINDOW - 1].astype(np.uint32)
        mixed *= np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(15)
        n = len(mixed) - WINDOW + 1
        h = mixed[:n] * _POWERS[0]
        for j in range(1, WINDOW):
            h += mixed[j : j + n] * _POWERS[j]
        found.append(np.flatnonzero(h < np.uint32(1 << 32 - CUT_BITS)) + (s + WINDOW))
    return np.concatenate(found)


def cuts(n: int, marks: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids, from the places in it where a cut is allowed."""
    out, last = [], 0
    for at in [*marks, n]:
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST or at == n and at > last:
            out.append(at)
            last = at
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Merkle root of hashes: inner nodes, and last their top with the number of leaves, are hashed after a first byte of their own; an odd node goes up as it is. Inner nodes hash an odd number of bytes, chunks an even one."""
    level = leaves
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + x + y).digest() for x, y in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[-1:] if len(level) % 2 else pairs
    return hashlib.sha256(b"\2" + len(leaves).to_bytes(8, "little") + b"".join(level)).digest()


def _encoded(docs: DataFrame, vocabulary: str, end_id: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """Of each row: n_tokens, sizes and first 128 address bits of its chunks, payload (its ids, compressed) and root."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)

        def encoded(part):  # what a slice has needed is gone, and the system's again, before the next one is encoded
            give_back()
            ids, bounds = token_ids(vocabulary, part.column(text_col))
            if width == 2 and max(end_id, int(ids.max(initial=0))) > 0xFFFF:
                raise ValueError("an id does not fit the width")
            ends = bounds[1:]
            ids = ids.astype(f"<u{width}")
            ids = np.insert(ids, ends, end_id)  # every document with its end id
            ends = ends + np.arange(1, len(ends) + 1)
            starts = np.concatenate(([0], ends[:-1]))
            data, marks = memoryview(ids).cast("B"), marks_of(ids)
            marks = marks[marks - WINDOW >= starts[np.searchsorted(starts, marks - 1, "right") - 1]]  # no window over two documents
            first = np.searchsorted(marks, starts, "right").tolist()
            last = np.searchsorted(marks, ends, "left").tolist()
            counts, sizes, keys, payloads, roots = [0], [], [], [], []
            for s, e, a, b in zip(starts.tolist(), ends.tolist(), first, last, strict=True):
                at, leaves = 0, []
                for end in cuts(e - s, (marks[a:b] - s).tolist()):
                    leaves.append(hashlib.sha256(data[(s + at) * width : (s + end) * width]).digest())
                    sizes.append(end - at)
                    at = end
                keys += [x[:16] for x in leaves]
                counts.append(len(sizes))
                payloads.append(press.compress(data[s * width : e * width]))
                roots.append(merkle(leaves))
            counts = pa.array(counts, pa.int32())
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            pairs = pa.StructArray.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1])], fields=list(_KEY))
            columns = [part.column("_row"), part.column(id_col), pa.array(ends - starts), pa.ListArray.from_arrays(counts, pa.array(sizes, pa.int32())), pa.ListArray.from_arrays(counts, pairs), pa.array(payloads, pa.binary()), pa.array(roots, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["row", "id", "n_tokens", "sizes", "keys", "payload", "root"])

        yield from map(encoded, sliced(batches, text_col, SLICE_BYTES, "tokens"))

    return docs.select(F.monotonically_increasing_id().alias("_row"), id_col, text_col).mapInArrow(run, f"row long, id {kind}, n_tokens long, sizes array<int>, keys array<struct<a:long,b:long>>, payload binary, root binary")


def _replaced(column: pa.Array, changed: dict[int, object]) -> pa.Array:
    """The column with new values at some places."""
    order = np.arange(len(column))
    order[list(changed)] = len(column) + np.arange(len(changed))
    return pa.concat_arrays([column, pa.array(list(changed.values()), column.type)]).take(pa.array(order))


def _arrange(width: int):
    """Documents in order, each after the marks of its shared chunks, to store rows. A document without marks is passed on as it is."""

    def run(batches):
        press, unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        file, start, marks = TaskContext.get().partitionId(), 0, {}
        for batch in sliced(batches, "payload"):
            place, rows = batch.column("place").to_pylist(), batch.column("row").to_pylist()
            at, recipes, payloads, chunks = [], {}, {}, []
            for i, (k, row) in enumerate(zip(place, rows, strict=True)):
                if k is not None:  # a document's marks stand before it, perhaps in another batch
                    marks.setdefault(row, {})[k] = batch.column("owner")[i].as_py()
                    continue
                at.append(i)
                if own := marks.pop(row, None):
                    data, s, kept, recipe = unpress.decompress(batch.column("payload")[i].as_py()), 0, [], []
                    for j, n in enumerate(batch.column("sizes")[i].as_py()):
                        part = data[s : s + n * width]
                        s += len(part)
                        if j in own:
                            recipe.append({"place": j, "hash": hashlib.sha256(part).digest()})
                            if own[j]:
                                chunks.append((recipe[-1]["hash"], part))
                        else:
                            kept.append(part)
                    recipes[len(at) - 1], payloads[len(at) - 1] = recipe, press.compress(b"".join(kept))
            docs = batch.select(["row", "id", "n_tokens", "sizes", "payload", "root"]).take(pa.array(at, pa.int64()))
            n_tokens = docs.column("n_tokens").to_numpy()
            local = start + np.cumsum(n_tokens) - n_tokens
            start += int(n_tokens.sum())
            n, m = len(at), len(chunks)
            if n + m:
                none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), pa.array([], _SHARED))
                columns = {
                    "kind": pa.array(["doc"] * n), "row": docs.column("row"), "id": docs.column("id"), "file": pa.array([file] * n, pa.int32()), "local_start": pa.array(local, pa.int64()), "n_tokens": docs.column("n_tokens"),
                    "sizes": docs.column("sizes"), "shared": _replaced(none, recipes), "payload": _replaced(docs.column("payload"), payloads), "root": docs.column("root"), "hash": pa.nulls(n, pa.binary()),
                }
                for name, values in (("kind", ["chunk"] * m), ("payload", [press.compress(x) for _, x in chunks]), ("hash", [x for x, _ in chunks])):
                    columns[name] = pa.concat_arrays([columns[name], pa.array(values, columns[name].type)])
                yield pa.RecordBatch.from_arrays([x if len(x) == n + m else pa.concat_arrays([x, pa.nulls(m, x.type)]) for x in columns.values()], list(columns))

    return run


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row of docs and write the store at `path`."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    staged_path, marks_path = scratch_path(spark, "encoded"), scratch_path(spark, "marks")
    encoded = _encoded(docs, vocabulary, end_id, width, id_col, text_col)
    with small_batches(spark):
        encoded.write.option("compression", "lz4_raw").parquet(staged_path)
    staged = spark.read.schema(encoded.schema).parquet(staged_path)
    places = staged.selectExpr("row", "id", "posexplode(keys) AS (place, key)").selectExpr("row", "id", "place", "key.a AS a", "key.b AS b")
    spot = F.struct("id", "row", "place")
    shared = places.groupBy("a", "b").agg(F.min(spot).alias("low"), F.count("*").alias("n")).filter("n > 1").select("a", "b", "low")
    shared = written(shared, "shared")  # so that the join's sides are dealt for it alone and a hot address can be split
    marks = places.join(shared, ["a", "b"]).select("row", "id", "place", spot.eqNullSafe(F.col("low")).alias("owner"))
    marks.write.option("compression", "zstd").parquet(marks_path)  # as the range of ids is sampled first
    marks = spark.read.schema(marks.schema).parquet(marks_path)
    both = staged.drop("keys").withColumns({"place": F.lit(None).cast("int"), "owner": F.lit(None).cast("boolean")}).unionByName(marks, allowMissingColumns=True)
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-path_bytes(spark, staged_path) // FILE_BYTES))  # a task sorts its part in memory
    order = [F.col("id").asc_nulls_first(), F.col("row")]
    ordered = both.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("place").asc_nulls_last())
    rows = ordered.select("row", "id", "n_tokens", "sizes", "payload", "root", "place", "owner").mapInArrow(_arrange(width), f"kind string, row long, id {kind}, file int, local_start long, {_DOC}, hash binary")
    with small_batches(spark):
        rows.write.option("compression", "lz4_raw").partitionBy("kind").parquet(f"{path}/packs")
    delete_path(spark, staged_path)
    delete_path(spark, marks_path)
    _write_manifest(spark, path, kind, width)


def _packs(spark: SparkSession, path: str, id_kind: str) -> DataFrame:
    return spark.read.schema(f"row long, id {id_kind}, file int, local_start long, {_DOC}, hash binary, kind string").parquet(f"{path}/packs")


def _file_roots(documents: DataFrame) -> DataFrame:
    """file, n_tokens, n_docs and Merkle root of each file's documents, streamed in order."""

    def run(batches):
        leaves, file, total = [], None, 0

        def closed():
            return pa.RecordBatch.from_pydict({"file": [file], "n_tokens": [total], "n_docs": [len(leaves)], "root": [merkle(leaves)]}, schema=pa.schema([("file", pa.int32()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("root", pa.binary())]))

        for batch in batches:
            for f, n, root in zip(*(batch.column(k).to_pylist() for k in ("file", "n_tokens", "root")), strict=True):
                if f != file:
                    if leaves:
                        yield closed()
                    leaves, file, total = [], f, 0
                leaves.append(root)
                total += n
        if leaves:
            yield closed()

    heads = documents.select("file", "local_start", "row", "n_tokens", "root").repartition("file").sortWithinPartitions("file", "local_start", "row").select("file", "n_tokens", "root")
    return heads.mapInArrow(run, "file int, n_tokens long, n_docs long, root binary")


def _write_manifest(spark: SparkSession, path: str, id_kind: str, width: int) -> None:
    files = sorted(_file_roots(_packs(spark, path, id_kind).filter("kind = 'doc'")).collect())  # one row per file
    starts = np.cumsum([0, *(r["n_tokens"] for r in files)]).tolist()
    spark.createDataFrame([(r["file"], s, r["n_tokens"], r["n_docs"], bytes(r["root"])) for r, s in zip(files, starts, strict=False)], "file int, start long, n_tokens long, n_docs long, root binary").coalesce(1).write.parquet(f"{path}/manifest")
    spark.createDataFrame([(VERSION, width, id_kind, starts[-1], merkle([bytes(r["root"]) for r in files]))], "version int, width int, id_kind string, n_tokens long, root binary").coalesce(1).write.parquet(f"{path}/head")


def verify_store(spark: SparkSession, path: str) -> None:
    """Raise unless the files' roots and the store's root follow from the documents' roots."""
    head = spark.read.parquet(f"{path}/head").first()
    found = sorted((r["file"], r["n_tokens"], r["n_docs"], bytes(r["root"])) for r in _file_roots(_packs(spark, path, head["id_kind"]).filter("kind = 'doc'")).collect())
    listed = sorted((r["file"], r["n_tokens"], r["n_docs"], bytes(r["root"])) for r in spark.read.parquet(f"{path}/manifest").collect())
    if head["version"] != VERSION or found != listed or merkle([x[3] for x in listed]) != bytes(head["root"]):
        raise ValueError(f"the store at {path} does not match its manifest")


def read_store(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """id, start, n_tokens, ids_crc32 (of all ids as 32-bit integers), and `ids` if asked for, of each document, rebuilt and checked."""
    head = spark.read.parquet(f"{path}/head").first()
    width, kind = head["width"], head["id_kind"]
    packs = _packs(spark, path, kind)
    docs = packs.filter("kind = 'doc'").select("row", "id", "file", "local_start", "n_tokens", "sizes", "shared", "payload", "root")
    manifest = F.broadcast(spark.read.parquet(f"{path}/manifest").select("file", F.col("start").alias("file_start")))  # one row per file
    nothing = {"place": F.lit(None).cast("int"), "part": F.lit(None).cast("binary")}
    alone = docs.filter("size(shared) = 0").withColumns(nothing)
    some = docs.filter("size(shared) > 0")
    wanted = some.selectExpr("row", "inline(shared)")
    fetched = wanted.join(packs.filter("kind = 'chunk'").selectExpr("hash", "payload AS part"), "hash").select("row", "place", "part")
    together = some.withColumns(nothing).unionByName(fetched, allowMissingColumns=True).repartition("row").sortWithinPartitions("row", F.col("place").asc_nulls_last())

    def run(batches):
        unpress, parts = zstandard.ZstdDecompressor(), {}
        for batch in sliced(batches, "payload"):
            rows, place = batch.column("row").to_pylist(), batch.column("place").to_pylist()
            sizes, payloads, roots, totals = (batch.column(k).to_pylist() for k in ("sizes", "payload", "root", "n_tokens"))
            at, crcs, every = [], [], []
            for i, (row, k) in enumerate(zip(rows, place, strict=True)):
                if k is not None:
                    parts.setdefault(row, {})[k] = unpress.decompress(batch.column("part")[i].as_py())
                    continue
                own, s, leaves = memoryview(unpress.decompress(payloads[i])), 0, []
                if found := parts.pop(row, {}):
                    pieces = []
                    for j, n in enumerate(sizes[i]):
                        if j in found:
                            pieces.append(found[j])
                        else:
                            pieces.append(own[s : s + n * width])
                            s += len(pieces[-1])
                    own, s = memoryview(b"".join(pieces)), 0
                for n in sizes[i]:
                    leaves.append(hashlib.sha256(own[s : s + n * width]).digest())
                    s += n * width
                for x in batch.column("shared")[i].as_py():
                    if leaves[x["place"]] != x["hash"]:
                        raise ValueError(f"chunk {x['place']} of row {row} is damaged")
                if merkle(leaves) != roots[i] or not s == len(own) == width * totals[i]:
                    raise ValueError(f"row {row} does not match its recipe")
                ids = np.frombuffer(own, f"<u{width}").astype("<u4").tobytes()
                at.append(i)
                crcs.append(zlib.crc32(ids))
                every.append(ids if keep_ids else None)
            if at:
                kept = batch.select(["id", "file", "local_start", "n_tokens"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(crcs, pa.int64()), pa.array(every, pa.binary())], ["id", "file", "local_start", "n_tokens", "ids_crc32", "ids"])

    made = f"id {kind}, file int, local_start long, n_tokens long, ids_crc32 long, ids binary"
    names = ["row", "id", "file", "local_start", "n_tokens", "sizes", "shared", "payload", "root", "place", "part"]
    rows = alone.select(*names).mapInArrow(run, made).unionByName(together.select(*names).mapInArrow(run, made))
    return rows.join(manifest, "file").select("id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))
