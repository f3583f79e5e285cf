"""Which batches of a store count: a log of numbered commits.

A batch's files are written first, under a number that nobody else has; one commit
then makes it count, and may end others in the same step. A commit is written whole
beside the log and renamed to the next number, which fails where another writer has
taken that: it is then tried again on top. So a reader sees all of a commit or none,
and whatever a writer that died has left is never read. Each SNAPSHOT-th commit
states all batches, so that a reader looks at few of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..model import EngineError

SNAPSHOT = 64


class Commits:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def children(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, version: int) -> dict:
        fs, p = self._at(f"{self.path}/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def live(self) -> tuple[dict[int, list[str]], int]:
        """Batches that count, each with the names it was given, and the number of the last commit (-1: none)."""
        versions = [int(x[:12]) for x in self.children(self.path) if x.endswith(".json") and x[:12].isdigit()]
        last = max(versions, default=-1)
        found: dict[int, list[str]] = {}
        for v in range(max(0, last // SNAPSHOT * SNAPSHOT), last + 1):
            record = self._read(v)
            if "live" in record:
                found = {}
            for b in record.get("remove", []):
                found.pop(b, None)
            found |= {b: names for b, names in record.get("live", record["add"])}
        return found, last

    def claim(self) -> int:
        """A number for a new batch, which no other call gets."""
        number = max([int(x) for x in self.children(f"{self.path}/claims") if x.isdigit()], default=-1) + 1
        while True:
            fs, p = self._at(f"{self.path}/claims/{number}")
            try:
                fs.create(p, False).close()
                return number
            except Py4JJavaError as e:
                if "AlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                number += 1

    def commit(self, batch: int, names: Sequence[str] = (), remove: Sequence[int] = ()) -> bool:
        """Make the batch count and end those of `remove`, in one step. False if another batch that stays has one of its names already. Raises if a batch to remove has ended meanwhile."""
        while True:
            live, version = self.live()
            if lost := [b for b in remove if b not in live]:
                raise EngineError(f"another writer has replaced batches {lost}")
            kept = {b: n for b, n in live.items() if b not in remove}
            if set(names) & {x for n in kept.values() for x in n}:
                return False
            add = [[batch, list(names)]]
            record = {"add": add, "remove": list(remove)}
            if (version + 1) % SNAPSHOT == 0:
                record["live"] = [[b, n] for b, n in kept.items()] + add
            if self._put(version + 1, json.dumps(record)):
                return True

    def _put(self, version: int, text: str) -> bool:
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fs, beside = self._at(f"{self.path}/.{uuid.uuid4().hex}")
        _, final = self._at(f"{self.path}/{version:012d}.json")
        out = fs.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(beside), fs.makeQualified(final), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            return True
        except Py4JJavaError as e:
            fs.delete(beside, False)
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
