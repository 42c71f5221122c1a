"""Snapshots of a table: versions side by side, and a log of pointers that names the current one.

A version's files are written first, under a name of their own. Then one small file, <path>/_log/<number>.json, makes it current: it is
written aside and moved to the next number, which only one of several writers can take. So there is no moment without a table, a
reader sees a version whole or not at all, and a writer whose expectation is out of date is refused instead of overwriting. Old versions
stay for readers that have begun; vacuum() deletes those that are no longer current and older than a given age.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.sinks import _files

DIGITS = 12


class Conflict(RuntimeError):
    """Another writer has published since the version that this one was made from."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self.at = _files(spark, self.path)

    def _log(self) -> list[int]:
        """Numbers of the log, ascending."""
        folder = self.at(f"{self.path}/_log")
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _entry(self, number: int) -> dict:
        stream = self.fs.open(self.at(self._name(number)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _name(self, number: int) -> str:
        return f"{self.path}/_log/{number:0{DIGITS}d}.json"

    def version(self) -> int:
        """The current version's number; 0 if nothing was published."""
        return max(self._log(), default=0)

    def publish(self, df: DataFrame, order: str | None = "created_at", expected: int | None = None, note: str = "") -> int:
        """Write *df* as the next version and make it current; returns its number.

        With *expected* the commit fails with Conflict if another version has become current since; without it the table is
        replaced whatever it is now. Rows are range-partitioned and sorted by *order*.
        """
        folder = f"v-{uuid.uuid4().hex}"
        (df.repartitionByRange(order).sortWithinPartitions(order) if order else df).write.parquet(f"{self.path}/{folder}")
        aside = self.at(f"{self.path}/_log/.{folder}")
        out = self.fs.create(aside, True)
        out.write(bytearray(json.dumps({"folder": folder, "time": time.time(), "note": note}).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        while True:
            now = self.version()
            if expected is not None and now != expected:
                self.fs.delete(aside, False)
                self.fs.delete(self.at(f"{self.path}/{folder}"), True)
                raise Conflict(f"version {now} is current, not {expected}")
            try:
                context.rename(aside, self.at(self._name(now + 1)), none)  # fails where the number is taken
                return now + 1
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" not in str(e.java_exception):
                    raise

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or an earlier one that is still there."""
        number = version or self.version()
        if not number:
            raise FileNotFoundError(f"nothing is published at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{self._entry(number)['folder']}")

    def vacuum(self, age: float = 3600.0) -> int:
        """Delete folders that no current version names and that are older than *age* seconds, and their log entries; returns how many."""
        log = self._log()
        held = {self._entry(n)["folder"]: n for n in log}
        newest, before, gone = max(log, default=0), time.time() - age, 0
        for f in self.fs.listStatus(self.at(self.path)):
            name = f.getPath().getName()
            if name.startswith("v-") and held.get(name) != newest and f.getModificationTime() / 1000 < before:
                if name in held:
                    self.fs.delete(self.at(self._name(held[name])), False)
                self.fs.delete(f.getPath(), True)
                gone += 1
        return gone
