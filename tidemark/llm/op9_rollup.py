"""Delta-maintained token rollups with idempotent batch commits.

A change says that a document was inserted, deleted or recounted. It becomes a signed delta: +1 document and
+tokens, -1 and -tokens, or both where a revision moves a document to another source, language or tokenizer
version. A batch's deltas are summed by key and written to a folder of their own attempt; the batch counts from
the moment its commit file is there. Such a file is written aside and moved into place, which fails where another
attempt was first, so a batch counts once however often it is applied, retried or applied at the same time.
compact() folds all that counts into one table in the same way: fold n + 1 holds fold n and the batches since,
and its file, which names them, replaces fold n at once. A break at any point leaves the totals as they were
before or as they are after. vacuum() deletes what no longer counts.

The store: data/<attempt>/, commits/<batch> (names its attempt), folds/<n> (names its attempt and members). The
driver lists commits and folds, a few bytes a batch, and no rows of data.

Edge cases: null source, language or version are keys of their own. Null counts are 0. A change that lacks
its operation or its old count is an error where it needs it (delete, revise): see signed(). Repeated rows
of a batch are repeated changes. Where there is a change_id column, rows of one id are one change, and if they differ
the least of them counts; rows with a null change_id are changes each. Ids are compared within a batch, not
between batches. An empty batch commits no rows. A rollup without batches is empty. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("source", "lang", "tokenizer")
SCHEMA = T.StructType([*(T.StructField(k, T.StringType()) for k in KEYS), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])
#: Columns of a change that are read, where they are there.
READ = ("op", *KEYS, "tokens", *(f"old_{k}" for k in KEYS), "old_tokens")


def single(changes: DataFrame) -> DataFrame:
    """One row for each change_id; rows without one stay."""
    if "change_id" not in changes.columns:
        return changes
    names = [c for c in READ if c in changes.columns]
    known = changes.where("change_id is not null").groupBy("change_id").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    return known.unionByName(changes.where("change_id is null").select(*names))


def signed(changes: DataFrame) -> DataFrame:
    """Changes as signed rows of KEYS, n_docs, n_tokens.

    *changes*: op (insert, delete, revise), source, lang, tokenizer, tokens; for delete the keys and tokens are
    those counted before; for revise old_source, old_lang, old_tokenizer (where absent: as the new ones) and
    old_tokens are. An unknown op or a revision without old_tokens raises.
    """
    changes = single(changes)
    has = set(changes.columns)
    old = lambda k: F.col(f"old_{k}") if f"old_{k}" in has else F.col(k)
    tokens = F.coalesce(F.col("tokens").cast("long"), F.lit(0))
    before = F.col("old_tokens").cast("long") if "old_tokens" in has else F.lit(None).cast("long")
    op = F.col("op")
    error = F.raise_error(F.concat(F.lit("not a valid change: "), F.coalesce(op, F.lit("null")))).cast("long")

    def row(keys: list[Column], docs: int, words: Column) -> Column:
        return F.struct(*(k.cast("string").alias(n) for k, n in zip(keys, KEYS, strict=True)), F.lit(docs).cast("long").alias("n_docs"), words.alias("n_tokens"))

    new_keys, old_keys = [F.col(k) for k in KEYS], [old(k) for k in KEYS]
    rows = (
        F.when(op == "insert", F.array(row(new_keys, 1, tokens)))
        .when(op == "delete", F.array(row(new_keys, -1, -tokens)))
        .when((op == "revise") & before.isNotNull(), F.array(row(old_keys, -1, -before), row(new_keys, 1, tokens)))
        .otherwise(F.array(row(new_keys, 0, error)))
    )
    return changes.select(F.explode(rows).alias("d")).select("d.*")


def summed(rows: DataFrame) -> DataFrame:
    """Totals by key. Sums are partial in each task before the shuffle, so a hot key costs one row a task."""
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def insertions(counted: DataFrame, tokenizer: str) -> DataFrame:
    """Changes that insert every row of (source, lang, tokens) under a tokenizer version."""
    return counted.select(F.lit("insert").alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), "tokens")


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)

    # -- files

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_data(self, rows: DataFrame) -> str:
        """Write a table of its own; it counts once a commit names it."""
        attempt = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{attempt}")
        return attempt

    def _aside(self, text: str) -> str:
        """Write a small file whole, where nothing reads it."""
        name = f"aside/{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(f"{self.path}/{name}"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return name

    def _move(self, source: str, target: str) -> bool:
        """Move a file into place at once; False if there is one already."""
        folder = self._path(f"{self.path}/{target.rpartition('/')[0]}")
        self._fs.mkdirs(folder)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._files.rename(self._path(f"{self.path}/{source}"), self._path(f"{self.path}/{target}"), none)
        except Exception as e:
            if self._fs.exists(self._path(f"{self.path}/{target}")) and "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    # -- state

    def _fold(self) -> tuple[int, str | None, frozenset[str]]:
        """Number, attempt and members of the fold that holds."""
        last = max(map(int, self._names("folds")), default=0)
        if not last:
            return 0, None, frozenset()
        held = json.loads(self._read(f"folds/{last}"))
        return last, held["attempt"], frozenset(held["members"])

    def committed(self, batch: str) -> bool:
        if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        return self._fs.exists(self._path(f"{self.path}/commits/{batch}"))

    def batches(self) -> list[str]:
        """Committed batches that no fold holds."""
        _, _, members = self._fold()
        return [b for b in self._names("commits") if b not in members]

    def _places(self) -> list[str]:
        """Folders of all that counts, from one reading of the store."""
        _, fold, members = self._fold()
        live = [self._read(f"commits/{b}") for b in self._names("commits") if b not in members]
        return [f"{self.path}/data/{a}" for a in ([fold] if fold else []) + live]

    # -- operations

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False if it was committed before."""
        if self.committed(batch):
            return False
        return self._move(self._aside(self._write_data(summed(signed(changes)))), f"commits/{batch}")

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens over all committed batches; keys without documents and tokens are left out."""
        places = self._places()
        if not places:
            return self.spark.createDataFrame([], SCHEMA)
        return summed(self.spark.read.schema(SCHEMA).parquet(*places)).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Fold all committed batches into one table; False if there is nothing to fold or another fold was first."""
        number, fold, members = self._fold()
        live = {b: self._read(f"commits/{b}") for b in self._names("commits") if b not in members}
        if not live:
            return False
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/data/{a}" for a in ([fold] if fold else []) + list(live.values())))
        attempt = self._write_data(summed(rows))
        return self._move(self._aside(json.dumps({"attempt": attempt, "members": sorted(members | set(live))})), f"folds/{number + 1}")

    def vacuum(self) -> None:
        """Delete data that no longer counts or never did, and older folds' files. Not while others read or write."""
        number, fold, members = self._fold()
        keep = {fold} | {self._read(f"commits/{b}") for b in self._names("commits") if b not in members}
        for name in set(self._names("data")) - keep:
            self._delete(f"data/{name}")
        for name in self._names("folds"):
            if int(name) < number:
                self._delete(f"folds/{name}")
        self._delete("aside")
