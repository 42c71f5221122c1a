"""Facts about many rows at once: rows are dealt into chunks of bounded size, and facts come back to a chunk's rows.

A fact that many documents share (a hash, a pair of ids) is written once for each chunk that has it, not once for
each document, so that the hottest fact has one row for each chunk. attach() brings facts and rows of a chunk together by one shuffle and a sort:
a task reads the facts of a chunk, then its rows, a batch at a time. It holds the facts of one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches

#: Bytes of text after which a chunk is full; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20


class Chunks:
    """Numbers for the chunks of one task, unique in a table that is written once."""

    def __init__(self) -> None:
        self.number, self.bytes = TaskContext.get().partitionId() << 33, 0

    def of(self, sizes: list[int]) -> np.ndarray:
        out = np.empty(len(sizes), np.int64)
        for i, n in enumerate(sizes):
            if self.bytes and self.bytes + n > CHUNK_BYTES:
                self.number, self.bytes = self.number + 1, 0
            self.bytes += n
            out[i] = self.number
        return out


def segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(chunk, kind, rows): runs of equal chunk and kind, which are the first two columns."""
    chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(chunk[a]), int(kind[a]), batch.slice(a, b - a)


def attach(facts: DataFrame, rows: DataFrame, prepare: Callable[[pa.Table], object], apply: Callable[[object, pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """*apply*(*prepare*(facts of a chunk), rows of the chunk), batch by batch. Both frames have a column chunk.

    A chunk without facts gets an empty table; facts of a chunk without rows are dropped.
    """
    small_batches(rows.sparkSession)
    own, other = [c for c in facts.columns if c != "chunk"], [c for c in rows.columns if c != "chunk"]
    f = facts.select("chunk", F.lit(0).alias("kind"), *(F.col(c).alias(f"f{i}") for i, c in enumerate(own)), *(F.lit(None).cast(rows.schema[c].dataType).alias(f"r{i}") for i, c in enumerate(other)))
    r = rows.select("chunk", F.lit(1).alias("kind"), *(F.lit(None).cast(facts.schema[c].dataType).alias(f"f{i}") for i, c in enumerate(own)), *(F.col(c).alias(f"r{i}") for i, c in enumerate(other)))
    n = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = state = None
        none: pa.RecordBatch | None = None
        for batch in batches:
            for chunk, kind, part in segments(batch):
                none = part.slice(0, 0) if none is None else none
                if chunk != at:
                    at, held, state = chunk, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if state is None:
                    known = pa.Table.from_batches(held or [none]).select(range(2, 2 + n)).rename_columns(own)
                    state, held = prepare(known), []
                out = apply(state, pa.RecordBatch.from_arrays([part.column(0), *(part.column(i) for i in range(2 + n, part.num_columns))], names=["chunk", *other]))
                if out is not None and out.num_rows:
                    yield out

    places = T._parse_datatype_string(schema)
    # One number as the key: Spark sorts it by radix. With two columns it would compare whole rows, as a chunk's rows tie in the first.
    order = (F.shiftleft("chunk", 1) + F.col("kind")).alias("order")
    both = f.unionByName(r)
    return both.repartition("chunk").select("*", order).sortWithinPartitions("order").drop("order").mapInArrow(run, places)
