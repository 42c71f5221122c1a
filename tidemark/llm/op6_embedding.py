"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c differ by a squared distance of at most 2 (1 - c). After a fixed random rotation
a vector is split into blocks of about WIDTH dimensions. If the whole squared distance is within its bound,
some block's is within its share of it (in proportion to its dimensions), so a range join of every block
finds all links. A block's join runs over a grid of its first few dimensions with cells of twice the radius:
a vector goes to its own cell and to those below it that its ball reaches, and a pair is compared where both
meet, the component-wise least cell. Pairs within the block's budget are verified by their exact cosine, and
only in the first block that admits them, so each link is found once. Within a cell, a tree of median splits
groups one side in leaves, and a leaf is compared only with vectors within the radius of its bounding box.

Equal vectors are collapsed to one before. Cells above CHUNK vectors are split into chunks, and each pair of
chunks is a unit of work of its own, so that no task holds more. Units return, per vector, how many links they
found and a spanning forest of them, never the pairs.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component link with nothing, as do
rows without vec_id (their component is null and they aren't kept). Doubles of any size, subnormal ones included, are scaled by a
power of two first. Vectors of different lengths never link.
Repeated rows count as copies. Only vec_id and embedding are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import join_hot, map_arrow, small_batches, written
from tidemark.llm.components import Forest, components

COSINE, WIDTH, CHUNK, SEED = 0.95, 8, 8192, 7
#: Vectors in an average cell that the grid aims at.
CELL = 16_384
#: Most vectors in a leaf of a unit's tree.
LEAF = 128
#: Rows of the grid that one task is meant to hold.
SHARE = 200_000
#: Parts of one in which unit vectors and the rotation are rounded. By Cauchy-Schwarz all partial sums of a product are then
#: integers below 2^53, so it is exact in any order: a vector has the same blocks and cells in whichever batch it is rotated.
PARTS = 2.0**26
#: Slack of single precision (and of the rounding) in block distances.
SLACK = 2e-6


@lru_cache(maxsize=16)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return np.rint(q * np.sign(np.diag(r)) * PARTS)


@lru_cache(maxsize=16)
def block_edges(dim: int) -> tuple[int, ...]:
    n = max(1, dim // WIDTH)
    return tuple(dim * i // n for i in range(n + 1))


def rotated(raw: np.ndarray) -> np.ndarray:
    """Rotated unit vectors in single precision, which is what all block decisions are made on; *raw* has doubles."""
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    return (np.rint(unit * PARTS) @ rotation(raw.shape[1]) / PARTS**2).astype(np.float32)


def radius(dim: int, block: int, cosine: float) -> float:
    e = block_edges(dim)
    return math.sqrt(2 * (1 - cosine) * (e[block + 1] - e[block]) / dim + SLACK)


def cells(z: np.ndarray, r: float, depth: int) -> np.ndarray:
    return np.floor(z[:, :depth] / np.float32(2 * r)).astype(np.int64)


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (the components; null if it links with nothing), key (digest of vec).

    Components are single or double precision as in the table, so that singles are not shuffled at twice their size.
    """
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = np.float32 if single else np.float64

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vec: list[bytes | None] = []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ok = i is not None and v and not any(x is None for x in v)
            a = np.asarray(v, np.float64) if ok else None
            ok = ok and bool(np.isfinite(a).all()) and bool(a.any())
            if ok and not single:  # a power of two: the cosine stays, and no square over- or underflows
                a = np.ldexp(a, -int(np.frexp(np.abs(a).max())[1]))
            vec.append((a + 0.0).astype(kind).tobytes() if ok else None)  # -0.0 and 0.0 are one
        key = [v and hashlib.blake2b(v, digest_size=16).digest() for v in vec]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec, pa.binary()), pa.array(key, pa.binary())], names=["vec_id", "vec", "key"])

    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_arrow(every, run, "vec_id long, vec binary, key binary").withColumn("wide", F.lit(not single))


def components_of(vec: list[bytes], wide: bool) -> np.ndarray:
    """The vectors of one length, a row each, as doubles."""
    return np.frombuffer(b"".join(vec), np.float64 if wide else np.float32).reshape(len(vec), -1).astype(np.float64)


def placed(nodes: DataFrame, depth: int, cosine: float) -> DataFrame:
    """rep, cell: every grid cell that a vector goes to, in all blocks; the cell's name has its block and dimension."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        reps, names = [], []
        vecs = batch.column(1).to_pylist()
        ids = batch.column(0).to_numpy()
        wide = batch.column(2)[0].as_py()
        for size in {len(v) for v in vecs}:
            at = [i for i, v in enumerate(vecs) if len(v) == size]
            z = rotated(components_of([vecs[i] for i in at], wide))
            dim, e = z.shape[1], block_edges(z.shape[1])
            for b in range(len(e) - 1):
                r, d = radius(dim, b, cosine), min(depth, e[b + 1] - e[b])
                part = z[:, e[b] : e[b + 1]]
                home, low = cells(part, r, d), cells(part - np.float32(r), r, d)
                for i, h, lo in zip(ids[at], home.tolist(), low.tolist(), strict=True):
                    for c in product(*(range(x, y + 1) for x, y in zip(lo, h, strict=True))):
                        reps.append(i)
                        names.append(f"{dim}:{b}:{':'.join(map(str, c))}")
        return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(names, pa.string())], names=["rep", "cell"])

    return map_arrow(nodes.select("rep", "vec", "wide"), run, "rep long, cell string")


def leaves(part: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """*rows* in groups of at most LEAF, split again and again at the median of the dimension that varies most."""
    out, todo = [], [rows] if len(rows) else []
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        at = part[own]
        order = np.argpartition(at[:, int(np.argmax(at.var(0)))], len(own) // 2)
        todo += [own[order[len(own) // 2 :]], own[order[: len(own) // 2]]]
    return out


class Unit:
    """The links of one pair of chunks of one cell."""

    def __init__(self, cell: str, i: int, j: int, rep: np.ndarray, copies: np.ndarray, raw: np.ndarray, chunk: np.ndarray, cosine: float):
        dim, self.block, *at = map(int, cell.split(":"))
        self.cell, self.same, self.cosine = np.array(at), i == j, cosine
        self.dim, self.edges = dim, block_edges(dim)
        order = np.argsort(rep)
        self.rep, self.copies, self.raw, chunk = rep[order], copies[order], raw[order], chunk[order]
        self.norm = np.linalg.norm(self.raw, axis=1)
        self.z = rotated(self.raw)
        self.left, self.right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        self.home = cells(self.z[:, self.edges[self.block] :], radius(dim, self.block, cosine), len(at))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of the pairs that are linked and belong here."""
        b, e = self.block, self.edges
        budget = [radius(self.dim, k, self.cosine) ** 2 for k in range(len(e) - 1)]
        part = self.z[:, e[b] : e[b + 1]]
        square = (part * part).sum(1, keepdims=True)
        one = np.ones_like(square)
        # |x|^2 + |y|^2 - 2 x.y as one product: (-2 x, |x|^2, 1) by (y, 1, |y|^2).
        rows, cols = np.hstack([-2 * part, square, one]), np.hstack([part, one, square])
        groups = leaves(part, self.left)
        right = np.concatenate(groups) if self.same else self.right
        axes = part[right].T.copy()
        done = 0
        for own in groups:
            # What lies further from the leaf's box than the radius can't link with any of its vectors.
            low, high = part[own].min(0)[:, None], part[own].max(0)[:, None]
            off = axes[:, done:] - np.clip(axes[:, done:], low, high)
            near = right[done + np.flatnonzero(np.einsum("ij,ij->j", off, off) <= np.float32(budget[b] + SLACK))]
            d = rows[own] @ cols[near].T
            x, y = np.divmod(np.flatnonzero(d <= np.float32(budget[b] + SLACK)), max(1, len(near)))
            if self.same:
                # Of the same chunk only this leaf and those after it are left; within the leaf each pair counts once.
                place = np.full(len(part), len(part))
                place[own] = np.arange(len(own))
                fresh = x < place[near[y]]
                x, y = x[fresh], y[fresh]
                done += len(own)
            x, y = own[x], near[y]
            here = (np.minimum(self.home[x], self.home[y]) == self.cell).all(1)
            x, y = x[here], y[here]
            for s in range(0, len(x), 1 << 15):
                i, j = x[s : s + (1 << 15)], y[s : s + (1 << 15)]
                gap = (self.z[i] - self.z[j]).astype(np.float64) ** 2
                # All blocks up to this one by the same sums, whichever task compares the pair.
                inside = np.stack([gap[:, e[k] : e[k + 1]].sum(1) <= budget[k] for k in range(b + 1)], 1)
                first = inside[:, b] & ~inside[:, :b].any(1)
                i, j = i[first], j[first]
                close = np.einsum("ij,ij->i", self.raw[i], self.raw[j]) / (self.norm[i] * self.norm[j]) >= self.cosine
                yield i[close], j[close]


def runs(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(cell, i, j), rep, copies, raw, chunk of each run of a batch's rows that belong to one unit."""
    if not batch.num_rows:
        return
    code = batch.column(0).dictionary_encode()
    wide = batch.column(7)[0].as_py()
    i, j, chunk, rep, copies = (batch.column(k).to_numpy() for k in range(1, 6))
    tag = np.stack([code.indices.to_numpy(), i, j])
    starts = np.flatnonzero(np.r_[True, (tag[:, 1:] != tag[:, :-1]).any(0)])
    for s, t in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
        raw = components_of(batch.column(6).slice(s, t - s).to_pylist(), wide)
        yield (code[int(s)].as_py(), int(i[s]), int(j[s])), rep[s:t], copies[s:t], raw, chunk[s:t]


def linked(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """a, b, n: where b is null, vector a has n more links (copies of a partner count); else a link of a forest."""
    spark = nodes.sparkSession
    count = nodes.count()
    depth = min(WIDTH, max(1, math.ceil(math.log2(max(1, count) / CELL))))
    where = written(placed(nodes, depth, cosine), "op6-cells")
    sizes = where.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1")
    chunked = where.join(sizes, "cell").withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int"))
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    unit = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j")))
    units = chunked.select("rep", "cell", "chunk", F.explode(unit).alias("u")).select("rep", "cell", "chunk", "u.i", "u.j")
    work = units.join(nodes.select("rep", "copies", "vec", "wide"), "rep")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.repartition(max(parts, 2, where.count() // SHARE), "cell", "i", "j").sortWithinPartitions("cell", "i", "j").select("cell", "i", "j", "chunk", "rep", "copies", "vec", "wide")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, links = Forest(), {}
        held: list[tuple[np.ndarray, ...]] = []
        key = None

        def close() -> None:
            u = Unit(*key, *map(np.concatenate, zip(*held, strict=True)), cosine)
            total = np.zeros(len(u.rep), np.int64)
            for i, j in u.pairs():
                np.add.at(total, i, u.copies[j])
                np.add.at(total, j, u.copies[i])
                for a, b in zip(u.rep[i].tolist(), u.rep[j].tolist(), strict=True):
                    forest.link(a, b)
            for at in np.flatnonzero(total):
                links[int(u.rep[at])] = links.get(int(u.rep[at]), 0) + int(total[at])

        for batch in batches:
            for here, *columns in runs(batch):
                if here != key:
                    if held:
                        close()
                    held, key = [], here
                held.append(tuple(columns))
        if held:
            close()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(list(links), pa.int64()), pa.nulls(len(links), pa.int64()), pa.array(list(links.values()), pa.int64())], names=["a", "b", "n"])
        for batch in forest.batches():
            yield batch.append_column("n", pa.nulls(batch.num_rows, pa.int64()))

    return dealt.mapInArrow(run, "a long, b long, n long")


def dedup(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of *vectors*."""
    every = written(prepared(vectors), "op6-vectors")
    able = every.where("key is not null")
    # One node for each distinct vector; its number holds once the table is written.
    copies = able.groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id())
    copies = written(copies, "op6-copies")
    firsts = able.dropDuplicates(["vec_id", "key"]).select(F.col("vec_id").alias("first"), "key", "vec", "wide")
    nodes = written(copies.join(firsts, ["first", "key"]).select("rep", "copies", "vec", "wide"), "op6-nodes")
    found = written(linked(nodes, cosine), "op6-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "root")
    known = copies.join(counts, "rep", "left").join(parts, "rep", "left")
    known = written(known.select("key", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "rep").alias("root")), "op6-known")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = join_hot(known, least, "root").select("key", "n", "component_id")
    # One vector's copies, or all that link with nothing, may be a third of the rows.
    out = join_hot(every.select("vec_id", "key"), known, "key", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))
