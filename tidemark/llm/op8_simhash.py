"""SimHash near-dedup over BK-trees.

A document's fingerprint has a bit set where over half of its shingles' hashes have it. Equal fingerprints
are collapsed to one node first. Of n bit blocks at most RADIUS hold differing bits, so two fingerprints
within the radius agree in some n - RADIUS of them: nodes are dealt to shards by those blocks' bits. A shard of over
TREE nodes is split by the same argument on the bits that its nodes need not share: of RADIUS + 1 blocks of these
one at least agrees, so its nodes go to RADIUS + 1 shards with longer keys each, and so on. Distinct nodes that share
all but log2(TREE) bits are TREE at most, so this ends, and a node's copies don't grow with the shard. Each shard is
one BK-tree (children keyed by their Hamming distance to the parent), and its nodes' queries follow only edges within
the radius. Tasks emit a spanning forest of the links they find, never the pairs of a group; components.py joins them.

deduplicated() has two rules. With *radius* alone, groups are linked fingerprints. With a *similarity* groups are
linked sets of shingles: nodes of one SimHash group and nodes that share a MinHash band are candidates, and a
link holds if the sets' Jaccard similarity reaches it (near.py). SimHash alone can't reach 0.8, which differs in about
10 of 64 bits.

Edge cases: fewer words than a shingle give one shingle of the whole sequence; no words (or a null text)
give fingerprint 0, which links like any other (and, by similarity, one group of all empty sets). Repeated rows share
their component. Rows without doc_id link too, but never name a component (a group of them alone has component
null) and are not kept by dedup(). deduplicated() keeps one row of every group, with or without ids: rows that share
an id are rows of their own, so different texts under one id both stay. Extra columns are not read by dedup() and kept by
deduplicated(). Texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import near
from tidemark.llm.common import broadcast_if_small, join_hot, map_arrow, plain, text_or_empty, written
from tidemark.llm.components import Forest, components, one_of_each

WORDS, RADIUS, BITS = 3, 2, 64
#: Nodes of one tree: bounds a task's memory and time.
TREE = 512
#: Nodes for which shard keys are made long enough, where fingerprints are evenly spread.
SHARD = 64
#: Hashes whose bits are counted at once.
SLAB = 8192


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SLAB):
        ones += np.unpackbits(hashes[at : at + SLAB].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority bits of the XXH64 of all shingles, repeats included; lower-cases A-Z."""
    return majority(near.hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(text_or_empty(docs), run, "doc_id long, fp long")


class BkTree:
    """Burkhard-Keller tree of integers under Hamming distance."""

    def __init__(self, values: list[int]):
        self.root = None
        for v in values:
            self.add(v)

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            below = node[1].get(d)
            if below is None:
                node[1][d] = (value, {})
                return
            node = below

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Values within the radius: only edges within it of the distance are followed."""
        todo = [self.root] if self.root else []
        while todo:
            held, edges = todo.pop()
            d = (held ^ value).bit_count()
            if d <= radius:
                yield held
            if edges:
                if len(edges) <= 2 * radius + 1:
                    todo += [n for e, n in edges.items() if d - radius <= e <= d + radius]
                else:
                    todo += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]


def shard_keys(nodes: int, radius: int = RADIUS, bits: int = BITS) -> list[list[tuple[int, int]]]:
    """The sets of bit blocks, as (shift, width), of which one at least agrees within the radius.

    Of n blocks at most *radius* hold differing bits, so some n - radius of them agree. More blocks give
    longer keys and more of them; n is the least for which evenly spread nodes leave SHARD or fewer a key.
    """
    n = radius + 1
    while n < 2 * radius + 4 and nodes / 2.0 ** (bits * (n - radius) // n) > SHARD:
        n += 1
    edges = [bits * i // n for i in range(n + 1)]
    parts = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(parts, n - radius)]


def longer(mask: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks that add one of radius + 1 blocks of the bits outside *mask*."""
    free = [b for b in range(bits) if not mask >> b & 1]
    edges = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[s:t]) for s, t in zip(edges, edges[1:], strict=False)]


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def sharded(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """fp, mask, bits: each node with its bits under each mask."""
    return nodes.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))


def shards(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, mask, bits: shards of at most TREE nodes, such that nodes within the radius share one."""
    masks = [sum(((1 << w) - 1) << s for s, w in key) for key in shard_keys(nodes.count(), radius)]
    member, done = sharded(nodes, masks), []
    while True:
        hot = written(member.groupBy("mask", "bits").agg(F.count("*").alias("n")).where(F.col("n") > TREE).select("mask", "bits"), "op8-hot")
        large = hot.agg(F.collect_set("mask")).first()[0]  # masks are few, whatever the nodes
        if not large:
            done.append(member)
            break
        small = broadcast_if_small(hot)
        done.append(member.join(small, ["mask", "bits"], "left_anti"))
        below = F.create_map(*(x for m in large for x in (F.lit(m), F.array(*(F.lit(signed(n)) for n in longer(m & MASK, radius))))))
        split = member.join(small, ["mask", "bits"], "left_semi").select("fp", F.explode(below[F.col("mask")]).alias("mask"))
        # Two masks may lead to one: distinct, as only distinct nodes are bounded by the bits that are left.
        member = written(split.distinct().withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))), "op8-split")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


#: Members of shards that one task is meant to hold.
SHARE = 200_000


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: a set of links that connects what the links within the radius connect. *nodes* has distinct fp."""
    member = written(shards(nodes, radius), "op8-shards")
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), member.count() // SHARE)
    dealt = member.repartition(parts, "mask", "bits").sortWithinPartitions("mask", "bits", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, forest = [], None, Forest()

        def close() -> None:
            if len(held) < 2:
                return
            tree = BkTree(held)
            for f in held:
                for g in tree.near(f, radius):
                    if g != f:
                        forest.link(f, g)

        for batch in batches:
            for fp, mask, bits in zip(*(batch.column(c).to_pylist() for c in ("fp", "mask", "bits")), strict=True):
                if (mask, bits) != key:
                    close()
                    held, key = [], (mask, bits)
                held.append(fp & MASK)
        close()
        yield from forest.batches(signed=True)

    return dealt.mapInArrow(run, "a long, b long")


MASK = (1 << 64) - 1


def dedup(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable), kept."""
    prints = written(fingerprints(docs, words), "op8-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "op8-nodes")
    found = written(links(nodes.select("fp"), radius), "op8-links")
    parts = components(found)
    # Component label: any node of it; its smallest doc_id is an aggregate over the component's nodes.
    of = written(nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "op8-roots")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = join_hot(of, least, "root").select("fp", "component_id")
    out = join_hot(prints, named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def marked(docs: DataFrame, words: int, similarity: bool) -> DataFrame:
    """The documents with __row, __fp, __node (the fingerprint, or by similarity the set's name) and __bands (by similarity)."""
    # Rows may lack or repeat a doc_id, so they carry a key of their own.
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    schema = T.StructType([*rows.schema.fields, T.StructField("__fp", T.LongType()), T.StructField("__node", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, nodes, keys = [], [], []
        for text in near.as_bytes(batch.column("text")):
            every = near.hashes(text, words)
            fps.append(majority(every))
            held = np.unique(every) if similarity else None
            nodes.append(near.node(held) if similarity else fps[-1])
            keys.append(near.bands(held) if similarity else None)
        whole = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, nodes)]
        return pa.RecordBatch.from_arrays([*batch.columns, *whole, pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names, "__fp", "__node", "__bands"])

    return written(map_arrow(rows, run, schema), "op8-rows")


def deduplicated(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, similarity: tuple[int, int] | None = None) -> DataFrame:
    """One document of each group, with its columns: the smallest doc_id's, or any of a group without ids."""
    names, docs = docs.columns, plain(docs, "doc_id", "text")
    rows = marked(docs, words, similarity is not None)
    prints = written(rows.select(F.col("__fp").alias("fp")).distinct(), "op8-nodes")
    found = written(links(prints, radius), "op8-links")
    if similarity is not None:
        groups = components(found).select(F.col("node").alias("__fp"), "root")
        of = join_hot(rows.select("__node", "__fp").distinct(), groups, "__fp", "left")
        keys = of.select(F.col("__node").alias("node"), F.xxhash64(F.lit("simhash"), F.coalesce("root", "__fp")).alias("key"))
        keys = keys.unionByName(rows.select(F.col("__node").alias("node"), F.explode("__bands").alias("key"))).distinct()
        found = written(near.links(rows.select("__row", "__node", "text"), written(keys, "op8-buckets"), words, similarity), "op8-similar")
    return one_of_each(rows, components(found), docs.columns).toDF(*names)
