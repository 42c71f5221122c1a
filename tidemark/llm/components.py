"""Connected components of links, distributed: local forests, then rounds of star contraction.

Each round, every node points to its smallest neighbour (large star), then neighbours of a node point to
the smallest of them (small star); the links shrink to stars whose centre is the component's smallest
node. A union-find within each partition first thins the links to a forest. Rounds are cut off from
their lineage by tables in the shared folder, and nothing is gathered in one task or on the driver. The hub of
a giant component is a hot key: its links meet its row by broadcast (join_hot), not in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_scratch, join_hot, written

MAX_ROUNDS = 50


class Forest:
    """Union-find that remembers one link for each union: at most as many as it has nodes."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.parent[high] = low
            self.parent.setdefault(low, low)

    def batches(self, signed: bool = False, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
        """(a, b): every node with its root, as signed longs."""
        fix = (lambda x: x - (1 << 64) if x >> 63 else x) if signed else (lambda x: x)
        pairs = [(fix(x), fix(self.find(x))) for x, up in list(self.parent.items()) if x != up]
        for at in range(0, len(pairs), rows):
            a, b = zip(*pairs[at : at + rows], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def thinned(links: DataFrame) -> DataFrame:
    """A forest of each partition's links: connects the same nodes within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.link(a, b)
        yield from forest.batches()

    return links.mapInArrow(run, "a long, b long")


def star(links: DataFrame, large: bool) -> DataFrame:
    """One star step on links (a, b) with a > b.

    Large: each node sends its larger neighbours to its smallest one (itself included). Small: each node
    sends its smaller neighbours, and itself, to the smallest. The smallest neighbour is an aggregate and
    comes back by a join, so no neighbourhood is collected.
    """
    sides = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        sides = sides.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = join_hot(sides, least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: each node that has a link, with the smallest node of its component."""
    edges = thinned(links).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    for _ in range(MAX_ROUNDS):
        # Stars already: no node is both a centre and a leaf, and no leaf has two centres.
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        roles = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
        if not roles.agg(F.max((F.col("leaf") + F.col("centre") > 1).cast("int"))).first()[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        large = written(star(edges, True), "links")
        small = written(star(large, False), "links")
        drop_scratch(edges, large)
        edges = small
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def one_of_each(rows: DataFrame, parts: DataFrame, columns: list[str]) -> DataFrame:
    """One row of each component, by the smallest doc_id (null last), then text's hash, then __row.

    *rows* has the documents' columns, __row (unique) and __node; *parts* is components()' result.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), F.col("__row").alias("row"))
    of = rows.select(F.col("__node").alias("node"), order.alias("order")).groupBy("node").agg(F.min("order").alias("order"))
    kept = of.join(parts, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("order").alias("order")).select(F.col("order.row").alias("__row"))
    # Kept rows grow with the corpus, so both sides are shuffled, whatever their size.
    return rows.join(kept.hint("merge"), "__row", "left_semi").select(*(F.col(f"`{c}`") for c in columns))
