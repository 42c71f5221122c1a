"""Shingles, their sets' similarity, and links between similar sets.

links() takes buckets of nodes that may be similar (a node is one set of shingles) and returns links that connect
what the similar pairs of a bucket connect, each verified on the whole sets. First each node of a bucket is compared
with the bucket's hub, the node that meets most others in all its buckets: among near copies the one they are copies of, so
a large group costs no pairs of its own. What is left are
buckets whose nodes these links don't join. Their nodes go through a prefix filter, which loses nothing: in the
order of how many of these nodes hold a shingle, two sets of similarity s share one among the first
n - ceil(s n) + 1 of each, and with enough left after it in both. So a passage that many documents share pairs none
of them by itself.

Fewer words than a shingle give one shingle of the whole sequence; no words (or a null text) give the empty set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, drop_scratch, join_hot, map_arrow, written
from tidemark.llm.components import components

SEED = 42
#: The rule of stages on shingles: words of one, and the least similarity as a fraction.
WORDS, SIMILARITY = 5, (4, 5)
#: MinHash bands and the hashes of each: two sets of similarity s share none with probability (1 - s^ROWS)^BANDS, 3e-6 at 0.8.
BANDS, ROWS = 32, 5
#: Hashes that are permuted at once.
SLAB = 4096
#: Most rows, of one number each, that are sent to all texts.
FIRST = 1 << 17

_RNG = np.random.default_rng(SEED)
TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of the text's shingles in order, repeats included; lower-cases A-Z."""
    w = text.lower().split()  # of bytes: the six ASCII white-space characters, A-Z
    if not w:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(w)] if len(w) <= words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64)


def node(held: np.ndarray) -> int:
    """The name of a set, from its sorted hashes."""
    return xxhash.xxh64_intdigest(held.tobytes(), SEED)


def bands(held: np.ndarray) -> np.ndarray:
    """The keys of the set's bands; none for an empty set."""
    if not len(held):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(held), SLAB):
        least = np.minimum(least, (held[at : at + SLAB] * TIMES[:, None] + PLUS[:, None]).min(axis=1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def as_bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def sets_of(rows: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, held: the set of each of *nodes*, made from one of its rows' texts."""
    first = rows.groupBy("__node").agg(F.min("__row").alias("__row")).join(nodes.select(F.col("node").alias("__node")).distinct(), "__node").select("__row")
    # Few rows of many: known in number, they go to where the texts lie, and no text is shuffled for its being left out.
    first = written(first, "near-first")
    texts = rows.join(broadcast_if_small(first, FIRST), "__row", "left_semi").select("__node", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = pa.array([np.unique(hashes(t, words)).view(np.int64) for t in as_bytes(batch.column(1))], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), held], names=["node", "held"])

    out = written(map_arrow(texts, run, "node long, held array<long>"), "near-sets")
    drop_scratch(first)
    return out


def verified(rows: DataFrame, pairs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets are similar enough, written."""
    sets = sets_of(rows, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), words)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    part, whole = similarity
    # Sizes first: sets of too different sizes need no intersection.
    both = both.where(whole * F.least(F.size("x"), F.size("y")) >= part * F.greatest(F.size("x"), F.size("y")))
    shared = F.size(F.array_intersect("x", "y"))
    out = written(both.where(whole * shared >= part * (F.size("x") + F.size("y") - shared)).select("a", "b"), "near-links")
    drop_scratch(sets)
    return out


def prefix_pairs(rows: DataFrame, nodes: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """a, b: pairs of *nodes* (node, root) of different roots that share a shingle of their prefixes."""
    part, whole = similarity
    sets = sets_of(rows, nodes, words)
    tokens = written(sets.select("node", F.size("held").alias("size"), F.explode("held").alias("token")), "near-tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    common = join_hot(tokens, often, "token").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("c"))
    # Shingles that no other node holds are the rarest of all and take the first places.
    length = F.col("size") - F.floor((part * F.col("size") + whole - 1) / whole) + 1 - (F.col("size") - F.size("c"))
    heads = common.select("node", "size", F.size("c").alias("n"), F.posexplode(F.slice("c", 1, F.greatest(length, F.lit(0)).cast("int"))).alias("at", "t"))
    heads = written(heads.select("node", "size", (F.col("n") - F.col("at")).alias("left"), "t.token").join(nodes, "node"), "near-heads")
    a, b = (heads.select("token", F.col("node").alias(x), F.col("root").alias(f"r{x}"), F.col("size").alias(f"s{x}"), F.col("left").alias(f"l{x}")) for x in "ab")
    # The first shingle that two sets share has all others that they share after it.
    enough = f"least(la, lb) * {part + whole} >= {part} * (sa + sb)"
    out = a.join(b, "token").where(f"a > b AND ra <> rb AND {whole} * least(sa, sb) >= {part} * greatest(sa, sb) AND {enough}").select("a", "b").distinct()
    out = written(out, "near-pairs")
    drop_scratch(sets, tokens, heads)
    return out


def links(rows: DataFrame, buckets: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """a, b: links that connect what the similar pairs of the buckets connect.

    *rows*: __row, __node, text; *buckets*: node, key, without repeats.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    many = written(buckets.join(sizes, "key"), "near-many")
    met = many.groupBy("node").agg(F.sum("n").alias("met"))
    hubs = many.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    shared = written(many.select("key", "node").join(hubs, "key"), "near-buckets")
    stars = written(shared.where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct(), "near-stars")
    found = verified(rows, stars, words, similarity)
    stars_of = components(found)
    of = shared.join(stars_of, "node", "left").select("key", "node", "hub", F.coalesce("root", "node").alias("root"))
    open_keys = of.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
    # The hub's pairs are done.
    left = written(of.where("node <> hub").join(open_keys, "key", "left_semi").select("key", "node", "root"), "near-open")
    still = left.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
    nodes = written(left.join(still, "key", "left_semi").select("node", "root").distinct(), "near-rest")
    rest = prefix_pairs(rows, nodes, words, similarity).join(stars, ["a", "b"], "left_anti")
    # The first links' components stand for them: stars, which settle at once where nothing is added.
    out = stars_of.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(rows, rest, words, similarity))
    drop_scratch(many, shared, stars, left, nodes)
    return out
