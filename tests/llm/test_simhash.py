from __future__ import annotations

import random
from itertools import combinations

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import clashing, docs
from tidemark.llm import op8_simhash as op
from tidemark.llm.components import components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    of = {n: n for n in nodes}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        of[b] = a
    return {n: find(n) for n in nodes}


TEXTS = ["", None, " \n", "One", "one", "a b", "A B c", "é ß 漢 x y", "w " * 4000, "\x1c\x1c a", "a\x85b c d"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert op.fingerprint((text or "").encode()) == brute_print(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "c", "\n", "\t", "é"]), max_size=30))
def test_fingerprints_of_random_texts(parts):
    text = " ".join(parts)
    assert op.fingerprint(text.encode()) == brute_print(text)


def test_slabs(monkeypatch):
    text = " ".join(map(str, range(500)))
    monkeypatch.setattr(op, "SLAB", 33)
    assert op.fingerprint(text.encode()) == brute_print(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=60), st.integers(0, 255), st.integers(0, 8))
def test_tree_finds_all_within_the_radius(values, query, radius):
    assert set(op.BkTree(values).near(query, radius)) == {v for v in values if (v ^ query).bit_count() <= radius}


@pytest.mark.parametrize("nodes", [10, 10**9, 10**13, 10**18])
def test_shard_keys_cover_all_differences(nodes):
    keys = op.shard_keys(nodes)
    masks = [sum(((1 << w) - 1) << s for s, w in k) for k in keys]
    for bits in combinations(range(64), 2):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


@pytest.mark.parametrize("mask", [0, 0xFFFF0000FFFF0000, (1 << 61) - 1])
def test_longer_masks_cover_all_differences(mask):
    free = [b for b in range(64) if not mask >> b & 1]
    below = op.longer(mask)
    assert all(m & mask == mask and m != mask for m in below)
    for bits in combinations(free, 2):
        assert any(not any(m >> b & 1 for b in bits) for m in below)


def test_hot_shards_are_split_and_lose_no_link(spark, monkeypatch):
    """All fingerprints in a few shards: no shard holds over TREE, and links equal those of all pairs."""
    monkeypatch.setattr(op, "TREE", 16)
    rng = random.Random(3)
    values = list({sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))) for _ in range(400)})
    df = spark.createDataFrame([(op.signed(v),) for v in values], "fp long")
    sizes = [r["count"] for r in op.shards(df).groupBy("mask", "bits").count().collect()]
    assert max(sizes) <= 16
    want = roots(values, [(a, b) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 2])
    got = {r.node: r.root for r in components(op.links(df)).collect()}
    groups = {}
    for v in values:
        groups.setdefault(got.get(op.signed(v), op.signed(v)), set()).add(want[v])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_hot_keys_meet_their_row_by_broadcast(spark, monkeypatch):
    from tidemark.llm import common

    big = spark.createDataFrame([(1, i) for i in range(50)] + [(None, -1)] + [(k, k) for k in range(2, 9)], "k long, v long")
    side = spark.createDataFrame([(1, "one"), (3, "three")], "k long, s string")
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(side, "k", how).select("k", "v", "s").collect()))
        monkeypatch.setattr(common, "HOT_ROWS", 10)
        assert sorted(map(str, common.join_hot(big, side, "k", how).select("k", "v", "s").collect())) == want
        monkeypatch.setattr(common, "HOT", 4)
        assert sorted(map(str, common.join_hot(big, side, "k", how).select("k", "v", "s").collect())) == want
        monkeypatch.undo()


@pytest.mark.parametrize("tree", [512, 6])
def test_dedup_matches_all_pairs(spark, monkeypatch, tree):
    monkeypatch.setattr(op, "TREE", tree)
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(90)) for _ in range(12)]
    texts = list(TEXTS)
    for b in base:
        for _ in range(8):
            w = b.split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    ids = [1000 - i for i in range(len(texts))]
    prints = {i: brute_print(t) for i, t in zip(ids, texts, strict=True)}
    want = roots(ids, [(a, b) for a, b in combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    df = clashing(docs(spark, texts, ids=ids))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op.dedup(df).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}
    assert any(prints[a] != prints[b] and want[a] == want[b] for a, b in combinations(ids, 2))
    out = op.deduplicated(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(set(want.values()))


def test_repeated_null_and_empty(spark):
    rows = op.dedup(docs(spark, ["a b c", "a b c", "x"], ids=[1, 1, None])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, False), (1, 1, True), (1, 1, True)]
    assert op.deduplicated(docs(spark, ["a b c", "a b c"], ids=[1, 1])).count() == 1
    assert op.dedup(docs(spark, [])).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.data())
def test_components(spark, data):
    links = data.draw(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=25))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    assert {r.node: r.root for r in components(df).collect()} == roots(nodes, [l for l in links if l[0] != l[1]])


def test_long_chain(spark):
    df = spark.range(300).selectExpr("id * 7 % 301 AS a", "(id + 1) * 7 % 301 AS b").repartition(5)
    assert {r.root for r in components(df).collect()} == {0}


def test_deduplicated_keeps_one_row_of_each_group(spark):
    texts = ["a b c", "a b c", "clean one without an id", "another text here", "some other words", "some other words", "a b c"]
    ids = [None, None, None, 7, 7, 9, 3]
    got = [(r.doc_id, r.text) for r in op.deduplicated(docs(spark, texts, ids=ids)).collect()]
    assert sorted(got, key=str) == sorted([(3, "a b c"), (None, texts[2]), (7, texts[3]), (7, texts[4])], key=str)
    assert [(r.doc_id, r.text) for r in op.deduplicated(docs(spark, texts[:2], ids=ids[:2])).collect()] == [(None, "a b c")]
