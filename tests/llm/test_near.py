from __future__ import annotations

import random
import re
from itertools import combinations

import pytest

from tests.llm.helpers import clashing, docs
from tests.llm.test_simhash import roots
from tidemark.llm import near, op8_simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def stage(df):
    return op8_simhash.deduplicated(df, near.WORDS, similarity=near.SIMILARITY)


def corpus():
    rng = random.Random(3)
    texts = ["", None, " \n", "One two", "one TWO", "a b c d e", "A b c d e"]
    for n in (12, 40, 100, 300, 1000):
        for _ in range(3):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            for changes in (0, 0, 1, 2, 3, n // 100, n // 50, n // 20):
                w = list(base)
                for at in rng.sample(range(n), min(changes, n)):
                    w[at] = "zz"
                texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("nulls", [False, True])
def test_stage_matches_brute_force_jaccard(spark, nulls):
    texts = corpus()
    sets = [brute_set(t) for t in texts]
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if similar(sets[a], sets[b])]
    want = roots(range(len(texts)), pairs)
    df = clashing(docs(spark, texts, ids=[None] * len(texts) if nulls else None))
    out = corpus_pipeline.near_dedup(spark, df, "")
    assert out.columns == df.columns
    rows = out.collect()
    if nulls:
        assert len(rows) == len(set(want.values()))
    else:
        assert sorted(r.doc_id for r in rows) == sorted(set(want.values()))
    prints = [op8_simhash.fingerprint((t or "").encode()) for t in texts]
    assert any((prints[a] ^ prints[b]).bit_count() > 2 for a, b in pairs)


def test_pairs_beyond_the_smallest_node_are_compared(spark, monkeypatch):
    """One bucket for all: only links of nodes that the smallest one does not join remain to be found."""
    import numpy as np

    monkeypatch.setattr(near, "bands", lambda hashes: np.zeros(min(1, len(hashes)), np.int64))
    texts = corpus()
    sets = [brute_set(t) for t in texts]
    want = roots(range(len(texts)), [(a, b) for a, b in combinations(range(len(texts)), 2) if similar(sets[a], sets[b])])
    assert sorted(r.doc_id for r in stage(docs(spark, texts)).collect()) == sorted(set(want.values()))


def test_empty(spark):
    assert stage(docs(spark, [])).count() == 0


def test_a_shared_passage_pairs_nobody(spark, monkeypatch):
    """Many documents with one passage: the prefix filter leaves no pair of them, and loses no near copy."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    texts += [t.replace("p7 ", "q ") for t in texts[:10]]
    sets = [brute_set(t) for t in texts]
    want = roots(range(len(texts)), [(a, b) for a, b in combinations(range(len(texts)), 2) if similar(sets[a], sets[b])])
    seen = []
    real = near.prefix_pairs
    monkeypatch.setattr(near, "prefix_pairs", lambda *a: seen.append(real(*a)) or seen[-1])
    assert sorted(r.doc_id for r in stage(docs(spark, texts)).collect()) == sorted(set(want.values())) and len(set(want.values())) == 60
    monkeypatch.setattr(near, "bands", lambda held: __import__("numpy").zeros(min(1, len(held)), "int64"))
    assert sorted(r.doc_id for r in stage(docs(spark, texts)).collect()) == sorted(set(want.values()))
    assert seen[-1].count() <= 10


def test_ids_null_shared_and_rows_repeated(spark):
    a, b, c = ("one text of more than five words here", "another text of more than five words", "a third text of more than five words")
    rows = [(None, a), (None, a), (3, b), (3, c), (3, c), (None, "x y"), (7, b)]
    got = [(r.doc_id, r.text) for r in stage(docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (3, b), (3, c), (None, "x y")], key=str)


def test_texts_of_few_sets_are_not_shuffled(spark, monkeypatch):
    plans, real, name = [], near.map_arrow, "spark.sql.autoBroadcastJoinThreshold"
    monkeypatch.setattr(near, "map_arrow", lambda df, *rest: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *rest))
    rows = spark.createDataFrame([(i, i // 2, f"a b c d e {i // 2}") for i in range(40)], "__row long, __node long, text string")
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        sets = near.sets_of(rows, rows.where("__node < 5").selectExpr("__node AS node"), 5)
        assert sorted((r.node, len(r.held)) for r in sets.collect()) == [(n, 2) for n in range(5)]
    finally:
        spark.conf.set(name, before)
    assert "Exchange hashpartitioning" not in plans[0]
