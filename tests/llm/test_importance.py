from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import clashing, docs
from tidemark.llm import op7_importance as op

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ing"]) for _ in range(rng.randrange(1, 5)))
    good = [" ".join(word() for _ in range(60)) for _ in range(300)]
    junk = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(30)] + ["der " * 100 for _ in range(10)]
    return good, junk


def test_keeps_good_and_rejects_junk(spark):
    good, junk = corpus()
    df = clashing(docs(spark, good + junk))
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 340, 2)] + [(None, 1, 0), (0, None, 0)], LABELS)
    rows = op.classify(df, labels).collect()
    assert len(rows) == 340
    assert sum(r.kept for r in rows if r.doc_id < 300) >= 297 and sum(r.kept for r in rows if r.doc_id >= 300) <= 1
    out = op.accepted(df, labels)
    assert out.columns == df.columns and {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in rows if r.kept}


def brute_buckets(raw):
    """n-gram buckets by Python integers, one at a time."""
    m = (1 << 32) - 1
    out = []
    for n in (1, 2, 3):
        for at in range(len(raw) - n + 1):
            h = n * 0x3C6EF35F & m
            for i in range(n):
                h ^= (raw[at + i] + 1) * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[i] & m
                h = h * 0x2C1B3C6D & m
            out.append((h * 0x9E3779B1 & m) >> 16)
    w = raw.split()
    same = [int(a == b) for a, b in zip(w, w[1:])]
    return out + [((2 * a + b + 1) * 0x61C88647 & m) >> 16 for a, b in zip(same, same[1:])]


def brute(texts, ids, good, floor, k=None):
    """log weight, key and kept of each text, by counters and one sort."""
    own = [Counter(brute_buckets((t or "").encode())) for t in texts]
    target, raw = Counter(), Counter()
    for i, c in zip(ids, own, strict=True):
        raw.update(c)
        if i in good:
            target.update(c)
    size = op.BUCKETS
    nt, nr = sum(target.values()) + size, sum(raw.values()) + size
    ratio = lambda b: math.log((target[b] + 1) / nt) - math.log((raw[b] + 1) / nr)
    weight = [math.fsum(n * ratio(b) for b, n in c.items()) for c in own]
    fit = [w / math.sqrt(sum(c.values()) + 1) for w, c in zip(weight, own, strict=True)]
    u = lambda i: (int(hashlib.md5(("gumbel" + (f":{i}" if i is not None else "")).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    key = [f - math.log(-math.log(u(i))) for f, i in zip(fit, ids, strict=True)]
    if k is None:
        edge = np.quantile([f for f, i in zip(fit, ids, strict=True) if i in good], floor)
        k = sum(f >= edge for f in fit)
    cut = sorted(key, reverse=True)[k - 1] if k else math.inf
    return weight, key, [x >= cut for x in key]


@pytest.mark.parametrize("k", [None, 0, 5, 150])
def test_weights_and_verdicts_match_brute_force(spark, k):
    good, junk = corpus()
    texts = [*good[:150], *junk, "", None, good[0], good[0]]
    ids = [*range(len(texts) - 2), None, 3]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in range(155, 160)] + [(2, 0, 0)], LABELS)
    weight, key, kept = brute(texts, ids, set(range(60)) - {2}, 0.05, k)
    got = sorted(op.classify(docs(spark, texts, ids=ids), labels, 0.05, k).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.key))
    want = sorted(zip(ids, weight, key, kept, strict=True), key=lambda r: (r[0] is None, r[0], r[2]))
    for r, (i, w, x, keep) in zip(got, want, strict=True):
        assert r.doc_id == i and abs(r.log_weight - w) < 1e-6 and abs(r.key - x) < 1e-9 and r.kept == keep
    rows = op.accepted(docs(spark, texts, ids=ids), labels, 0.05, k).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((i, t) for i, t, keep in zip(ids, texts, kept, strict=True) if keep)


def test_noise_decides_at_the_edge(spark):
    """A sample of half the good documents is no threshold on their weights."""
    good, junk = corpus()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)], LABELS)
    rows = [r for r in op.classify(docs(spark, good + junk), labels, k=150).collect() if r.doc_id < 300]
    by = sorted(rows, key=lambda r: -r.log_weight / math.sqrt(r.n_grams + 1))
    assert sum(r.kept for r in by[:150]) > sum(r.kept for r in by[150:]) > 20


def test_columns_of_any_name_stay(spark):
    df = docs(spark, ["a b", "c"]).selectExpr("*", "'x' AS `a.b`", "1 AS __weight", "2 AS __log_weight", "3 AS __n", "4 AS c2")
    out = op.accepted(df, spark.createDataFrame([], LABELS))
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_buckets_do_not_depend_on_slabs(monkeypatch):
    raw = random.Random(1).randbytes(5000).replace(b" ", b"x")
    whole = np.sort(np.concatenate(list(op.buckets(raw))))
    monkeypatch.setattr(op, "SLAB", 97)
    assert (np.sort(np.concatenate(list(op.buckets(raw)))) == whole).all()


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.choice([-1e6, 0.0, 5.0]) + rng.random() for _ in range(3000)] + [7.0] * 40
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 30, 45, 1500, 3040):
        cut = op.kth_largest(df, k)
        kept = sum(v >= cut for v in values)
        assert k <= kept <= k + (40 if sorted(values, reverse=True)[k - 1] == 7.0 else 0)


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], LABELS)
    assert [r.kept for r in op.classify(docs(spark, ["a", None]), none).collect()] == [True, True]
    assert op.classify(docs(spark, []), none).count() == 0 and op.accepted(docs(spark, []), none).count() == 0
    unknown = spark.createDataFrame([(99, 1, 0)], LABELS)
    assert op.accepted(docs(spark, ["a", None]), unknown).count() == 2
