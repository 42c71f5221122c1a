"""op12 against a dictionary of all strings of the length."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import clashing, docs
from tidemark.llm import op12_suffix, passages
from tidemark.llm.queries import op12_suffix_dedup


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        starts = [i for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1])]
        ends = [i + 1 for i in range(len(r)) if gone[i] and (i + 1 == len(r) or not gone[i + 1])]
        out.append((len(r), starts, ends, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(length, n=60, seed=1):
    """Random texts with shared passages a little shorter, as long and longer than *length*, at all offsets."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdé") for _ in range(k))
    passages = [word(length + rng.randrange(-3, length)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [word(rng.randrange(3 * length))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(4)
            parts += [p[cut : len(p) - rng.randrange(4)], word(rng.randrange(length))]
        out.append("".join(parts))
    return [*out, None, "", "a" * (length - 1), "a" * (length + 1), "ab" * length, out[3], out[3], passages[0]]


def result(df):
    return sorted((r["doc_id"], r["n_bytes"], r["starts"], r["ends"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("length", [9, 24, 40, 100])
def test_equals_brute_force(spark, length):
    made = corpus(length, seed=length)
    table = docs(spark, made).repartition(3)
    got = result(op12_suffix.dedup(clashing(table) if length == 24 else table, length))
    assert got == [(i, *row) for i, row in enumerate(brute(made, length))]


def test_small_slices(spark, monkeypatch):
    """Long texts go slice by slice, in the functions that tasks run."""
    monkeypatch.setattr(op12_suffix, "SLICE", 37)
    made = [t for t in corpus(24, seed=8) if t]
    length, buffers = 24, [np.frombuffer(t.encode(), np.uint8) for t in made]
    h = [op12_suffix.sample_prints(b, length)[1] for b in buffers]
    known = np.array([k for k, n in Counter(np.concatenate(h).tolist()).items() if n > 1])
    runs = [op12_suffix.candidate_runs(len(b), op12_suffix.samples(len(b), length)[np.isin(x, known)], length) for b, x in zip(buffers, h, strict=True)]
    pairs = []
    for b, r in zip(buffers, runs, strict=True):
        for places in op12_suffix.run_slices(r):
            pairs += zip(op12_suffix.fingerprints(b, places, length).tolist(), op12_suffix.residues(b, places, length, 2).astype(int).tolist(), strict=True)
    once = sorted(p for p, n in Counter(pairs).items() if n == 1)
    facts = pa.table({"h": [a for a, _ in once], "x": pa.array([b for _, b in once], pa.int32())})
    spans = [op12_suffix.repeated_spans(b, r.ravel().tolist(), op12_suffix.known_pairs(facts), length) for b, r in zip(buffers, runs, strict=True)]
    assert [([a for a, _ in s], [b for _, b in s]) for s in spans] == [row[1:3] for row in brute(made, length)]


def test_covers_have_every_difference():
    for v, cover in op12_suffix.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_every_repeat_is_a_candidate():
    """Samples that tie with no sample never rule out a place whose string repeats."""
    rng = random.Random(4)
    for _ in range(50):
        length = rng.choice([9, 21, 24, 40])
        v, _ = op12_suffix.cover_of(length)
        shared = bytes(rng.randrange(256) for _ in range(length))
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randrange(90))) + shared + bytes(rng.randrange(256) for _ in range(rng.randrange(90))) for _ in range(2))
        prints = [op12_suffix.sample_prints(np.frombuffer(t, np.uint8), length) for t in (a, b)]
        tied = set(prints[0][1].tolist()) & set(prints[1][1].tolist())
        for t, (places, h) in zip((a, b), prints, strict=True):
            runs = op12_suffix.candidate_runs(len(t), places[[x in tied for x in h.tolist()]], length)
            assert any(x <= t.find(shared) <= y for x, y in runs.tolist())


def test_pairs_that_share_a_fingerprint():
    facts = pa.table({"h": [5, 5, 5, 9], "x": pa.array([1, 2, 7, 1], pa.int32())})
    got = op12_suffix.holds(op12_suffix.known_pairs(facts), np.array([5, 5, 5, 9, 9, 10, 1]), np.array([7, 2, 3, 1, 2, 1, 1]))
    assert got.tolist() == [True, True, False, True, False, False, False]


def test_query_and_stripped_texts(spark, tmp_path):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(450))
    made = ["x" * 50 + passage + "y" * 30, passage + "z", passage[:399], None, "é" * 350]
    docs(spark, made, ids=[1, None, 2, 3, 3]).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(made, 400)
    got = {r["n_bytes"]: r for r in op12_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {n: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for n, r in got.items()} == {n: (sum(b - a for a, b in zip(s, e, strict=True)), len(s), sha) for n, s, e, sha in want}
    kept = {bytes(r["kept"]) for r in op12_suffix.stripped(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    assert {hashlib.sha256(k).hexdigest() for k in kept} == {w[3] for w in want}


def test_one_passage_in_all_rows(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdef") for _ in range(60))
    made = [f"{i:04d} {passage} {i:04d}" for i in range(500)]
    got = result(op12_suffix.dedup(docs(spark, made).repartition(5), 40))
    assert got == [(i, *row) for i, row in enumerate(brute(made, 40))]


def test_empty_table(spark):
    assert op12_suffix.dedup(docs(spark, [])).count() == 0


def test_buckets_across_batches(spark):
    """Ties and single rows are told right wherever a batch ends, each tie once for each chunk."""
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.randrange(2), rng.randrange(3)) for _ in range(90)]
    n = Counter((h, x) for h, x, _ in rows)
    df = spark.createDataFrame(rows, op12_suffix.ROWS)
    for size in (1, 2, 3, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            ties = sorted(map(tuple, op12_suffix.sorted_buckets(df, True).collect()))
            single = sorted(map(tuple, op12_suffix.sorted_buckets(df, False).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(set(ties)) == sorted({r for r in rows if n[r[:2]] > 1}) and len(ties) <= len(set(ties)) + 90 * (size < 4)
        assert single == sorted(r for r in rows if n[r[:2]] == 1)


def brute_shared(texts, size):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    holders = defaultdict(set)
    for i, w in enumerate(split):
        for j in range(len(w) - size + 1):
            holders[tuple(w[j : j + size])].add(i)
    out = []
    for w in split:
        inside = {k for j in range(len(w) - size + 1) if len(holders[tuple(w[j : j + size])]) > 1 for k in range(j, j + size)}
        out.append(len(inside))
    return out


def worded(size, n=50, seed=1):
    """Texts of words with shared passages a little shorter, as long and longer than *size* words, and with repeats of their own."""
    rng = random.Random(seed)
    some = lambda k: [rng.choice(("a", "bé", "c" * 30, "the", "d")) for _ in range(k)]
    shared = [some(size + rng.randrange(-2, size)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = some(rng.randrange(2 * size))
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            parts += p[rng.randrange(3) : len(p) - rng.randrange(3)] + some(rng.randrange(size))
        out.append("".join(w + rng.choice((" ", " ", "\n", "\t  ")) for w in parts))
    own = " ".join(f"o{i}" for i in range(size))
    return [*out, None, "", " \n", f"{own} x {own}", "z " * (3 * size), out[3], out[3], " ".join(shared[0]), " ".join(shared[1])]


@pytest.mark.parametrize("size", [1, 2, 7, 12, 51])
def test_shared_words_equal_brute_force(spark, size):
    made = worded(size, seed=size)
    got = op12_suffix.dedup(docs(spark, made).repartition(3), 40, size).select("doc_id", "n_shared_words").collect()
    assert sorted(map(tuple, got)) == list(enumerate(brute_shared(made, size)))


def test_shared_words_in_small_slices(monkeypatch):
    """Long texts go slice by slice and block by block; one text after the other tells the same as all at once."""
    made = [np.frombuffer((t or "").encode(), np.uint8) for t in worded(12, seed=5)]
    words = passages.words_of(made)
    windows = np.concatenate([at for at, _ in passages.smallest_grams(words, 12, op12_suffix.span_prints)])
    want = [c.tolist() for c in op12_suffix.window_prints(words, windows, 12)]
    grams = sorted(passages.grams_once(words, 12, op12_suffix.span_prints).tolist())
    monkeypatch.setattr(op12_suffix, "SLICE", 23)
    monkeypatch.setattr(passages, "BLOCK", 17)
    assert [c.tolist() for c in op12_suffix.window_prints(words, windows, 12)] == want
    assert sorted(h for t in made for h in passages.grams_once(passages.words_of([t]), 12, op12_suffix.span_prints).tolist()) == grams
    assert max(want[1]) < 0


def test_passages_of_over_50_words_that_are_short(spark, tmp_path):
    """A passage of 51 words with fewer than 400 bytes stays by contract, and is told by n_shared_words; one of 50 is not."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    filler = lambda k: " ".join(word() for _ in range(k))
    over, under, own = filler(51), filler(50), filler(60)
    made = [f"{filler(80)} {over} {filler(9)}", f"{filler(7)}\n{over}\n{filler(300)}", f"{filler(80)} {under} {filler(9)}", f"{under} {filler(70)}", f"{own} {word()} {own}", filler(400)]
    docs(spark, made).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_removed"], r["n_shared_words"]) for r in op12_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 51), 1: (0, 51), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0)}
