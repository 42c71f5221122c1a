from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import op6_embedding as op


def brute(rows, cosine=0.95):
    """(n_links, component) per row over all pairs."""
    ok = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    n = len(rows)
    link = [[a != b and ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]) and np.dot(rows[a][1], rows[b][1]) / (np.linalg.norm(rows[a][1]) * np.linalg.norm(rows[b][1])) >= cosine for b in range(n)] for a in range(n)]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            k = todo.pop()
            new = [b for b in range(n) if link[k][b] and b not in seen]
            seen.update(new)
            todo += new
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((rows[a][0], sum(link[a]), min(ids) if ids else None))
    return out


def some(rng, n, dim, groups):
    centres = rng.normal(size=(groups, dim))
    out = []
    for i in range(n):
        v = centres[i % groups] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.22, 0.3])
        out.append((i * 3 + 1, (v * rng.choice([0.5, 1, 7])).astype(np.float32).astype(float).tolist()))
    return out


@pytest.mark.parametrize(("dim", "chunk", "cell"), [(64, 8192, 16_384), (64, 25, 20), (5, 10, 10), (20, 30, 5)])
def test_same_as_all_pairs(spark, monkeypatch, dim, chunk, cell):
    monkeypatch.setattr(op, "CHUNK", chunk)
    monkeypatch.setattr(op, "CELL", cell)
    rows = some(np.random.default_rng(dim + chunk), 160, dim, 12)
    rows += [(1000 + i, rows[0][1]) for i in range(5)] + [(1, rows[0][1])]
    got = op.dedup(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_single_precision_components(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAF", 7)
    rows = [(i, np.float32(v).astype(float).tolist()) for i, v in some(np.random.default_rng(3), 120, 24, 9)]
    got = op.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))


def test_leaves_partition_the_rows():
    part = np.random.default_rng(5).normal(size=(1000, 8)).astype(np.float32)
    groups = op.leaves(part, np.arange(1000))
    assert sorted(np.concatenate(groups).tolist()) == list(range(1000)) and max(map(len, groups)) <= op.LEAF
    assert op.leaves(part, np.arange(0)) == []


def test_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (None, v), (9, [1.0, 2.0]), (10, [-1.0, -2.0, -3.0]), (11, [2.0, 4.0, 6.0])]
    df = spark.createDataFrame([(i, x, "k", "c") for i, x in rows], "vec_id long, embedding array<double>, key string, cell string")
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id) for r in op.dedup(df).collect())
    assert got == sorted((i if i is not None else -1, n, c) for i, n, c in brute(rows))
    assert op.dedup(df.where("false")).count() == 0


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    got = sorted((r.vec_id, r.n_links) for r in op.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]


@pytest.mark.parametrize("dim", [1, 5, 64, 300])
def test_a_vector_is_rotated_alike_in_every_batch(dim):
    raw = np.random.default_rng(dim).normal(size=(257, dim)) * np.random.default_rng(1).uniform(1e-3, 1e3, (257, 1))
    whole = op.rotated(raw)
    assert all((op.rotated(raw[i : i + 1]) == whole[i]).all() for i in range(len(raw)))
    assert (op.rotated(raw[::-1].copy())[::-1] == whole).all() and (op.rotated(raw[40:71]) == whole[40:71]).all()
    assert np.allclose(np.linalg.norm(whole, axis=1), 1, atol=1e-6)


def test_doubles_of_any_size(spark):
    """Squares that over- or underflow, and subnormal components, link like any other vector."""
    unit = [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, -1.0])]
    scales = [1e200, 1e200, 1e-200, 5e-324, 1e308]
    rows = [(i, [x * s for x in v]) for (i, v), s in zip(unit, scales, strict=True)]
    got = op.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(unit))
