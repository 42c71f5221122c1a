"""Keyword automaton and nearest join against Python's own loops."""

from __future__ import annotations

import datetime as dt
import random

from tidemark.operators import matching
from tidemark.schema import TRACKED_DIM

POSTS = "id string, text string, created_at string, n long"


def brute(tracked, posts, order):
    out = []
    for slug, date, keyword, given in tracked:
        hits = [p for p in posts if given is None and keyword is not None and p["text"] is not None and keyword.lower() in p["text"].lower()]

        def far(p):
            try:
                return abs((dt.datetime.fromisoformat(p["created_at"]).date() - date).days)
            except (TypeError, ValueError):
                return matching.FAR

        best = min(hits, key=lambda p: (far(p), *(p[c] for c in order)), default=None)
        out.append((slug, given if given is not None else best and best["id"], len(hits)))
    return sorted(out)


def test_resolve_equals_a_loop(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "alphabet", "ta", "x y", "é", "no such"]
    posts = [{"id": str(i), "text": rng.choice([None, "", *(" ".join(rng.choices(words, k=4)).upper() for _ in range(9))]), "created_at": rng.choice([None, "bad", *(f"2024-01-{d:02d}T10:00:00" for d in range(1, 29))]), "n": rng.randrange(5) * 1000 + i} for i in range(300)]
    tracked = [(f"s{i}", rng.choice([None, *(dt.date(2024, 1, d) for d in range(1, 31))]), rng.choice([None, "", *words]), rng.choice([None, None, None, "given"])) for i in range(80)]
    dim = spark.createDataFrame([(s, s, d, "c", "", k, g) for s, d, k, g in tracked], TRACKED_DIM)
    df = spark.createDataFrame([tuple(p.values()) for p in posts], POSTS)
    for order in (("id",), ("n", "id"), ("n",)):
        got = sorted(map(tuple, matching.resolve(dim, df, order).collect()))
        assert got == brute(tracked, posts, order), order


def test_ties_keep_the_first_row_on_either_side(spark):
    posts = [("9", "k", "2024-01-08", 1), ("1", "k", "2024-01-12", 2), ("5", "k", "2024-01-12", 0)]
    dim = spark.createDataFrame([("s", "s", dt.date(2024, 1, 10), "c", "", "k", None)], TRACKED_DIM)
    df = spark.createDataFrame(posts, POSTS)
    assert matching.resolve(dim, df, ("id",)).first().post_id == "1"
    assert matching.resolve(dim, df, ("n",)).first().post_id == "5"


def test_many_keywords_in_several_passes(spark, monkeypatch):
    """A hundred thousand keywords, and the same by automata of a few."""
    rng = random.Random(1)
    words = [f"k{i}z" for i in range(100_000)]
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(200)]
    posts = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    keys = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = sorted({(str(i), w) for i, t in enumerate(texts) for w in t.split()})
    for most in (matching.KEYWORDS, 30_000):
        monkeypatch.setattr(matching, "KEYWORDS", most)
        hits, numbers = matching.search(posts, keys)
        assert sorted((r.id, r.keyword) for r in hits.join(numbers, "number").collect()) == want


def test_no_keywords_and_no_posts(spark):
    dim = spark.createDataFrame([("s", "s", None, "c", "", None, "7"), ("t", "t", None, "c", "", None, None)], TRACKED_DIM)
    none = spark.createDataFrame([], POSTS)
    assert sorted(map(tuple, matching.resolve(dim, none).collect()), key=str) == [("s", "7", 0), ("t", None, 0)]


def test_the_plan_has_no_nested_loop(spark):
    dim = spark.createDataFrame([("s", "s", dt.date(2024, 1, 10), "c", "", "k", None)], TRACKED_DIM)
    df = spark.createDataFrame([("9", "k", "2024-01-08", 1)], POSTS)
    plan = matching.resolve(dim, df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
