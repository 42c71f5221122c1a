"""op13: counts against Python's own, collisions, edge cases, and the masks against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest

from tests.llm.helpers import clashing, docs
from tidemark.llm import op13_audit


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"words": len(words), "distinct": len(set(words)), "capitals": len(re.findall("[A-Z]", text)), "symbols": len(re.findall(r"[#$%&*|]", text)), "points": len(text)}


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "B", "ab", "é", "漢", " ", "\n", "\x1c", " ", "#", "Zz ", "word "]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_counts_equal_pythons(monkeypatch):
    made = ["", " ", "\n\t", "a", " a", "a ", *texts(300), "x" * 5000, "one two " * 900]
    got = op13_audit.counted(pa.array(made))
    for limit in (1 << 20, 64):  # also by groups of few bytes and texts that are scanned by slices
        monkeypatch.setattr(op13_audit, "LONG", limit)
        got = op13_audit.counted(pa.array(made))
        for i, t in enumerate(made):
            assert {k: int(v[i]) for k, v in got.items()} == brute_counts(t), t


def test_a_slice_of_a_column():
    column = pa.array(["no", *texts(20), "no"]).slice(3, 12)
    got = op13_audit.counted(column)
    assert got["words"].tolist() == [brute_counts(t)["words"] for t in column.to_pylist()]


def test_equal_hashes_are_verified(monkeypatch):
    zeros = op13_audit.np.zeros(op13_audit.LONG + 1, op13_audit.np.uint64)
    monkeypatch.setattr(op13_audit, "tables", lambda: (zeros, zeros))  # every word has one hash
    made = texts(50) + ["ab cd ab ef"]
    assert op13_audit.counted(pa.array(made))["distinct"].tolist() == [brute_counts(t)["distinct"] for t in made]


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    fails = []
    for i, t, lang in rows:
        n = brute_counts(t or "")
        e = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
        bad = {"A": n["words"] < 100, "B": 100 * n["distinct"] < 80 * n["words"], "C": 100 * n["capitals"] > 10 * n["points"], "D": n["symbols"] > 0, "E": e}
        fails.append((lang or "", {k for k, v in bad.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                c = Counter()
                for p, bad, g, x in fails:
                    if p != part:
                        continue
                    earlier, here = bad & set(order[:k]), f in bad
                    removed = here and not earlier
                    for name, hit in (("kept", not here and not earlier), ("removed", removed), ("redundant", here and earlier), ("unique_fails", bad == {f}), ("good_lost", removed and g), ("toxic_lost", removed and x)):
                        c[name] += bool(hit)
                out[part, "".join(order), k + 1] = c
                shapley[part, f] += c["removed"]
    return {key: (*(c[n] for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[key[0], key[1][key[2] - 1]]) for key, c in out.items()}


LABELS = "doc_id long, quality int, toxic int"
NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in NAMES) for r in df.collect()}


@pytest.mark.parametrize("clash", [False, True])
def test_audit_equals_brute_force(spark, clash):
    rng = random.Random(7)
    some = ["a b " * 60, " ".join(f"w{i}" for i in range(120)), "W" * 30, None, "", "x # y", *texts(6)]
    rows = [(rng.choice([None, *range(25)]), rng.choice(some), rng.choice([None, "", "en", "de"])) for _ in range(90)]
    labels = [(rng.choice([None, *range(30)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(30)]
    table = docs(spark, [t for _, t, _ in rows], langs=[lang for *_, lang in rows], ids=[i for i, *_ in rows])
    got = op13_audit.audit(clashing(table) if clash else table, spark.createDataFrame(labels, LABELS))
    assert result(got) == brute(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert op13_audit.audit(docs(spark, []), none).count() == 0
    assert result(op13_audit.audit(docs(spark, ["a"]), none)) == brute([(0, "a", "en")], [])


def test_one_text_in_most_rows(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}", "en") for i in range(400)] + [(5, "same text", "en"), (1, "same text", "fr")]
    table = docs(spark, [t for _, t, _ in rows], langs=[x for *_, x in rows], ids=[i for i, *_ in rows])
    assert result(op13_audit.audit(table, spark.createDataFrame([(1, 1, 0), (2, 0, 1)], LABELS))) == brute(rows, [(1, 1, 0), (2, 0, 1)])
