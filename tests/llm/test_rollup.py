from __future__ import annotations

import random

import pytest

from tests.llm.helpers import docs
from tidemark.llm import op9_rollup as op

CHANGES = "change_id long, op string, source string, lang string, tokenizer string, tokens long, old_tokenizer string, old_tokens long, n_docs string"
PLAIN = "op string, source string, lang string, tokenizer string, tokens long"


def totals(r):
    return {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


def test_rollup_follows_the_documents(spark, tmp_path):
    rng = random.Random(1)
    held, number = {}, 0
    r = op.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    for batch in range(4):
        rows = []
        for _ in range(60):
            number += 1
            kind = rng.choice(["insert", "insert", "delete", "revise"]) if held else "insert"
            if kind == "insert":
                held[number] = (rng.choice(["hot", "hot", "s2", None]), rng.choice(["en", None]), "v1", rng.randrange(50))
                rows.append((number, kind, *held[number], None, None, "x"))
            else:
                key = rng.choice(list(held))
                s, lang, tok, n = held.pop(key)
                if kind == "delete":
                    rows.append((number, kind, s, lang, tok, n, None, None, "x"))
                else:
                    held[key] = (s, lang, "v2", rng.randrange(50))
                    rows.append((number, kind, s, lang, "v2", held[key][3], tok, n, "x"))
        df = spark.createDataFrame(rows + rows[:5], CHANGES)  # five arrive twice
        assert r.apply(f"b{batch}", df)
        assert not r.apply(f"b{batch}", df)
        want = {}
        for s, lang, tok, n in held.values():
            d, t = want.get((s, lang, tok), (0, 0))
            want[s, lang, tok] = (d + 1, t + n)
        assert totals(r) == want
        if batch == 1:
            assert r.compact() and not r.compact()
            assert totals(r) == want and r.batches() == []
            assert not r.apply("b0", df) and totals(r) == want
    assert r.compact()
    assert totals(r) == want and not r.apply("b3", df) and not r.apply("b0", df)
    r.vacuum()
    assert totals(r) == want and not r.apply("b0", df) and len(list((tmp_path / "r/data").iterdir())) == 1


class Stop(Exception):
    pass


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("name", ["_write_data", "_aside", "_move"])
@pytest.mark.parametrize("what", ["apply", "compact"])
def test_break_at_any_file_operation(spark, tmp_path, monkeypatch, what, name, after):
    """A break before or after each file operation leaves the totals before or after; trying again completes it."""
    r = op.Rollup(spark, f"file://{tmp_path}/r")
    one = lambda n: spark.createDataFrame([("insert", "s", "l", "t", n)], PLAIN)
    r.apply("a", one(5))
    r.apply("b", one(7))
    r.compact()
    r.apply("c", one(1))
    before = {("s", "l", "t"): (3, 13)}
    done = {("s", "l", "t"): (4, 15)} if what == "apply" else before
    run = (lambda: r.apply("d", one(2))) if what == "apply" else r.compact
    real = getattr(op.Rollup, name)

    def broken(self, *args):
        if after:
            real(self, *args)
        raise Stop

    with monkeypatch.context() as m:
        m.setattr(op.Rollup, name, broken)
        with pytest.raises(Stop):
            run()
    assert totals(r) == (done if after and name == "_move" else before)
    run()
    assert totals(r) == done
    r.vacuum()
    run()
    assert totals(r) == done


def test_two_writers_commit_once(spark, tmp_path, monkeypatch):
    """A second writer that has seen nothing committed comes last: its attempt does not count."""
    a, b = op.Rollup(spark, f"file://{tmp_path}/r"), op.Rollup(spark, f"file://{tmp_path}/r")
    df = spark.createDataFrame([("insert", "s", "l", "t", 5)], PLAIN)
    assert a.apply("x", df)
    monkeypatch.setattr(b, "committed", lambda batch: False)
    assert not b.apply("x", df) and totals(a) == totals(b) == {("s", "l", "t"): (1, 5)}
    state = b._fold()
    monkeypatch.setattr(b, "_fold", lambda: state)
    assert a.compact() and not b.compact()
    assert totals(a) == {("s", "l", "t"): (1, 5)}


def test_change_ids(spark, tmp_path):
    r = op.Rollup(spark, f"file://{tmp_path}/r")
    rows = [(None, "insert", 5), (None, "insert", 7), (None, "insert", 7), (1, "insert", 2), (1, "insert", 2), (2, "insert", 9), (2, "insert", 4)]
    df = spark.createDataFrame([(i, o, "s", "l", "t", n) for i, o, n in rows], f"change_id long, {PLAIN}")
    r.apply("x", df)
    assert totals(r) == {("s", "l", "t"): (5, 5 + 7 + 7 + 2 + 4)}


@pytest.mark.parametrize("row", [("other", 1, None), (None, 1, None), ("revise", 1, None)])
def test_invalid_changes_raise(spark, tmp_path, row):
    r = op.Rollup(spark, f"file://{tmp_path}/r")
    df = spark.createDataFrame([(row[0], "s", "l", "t", row[1], row[2])], f"{PLAIN}, old_tokens long")
    with pytest.raises(Exception):
        r.apply("x", df)
    assert not r.committed("x") and r.totals().count() == 0
    with pytest.raises(ValueError):
        r.apply("../x", df)


def test_empty_batch_and_null_counts(spark, tmp_path):
    r = op.Rollup(spark, f"file://{tmp_path}/r")
    assert r.apply("e", spark.createDataFrame([], PLAIN)) and r.totals().count() == 0
    assert r.apply("n", spark.createDataFrame([("insert", None, None, None, None)], PLAIN))
    assert totals(r) == {(None, None, None): (1, 0)}


def test_counts_of_a_tokenizer(spark, tmp_path):
    """Token counts of op2 as a tokenizer version, against the encoder itself."""
    pytest.importorskip("public_tokenizers")
    from tidemark.llm import op2_bpe
    from tidemark.llm.queries import tokenizer_path

    texts = ["The thing", None, "naïve école", "a b c"]
    df = docs(spark, texts, sources=["x", "x", "y", "y"])
    counted = df.select("doc_id", "source", "lang").join(op2_bpe.round_trip(df, tokenizer_path()).selectExpr("doc_id", "n_tokens AS tokens"), "doc_id")
    r = op.Rollup(spark, f"file://{tmp_path}/r")
    r.apply("load", op.insertions(counted, "bpe-49k"))
    bpe = op2_bpe.load(tokenizer_path())
    n = [len(bpe.encode(t or "")) for t in texts]
    assert totals(r) == {("x", "en", "bpe-49k"): (2, n[0] + n[1]), ("y", "en", "bpe-49k"): (2, n[2] + n[3])}
