from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, docs
from tidemark.llm import op3_quality as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "one", "é" * 3000, "a b c d e f g h", "a b c d e f g h " * 2, "x " * 5000, "l1\nl1\n \nl1\r\nl2", "#*$%&|<>", "   x", "\x1c a"]
    out += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    return out + ["\n".join(rng.choice(["p q", "r", ""]) for _ in range(12)) for _ in range(20)]


def test_counts_match_brute_force(spark):
    every = texts()
    got = {r.doc_id: r for r in op.features(clashing(docs(spark, every))).collect()}
    for i, t in enumerate(every):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 250, 0.02), (3, 400, 0.02), (40, 3000, 0.02), (0, 10, 0.5), (900, 60_000, 0.02), (5000, 300_000, 0.02)])
def test_binomial_tail_is_exact(spark, k, n, p):
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k + 1)]
    want = math.exp(max(logs)) * math.fsum(math.exp(x - max(logs)) for x in logs)
    got = spark.createDataFrame([(k, n)], "k long, n long").select(op.binomial_tail(F.col("k"), F.col("n"), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-7, abs=1e-300)
    assert spark.range(1).select(op.binomial_tail(F.lit(n), F.lit(n), p)).first()[0] == 1.0


def test_cutoffs_limit_false_rejections(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["word", "text", "more"]) + str(rng.randrange(999)) for _ in range(30)) for _ in range(900)]
    junk = [" ".join("%%%" + str(rng.randrange(999)) for _ in range(30)) for _ in range(100)]
    df = docs(spark, good + junk)
    labels = spark.createDataFrame([(i, int(i < 900), 0) for i in range(1000)] + [(5, None, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = op.judge(df, labels).collect()
    assert len(rows) == 1000
    assert sum(r.kept for r in rows if r.doc_id < 900) >= 900 * (1 - op.RISK) and not any(r.kept for r in rows if r.doc_id >= 900)
    # Too few labels certify nothing: only the base rule rejects.
    few = op.judge(df, labels.where("doc_id < 50")).collect()
    assert all(r.kept != r.base_failed for r in few)


def tail(k, n, p):
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def brute_cutoffs(rows, tunes):
    """The path and its test for one stratum, by lists: rows are {rule: metric} of the good documents."""
    head, rest = [r for r in rows if tunes[r["doc_id"]]], [r for r in rows if not tunes[r["doc_id"]]]
    steps = sorted((sum(r[rule] > c for r in head), n, i, c) for n, rule in enumerate(op.GRID) for i, c in enumerate(op.GRID[rule]))
    return steps, rest


def test_kept_matches_brute_force(spark):
    """Verdicts of three strata, one of them without language and one with few labels, against the method written with lists."""
    rng = random.Random(9)
    texts, langs = [], []
    for n in range(2600):
        lang = rng.choice(["en", "en", None, "de"]) if n % 40 else "few"
        bad = rng.random() < (0.1 if n % 5 else 0.01)
        w = [rng.choice(["word", "text", "more", "!!", "a$"]) + str(rng.randrange(999)) for _ in range(rng.randrange(15, 40))]
        if bad:
            w = [x + rng.choice(["%%%", "!!!!", "", "#"]) for x in w] + w[:12]
        texts.append(" ".join(w))
        langs.append(lang)
    df = docs(spark, texts, langs=langs)
    good = {n for n in range(2600) if n % 7}
    labels = spark.createDataFrame([(n, int(n in good), 0) for n in range(2600)], "doc_id long, quality int, toxic int")
    tunes = {r.doc_id: r.t for r in spark.range(2600).selectExpr("id AS doc_id", "pmod(xxhash64('holdout', id), 2) = 0 AS t").collect()}
    risk, level = 0.05, 0.1
    got = {r.doc_id: r for r in op.judge(df, labels, risk, level).collect()}
    strata = {}
    for n in sorted(good):
        if not got[n].base_failed:
            strata.setdefault(langs[n], []).append(got[n].asDict())
    cuts = {}
    for s, rows in strata.items():
        steps, rest = brute_cutoffs(rows, tunes)
        now, cuts[s] = dict.fromkeys(op.GRID, math.inf), dict.fromkeys(op.GRID, math.inf)
        for _, rule, _, c in steps:
            name = list(op.GRID)[rule]
            now[name] = min(now[name], c)
            k = sum(any(r[x] > now[x] for x in now) for r in rest)
            if k >= len(rest) * risk or tail(k, len(rest), risk) > level / len(strata):
                break
            cuts[s] = dict(now)
    for n, r in got.items():
        assert r.kept == (not r.base_failed and not any(r[x] > c for x, c in cuts.get(langs[n], {}).items())), n
    assert all(c == math.inf for c in cuts["few"].values()) and any(c < math.inf for c in cuts["en"].values())
    assert any(not r.kept and not r.base_failed for r in got.values())


def test_no_labels_null_stratum_and_empty(spark):
    df = docs(spark, ["word " * 3 + " ".join(map(str, range(30)))] * 3, langs=[None, "en", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in op.judge(df, none).collect()] == [True] * 3
    assert op.judge(docs(spark, []), none).count() == 0


def test_repeated_rows_certify_nothing(spark):
    """Sixty good documents are too few, and so are they twenty times over."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" + "$$$$" * (n >= 60) for _ in range(30)) for n in range(70)]
    labels = spark.createDataFrame([(n, int(n < 60), 0) for n in range(70)], "doc_id long, quality int, toxic int")
    once = docs(spark, texts)
    many = docs(spark, texts * 20, ids=list(range(70)) * 20)
    assert all(r.kept for r in op.judge(once, labels).collect())
    assert all(r.kept for r in op.judge(many, labels).collect())
