"""op11 against the libraries on whole texts, groups by common ends and counts in one dictionary."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.helpers import clashing, docs
from tidemark.llm import op11_align
from tidemark.llm.queries import ALIGNED

PATHS = tuple(map(public_tokenizers.path, ALIGNED))
MARKS = [" ", "  ", "\n", "\t ", "a", "the", "Straße", "naïve", "漢字", "🙂", "'s", "<|endoftext|>", "<s>", "</s>", "<0x41>", "\x00", "▁", "١٢", "é", "\x1c", " ", "x" * 30, "12345", "#$%", "\r\n"]


def texts(n=120, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(MARKS) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(n)]


def unicode_bytes():
    """The byte-level alphabet, character to byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@pytest.fixture(scope="module")
def tools():
    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    return a, b, unicode_bytes()


def brute(rows, tools):
    a, b, to_byte = tools
    found, counts = [], Counter()
    for i, text in rows:
        groups, links = [], []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [bytes(to_byte[c] for c in a.id_to_token(t)) for t in ia]
            bb = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in ib]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
                common, ga, gb = set(ea) & set(eb), [[]], [[]]
                for ids, ends, out in ((ia, ea, ga), (ib, eb, gb)):
                    for t, e in zip(ids, ends, strict=True):
                        out[-1].append(t)
                        if e in common:
                            out.append([])
                groups = list(zip(ga[:-1], gb[:-1], strict=True))
                links = [(x, y) for x, e in zip(ia, ea, strict=True) for y, f in zip(ib, eb, strict=True) if e == f] if len(ia) < 500 else [(x[-1], y[-1]) for x, y in groups]
            else:
                ia = ib = []
        else:
            ia = ib = []
        counts.update(links)
        found.append((i, ia, ib, groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for i, ia, ib, groups, links in found:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        out.append((i, len(ia), len(ib), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_equals_brute_force(spark, tools, clash):
    made = [None, "", " ", *MARKS, *texts(), "the cat sat", "the cat sat"]
    ids = [None, None, *range(len(made) - 2)]
    table = docs(spark, made, ids=ids)
    assert result(op11_align.align(clashing(table) if clash else table, *PATHS)) == brute(zip(ids, made, strict=True), tools)


def test_long_texts_are_cut_where_both_begin_a_token(spark, tools, monkeypatch):
    made = ["".join(texts(40, seed)) for seed in range(6)] + ["x" * 400, " " * 400, "a b " * 200]
    made = [t.replace("▁", "") for t in made]
    whole = brute(enumerate(made), tools)
    for part, group, memo in ((1, 1, 0), (7, 50, 3), (64, 10_000, 32)):
        monkeypatch.setattr(op11_align, "PART", part)
        monkeypatch.setattr(op11_align, "GROUP", group)
        monkeypatch.setattr(op11_align, "PAIRS", 5)
        monkeypatch.setattr(op11_align, "MEMO_CHARS", memo)
        two = op11_align.load(*PATHS)
        two.memo = op11_align.Memo(20)
        got = op11_align.align_texts(two, made)
        assert all(len(list(op11_align.parts_of(t))) > 3 for t in made[:6])
        assert [(i, *r[:4], r[4]) for i, r in enumerate(got)] == [(w[0], *w[1:5], w[7]) for w in whole]
        assert [sum(r[6]) for r in got] == [w[4] for w in whole]


def test_a_lost_part_loses_the_text(monkeypatch):
    monkeypatch.setattr(op11_align, "PART", 1)
    two = op11_align.load(*PATHS)
    assert op11_align.align_texts(two, ["one two ▁ three", "one"])[0] == (0, 0, 0, 0, "", [], [])


def test_components_are_the_groups_by_common_ends():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 60)
        a, b = (sorted(rng.sample(range(1, n), rng.randrange(n))) + [n] for _ in range(2))
        group_a, group_b, link_a, link_b = op11_align.aligned(np.diff([0, *a]), np.diff([0, *b]))
        common = sorted(set(a) & set(b))
        assert group_a.tolist() == np.searchsorted(common, a).tolist() and group_b.tolist() == np.searchsorted(common, b).tolist()
        assert [a[i] for i in link_a] == [b[i] for i in link_b] == common


def test_chunks_share_counts(spark, tools, monkeypatch):
    from tidemark.llm import chunks

    monkeypatch.setattr(chunks, "CHUNK_BYTES", 50)
    made = texts(60, 9) * 2
    table = docs(spark, made).repartition(3)
    assert result(op11_align.align(table, *PATHS)) == brute(enumerate(made), tools)


def test_empty_table(spark):
    assert op11_align.align(docs(spark, []), *PATHS).count() == 0


def test_pairs_of_a_batch():
    two = op11_align.load(*PATHS)
    rows = op11_align.align_texts(two, ["a a a b"])
    assert sum(rows[0][6]) == rows[0][3] == 4 and pa.array(rows[0][5]).to_pylist() == sorted(rows[0][5])
