from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import clashing, docs
from tidemark.llm import op2_bpe as op

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("word_bpe_49k.json")
CASES = ["", None, " ", "The thing, isn't it? 123", "Σας ΟΔΟΣ İstanbul", "a<|endoftext|>b<|startoftext|>", "naïve école x y", "a" * 9000, "!" * 5000, "inthe" * 3000, "é" * 4000, "👩‍👩‍👧 한국 가", "\x1c\x00\x85"]


@pytest.fixture(scope="module")
def theirs():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def same(theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    mine = op.load(PATH)
    assert mine.encode(text) == ids
    assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", CASES)
def test_same_as_the_library(theirs, text):
    same(theirs, text or "")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinthrso tA'sé1.!<|\n"), max_size=80))
def test_same_on_random_text(theirs, text):
    same(theirs, text)


def test_stream_is_the_whole(monkeypatch):
    mine = op.load(PATH)
    assert mine.lookahead is not None and mine.lookahead < 2000
    rng = random.Random(5)
    for alphabet in ("abc", "int", "aeinrsth", "the"):
        s = mine.symbols("".join(rng.choice(alphabet) for _ in range(6000)))
        whole = mine.merged(list(s))
        for chunk in (1, 7, 500):
            monkeypatch.setattr(op, "CHUNK", chunk)
            assert list(mine.transduce(s[: 2500 if chunk == 1 else None])) == (mine.merged(list(s[:2500])) if chunk == 1 else whole)


def test_lookahead_holds_on_small_lists():
    """Against brute force: no continuation changes a token that ends L symbols before the end."""
    rng = random.Random(2)
    for _ in range(60):
        known, merges = ["a", "b"], []
        while len(merges) < 6:
            u, v = rng.choice(known), rng.choice(known)
            if len(u + v) < 9 and u + v not in known:
                known.append(u + v)
                merges.append((tuple(u), tuple(v)))
        limit = op.sufficient_lookahead(merges)
        rank = {(u, v): i for i, (u, v) in enumerate(merges)}

        def encode(text, rank=rank):
            out = [(c,) for c in text]
            while (best := min(((rank.get(p, 99), i) for i, p in enumerate(zip(out, out[1:]))), default=(99, 0)))[0] < 99:
                out[best[1] : best[1] + 2] = [out[best[1]] + out[best[1] + 1]]
            return out

        for _ in range(15):
            head = [rng.choice("ab") for _ in range(40)]
            kept, used = [], 0
            for t in encode(head):
                used += len(t)
                if used > 40 - limit:
                    break
                kept.append(t)
            assert encode(head + [rng.choice("ab") for _ in range(12)])[: len(kept)] == kept


def test_improper_list_has_no_bound():
    assert op.sufficient_lookahead([(("a",), ("b", "c")), (("b",), ("c",))]) is None


def test_incremental_decoder_splits_anywhere():
    mine = op.load(P.path("word_bpe_49k.json"))
    ids = mine.encode("naïve école 한국 " * 20)
    for step in (1, 2, 5):
        d = op.Decoder(mine)
        assert "".join(d.feed(ids[i : i + step]) for i in range(0, len(ids), step)) + d.close() == mine.decode(ids)


def test_round_trip(spark, theirs):
    rows = {r.doc_id: r for r in op.round_trip(clashing(docs(spark, CASES)), PATH).collect()}
    for i, t in enumerate(CASES):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = op.encode(docs(spark, CASES), PATH)
    assert {r.doc_id: r.text for r in op.decode(encoded, PATH).collect()}[3] == theirs.decode(theirs.encode(CASES[3], add_special_tokens=False).ids)
    assert op.round_trip(docs(spark, []), PATH).count() == 0


def test_long_text_crosses_slices(theirs, monkeypatch):
    monkeypatch.setattr(op, "SLICE", 100)
    mine = op.load(PATH)
    ids = mine.encode("some words and others " * 300)
    n, a, b = op.digest(mine, ids)
    assert (n, a, b) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(theirs.decode(ids).encode()).hexdigest())


@pytest.mark.parametrize("part", [1, 3, 50, 1000])
@pytest.mark.parametrize("text", [*(c for c in CASES if c), "don't we're 're <|endoftext|>!!!'s 12", "e\u0301 \u1100\u1161\u11a8 한국어 \u0915\u093c A\u030a\u0323" * 40, "x" * 3000 + "\u0301" * 200 + "漢字" * 500])
def test_streamed_text_is_the_whole(monkeypatch, part, text):
    mine = op.load(PATH)
    want = mine.encode(text)
    monkeypatch.setattr(op, "PART", part)
    monkeypatch.setattr(op, "LONG", 0)
    assert list(mine.ids(text)) == want == mine.encode(text)


def test_slices_end_where_normalization_looks_across_nothing():
    """No character that inert() lets a slice begin with is the second of a composition or reorders."""
    import unicodedata

    for i in range(0x110000):
        d = unicodedata.decomposition(c := chr(i))
        if d and not d.startswith("<") and len(parts := d.split()) == 2 and unicodedata.normalize("NFC", "".join(chr(int(x, 16)) for x in parts)) == c:
            assert not op.inert(chr(int(parts[1], 16))), hex(i)
        if unicodedata.combining(c):
            assert not op.inert(c)


@pytest.mark.parametrize("unit", ["inthe", "some words, and others ", "é漢! 12 x", "!?"])
def test_memory_does_not_grow_with_the_text(unit):
    """Beside the text and one pre-token as text, what a round trip holds at once is a constant."""
    import tracemalloc

    mine = op.load(PATH)
    peaks = []
    for chars in (1 << 17, 1 << 19):
        text = unit * (chars // len(unit))
        op.digest(mine, mine.ids(text))
        tracemalloc.start()
        op.digest(mine, mine.ids(text))
        longest = len(text.encode()) if " " not in unit else 0
        peaks.append(tracemalloc.get_traced_memory()[1] - 4 * longest)
        tracemalloc.stop()
    assert peaks[1] < 6 << 20


def test_workers_let_tables_go(spark):
    """A worker lives on for later steps, and must not hold the tables beside them."""
    rows = docs(spark, ["a text"] * 16).repartition(4)
    assert op.tokenized(rows, PATH).count() == 16 == len(op.tokenized(rows, PATH).select("ids").collect())

    def held(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [op.load.cache_info().currsize]})

    assert {r.n for r in rows.select("doc_id").mapInArrow(held, "n long").collect()} == {0}
