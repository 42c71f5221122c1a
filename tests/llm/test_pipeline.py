from __future__ import annotations

import hashlib
import math
from itertools import combinations
from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm import test_importance, test_mixing, test_near, test_pii  # noqa: E402
from tests.llm.test_simhash import roots  # noqa: E402
from tidemark.llm import op1_pii  # noqa: E402
from tidemark.llm.queries import tokenizer_path  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def brute_quality(rows, labels):
    least = {}
    for r in labels:
        if r.doc_id is not None and r.quality is not None:
            least[r.doc_id] = min(r.quality, least.get(r.doc_id, 1))
    _, _, kept = test_importance.brute([r.text for r in rows], [r.doc_id for r in rows], {i for i, q in least.items() if q == 1}, 0.002)
    return [r for r, k in zip(rows, kept, strict=True) if k]


def brute_near_dedup(rows):
    sets = {r.doc_id: test_near.brute_set(r.text) for r in rows}
    of = roots(list(sets), [(a, b) for a, b in combinations(sets, 2) if test_near.similar(sets[a], sets[b])])
    return [r for r in rows if of[r.doc_id] == r.doc_id]


def brute_redact(text, more):
    """Base spans by the patterns themselves, *more* by the operator; overlapping ones are replaced together."""
    spans = sorted({(s, e, k) for k, s, e in test_pii.brute(text)} | more)
    out, at = "", 0
    for s, e, k in spans:
        if s >= at:
            out += text[at:s] + f"<{k.upper()}>"
        at = max(at, e)
    return out + text[at:]


def brute_copies(spark, rows):
    """Copies of each (doc_id, source, text): lambda by bisection, then the copies with the smallest keys within the target."""
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    u = {r[0]: ((r[1] >> 12 if r[1] >= 0 else (r[1] + 2**64) >> 12) + 0.5) / 2**52 for r in df.selectExpr("doc_id", "xxhash64('mix', CAST(doc_id AS string), text, coalesce(source, ''))").collect()}
    size = {i: len(t.split()) for i, _, t in rows}
    total = {}
    for i, s, _ in rows:
        total[s] = total.get(s, 0) + size[i]
    copies = {}
    for s, goal in test_mixing.targets(total).items():
        own = [i for i, o, _ in rows if o == s and size[i]]
        if goal <= 0 or not own:
            continue
        mean = total[s] / len(own)
        rate = lambda i, lam: min(3.0, math.exp(min(lam * size[i] / mean, 5)))
        low, high = -700.0, 700.0
        for _ in range(200):
            lam = (low + high) / 2
            low, high = (lam, high) if sum(size[i] * rate(i, lam) for i in own) < goal else (low, lam)
        words = 0
        for _, i in sorted(((c - u[i]) / rate(i, lam), i) for i in own for c in (1, 2, 3)):
            words += size[i]
            if words > goal * (1 + 1e-9):
                break
            copies[i] = copies.get(i, 0) + 1
    return copies


def test_stages_and_run_match_brute_force(spark):
    """Each stage on its predecessor's rows, and the whole run, by code of their own."""
    raw = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted(raw.collect(), key=lambda r: r.doc_id)
    rows = brute_quality(rows, spark.read.parquet(f"{DATA}/labels.parquet").collect())
    assert len(rows) < raw.count()
    before = len(rows)
    rows = brute_near_dedup(rows)
    assert len(rows) < before
    frame = raw.where(raw["doc_id"].isin([r.doc_id for r in rows]))
    spans = {r.doc_id: r.spans for r in op1_pii.detect(frame).collect()}
    more = {i: {(int(a), int(b), k) for k, a, b in (x.split(":") for x in s.split(",") if x)} for i, s in spans.items()}
    clean = [(r.doc_id, r.source, brute_redact(r.text, more[r.doc_id])) for r in rows]
    assert [r[2] for r in clean] != [r.text for r in rows]
    copies = brute_copies(spark, clean)
    theirs = tokenizers.Tokenizer.from_file(tokenizer_path())
    theirs.no_padding()
    theirs.no_truncation()
    want = []
    for i, _, text in clean:
        ids = theirs.encode(text, add_special_tokens=False).ids
        told = (hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        want += [(i, ids, len(ids), *told)] * copies.get(i, 0)
    got = sorted((r.doc_id, r.ids, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(DATA)).collect())
    assert got == sorted(want) and len(got) > 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(DATA)).columns == docs.columns
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(DATA)).count() == 0
