"""Remote calls, models at their limits and checkpoints that know their scorers."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scorers
from tidemark.operators.calls import Pace, Policy, answers


class Flaky:
    """Fails for a text as often as its number says."""

    def __init__(self):
        self.tries = {}

    def __call__(self, text, user=""):
        n = self.tries[text] = self.tries.get(text, 0) + 1
        if n <= int(text):
            raise TimeoutError(f"try {n}")
        return f"ok {text}"


class Final(Exception):
    retry = False


def test_retries_and_errors():
    client = Flaky()
    rows = [(str(n),) for n in (0, 1, 2, 3, 9, 0)]
    got = list(answers(client, rows, Policy(threads=3, tries=3, wait=0.001)))
    assert got == [("ok 0", None), ("ok 1", None), ("ok 2", None), (None, "try 3"), (None, "try 3"), ("ok 0", None)]
    assert client.tries == {"0": 2, "1": 2, "2": 3, "3": 3, "9": 3}

    def refuses(text):
        client.tries["x"] = client.tries.get("x", 0) + 1
        raise Final

    assert list(answers(refuses, [("a",)], Policy(tries=5))) == [(None, "Final")] and client.tries["x"] == 1


def test_queue_is_bounded_and_paced():
    taken, most = [], []

    def rows():
        for i in range(30):
            taken.append(i)
            yield (i,)

    for done, _ in enumerate(answers(lambda i: str(i), rows(), Policy(threads=2))):
        most.append(len(taken) - done)
    assert max(most) <= 2 * 2 + 1 and len(taken) == 30
    began, pace = time.monotonic(), Pace(100)
    for _ in range(11):
        pace.take()
    assert 0.09 < time.monotonic() - began < 1


def test_remote_scorer_keeps_errors(spark):
    def client(text, user):
        if text == "boom":
            raise ValueError("no answer")
        return json.dumps({"score": 0.25, "label": "positive"}) if text != "odd" else "no JSON"

    df = spark.createDataFrame([(1, "fine", "u"), (2, "boom", "u"), (3, "odd", "u"), (4, "https://a.b/c https://d", "u"), (5, " ", "u")], "id long, text string, user string")
    got = {r.id: (r.score_llm, r.label_llm, r.error_llm) for r in scorers.RemoteScorer(client, policy=Policy(wait=0.001)).score(df).collect()}
    assert got == {1: (0.25, "positive", None), 2: (None, None, "no answer"), 3: (None, None, "unreadable: no JSON"), 4: (0.0, "off_topic", None), 5: (None, None, None)}


def test_models_see_texts_of_like_length_cut_to_their_limit():
    seen = []

    def model(texts):
        seen.append([len(t.split()) for t in texts])
        return [(len(t.split()) / 1000, "neutral") for t in texts]

    texts = ["w " * n for n in (900, 3, 512, 700, 1, 2)] + [" ".join(["a"] * 600)]
    rows = scorers.in_batches(model, texts, 2, 512, 1e9, lambda: 0.0)
    assert [r[0] for r in rows] == [0.512, 0.003, 0.512, 0.512, 0.001, 0.002, 0.512]
    assert seen[0] == [1, 2] and max(map(max, seen)) == 512 and all(max(b) - min(b) <= 509 for b in seen)
    assert scorers.truncated("a b  c d", 2) == "a b" and scorers.truncated(" a ", 2) == " a " and scorers.truncated("", 2) == ""


def test_ceiling_and_bad_batches():
    used = iter([0.0, 50.0, 101.0])
    rows = scorers.in_batches(lambda t: [(0.5, "x")] * len(t), ["a", "bb", "ccc", "dddd", "eeeee"], 2, 9, 100.0, lambda: next(used))
    assert [r[0] for r in rows] == [0.5, 0.5, 0.5, 0.5, None] and rows[4][2] == "memory ceiling of 100 MB"
    assert scorers.in_batches(lambda t: [], ["a"], 2, 9, 1.0, lambda: 0.0) == [(None, None, "0 answers to 1 texts")]


def test_rows_left_at_the_ceiling_are_scored_later(spark):
    load = lambda: lambda texts: [(0.5, "positive")] * len(texts)
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    first = scorers.ModelScorer(load, ceiling_mb=1).score(df)
    assert {r.id: (r.score_transformer, r.score_failed, (r.error_transformer or "")[:14]) for r in first.collect()} == {1: (None, True, "memory ceiling"), 2: (0.0, False, "")}
    again = scorers.ModelScorer(load).score(first)
    assert {r.id: (r.score_transformer, r.score_failed, r.error_transformer) for r in again.collect()} == {1: (0.5, False, None), 2: (0.0, False, None)}


def test_a_checkpoint_is_its_scorers_own(spark, tmp_path):
    df = spark.createDataFrame([(i, "good day") for i in range(20)], "id long, text string")
    place = f"{tmp_path}/c"
    run = lambda s: {r[0] for r in scorers.analyze(df, s, checkpoint=place, batches=3).select(f"score_{s[-1].name}").collect()}
    assert run([scorers.LexiconScorer({"good": 1.0})]) == {1.0}
    assert run([scorers.LexiconScorer({"good": -0.5})]) == {-0.5}
    assert run([scorers.LexiconScorer({"good": 1.0})]) == {1.0}
    posts = df.withColumn("user", F.lit("u"))
    for template, value in (("a {text}", 0.1), ("b {text}", 0.2)):
        client = lambda said, user: json.dumps({"score": {"a": 0.1, "b": 0.2}[said[0]], "label": "x"})
        out = scorers.analyze(posts, [scorers.RemoteScorer(client, template=template)], checkpoint=place, batches=2)
        assert {r.score_llm for r in out.collect()} == {value}


def test_signatures():
    a, b = (scorers.LexiconScorer(w) for w in ({"x": 1.0, "y": 2.0}, {"y": 2.0, "x": 1.0}))
    assert scorers.signature(a) == scorers.signature(b) != scorers.signature(scorers.ValenceScorer({"x": 1.0, "y": 2.0}))
    make = lambda n: lambda t: t * n
    assert scorers.signature(make(2)) == scorers.signature(make(2)) != scorers.signature(make(3))
    assert scorers.signature(lambda t: t + "a") != scorers.signature(lambda t: t + "b")
    assert " at 0x" not in scorers.signature([make, object(), len, Policy()])


def test_input_is_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def marked(x):
        reads.add(1)
        return f"good {x}"

    df = spark.range(50).select("id", marked("id").alias("text"))
    out = scorers.analyze(df, [scorers.LexiconScorer({"good": 1.0})], checkpoint=f"{tmp_path}/c", batches=5)
    assert out.count() == 50 and reads.value == 50


def test_no_posts(spark, tmp_path):
    df = spark.createDataFrame([], "id long, text string")
    assert scorers.analyze(df, [scorers.LexiconScorer({"good": 1.0})], checkpoint=f"{tmp_path}/c").columns == ["id", "text", "score_vader", "label_vader"]


@pytest.mark.parametrize("batches", [1, 7])
def test_parts_hold_all_rows(spark, tmp_path, batches):
    df = spark.range(30).select(F.when(F.col("id") > 20, F.col("id")).alias("id"), F.lit("good").alias("text"))  # most keys are null
    assert scorers.analyze(df, [scorers.LexiconScorer({"good": 1.0})], checkpoint=f"{tmp_path}/c", batches=batches).count() == 30
