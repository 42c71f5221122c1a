from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions import text as ft
from tidemark.functions.time import fetch_gap
from tidemark.operators import scorers
from tidemark.operators.valence import read_lexicon, valence

LEXICON = {"good": 1.9, "great": 3.1, "bad": -2.5, ":)": 2.0}


def squashed(total: float) -> float:
    return total / (total * total + 15) ** 0.5


@pytest.mark.parametrize(
    ("text", "total"),
    [
        ("", 0.0),
        ("nothing here", 0.0),
        ("a good day", 1.9),
        ("a very good day", 1.9 + 0.293),
        ("very much a good day", 1.9 + 0.293 * 0.9),
        ("slightly bad", -2.5 + 0.293),
        ("not good", 1.9 * -0.74),
        ("it isn't really good", (1.9 + 0.293) * -0.74),
        ("a GOOD day", 1.9 + 0.733),
        ("GOOD DAY", 1.9),
        ("good!!!", 1.9 + 3 * 0.292),
        ("bad!!!!!!", -2.5 - 4 * 0.292),
        ("good???", 1.9 + 3 * 0.18),
        ("good?????", 1.9 + 0.96),
        ("good but bad", 1.9 * 0.5 - 2.5 * 1.5),
        ("fine :)", 2.0),
        ("the least good day", 1.9 * -0.74),
        ("at least a good day", 1.9),
        ("at least good", 1.9),
        ("never so good", (1.9 + 0.293) * 1.25),
        ("never been so good", (1.9 + 0.293) * 1.25),
        ("never good", 1.9 * -0.74),
        ("without doubt good", 1.9),
        ("without a doubt good", 1.9),
        ("without any good", 1.9 * -0.74),
        ("that was the bomb", 3.0),
        ("a kiss of death", -1.5),
        ("a Bad ASS film", 1.5),
        ("bad", -2.5),
        ("yeah right, good", -2.0 + 1.9),
        ("a broken heart but good", -2.9 * 0.5 + 1.9 * 1.5),
    ],
)
def test_valence_rules(text, total):
    assert valence(text, LEXICON) == pytest.approx(squashed(total))


def test_idioms_of_the_caller_and_emoji():
    from tidemark.operators.valence import Trie

    idioms = Trie({"a b": 1.0, "a b c d": 2.0, "b": -1.0})
    assert idioms.at(["a", "b", "c", "x"], 0) == (2, 1.0) and idioms.at(["a", "b", "c", "d"], 0) == (4, 2.0) and idioms.at(["c"], 0) is None
    assert valence("a b c", {}, idioms) == pytest.approx(squashed(1.0)) and valence("x b", {}, idioms) == pytest.approx(squashed(-1.0))
    assert valence("\U0001f600", LEXICON, emoji={"\U0001f600": "great smile"}) == pytest.approx(squashed(3.1))


def test_large_lexicons_score_like_small_ones(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Good, bad good's"), (2, None), (3, "nothing"), (4, "it's GREAT")], "id long, text string")
    weights = {"good": 0.5, "bad": -0.75, "great": 3.0, "it's": 1.0}
    small = {r.id: r.score_vader for r in scorers.LexiconScorer(weights).score(df).collect()}
    monkeypatch.setattr(scorers, "SMALL_LEXICON", 2)
    assert {r.id: r.score_vader for r in scorers.LexiconScorer(weights).score(df).collect()} == small


def test_valence_scorer(spark, tmp_path):
    (tmp_path / "lexicon.txt").write_text("good\t1.9\t0.9\t[2, 2]\nbad\t-2.5\t0.6\t[3]\n")
    weights = read_lexicon(f"{tmp_path}/lexicon.txt")
    df = spark.createDataFrame([(1, "good", None), (2, "bad", None), (3, None, None), (4, "good", 0.1)], "id long, text string, score_vader double")
    got = {r.id: (r.score_vader, r.label_vader) for r in scorers.ValenceScorer(weights).score(df).collect()}
    assert got == {1: (round(squashed(1.9), 4), "positive"), 2: (round(squashed(-2.5), 4), "negative"), 3: (0.0, "neutral"), 4: (0.1, "positive")}


def test_prompt_keeps_braces_of_values(spark):
    df = spark.createDataFrame([("a {user} b", "u"), (None, "v")], "text string, user string")
    got = [r[0] for r in df.select(ft.prompt("Say: {text} by {user}.", text=F.col("text"), user=F.col("user"))).collect()]
    assert got == ["Say: a {user} b by u.", "Say:  by v."]


def test_gap(spark):
    now = dt.datetime(2024, 1, 20)
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 19), now), (2, dt.datetime(2024, 1, 12), now), (3, None, now)], "id long, h timestamp, now timestamp")
    got = {r.id: r.gap for r in df.select("id", fetch_gap(F.col("h"), F.col("now")).alias("gap")).collect()}
    assert got == {1: 0, 2: 86400 + 300 - 1, 3: None}


def test_a_run_after_a_break_scores_only_what_is_missing(spark, tmp_path):
    class Breaks:
        name = "x"
        seen: list[int] = []

        def score(self, posts):
            self.seen.append(posts.count())
            if len(self.seen) == 3:
                raise RuntimeError("broken")
            return posts.withColumn("score_x", F.lit(1.0))

    df = spark.range(40).select("id", F.lit("t").alias("text"))
    scorer = Breaks()
    with pytest.raises(RuntimeError):
        scorers.analyze(df, [scorer], checkpoint=f"{tmp_path}/c", batches=4)
    out = scorers.analyze(df, [scorer], checkpoint=f"{tmp_path}/c", batches=4)
    assert out.count() == 40 and out.columns == ["id", "text", "score_x"]
    assert len(scorer.seen) == 5 and sum(scorer.seen[:2]) + sum(scorer.seen[3:]) == 40
    # Other texts don't meet the old checkpoint.
    assert scorers.analyze(df.withColumn("text", F.lit("u")), [scorer], checkpoint=f"{tmp_path}/c", batches=4).first().text == "u"


def test_errors_are_reasons(spark):
    def client(said, user):
        if user == "b":
            raise ValueError("no answer")
        return json.dumps({"stance": "neutral_other", "confidence": 0.5, "reason": said})

    df = spark.createDataFrame([("1", "s", "a", "hi", 0.1), ("2", "s", "b", "ho", 0.2)], "id string, tracked_slug string, user string, text string, score double")
    got = {r.id: (r.stance, r.reason) for r in scorers.classify_stance(df, client, template="<{text}>").collect()}
    assert got == {"1": ("neutral_other", "<hi>"), "2": ("error", "no answer")}


def test_commands_with_plugins(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "plugged.py").write_text(
        "import json\n"
        "def load():\n    return lambda texts: [(0.5, 'positive') for _ in texts]\n"
        "def ask(text, user):\n    return json.dumps({'score': -0.5})\n"
        "def stance(text, user):\n    return json.dumps({'stance': 'neutral_other', 'confidence': 1, 'reason': 'r'})\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "plugged.py"))
    (tmp_path / "lex.json").write_text(json.dumps(LEXICON))
    spark.createDataFrame([("1", "a", "admin", "good", "2024-01-01"), ("2", "b", "media", "bad", "2024-01-02")], "id string, user string, tier string, text string, created_at string").write.parquet(f"{tmp_path}/posts")
    cli.main(["analyze", "--posts", f"{tmp_path}/posts", "--out", f"{tmp_path}/scored", "--lexicon", f"{tmp_path}/lex.json", "--rules", "--model", "plugged:load", "--client", "plugged:ask", "--tiers", "admin, other", "--checkpoint", f"{tmp_path}/part", "--batches", "2"])
    got = {r.id: (r.score_vader > 0, r.score_transformer, r.score_llm) for r in spark.read.parquet(f"{tmp_path}/scored").collect()}
    assert got == {"1": (True, 0.5, -0.5), "2": (False, 0.5, None)}
    assert not (tmp_path / "part").exists()
    spark.createDataFrame([("1", "s", "a", "hi", 0.1)], "id string, tracked_slug string, user string, text string, score_vader double").write.parquet(f"{tmp_path}/replies")
    for _ in range(2):  # the second time the table is there
        cli.main(["stance", "--stances", f"{tmp_path}/stances", "--replies", f"{tmp_path}/replies", "--client", "plugged:stance"])
    assert "neutral_other" in capsys.readouterr().out
