from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import score as fs
from tidemark.functions import text as ft
from tidemark.functions import time as tm


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("raw", "want"), [
    ("<p>a</p><p>b</p>", "a b"), ("  x   y ", "x y"), ("a &amp; <b>b</b>", "a &amp; b"), ("<a href='<x>'>t</a>", "'>t"), ("", ""), (None, None),
])
def test_strip_html(spark, raw, want):
    assert one(spark, raw, ft.strip_html) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("https://a.b/c", True), (" http://a  https://b \n", True), ("http://a word", False), ("", False), (None, False), ("see http://a", False), ("https://a https://b", True),
])
def test_url_only(spark, raw, want):
    assert one(spark, raw, ft.url_only) is want


def test_url_only_is_linear(spark):
    assert one(spark, "http://" + "a" * 50_000 + " x", ft.url_only) is False


@pytest.mark.parametrize(("raw", "want"), [("  \t", True), (None, True), ("x", False)])
def test_empty(spark, raw, want):
    assert one(spark, raw, ft.empty_text) is want


@pytest.mark.parametrize(("score", "inclusive", "strict"), [(-0.05, "negative", "neutral"), (-0.0499, "neutral", "neutral"), (0.0, "neutral", "neutral"), (0.05, "positive", "neutral"), (0.06, "positive", "positive"), (None, None, None)])
def test_labels(spark, score, inclusive, strict):
    assert one(spark, score, fs.label, "double") == inclusive
    assert one(spark, score, fs.strict_label, "double") == strict


def test_small_text_functions(spark):
    assert one(spark, "x" * 40, ft.ellipsis) == "x" * 34 + ".."
    assert one(spark, "x" * 36, ft.ellipsis) == "x" * 36
    assert one(spark, "a, b ,,c", ft.csv_list) == ["a", "b", "c"]
    assert one(spark, "replies_a_b", lambda c: ft.remove_prefix(c, "replies_")) == "a_b"
    assert one(spark, -0.26, lambda c: ft.bar(c, 20), "double") == "█" * 5
    assert one(spark, None, lambda c: ft.bar(c, 20), "double") == ""
    assert one(spark, "MAGA ultra maga", lambda c: ft.keyword_hits(c, ["maga", "ultra maga"])) == 2
    assert one(spark, 0.25, lambda c: ft.interval(c, c), "double") == "[+0.250, +0.250]"


@pytest.mark.parametrize(("raw", "want"), [
    ('{"score": 0.5, "label": "positive"}', (0.5, "positive", True)),
    ('```json\n{"score": -0.2}\n```', (-0.2, "negative", True)),
    ('```{"score": 0.05}```', (None, None, False)),
    ('{"score": "0.5"}', (None, None, False)),
    ("nothing", (None, None, False)),
    (None, (None, None, False)),
])
def test_sentiment_reply(spark, raw, want):
    assert tuple(one(spark, raw, ft.sentiment_reply)) == want


@pytest.mark.parametrize(("raw", "stance", "ok"), [('{"stance": "a", "confidence": 0.5, "reason": "r"}', "a", True), ('```\n{"stance": "b"}\n```', "b", True), ("{broken", "error", False), ("", "error", False), (None, "error", False)])
def test_stance_reply(spark, raw, stance, ok):
    got = one(spark, raw, ft.stance_reply)
    assert (got.stance, got.ok) == (stance, ok)


@pytest.mark.parametrize(("raw", "want"), [("2024-01-01T00:00:00Z", "2024-01-01T00:00:00"), ("2024-01-01T02:00:00.5+02:00", "2024-01-01T00:00:00.500000"), ("bad", None), (None, None)])
def test_iso(spark, raw, want):
    got = one(spark, raw, tm.parse_iso)
    assert (got and got.isoformat()) == want


def test_loyalty(spark):
    as_of = F.lit("2024-01-01").cast("timestamp")
    score = lambda bio, made: spark.createDataFrame([(bio, made)], "b string, c string").select(fs.loyalty_score(F.col("b"), F.try_to_timestamp("c"), as_of, ["maga", "ultra maga", "kag", "patriot"])).first()[0]
    assert score(None, None) == 0
    assert score("ultra MAGA", "2024-01-01") == pytest.approx(0.4)
    assert score("ultra maga kag patriot", "2010-01-01") == pytest.approx(1.0)
    assert score("", "2030-01-01") == 0 and score("", "bad") == 0
    assert one(spark, 0.7, fs.loyalty_tier, "double") == "high" and one(spark, 0.3, fs.loyalty_tier, "double") == "medium"


def test_probabilities(spark):
    kind = "array<struct<label:string,score:double>>"
    p = [("Negative", 0.2), ("neutral", 0.4), ("POSITIVE", 0.4)]
    assert one(spark, p, fs.expected_score, kind) == 0.2
    assert one(spark, p, fs.likeliest_label, kind) == "neutral"
