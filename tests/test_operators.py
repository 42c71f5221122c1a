from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, events, matching, replies, resample, restore, scorers, series, stance, summary
from tidemark.sources import dims

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
POSTS = "id string, user string, tier string, tracked_slug string, created_at timestamp, score double, label string"


def post(i, when, score, user="u", tier="t", slug="s", label="neutral"):
    return (str(i), user, tier, slug, dt.datetime.fromisoformat(when) if when else None, score, label)


@pytest.fixture(scope="module")
def posts(spark):
    rng = np.random.default_rng(1)
    rows = [post(i, f"2024-01-{1 + int(d):02d} {int(h):02d}:30:00", None if s > 0.97 else float(round(s, 3)), f"u{i % 5}", f"t{i % 3}", f"s{i % 2}") for i, (d, h, s) in enumerate(zip(rng.choice([0, 1, 4, 5, 9, 20], 300), rng.integers(0, 24, 300), rng.uniform(-1, 1, 300), strict=True))]
    return spark.createDataFrame(rows, POSTS).cache()


@pytest.mark.parametrize("width", [1, 3, 4, 5])
def test_resample_and_rolling_match_pandas(posts, width):
    got = series.rolling(series.resample(posts, "day", ("tier",)), width, ("tier",)).toPandas().sort_values(["tier", "period"])
    pdf = posts.toPandas().dropna(subset=["score"]).set_index("created_at")
    for tier, g in pdf.groupby("tier"):
        daily = g["score"].resample("1D").mean()
        mine = got[got.tier == tier]
        np.testing.assert_allclose(mine["mean"].to_numpy(float), daily.to_numpy(), atol=1e-12)
        np.testing.assert_allclose(mine["smoothed"].to_numpy(float), daily.rolling(width, center=True, min_periods=1).mean().to_numpy(), atol=1e-12)
        assert mine["n"].tolist() == g["score"].resample("1D").count().tolist()


def test_resample_edge_cases(spark):
    df = spark.createDataFrame([post(1, "2024-01-01 05:00:00", 1.0, None), post(2, "2024-01-03 05:00:00", None, "a"), post(3, None, 1.0, "b")], POSTS)
    got = series.resample(df, "day", ("user",)).collect()
    assert [(r.user, r.n) for r in got] == [(None, 1)]
    assert series.resample(df, "day", dropna=False).count() == 3
    assert series.resample(df.where("false"), "hour").count() == 0


def test_heatmap_and_pivot_match_pandas(posts):
    pdf = posts.toPandas().dropna(subset=["score"])
    pdf["week"] = pdf["created_at"].dt.to_period("W").dt.start_time
    want = pdf.groupby(["user", "week"])["score"].mean()
    got = series.account_heatmap(posts).toPandas().set_index(["user", "week"])["mean"].sort_index()
    np.testing.assert_allclose(got.to_numpy(), want.sort_index().to_numpy(), atol=1e-12)
    assert series.account_week_pivot(posts).count() == 5
    assert len(series.charts(posts, ("score", "absent"))) == 5


def test_event_windows_edges(spark):
    ev = dims.events(spark, [(dt.date(2024, 1, 10), "e", "", "c", "i"), (dt.date(2030, 1, 1), "none", "", "c", "i")])
    rows = [post(1, "2024-01-08 00:00:00", 1.0), post(2, "2024-01-07 23:59:59", 9.0), post(3, "2024-01-10 00:00:00", -1.0), post(4, "2024-01-12 00:00:00", 9.0), post(5, "2024-01-11 12:00:00", None)]
    got = events.compare_events(spark.createDataFrame(rows, POSTS), ev).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.n_pre, r.n_post, r.mean_pre, r.mean_post, r.diff) == (1, 2, 1.0, -1.0, -2.0)
    assert events.compare_events(spark.createDataFrame(rows, POSTS), ev, where="tier = 'x'").count() == 0


@SLOW
@given(st.lists(st.integers(-100, 100), min_size=1, max_size=20), st.integers(1, 72))
def test_pre_and_post_add_up(spark, offsets, hours):
    c = dt.datetime(2024, 3, 1)
    rows = [post(i, (c + dt.timedelta(hours=o)).isoformat(), 0.1) for i, o in enumerate(offsets)]
    got = events.compare_events(spark.createDataFrame(rows, POSTS), dims.events(spark, [(c.date(), "e", "", "c", "i")]), hours).first()
    want = sum(-hours <= o < hours for o in offsets)
    assert (got.n_pre + got.n_post if got else 0) == want


def test_bootstrap_equals_one_shot_numpy(spark, posts, monkeypatch):
    monkeypatch.setattr(bootstrap, "CELLS", 1000)
    v = np.random.default_rng(3).normal(size=150)
    rng = np.random.default_rng(0)
    lo, hi = np.quantile(v[rng.integers(0, 150, size=(2000, 150))].mean(axis=1), [0.025, 0.975])
    assert bootstrap.mean_ci(v) == (float(v.mean()), float(lo), float(hi))
    assert all(np.isnan(bootstrap.mean_ci([])))
    assert bootstrap.mean_ci([2.0, np.nan]) == (2.0, 2.0, 2.0)
    assert all(np.isnan(bootstrap.diff_ci([1.0], [])))
    assert bootstrap.diff_ci([1.0] * 3, [0.0] * 4) == (1.0, 1.0, 1.0)
    got = {r.tier: r for r in bootstrap.exact_mean_ci(posts, ("tier",)).collect()}
    for tier, g in posts.toPandas().sort_values(["created_at", "id"]).groupby("tier"):
        m, lo, hi = bootstrap.mean_ci(g["score"])
        assert (got[tier].n, got[tier].mean, got[tier].ci_low, got[tier].ci_high) == (len(g), m, lo, hi)


def test_poisson_interval_is_near_the_exact_one(posts):
    exact = {r.tier: r for r in bootstrap.exact_mean_ci(posts, ("tier",)).collect()}
    for r in bootstrap.poisson_mean_ci(posts, ("tier",), replicates=400).collect():
        e = exact[r.tier]
        assert r.mean == pytest.approx(e.mean) and abs(r.ci_low - e.ci_low) < 0.05 and abs(r.ci_high - e.ci_high) < 0.05
    sides = posts.withColumn("on", F.col("tier") == "t0")
    d = bootstrap.poisson_diff_ci(sides, ("tracked_slug",), "on", replicates=400).collect()
    x = {r.tracked_slug: r for r in bootstrap.exact_diff_ci(sides, ("tracked_slug",), "on").collect()}
    for r in d:
        assert r.diff == pytest.approx(x[r.tracked_slug].diff) and abs(r.diff_ci_low - x[r.tracked_slug].diff_ci_low) < 0.08


def test_large_groups_are_drawn_by_many_tasks(spark, monkeypatch):
    """Against NumPy within the error of the replicates, with a null group, null ids and values that half the rows share."""
    monkeypatch.setattr(bootstrap, "WHOLE", 300)
    rng = np.random.default_rng(5)
    rows = [(g, None, dt.datetime(2024, 1, 1), float(rng.choice([0.25, rng.normal()])), bool(rng.random() < 0.4)) for g, n in (("a", 3000), (None, 2000), ("small", 40)) for _ in range(n)]
    rows += [("a", "x", dt.datetime(2024, 1, 1), None, True), ("a", "x", dt.datetime(2024, 1, 1), float("nan"), False)]
    df = spark.createDataFrame(rows, "tier string, id string, created_at timestamp, score double, on boolean")
    got = {r.tier: r for r in bootstrap.exact_mean_ci(df, ("tier",)).collect()}
    assert set(got) == {"a", None, "small"} and got["a"].n == 3002
    for tier, r in got.items():
        v = np.array([x[3] for x in rows if x[0] == tier and x[3] is not None and not np.isnan(x[3])])
        m, lo, hi = bootstrap.mean_ci(v)
        error = 0.0 if tier == "small" else 4 * v.std() / np.sqrt(len(v)) * 0.06  # the quantiles' own error with 2000 replicates
        assert r.mean == pytest.approx(m) and abs(r.ci_low - lo) <= error + 1e-9 and abs(r.ci_high - hi) <= error + 1e-9
    d = {r.tier: r for r in bootstrap.exact_diff_ci(df, ("tier",), "on").collect()}
    for tier, r in d.items():
        v = [np.array([x[3] for x in rows if x[0] == tier and x[3] is not None and not np.isnan(x[3]) and x[4] == side]) for side in (True, False)]
        m, lo, hi = bootstrap.diff_ci(*v)
        error = 0.0 if tier == "small" else 0.3 * np.sqrt(sum(x.var() / len(x) for x in v))
        assert r.diff == pytest.approx(m) and abs(r.diff_ci_low - lo) <= error + 1e-9 and abs(r.diff_ci_high - hi) <= error + 1e-9


def test_every_replicate_draws_exactly_n(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(x)) for g, n in (("a", 900), ("b", 64), ("one", 1), ("same", 500)) for x in (rng.normal(size=n) if g != "same" else [7.0] * n)] + [("a", 0.5)] * 400
    means = resample.replicate_means(spark.createDataFrame(rows, "g string, score double"), 50, block=32)
    out = means.collect()
    assert {(r.g, r.n) for r in out} == {("a", 1300), ("b", 64), ("one", 1), ("same", 500)} and len(out) == 4 * 50
    assert {r.mean for r in out if r.g == "same"} == {7.0}
    again = {(r.g, r.b): r.mean for r in resample.replicate_means(spark.createDataFrame(rows[::-1], "g string, score double").repartition(7), 50, block=32).collect()}
    assert all(again[r.g, r.b] == pytest.approx(r.mean, abs=1e-12) for r in out)
    a = np.array([r.mean for r in out if r.g == "a"])
    v = np.array([x for g, x in rows if g == "a"])
    assert abs(a.mean() - v.mean()) < 4 * v.std() / np.sqrt(1300 * 50) and 0.6 < a.std() / (v.std() / np.sqrt(1300)) < 1.4


def test_a_hundred_million_rows_are_a_few_values(spark):
    """Rows of one group that are counted, not gathered: 10^8 in 40 leaves of one value each."""
    values = spark.range(40).select(F.lit("g").alias("g"), (F.col("id") / 10).alias("score"), F.lit(2_500_000).cast("long").alias("k"))
    dealt = resample.leaves(values, resample.BLOCK)
    assert sorted(r.leaf for r in dealt.collect()) == list(range(40))
    total = np.zeros(20, np.int64)
    for r in resample.paths(dealt).collect():
        total += resample.draws_of(r.g, r.leaf, list(r.path), 20, 0)
    assert (total == 100_000_000).all()


def test_poisson_draws_rows_without_an_id_of_their_own(spark):
    """The null group stays, and rows that lack or share an id are drawn one by one."""
    for id_ in (None, "same"):
        df = spark.createDataFrame([(g, id_, float(n % 10)) for g in ("a", None) for n in range(200)], "tier string, id string, score double")
        rows = bootstrap.poisson_mean_ci(df, ("tier",), replicates=300).collect()
        assert {r.tier for r in rows} == {"a", None}
        for r in rows:
            half = 1.96 * np.std(np.arange(200) % 10) / np.sqrt(200)
            assert r.mean == 4.5 and abs(r.ci_low - (4.5 - half)) < 0.2 and abs(r.ci_high - (4.5 + half)) < 0.2
        sides = df.withColumn("on", F.col("score") < 5)
        got = bootstrap.poisson_diff_ci(sides, ("tier",), "on", replicates=300).collect()
        assert {r.tier for r in got} == {"a", None} and all(r.diff_ci_low < r.diff < r.diff_ci_high for r in got)


def test_post_summary(spark):
    rows = [post(1, "2024-01-01", 0.5, slug="a", label="Positive"), post(2, "2024-01-01", -0.5, slug="a", label="NEGATIVE"), post(3, "2024-01-01", None, slug="a", label="off_topic"), post(4, "2024-01-01", 0.1, slug="a", label=None), post(5, "2024-01-01", 0.1, slug=None)]
    df = spark.createDataFrame(rows, POSTS)
    r = replies.post_summary(df).collect()
    assert len(r) == 1 and (r[0].n, r[0].pct_critical, r[0].pct_neutral, r[0].pct_supportive) == (4, 25.0, 0.0, 25.0)
    none = replies.post_summary(df, slug="zzz").first()
    assert (none.slug, none.n, none.mean_score, none.pct_critical) == ("zzz", 0, None, None)
    assert replies.post_summary_ci(df).first().score_col == "score"


def test_loyalty_segments(spark, posts):
    plain = replies.with_loyalty(posts, ["x"])
    assert {r.loyalty_tier for r in plain.select("loyalty_tier").distinct().collect()} == {"unknown"}
    df = posts.withColumn("account", F.when(F.col("id") != "0", F.struct(F.lit("maga kag x y").alias("bio"), F.lit("bad").alias("created_at"))))
    seg = replies.loyalty_segments(replies.with_loyalty(df, ["maga", "kag", "x", "y"]))
    assert [(r.tracked_slug, r.loyalty_tier) for r in seg.collect()] == [("s0", "low"), ("s0", "high"), ("s1", "high")]


def test_flippers_edges(spark):
    rows = [post(1, "2024-01-01", 0.1, "edge", slug="a"), post(2, "2024-01-01", -0.5, "edge", slug="b"), post(3, "2024-01-01", 0.2, "yes", slug="a"), post(4, "2024-01-01", -0.2, "yes", slug="b"), post(5, "2024-01-01", 0.9, "one", slug="a")]
    df = spark.createDataFrame(rows, POSTS)
    assert [r.user for r in replies.flippers(df, "a", "b").collect()] == ["yes"]
    assert [r.id for r in replies.flipper_rows(df, "a", "b").collect()] == ["4"]
    assert replies.sample_with_flippers(df, "a", "b", n=5).count() == 5


@SLOW
@given(st.lists(st.sampled_from([-0.9, -0.3, 0.0, 0.3, 0.8, None]), max_size=25), st.integers(1, 6))
def test_sample_sizes(spark, scores, n):
    df = spark.createDataFrame([post(i, "2024-01-01", s) for i, s in enumerate(scores)], POSTS)
    got = replies.stratified_sample(df, n).groupBy("bucket").count().collect()
    have = {"critical": sum(s is not None and s < -0.3 for s in scores), "mid": sum(s is not None and -0.3 <= s < 0.3 for s in scores), "supportive": sum(s is not None and s >= 0.3 for s in scores)}
    assert {r.bucket: r["count"] for r in got} == {b: min(n, k) for b, k in have.items() if k}


def test_stance_tables(spark):
    df = spark.createDataFrame([("a", "pro_war_critical", -0.5), ("a", "error", 0.0), ("b", "pro_trump_antiwar", 0.4), ("b", "pro_war_critical", -0.3)], "tracked_slug string, stance string, score double")
    assert {(r.stance, r.n, round(r.share, 3)) for r in stance.distribution(df).collect()} == {("pro_war_critical", 2, 0.667), ("pro_trump_antiwar", 1, 0.333)}
    wide = {r.tracked_slug: r.asDict() for r in summary.crosstab(stance.valid(df), "tracked_slug", "stance").collect()}
    assert wide["a"]["pro_trump_antiwar"] == 0 and wide["b"]["pro_war_critical"] == 50
    for s in ("a", "b"):
        assert sum(v for k, v in wide[s].items() if k != "tracked_slug") == pytest.approx(100)
    assert {r.stance: r.flag for r in stance.against_score(df).collect()} == {"pro_war_critical": "score negative, stance pro", "pro_trump_antiwar": "score positive, stance anti"}


def test_pick(spark):
    df = spark.createDataFrame([("a", None, 0.1), ("b", None, None)], "slug string, score_transformer double, score_vader double")
    assert summary.score_column(df) == "score_vader" and summary.score_column(df, "score_transformer") == "score_transformer"
    assert {r.slug: r.picked for r in summary.picked_per_group(df, "slug", ("score_transformer", "score_vader")).collect()} == {"a": "score_vader", "b": None}
    with pytest.raises(ValueError):
        summary.score_column(df.where("slug = 'b'"))
    assert summary.coverage(F.lit(1), F.lit(0)) is not None


def test_nearest_match(spark):
    tracked = dims.tracked(spark, [("near", "", dt.date(2024, 1, 10), "", "", "WORD", None), ("none", "", dt.date(2024, 1, 1), "", "", "absent", None), ("given", "", dt.date(2024, 1, 1), "", "", "word", "77"), ("nokey", "", dt.date(2024, 1, 1), "", "", None, None)])
    posts = spark.createDataFrame([("1", "a word", "2024-01-08T00:00:00Z"), ("2", "Word b", "2024-01-12T00:00:00Z"), ("3", "word", "bad"), ("4", None, "2024-01-10T00:00:00Z")], "id string, text string, created_at string")
    assert {r.slug: r.post_id for r in matching.resolve(tracked, posts).collect()} == {"near": "1", "none": None, "given": "77", "nokey": None}


def test_restore(spark):
    cur = spark.createDataFrame([("x", "1", None, None), ("x", "2", 0.9, "positive"), ("y", "1", None, None), ("x", "3", None, None)], "platform string, id string, score_vader double, label_vader string")
    prior = spark.createDataFrame([("x", "1", 0.1, "positive", 0), ("x", "1", 0.2, "positive", 1), ("x", "2", -0.5, "negative", 0), ("x", "3", None, None, 0)], "platform string, id string, score_vader double, label_vader string, n int")
    got = {(r.platform, r.id): (r.score_vader, r.label_vader) for r in restore.restore(cur, prior, ("vader",), ("platform", "id"), "n").collect()}
    assert got == {("x", "1"): (0.2, "positive"), ("x", "2"): (0.9, "positive"), ("y", "1"): (None, None), ("x", "3"): (None, None)}
    over = {(r.platform, r.id): r.score_vader for r in restore.restore(cur, prior, ("vader",), ("platform", "id"), "n", overwrite=True).collect()}
    assert over[("x", "2")] == -0.5
    assert restore.coverage_of(cur, prior).first().complete is True


def test_scorers(spark):
    df = spark.createDataFrame([("1", "u", "admin", "good good bad", None), ("2", "v", "media", "  ", None), ("3", "w", "media", "bad", 0.7), ("4", "x", "admin", "http://a", None), ("5", "y", "admin", "boom", None)], "id string, user string, tier string, text string, score_transformer double")
    lex = scorers.LexiconScorer({"good": 1.0, "bad": -0.5}).score(df)
    assert {r.id: r.score_vader for r in lex.collect()} == {"1": 0.5, "2": 0.0, "3": -0.5, "4": 0.0, "5": 0.0}

    def load():
        def model(texts):
            if "boom" in texts:
                raise RuntimeError
            return [(len(t) / 100, "positive") for t in texts]

        return model

    got = {r.id: (r.score_transformer, r.label_transformer, r.score_failed) for r in scorers.ModelScorer(load, batch=1).score(df).collect()}
    assert got["1"] == (0.13, "positive", False) and got["2"] == (0.0, "neutral", False) and got["3"][0] == 0.7 and got["5"] == (None, None, True)

    def client(text, user):
        if text == "boom":
            raise RuntimeError
        return '{"score": 0.25}'

    remote = {r.id: (r.score_llm, r.label_llm) for r in scorers.RemoteScorer(client, tiers=["admin"]).score(df).collect()}
    assert remote == {"1": (0.25, "positive"), "2": (None, None), "3": (None, None), "4": (0.0, "off_topic"), "5": (None, None)}
    sample = df.withColumns({"tracked_slug": F.lit("s"), "score": F.lit(0.1)})
    out = {r.id: r.stance for r in scorers.classify_stance(sample, lambda t, u: 1 / 0 if t == "boom" else '{"stance": "neutral_other"}').collect()}
    assert out["5"] == "error" and out["1"] == "neutral_other"
    chain = scorers.analyze(df.drop("score_transformer"), [scorers.LexiconScorer({"good": 1.0})])
    assert pd.notna(chain.first().score_vader)


def test_restore_takes_the_last_row_of_a_repeated_id(spark, tmp_path):
    cur = spark.createDataFrame([("a", None, None)], "id string, score_vader double, label_vader string")
    rows = [("a", 0.9, "positive"), ("a", -0.4, "negative")]
    spark.createDataFrame(rows, cur.schema).coalesce(1).write.parquet(f"file://{tmp_path}/prior")
    prior = spark.read.parquet(f"file://{tmp_path}/prior")
    assert tuple(restore.restore(cur, prior, ("vader",)).first()) == ("a", -0.4, "negative")


def test_intervals_of_events_and_segments(spark):
    import datetime as dt

    rows = [(str(i), dt.datetime(2024, 1, 4 + i % 2, 12), (i * 7 % 11 - 5) / 5 + i % 2) for i in range(80)]
    posts = spark.createDataFrame(rows, "id string, created_at timestamp, score double")
    dim = spark.createDataFrame([(dt.date(2024, 1, 5), "e", "", "", ""), (dt.date(2024, 1, 4), "one side", "", "", "")], "date date, label string, description string, category string, impact string")
    for exact in (False, True):
        got = {r.event_label: r for r in events.compare_events_ci(posts, dim, 24, exact=exact).collect()}
        assert got["e"].diff_ci_low < got["e"].diff < got["e"].diff_ci_high
        assert got["one side"].n_pre == 0 and got["one side"].diff_ci_low is None
    seg = posts.selectExpr("*", "'s' AS tracked_slug", "CASE WHEN id % 3 = 0 THEN 'low' ELSE 'high' END AS loyalty_tier")
    near = {r.loyalty_tier: r for r in replies.loyalty_segments_ci(seg).collect()}
    for r in replies.loyalty_segments_ci(seg, exact=True).collect():
        assert r.ci_low < r.mean < r.ci_high and abs(near[r.loyalty_tier].ci_low - r.ci_low) < 0.1


def test_sample_keeps_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "u", "a", 0.5), (None, "v", "a", 0.6), ("x", "w", "a", 0.1)], "id string, user string, tracked_slug string, score double")
    assert replies.sample_with_flippers(df, "a", "b").count() == 3


def test_leaves_are_dealt_to_tasks_of_their_own(spark):
    """Leaves are few bytes and much work: not left to as few tasks as their bytes ask for."""
    values = spark.range(2000).selectExpr("concat('g', id % 2) AS g", "id / 10.0D AS score", "1L AS k")
    dealt = resample.leaves(values, 50).cache()
    n = dealt.select("g", "leaf").distinct().count()
    sums = resample.totals(dealt, 20, 0)
    assert n > 30 and sums.rdd.getNumPartitions() == n
    each = sums.selectExpr("g", "posexplode(n) AS (b, n)").groupBy("g", "b").sum("n").collect()
    assert len(each) == 40 and {r[2] for r in each} == {1000}
    dealt.unpersist()
