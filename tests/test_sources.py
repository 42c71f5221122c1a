from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.schema import POST, REPLY, SCORES, conform, scored_schema
from tidemark.sources import dims, files, sinks


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_jsonl_blank_and_corrupt_lines(spark, tmp_path):
    lines(tmp_path / "a.jsonl", {"id": "1", "metrics": {"likes": 3}}, "", {"id": "2", "user": "u"})
    got = files.read_jsonl(spark, f"{tmp_path}/a.jsonl").orderBy("id").collect()
    assert [r.id for r in got] == ["1", "2"] and got[0].metrics == {"likes": 3} and got[0].user is None
    lines(tmp_path / "b.jsonl", {"id": "1"}, "{not json", {"id": "3"})
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"{tmp_path}/b.jsonl").collect()
    assert {r.id for r in files.read_jsonl(spark, f"{tmp_path}/b.jsonl", bad_lines="drop").collect()} == {"1", "3"}


def test_missing_path_is_empty(spark, tmp_path):
    assert files.read_jsonl(spark, f"{tmp_path}/none.jsonl").count() == 0
    assert files.load_posts(spark, f"{tmp_path}/none").count() == 0
    assert files.line_counts(spark, f"{tmp_path}/*.jsonl").count() == 0


def test_load_posts_dedupes_and_leaves_replies_out(spark, tmp_path):
    lines(tmp_path / "a.jsonl", {"id": "1", "text": "first"}, {"id": "1", "text": "again"}, {"id": "", "text": "no id"}, {"text": "null id"})
    lines(tmp_path / "b.jsonl", {"id": "1", "text": "other file"}, {"id": "2", "text": "two"})
    lines(tmp_path / "replies_x.jsonl", {"id": "9", "text": "reply"})
    got = {r.id: r.text for r in files.load_posts(spark, str(tmp_path)).collect()}
    assert got == {"1": "first", "2": "two"}


def test_replies_have_their_slug(spark, tmp_path):
    r = {"id": "1", "account": {"id": "a", "bio": "b", "verified": True}, "parent_id": "p", "in_reply_to_id": "p"}
    lines(tmp_path / "replies_my_slug.jsonl", r, r, {**r, "id": "2", "in_reply_to_id": "1"})
    every = files.load_replies(spark, str(tmp_path))
    assert every.count() == 3 and {x.tracked_slug for x in every.collect()} == {"my_slug"}
    assert files.load_replies(spark, str(tmp_path), unique=True).count() == 2
    assert files.load_replies(spark, str(tmp_path), "absent").count() == 0
    assert {x.id for x in files.direct_replies(every).collect()} == {"1"}
    assert every.select("account.verified").first()[0] is True


def test_reply_record(spark):
    raw = spark.createDataFrame([("1", "<p>hi</p>", "2024-01-01T00:00:00Z", "p", 2, None, 1, ("7", "joe"))], "id string, content string, created_at string, in_reply_to_id string, reblogs_count long, favourites_count long, replies_count long, account struct<id:string,username:string>")
    raw = raw.withColumn("account", F.col("account").cast(f"struct<id:string,username:string>"))
    row = files.reply_record(raw.withColumn("account", F.struct(F.col("account.id").alias("id"), F.col("account.username").alias("username"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in REPLY["account"].dataType.fields[2:]))), "p", "second").first()
    assert row.user == "joe" and row.metrics == {"reblogs": 2, "favourites": 0, "replies": 1} and row.source == "reply"


def test_conform_adds_columns_and_drops_nan(spark):
    df = spark.createDataFrame([("1", float("nan")), ("2", 0.5)], "id string, score_vader double")
    out = conform(df, scored_schema())
    assert set(SCORES.fieldNames()) <= set(out.columns) and set(POST.fieldNames()) <= set(out.columns)
    assert {r.id: r.score_vader for r in out.collect()} == {"1": None, "2": 0.5}


def test_window_cap_and_high_water(spark):
    df = spark.createDataFrame([("1", "u", "2024-01-01T10:00:00Z"), ("2", "u", "2024-01-02T10:00:00+00:00"), ("3", "u", "bad"), ("4", "v", "bad")], "id string, user string, created_at string")
    assert {r.user: r.latest and r.latest.isoformat() for r in files.high_water_mark(df).collect()} == {"u": "2024-01-02T10:00:00", "v": None}
    ts = df.withColumn("created_at", F.try_to_timestamp("created_at"))
    assert {r.id for r in files.in_window(ts, "2024-01-01", "2024-01-01").collect()} == {"1"}
    assert {r.id for r in files.newest_per_user(ts.where("user = 'u'"), 1).collect()} == {"2"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "", None]), st.integers(0, 9)), max_size=12))
def test_first_wins_is_idempotent(spark, rows):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "id string, v int, line int")
    once = files.first_wins(df, order=("line",))
    want = {}
    for k, v in rows:
        if k:
            want.setdefault(k, v)
    assert {r.id: r.v for r in once.collect()} == want
    again = files.first_wins(once.withColumn("line", F.lit(0)), order=("line",))
    assert {r.id: r.v for r in again.collect()} == want


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "s"), ("2", "t")], "id string, tracked_slug string")
    assert not sinks.write_jsonl(df.where("false"), f"{tmp_path}/e") and not (tmp_path / "e").exists()
    sinks.write_jsonl(df, f"{tmp_path}/j")
    sinks.write_jsonl(df, f"{tmp_path}/j", append=True)
    assert spark.read.json(f"{tmp_path}/j").count() == 4
    sinks.write_replies(df, f"{tmp_path}/r")
    assert (tmp_path / "r/tracked_slug=s").exists()
    sinks.publish(df, f"{tmp_path}/p", "id")
    sinks.publish(df.limit(1), f"{tmp_path}/p", "id")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 1 and not (tmp_path / "p.staging").exists()
    sinks.append_partial(df, f"{tmp_path}/b", 0)
    sinks.append_partial(df, f"{tmp_path}/b", 0)
    assert spark.read.parquet(f"{tmp_path}/b").count() == 2
    calls = []
    for _ in range(2):
        files.load_or_compute(spark, f"{tmp_path}/c", lambda: calls.append(1) or df)
    assert len(calls) == 1


def test_dims(spark):
    a = dims.accounts(spark, {"t": ["x", "y"], "u": ["z"]})
    assert a.count() == 3 and "Broadcast" not in dims.small(a, 1)._jdf.queryExecution().analyzed().toString()
    nested = spark.createDataFrame([({"t": ["x", "y"]},)], "tiers map<string,array<string>>")
    assert {tuple(r) for r in dims.flatten_accounts(nested).collect()} == {("t", "x"), ("t", "y")}


def test_first_wins_by_a_number(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (None, "c", 2)], "id long, v string, line long")
    assert [tuple(r) for r in files.first_wins(df, order=("line",)).collect()] == [(1, "a")]


@pytest.mark.parametrize("moves", [0, 1])
def test_publish_broken_between_its_moves_loses_no_table(spark, tmp_path, monkeypatch, moves):
    path = f"file://{tmp_path}/t"
    sinks.publish(spark.range(3), path, "id")
    real, seen = sinks._move, []

    def broken(*args):
        if len(seen) == moves:
            raise OSError("stopped")
        seen.append(1)
        real(*args)

    with monkeypatch.context() as m:
        m.setattr(sinks, "_move", broken)
        with pytest.raises(OSError):
            sinks.publish(spark.range(5), path, "id")
    sinks.recover(spark, path)
    assert spark.read.parquet(path).count() == (3 if moves == 0 else 5)
    sinks.publish(spark.range(7), path, "id")
    assert spark.read.parquet(path).count() == 7 and not (tmp_path / "t.old").exists()


def test_analyze_needs_a_lexicon():
    from tidemark import cli

    with pytest.raises(SystemExit):
        cli.parser().parse_args(["analyze", "--posts", "p", "--out", "o"])
