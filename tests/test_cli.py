from __future__ import annotations

import json

from tidemark import cli


def test_commands(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    for h in ("a", "b"):
        rows = [{"id": f"{h}{i}", "user": h, "tier": "media", "text": "good news", "created_at": f"2024-01-0{i + 1}T00:00:00Z"} for i in range(3)]
        (raw / f"{h}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (raw / "replies_s.jsonl").write_text(json.dumps({"id": "r", "parent_id": "p", "in_reply_to_id": "p"}))
    (tmp_path / "dims.json").write_text(json.dumps({"accounts": {"media": ["a", "b", "c"]}, "terms": ["x"], "events": [{"date": "2024-01-02", "label": "e"}], "tracked": [{"slug": "s", "event_date": "2024-01-02", "match_keyword": "NEWS"}]}))
    (tmp_path / "lex.json").write_text('{"good": 1.0}')
    d = ["--dims", f"{tmp_path}/dims.json"]
    cli.main(["run-all", "--raw", str(raw), "--out", f"{tmp_path}/posts", "--lexicon", f"{tmp_path}/lex.json", *d])
    scored = spark.read.parquet(f"{tmp_path}/posts-scored")
    assert scored.count() == 6 and scored.first().score_vader == 1.0
    cli.main(["status", "--raw", str(raw), *d])
    cli.main(["resolve", "--raw", f"{raw}/a.jsonl", *d])
    cli.main(["ingest-replies", "--raw", str(raw), "--out", f"{tmp_path}/replies", "--direct"])
    cli.main(["event-study", "--scored", f"{tmp_path}/posts-scored", *d])
    out = capsys.readouterr().out
    assert "a1" in out and "media" in out and "2024-01-02" in out


def test_collect_and_event_study_switches(spark, tmp_path, capsys):
    """Landed pages into a ledger; replies scored once, again only where it is forced; no comparison of broadcasters."""
    from tidemark.sources import paged

    rows = [(f"{i}", "ann" if i % 2 else "bob", f"2024-01-0{i + 1}T00:00:00Z", i) for i in range(6)]
    paged.land(spark.createDataFrame(rows, "id string, user string, created_at string, page long"), f"file://{tmp_path}/pages")
    for _ in range(2):
        cli.main(["collect", "--root", f"file://{tmp_path}/pages", "--ledger", f"{tmp_path}/book", "--since", "2024-01-02", "--until", "2024-01-05", "--sources", "ann, bob, cid", "--run", "one"])
    out = capsys.readouterr().out
    assert "collected" in out and "empty" in out and "cid" in out
    replies = [(f"{i}", "s", "2024-01-01", "good" if i else "bad") for i in range(4)]
    spark.createDataFrame(replies, "id string, tracked_slug string, created_at string, text string").write.parquet(f"{tmp_path}/replies")
    study = ["event-study", "--replies", f"{tmp_path}/replies", "--scored-replies", f"{tmp_path}/scored", "--scored", f"{tmp_path}/none", "--no-broadcaster"]
    for weight, force, mean in ((1.0, [], 0.75), (0.5, [], 0.75), (0.5, ["--force-score"], 0.375)):
        (tmp_path / "lex.json").write_text(json.dumps({"good": weight}))
        cli.main([*study, "--lexicon", f"{tmp_path}/lex.json", *force])
        assert f"{mean}" in capsys.readouterr().out
