"""Command line: python -m tidemark.cli COMMAND. Each command reads landed files and prints or writes tables."""

from __future__ import annotations

import argparse
import importlib
import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as ft
from tidemark.operators import events, matching, replies, scorers, series, stance, summary, valence
from tidemark.schema import EVENT_DIM, REPLY, SCORE_COLUMNS, SCORES, TRACKED_DIM, conform, scored_schema
from tidemark.session import session
from tidemark.sources import dims, files, ledger, paged, sinks


def show(df: DataFrame, rows: int = 200) -> None:
    print(df._jdf.showString(rows, 60, False))


def load_dims(spark: SparkSession, path: str | None) -> dict:
    """Dimensions from a JSON file: accounts {tier: [handle]}, terms [text], events and tracked as lists of rows."""
    return json.loads(Path(path).read_text()) if path else {"accounts": {}, "terms": [], "events": [], "tracked": []}


def _rows(df_schema, rows: list[dict]) -> list[tuple]:
    import datetime as dt

    fix = lambda f, v: dt.date.fromisoformat(v) if v and f.dataType.simpleString() == "date" else v
    return [tuple(fix(f, r.get(f.name)) for f in df_schema) for r in rows]


def cmd_ingest(spark, a) -> None:
    """Landed JSONL to one deduplicated Parquet table, optionally within a window of days, and the budget report."""
    posts = files.load_posts(spark, a.raw, bad_lines=a.bad_lines)
    posts = posts.withColumn("created_at", F.try_to_timestamp("created_at"))
    if a.since or a.until:
        posts = files.in_window(posts, a.since or "0001-01-01", a.until or "9999-12-31")
    if a.cap:
        posts = files.newest_per_user(posts, a.cap)
    sinks.publish(posts, a.out)
    d = load_dims(spark, a.dims)
    terms = spark.createDataFrame([(t,) for t in d["terms"]], "term string")
    show(summary.budget(dims.accounts(spark, d["accounts"]), terms, a.account_cap, a.term_cap, a.price))
    show(spark.read.parquet(a.out).groupBy("user").count().orderBy(F.col("count").desc(), "user"))


def cmd_ingest_replies(spark, a) -> None:
    rows = files.load_replies(spark, a.raw, a.slug, unique=not a.keep_repeats)
    sinks.write_replies(files.direct_replies(rows) if a.direct else rows, a.out)
    show(spark.read.parquet(a.out).groupBy("tracked_slug").count().orderBy("tracked_slug"))


def plugin(spec: str):
    """The object that package.module:name names; executors have to be able to import it, too."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def template(path: str | None) -> str | None:
    return Path(path).read_text(encoding="utf-8") if path else None


def cmd_analyze(spark, a) -> None:
    """Score what has no score yet, with scores of an earlier table put back first: lexicon or rules, then model, then remote."""
    posts = conform(spark.read.parquet(a.posts), scored_schema())
    prior = spark.read.parquet(a.prior) if a.prior else None
    kind = scorers.ValenceScorer if a.rules else scorers.LexiconScorer
    chain: list[scorers.Scorer] = [kind(valence.read_lexicon(a.lexicon))]
    if a.model:
        chain.append(scorers.ModelScorer(plugin(a.model)))
    if a.client:
        split = lambda x: [v.strip() for v in x.split(",") if v.strip()] if x else None
        chain.append(scorers.RemoteScorer(plugin(a.client), split(a.tiers), split(a.accounts), a.threads, template=template(a.template)))
    sinks.publish(scorers.analyze(posts, chain, prior, a.checkpoint, a.batches), a.out, checkpoint=a.checkpoint)


def cmd_charts(spark, a) -> None:
    for name, df in series.charts(spark.read.parquet(a.scored), SCORE_COLUMNS).items():
        df.write.mode("overwrite").parquet(f"{a.out}/{name}")
        print(name)


def cmd_summary(spark, a) -> None:
    df = spark.read.parquet(a.scored)
    s = summary.score_column(df, a.score)
    for title, table in (("by account", summary.mean_by(df, "user", score=s)), ("by tier", summary.mean_by(df, "tier", score=s)), ("by week", summary.weekly(df, s).orderBy("week"))):
        print(title)
        show(table.withColumns({"mean": ft.signed(F.col("mean")), "bar": ft.bar(F.col("mean"), 30)}))


def cmd_collect(spark, a) -> None:
    """Fetch the open windows of paged sources into a ledger: pages landed under --root, or a --client of package.module:name."""
    options = {k: v for k, v in (("root", a.root), ("client", a.client)) if v}
    names = [v.strip() for v in a.sources.split(",") if v.strip()] if a.sources else paged.client_of(options).sources()
    book = ledger.Ledger(spark, a.ledger)
    show(book.run(a.name or time.strftime("%Y%m%dT%H%M%S"), ledger.windows_of(spark, names, a.since, a.until), options, a.cap, a.force).orderBy("source"))
    show(book.posts().groupBy("source").count().orderBy("source"))


def cmd_event_study(spark, a) -> None:
    d = load_dims(spark, a.dims)
    if a.replies:
        rows = spark.read.parquet(a.replies)
        if a.scored_replies:
            if not a.lexicon:
                raise SystemExit("--scored-replies needs a --lexicon")
            raw, kind = conform(rows, T.StructType([*REPLY, *SCORES])), scorers.ValenceScorer if a.rules else scorers.LexiconScorer
            rows = files.load_or_compute(spark, a.scored_replies, lambda: kind(valence.read_lexicon(a.lexicon)).score(raw), a.force_score)
        rows = rows.where(F.col("tracked_slug") == a.slug) if a.slug else rows
        s, lab = summary.score_column(rows, a.score), summary.label_column(rows)
        if rows.isEmpty():
            raise SystemExit(f"no replies{f' to {a.slug}' if a.slug else ''}")
        show(replies.post_summary_ci(rows, s, lab, a.exact))
        show(replies.loyalty_segments_ci(replies.with_loyalty(rows, d.get("loyalty_keywords", [])), s, a.exact))
    if a.scored and not a.no_broadcaster:
        df = spark.read.parquet(a.scored)
        show(events.compare_events_ci(df, dims.events(spark, _rows(EVENT_DIM, d["events"])), a.window_hours, summary.score_column(df, a.score), a.where, a.exact).orderBy("event_date"))


def cmd_stance(spark, a) -> None:
    """Stances of a sample of replies: the table at --stances, classified first where it is missing (or with --force)."""
    if a.client:
        if not a.replies:
            raise SystemExit("--client needs --replies")

        def classified() -> DataFrame:
            rows = spark.read.parquet(a.replies)
            score = summary.score_column(rows, a.score)
            return scorers.classify_stance(replies.stratified_sample(rows, a.n, score=score), plugin(a.client), score, a.threads, template(a.template))

        df = files.load_or_compute(spark, a.stances, classified, a.force)
    else:
        df = spark.read.parquet(a.stances)
    s = next((c for c in df.columns if c.startswith("score")), "score")
    for table in (stance.distribution(df), stance.by_post(df), stance.against_score(df, s)):
        show(table)


def cmd_sample(spark, a) -> None:
    df = spark.read.parquet(a.replies)
    s = summary.score_column(df, a.score)
    out = replies.sample_with_flippers(df, a.first, a.then, a.n, score=s) if a.first and a.then else replies.stratified_sample(df, a.n, score=s)
    out.write.mode("overwrite").parquet(a.out)


def cmd_resolve(spark, a) -> None:
    tracked = dims.tracked(spark, _rows(TRACKED_DIM, load_dims(spark, a.dims)["tracked"]))
    show(matching.resolve(tracked, files.read_jsonl(spark, a.raw, bad_lines="drop", ordered=True), ("file", "block", "line")))


def cmd_status(spark, a) -> None:
    """Lines and bytes of each landed file, and handles without one."""
    found = files.line_counts(spark, f"{a.raw}/*.jsonl")
    show(found.orderBy("file"))
    d = load_dims(spark, a.dims)
    have = found.select(F.regexp_replace("file", r"\.jsonl$", "").alias("handle"))
    show(summary.missing_sources(dims.accounts(spark, d["accounts"]), have, "handle"))


def cmd_run_all(spark, a) -> None:
    cmd_ingest(spark, a)
    a.posts, a.prior, a.scored = a.out, None, f"{a.out}-scored"
    a.out = a.scored
    cmd_analyze(spark, a)
    a.out = f"{a.scored}-charts"
    cmd_charts(spark, a)
    cmd_summary(spark, a)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, fn, *options: str, **defaults) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=fn.__doc__)
        for o in options:
            c.add_argument(f"--{o.rstrip('!')}", required=o.endswith("!"))
        c.set_defaults(run=fn, **defaults)
        return c

    def ingest_options(c: argparse.ArgumentParser) -> None:
        c.add_argument("--cap", type=int)
        c.add_argument("--bad-lines", choices=["fail", "drop"], default="fail")
        for o, default in (("account-cap", 500), ("term-cap", 150)):
            c.add_argument(f"--{o}", type=int, default=default)
        c.add_argument("--price", type=float, default=0.005)

    def analyze_options(c: argparse.ArgumentParser) -> None:
        c.add_argument("--rules", action="store_true", help="valence rules instead of mean word weights")
        for o, what in (("model", "package.module:name of a function that loads a model"), ("client", "package.module:name of a function of (text, user)"), ("template", "file of the prompt, with {text} and {user}"), ("tiers", "tiers that the client sees"), ("accounts", "accounts that the client sees"), ("checkpoint", "folder of partial results; a run after a break goes on from there")):
            c.add_argument(f"--{o}", help=what)
        c.add_argument("--threads", type=int, default=5)
        c.add_argument("--batches", type=int, default=16)

    ingest_options(add("ingest", cmd_ingest, "raw!", "out!", "dims", "since", "until"))
    c = add("ingest-replies", cmd_ingest_replies, "raw!", "out!", "slug")
    c.add_argument("--direct", action="store_true")
    c.add_argument("--keep-repeats", action="store_true")
    analyze_options(add("analyze", cmd_analyze, "posts!", "out!", "lexicon!", "prior"))
    add("charts", cmd_charts, "scored!", "out!")
    add("summary", cmd_summary, "scored!", "score")
    c = add("event-study", cmd_event_study, "replies", "scored", "slug", "score", "dims", "where")
    c.add_argument("--window-hours", type=int, default=48)
    c.add_argument("--exact", action="store_true", help="resample exactly, small groups draw for draw as NumPy does")
    c.add_argument("--no-broadcaster", action="store_true", help="leave out the comparison before and after events")
    c.add_argument("--scored-replies", help="table of scored replies: read if it is there, else scored with --lexicon and written")
    c.add_argument("--force-score", action="store_true", help="score the replies again")
    c.add_argument("--lexicon")
    c.add_argument("--rules", action="store_true")
    c = add("collect", cmd_collect, "ledger!", "since!", "until!", "root", "client", "sources")
    c.add_argument("--cap", type=int)
    c.add_argument("--run", dest="name", help="name of the run; a run that is done is not done again (default: the time)")
    c.add_argument("--force", action="store_true", help="fetch collected windows again")
    c = add("sample", cmd_sample, "replies!", "out!", "score", "first", "then")
    c.add_argument("--n", type=int, default=50)
    c = add("stance", cmd_stance, "stances!", "replies", "client", "template", "score")
    c.add_argument("--n", type=int, default=50)
    c.add_argument("--threads", type=int, default=5)
    c.add_argument("--force", action="store_true")
    add("resolve", cmd_resolve, "raw!", "dims!")
    add("status", cmd_status, "raw!", "dims")
    c = add("run-all", cmd_run_all, "raw!", "out!", "dims", "since", "until", "lexicon!", "score")
    ingest_options(c)
    analyze_options(c)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(session(), a)


if __name__ == "__main__":
    main()
