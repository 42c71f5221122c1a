"""The catalogue's queries in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import math

from tidemark.operators.bootstrap import CDF, PER_HASH, REPLICATES
from tidemark.operators.stance import CATEGORIES
from tidemark.plans.adapters import AS_OF, COLOURS, EVENTS, KEYWORDS, SOURCES, TRACKED

SCORED = """scored AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS "user", event_type AS tier, event_type AS tracked_slug, ts AS created_at,
         greatest(-1.0, least(1.0, (value - 50) / 50)) AS score, props,
         CASE WHEN greatest(-1.0, least(1.0, (value - 50) / 50)) >= 0.05 THEN 'positive' WHEN greatest(-1.0, least(1.0, (value - 50) / 50)) <= -0.05 THEN 'negative' ELSE 'neutral' END AS label
  FROM events)"""
_NAMES = ", ".join(f"'{c}'" for c in CATEGORIES)
STANCES = f"""{SCORED}, stances AS (
  SELECT *, CASE WHEN event_id % 11 = 0 THEN 'error' ELSE [{_NAMES}][CAST(event_id % 6 + 1 AS INTEGER)] END AS stance FROM scored)"""
EVENT_VALUES = ", ".join(f"(DATE '{d}', '{label}', '{category}')" for d, label, _, category, _ in EVENTS)
DIM = f"""dim AS (SELECT * FROM (VALUES {EVENT_VALUES}) AS t(date, label, category))"""


def windows(hours: int) -> str:
    return f"""rows AS (
  SELECT d.date AS event_date, d.label AS event_label, s.id, s.score, s.created_at >= CAST(d.date AS TIMESTAMP) AS is_post, s.tier
  FROM scored s JOIN dim d ON s.created_at >= CAST(d.date AS TIMESTAMP) - INTERVAL {hours} HOUR AND s.created_at < CAST(d.date AS TIMESTAMP) + INTERVAL {hours} HOUR)"""


def compare(hours: int, where: str = "true") -> str:
    return f"""WITH {SCORED}, {DIM}, {windows(hours)}
SELECT strftime(event_date, '%Y-%m-%d') AS event_date, event_label, count(*) FILTER (NOT is_post) AS n_pre, count(*) FILTER (is_post) AS n_post,
       round(avg(score) FILTER (NOT is_post), 9) AS mean_pre, round(avg(score) FILTER (is_post), 9) AS mean_post,
       round(avg(score) FILTER (is_post) - avg(score) FILTER (NOT is_post), 9) AS diff, {hours} AS window_hours, 'score' AS score_col
FROM rows WHERE {where} GROUP BY event_date, event_label"""


def resample(every: str, by: str = "", source: str = "scored", form: str = "%Y-%m-%d", smooth: int = 0, where: str = "score IS NOT NULL", n_only: bool = False) -> str:
    """Calendar from first to last period of each key, means, counts and (if asked) a centered rolling mean."""
    key = f'"{by}", ' if by else ""
    join = f'AND a."{by}" IS NOT DISTINCT FROM s."{by}"' if by else ""
    part = f'PARTITION BY a."{by}"' if by else ""
    after = (smooth - 1) // 2
    rolled = f", round(avg(s.mean) OVER ({part} ORDER BY a.period ROWS BETWEEN {smooth - 1 - after} PRECEDING AND {after} FOLLOWING), 9) AS smoothed" if smooth else ""
    mean = "" if n_only else f", round(s.mean, 9) AS mean{rolled}"
    out_key = f'a."{by}", ' if by else ""
    return f"""seen AS (
  SELECT {key}date_trunc('{every}', created_at) AS period, avg(score) AS mean, count(score) AS n FROM {source} WHERE {where} GROUP BY ALL),
ends AS (SELECT {key}min(period) AS lo, max(period) AS hi FROM seen {f'GROUP BY "{by}"' if by else ""}),
spine AS (SELECT {key}unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 {every})) AS period FROM ends)
SELECT {out_key}strftime(a.period, '{form}') AS period{mean}, coalesce(s.n, 0) AS n
FROM spine a LEFT JOIN seen s ON a.period = CAST(s.period AS TIMESTAMP) {join}"""


def poisson(key: str, b: str) -> str:
    u = f"((CAST(('0x' || substr(md5({key} || ':' || CAST({b} // {PER_HASH} AS VARCHAR)), CAST({b} % {PER_HASH} * 4 + 1 AS INTEGER), 4)) AS INTEGER) + 0.5::DOUBLE) / 65536)"
    return " + ".join(f"CAST({u} > CAST({c!r} AS DOUBLE) AS INTEGER)" for c in CDF)


BUCKET = "CASE WHEN score < -0.3 THEN 'critical' WHEN score < 0.3 THEN 'mid' WHEN score IS NOT NULL THEN 'supportive' END"
LABEL = lambda s: f"CASE WHEN {s} >= 0.05 THEN 'positive' WHEN {s} <= -0.05 THEN 'negative' WHEN {s} IS NOT NULL THEN 'neutral' END"
STRICT = lambda s: f"CASE WHEN {s} > 0.05 THEN 'positive' WHEN {s} < -0.05 THEN 'negative' WHEN {s} IS NOT NULL THEN 'neutral' END"


def sampled(source: str, n: int, seed: int, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, {BUCKET} AS bucket, row_number() OVER (PARTITION BY tracked_slug, {BUCKET} ORDER BY md5(id || ':{seed}'), id) AS rn
  FROM {source} WHERE tracked_slug IS NOT NULL AND score IS NOT NULL) WHERE rn <= {n})"""


SHARES = """round(100 * avg(CASE WHEN lower(label) = 'negative' THEN 1.0 ELSE 0.0 END), 9) AS pct_critical,
       round(100 * avg(CASE WHEN lower(label) = 'neutral' THEN 1.0 ELSE 0.0 END), 9) AS pct_neutral,
       round(100 * avg(CASE WHEN lower(label) = 'positive' THEN 1.0 ELSE 0.0 END), 9) AS pct_supportive"""
BAR = lambda x, k: f"repeat('█', CAST(floor(abs({x}) * {k}) AS INTEGER))"
SECOND = "%Y-%m-%d %H:%M:%S.%f"
FLIP = """means AS (SELECT "user", avg(score) FILTER (tracked_slug = 'click') AS mean_first, avg(score) FILTER (tracked_slug = 'view') AS mean_then
  FROM scored WHERE tracked_slug IN ('click', 'view') AND "user" IS NOT NULL GROUP BY "user"),
flip AS (SELECT * FROM means WHERE mean_first > 0.02 AND mean_then < -0.02)"""
HITS = " + ".join(f"CAST(contains(lower(d.text), '{k}') AS INTEGER)" for k in KEYWORDS)
LOYAL = f"""loyal AS (
  SELECT d.doc_id, d.lang AS tracked_slug, (d.doc_id % 21 - 10) / 10.0::DOUBLE AS score,
         least(0.7::DOUBLE, CAST({HITS} AS DOUBLE) * 0.2::DOUBLE)
         + least(0.3::DOUBLE, greatest(0.0::DOUBLE, (floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(e.ts))) / 86400) / 365.25::DOUBLE) / 10.0::DOUBLE)) AS loyalty_score
  FROM documents d JOIN events e ON e.event_id = d.doc_id),
tiers AS (SELECT *, CASE WHEN loyalty_score >= 0.7::DOUBLE THEN 'high' WHEN loyalty_score >= 0.3::DOUBLE THEN 'medium' ELSE 'low' END AS loyalty_tier FROM loyal)"""
REPLY = """r AS (SELECT conv_id || ':' || turn AS id, conv_id || ':' || (turn - 1) AS in_reply_to_id, conv_id || ':0' AS parent_id, role AS "user" FROM conversations)"""
POSTS = """posts AS (SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id, d.source AS "user", d.text, d.lang, e.ts AS created_at FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id)"""
_lit = lambda x: "NULL" if x is None else f"'{x}'"
TRACKED_VALUES = ", ".join(f"({_lit(s)}, DATE '{day}', {_lit(k)}, {_lit(p)})" for s, _, day, _, _, k, p in TRACKED)
CURRENT = f"""cur AS (SELECT id, CASE WHEN event_id % 4 = 0 THEN score END AS score_vader, CASE WHEN event_id % 4 = 0 THEN label END AS label_vader FROM scored),
prior AS (SELECT id, score / 2 AS score_vader, {LABEL("(score / 2)")} AS label_vader FROM scored WHERE event_id % 3 <> 0)"""
PROBS = ("(event_id % 7 + 1)", "(user_id % 5 + 1)", "(event_id % 3 + 1)")
TOTAL = " + ".join(PROBS)
NUMBER = "((event_id % 200 - 100) / 100.0)"
SPACE = r"[\s\x0B\x85\xA0]"
_URL = "https?://\\S+"
LEX = ", ".join(f"('{w}', {x}::DOUBLE)" for w, x in {"the": 0.5, "and": -0.25, "que": 0.75, "der": -0.5, "thing": 1.0, "of": -0.75}.items())
assert math.isclose(CDF[0], math.exp(-1))

SQL: dict[str, str] = {
    "summary_by_tier": f"WITH {SCORED} SELECT tier, round(avg(score), 9) AS mean, count(score) AS n FROM scored GROUP BY tier",
    "summary_by_account": f'WITH {SCORED} SELECT "user", round(avg(score), 9) AS mean, count(score) AS n FROM scored GROUP BY "user"',
    "weekly_trend": f"WITH {SCORED} SELECT CAST(week(created_at) AS BIGINT) AS week, round(avg(score), 9) AS mean, count(score) AS n FROM scored GROUP BY 1",
    "weekly_trend_by_year": f"WITH {SCORED} SELECT CAST(isoyear(created_at) AS BIGINT) AS iso_year, CAST(week(created_at) AS BIGINT) AS week, round(avg(score), 9) AS mean, count(score) AS n FROM scored GROUP BY 1, 2",
    "summary_table": f"""WITH {SCORED} SELECT "user", CASE WHEN length('account number ' || "user" || ' of the collected posts') > 36 THEN substr('account number ' || "user" || ' of the collected posts', 1, 34) || '..' ELSE 'account number ' || "user" || ' of the collected posts' END AS name,
       {BAR("round(avg(score), 6)", 20)} AS bar, count(score) AS n FROM scored GROUP BY "user" """,
    "daily_timeline": f"WITH {SCORED}, {resample('day', smooth=3)}",
    "daily_by_user": f"WITH {SCORED}, {resample('day', by='user')}",
    "daily_volume": f"WITH {SCORED}, {resample('day', n_only=True)}",
    "tier_rolling5": f"WITH {SCORED}, {resample('day', by='tier', smooth=5)}",
    "hourly_public": f"WITH {SCORED}, {resample('hour', form='%Y-%m-%d %H:%M', where="tier = 'view'")}",
    "account_week_heatmap": f"""WITH {SCORED} SELECT "user", strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week, strftime(date_trunc('week', created_at), '%b %d') AS month_day, round(avg(score), 9) AS mean
       FROM scored WHERE score IS NOT NULL GROUP BY "user", date_trunc('week', created_at)""",
    "account_week_pivot": f"""WITH {SCORED} SELECT "user", {", ".join(f"round(avg(score) FILTER (strftime(date_trunc('week', created_at), '%m%d') = '{w}'), 9) AS w{w}" for w in ("0101", "0108", "0115", "0122", "0129"))} FROM scored WHERE score IS NOT NULL GROUP BY "user" """,
    "event_window_48h": compare(48),
    "event_window_filtered": compare(24, "tier = 'click'"),
    "event_markers": f"WITH {DIM} SELECT strftime(date, '%Y-%m-%d') AS date, label, category, CASE category {' '.join(f'WHEN {c!r} THEN {k!r}' for c, k in COLOURS.items())} ELSE 'gray' END AS colour FROM dim WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-12-31'",
    "dedupe_first_wins": f"""WITH {SCORED}, u AS (SELECT 0 AS b, id, "user", score FROM scored UNION ALL SELECT 1, id, "user", score + 10 FROM scored)
       SELECT id, "user", round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b) AS rn FROM u) WHERE rn = 1""",
    "dedupe_texts": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL AND text <> '') WHERE rn = 1",
    "cap_newest_per_user": 'SELECT o_orderkey AS id, o_custkey AS "user" FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3',
    "high_water_mark": f"""WITH {SCORED} SELECT "user", strftime(max(created_at), '{SECOND}') AS latest FROM scored GROUP BY "user" """,
    "fetch_gaps": f"""WITH {SCORED} SELECT "user", CAST(floor(epoch(greatest(max(created_at) + INTERVAL 1 SECOND, TIMESTAMP '2024-02-06 12:00:00' - INTERVAL 7 DAY + INTERVAL 5 MINUTE))) - floor(epoch(max(created_at))) - 1 AS BIGINT) AS gap FROM scored GROUP BY "user" """,
    "prompts": "SELECT doc_id, md5(concat('Text: ', coalesce(text, ''), ' / ', coalesce(source, ''), '.')) AS prompt_md5 FROM documents",
    "fetch_windows": f"""WITH {SCORED} SELECT "user", strftime(greatest(max(created_at) + INTERVAL 1 SECOND, TIMESTAMP '2024-02-02 12:00:00' - INTERVAL 7 DAY + INTERVAL 5 MINUTE), '{SECOND}') AS start,
       strftime(TIMESTAMP '2024-02-02 12:00:00' - INTERVAL 30 SECOND, '{SECOND}') AS stop FROM scored GROUP BY "user" """,
    "posts_in_window": f"""WITH {SCORED} SELECT id, "user" FROM scored WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""",
    "source_counts": f"""WITH {SCORED}, dim AS (SELECT unnest([{", ".join(map(repr, SOURCES))}]) AS tier) SELECT d.tier, count(s.id) AS n FROM dim d LEFT JOIN scored s ON s.tier = d.tier GROUP BY d.tier""",
    "status_missing": f"""SELECT tier FROM (SELECT unnest([{", ".join(repr(s.upper()) for s in SOURCES)}]) AS tier) WHERE lower(tier) NOT IN (SELECT lower(event_type) FROM events WHERE event_type IS NOT NULL)""",
    "coverage": "SELECT conv_id, count(*) FILTER (role = 'assistant') AS collected, count(*) AS reported, round(100.0 * count(*) FILTER (role = 'assistant') / count(*), 9) AS pct, 100.0 * count(*) FILTER (role = 'assistant') / count(*) < 50 AS truncated FROM conversations GROUP BY conv_id",
    "budget": "SELECT a * 500 AS account_posts, t * 150 AS term_posts, a * 500 + t * 150 AS posts, round((a * 500 + t * 150) * 0.005::DOUBLE, 9) AS cost FROM (SELECT count(DISTINCT user_id) AS a, count(DISTINCT event_type) AS t FROM events)",
    "account_tiers": "SELECT CAST(user_id AS VARCHAR) AS \"user\", CASE WHEN user_id = 3 THEN 'media' ELSE 'admin' END AS tier FROM events GROUP BY user_id",
    "direct_replies": f'WITH {REPLY} SELECT id, "user" FROM r WHERE in_reply_to_id = parent_id',
    "reply_parents": f'WITH {REPLY} SELECT a.id, a."user", b."user" AS parent_user FROM r a JOIN r b ON a.in_reply_to_id = b.id',
    "post_summary": f"WITH {SCORED} SELECT tracked_slug AS slug, count(*) AS n, round(avg(score), 9) AS mean_score, {SHARES} FROM scored WHERE tracked_slug IS NOT NULL GROUP BY tracked_slug",
    "post_label_shares": f"WITH {SCORED} SELECT 'click' AS slug, count(*) AS n, round(avg(score), 9) AS mean_score, {SHARES} FROM scored WHERE tracked_slug = 'click'",
    "mean_ci_poisson": f"""WITH {SCORED}, reps AS (SELECT tier, b, score, {poisson("id", "b")} AS w FROM scored, (SELECT unnest(range({REPLICATES})) AS b) WHERE score IS NOT NULL),
       m AS (SELECT tier, b, sum(w * score) / nullif(sum(w), 0) AS m FROM reps GROUP BY tier, b),
       ci AS (SELECT tier, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY tier)
       SELECT s.tier, round(avg(s.score), 9) AS mean, round(any_value(ci.lo), 9) AS ci_low, round(any_value(ci.hi), 9) AS ci_high FROM scored s JOIN ci ON ci.tier = s.tier GROUP BY s.tier""",
    "diff_ci_poisson": f"""WITH {SCORED}, {DIM}, {windows(48)}, reps AS (SELECT event_label, is_post, b, score, {poisson("id", "b")} AS w FROM rows, (SELECT unnest(range({REPLICATES})) AS b)),
       m AS (SELECT event_label, b, sum(w * score) FILTER (is_post) / nullif(sum(w) FILTER (is_post), 0) - sum(w * score) FILTER (NOT is_post) / nullif(sum(w) FILTER (NOT is_post), 0) AS m FROM reps GROUP BY event_label, b),
       ci AS (SELECT event_label, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY event_label)
       SELECT r.event_label, round(avg(score) FILTER (is_post) - avg(score) FILTER (NOT is_post), 9) AS diff, round(any_value(lo), 9) AS diff_ci_low, round(any_value(hi), 9) AS diff_ci_high FROM rows r JOIN ci ON ci.event_label = r.event_label GROUP BY r.event_label""",
    "event_window_ci": f"""WITH {SCORED}, {DIM}, {windows(48)}, reps AS (SELECT event_date, event_label, is_post, b, score, {poisson("id", "b")} AS w FROM rows, (SELECT unnest(range({REPLICATES})) AS b)),
       m AS (SELECT event_date, event_label, b, sum(w * score) FILTER (is_post) / nullif(sum(w) FILTER (is_post), 0) - sum(w * score) FILTER (NOT is_post) / nullif(sum(w) FILTER (NOT is_post), 0) AS m FROM reps GROUP BY ALL),
       ci AS (SELECT event_date, event_label, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY ALL)
       SELECT strftime(r.event_date, '%Y-%m-%d') AS event_date, r.event_label, count(*) FILTER (NOT is_post) AS n_pre, count(*) FILTER (is_post) AS n_post,
       round(avg(score) FILTER (NOT is_post), 9) AS mean_pre, round(avg(score) FILTER (is_post), 9) AS mean_post, round(avg(score) FILTER (is_post) - avg(score) FILTER (NOT is_post), 9) AS diff, 48 AS window_hours, 'score' AS score_col,
       round(any_value(lo), 9) AS diff_ci_low, round(any_value(hi), 9) AS diff_ci_high FROM rows r JOIN ci ON ci.event_label = r.event_label AND ci.event_date = r.event_date GROUP BY r.event_date, r.event_label""",
    "post_summary_poisson": f"""WITH {SCORED}, reps AS (SELECT tracked_slug, b, score, {poisson("id", "b")} AS w FROM scored, (SELECT unnest(range({REPLICATES})) AS b) WHERE score IS NOT NULL),
       m AS (SELECT tracked_slug, b, sum(w * score) / nullif(sum(w), 0) AS m FROM reps GROUP BY ALL), ci AS (SELECT tracked_slug, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY ALL)
       SELECT s.tracked_slug AS slug, count(*) AS n, round(avg(score), 9) AS mean_score, {SHARES}, round(any_value(lo), 9) AS ci_low, round(any_value(hi), 9) AS ci_high, 'score' AS score_col, 'label' AS label_col FROM scored s JOIN ci ON ci.tracked_slug = s.tracked_slug GROUP BY s.tracked_slug""",
    "loyalty_segments_poisson": f"""WITH {LOYAL}, reps AS (SELECT tracked_slug, loyalty_tier, b, score, {poisson("doc_id", "b")} AS w FROM tiers, (SELECT unnest(range({REPLICATES})) AS b)),
       m AS (SELECT tracked_slug, loyalty_tier, b, sum(w * score) / nullif(sum(w), 0) AS m FROM reps GROUP BY ALL), ci AS (SELECT tracked_slug, loyalty_tier, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY ALL)
       SELECT t.tracked_slug, t.loyalty_tier, count(*) AS n, round(avg(score), 9) AS mean, round(any_value(lo), 9) AS ci_low, round(any_value(hi), 9) AS ci_high, 'score' AS score_col FROM tiers t JOIN ci ON ci.tracked_slug = t.tracked_slug AND ci.loyalty_tier = t.loyalty_tier GROUP BY t.tracked_slug, t.loyalty_tier""",
    "loyalty_scores": f"WITH {LOYAL} SELECT doc_id, round(loyalty_score, 9) AS loyalty_score, loyalty_tier FROM tiers",
    "loyalty_segments": f"WITH {LOYAL} SELECT tracked_slug, loyalty_tier, count(*) AS n, round(avg(score), 9) AS mean FROM tiers WHERE tracked_slug IS NOT NULL GROUP BY 1, 2",
    "flippers": f'WITH {SCORED}, {FLIP} SELECT "user", round(mean_first, 9) AS mean_first, round(mean_then, 9) AS mean_then FROM flip',
    "flipper_rows": f"""WITH {SCORED}, {FLIP} SELECT id, "user", round(score, 9) AS score FROM scored WHERE tracked_slug = 'view' AND "user" IN (SELECT "user" FROM flip)""",
    "stratified_sample": f"WITH {SCORED}, {sampled('scored', 50, 42, 'sample')} SELECT id, tracked_slug, bucket, round(score, 9) AS score FROM sample",
    "sample_union_dedup": f"""WITH {SCORED}, {sampled("scored", 50, 42, "a")}, {sampled("scored", 50, 7, "b")},
       u AS (SELECT 0 AS branch, id, tracked_slug, bucket FROM a UNION ALL SELECT 1, id, tracked_slug, bucket FROM b)
       SELECT id, tracked_slug, bucket FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY branch) AS k FROM u) WHERE k = 1""",
    "stance_distribution": f"""WITH {STANCES}, c AS (SELECT stance, count(*) AS n FROM stances WHERE stance <> 'error' GROUP BY stance)
       SELECT stance, n, round(n / sum(n) OVER (), 9) AS share, {BAR("round(n / sum(n) OVER (), 6)", 40)} AS bar FROM c""",
    "stance_crosstab": f"""WITH {STANCES}, c AS (SELECT tracked_slug, stance, count(*) AS n FROM stances WHERE stance <> 'error' GROUP BY ALL)
       SELECT tracked_slug, stance, n, round(100.0 * n / sum(n) OVER (PARTITION BY tracked_slug), 9) AS pct FROM c""",
    "stance_crosstab_wide": f"WITH {STANCES} SELECT tracked_slug, {', '.join(f'round(100.0 * count(*) FILTER (stance = {c!r}) / count(*), 9) AS {c}' for c in CATEGORIES)} FROM stances WHERE stance <> 'error' GROUP BY tracked_slug",
    "stance_vs_score": f"""WITH {STANCES}, m AS (SELECT stance, avg(score) AS mean, count(score) AS n FROM stances WHERE stance <> 'error' GROUP BY stance)
       SELECT stance, round(mean, 9) AS mean, n, CASE WHEN stance = 'pro_war_critical' AND mean < -0.1 THEN 'score negative, stance pro' WHEN stance = 'pro_trump_antiwar' AND mean > 0 THEN 'score positive, stance anti' ELSE '' END AS flag FROM m""",
    "label_crosstab": """WITH c AS (SELECT d.lang, CAST(l.quality AS VARCHAR) AS quality, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang IS NOT NULL AND l.quality IS NOT NULL GROUP BY ALL)
       SELECT lang, quality, n, round(100.0 * n / sum(n) OVER (PARTITION BY lang), 9) AS pct FROM c""",
    "nearest_tracked_match": f"""WITH {POSTS}, dim AS (SELECT * FROM (VALUES {TRACKED_VALUES}) AS t(slug, event_date, match_keyword, post_id)),
       hits AS (SELECT d.slug, p.id, p.doc_id, coalesce(abs(date_diff('day', CAST(p.created_at AS DATE), d.event_date)), 1000000000) AS dist
                FROM posts p JOIN dim d ON d.post_id IS NULL AND contains(lower(p.text), lower(d.match_keyword))),
       best AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY dist, doc_id) AS rn, count(*) OVER (PARTITION BY slug) AS n FROM hits)
       SELECT d.slug, coalesce(d.post_id, b.id) AS post_id, coalesce(b.n, 0) AS n_matches FROM dim d LEFT JOIN best b ON b.slug = d.slug AND b.rn = 1""",
    "paged_posts": f"""WITH {SCORED} SELECT tier AS source, id, round(score, 9) AS score FROM scored WHERE CAST(created_at AS DATE) BETWEEN '2024-01-08' AND '2024-01-20'
       QUALIFY row_number() OVER (PARTITION BY tier ORDER BY created_at DESC, id) <= 1000""",
    "paged_stream": f"""WITH {SCORED} SELECT tier AS source, id FROM scored WHERE created_at IS NOT NULL""",
    "ingest_ledger": f"""WITH {SCORED}, w AS (SELECT * FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('absent')) AS s(source), (VALUES ('2024-01-01', '2024-01-15', 1), ('2024-01-16', '2025-12-31', 0)) AS t(since, until, early)),
       c AS (SELECT source, since, until, early, count(id) AS n FROM w LEFT JOIN scored ON tier = source AND CAST(created_at AS DATE) BETWEEN CAST(since AS DATE) AND CAST(until AS DATE) GROUP BY ALL)
       SELECT source, since, until, CASE WHEN n > 0 THEN 'collected' ELSE 'empty' END AS state, CAST(CASE WHEN n = 0 AND early = 1 THEN 2 ELSE 1 END AS BIGINT) AS tries, CAST(n AS BIGINT) AS n FROM c""",
    "reply_trees": """WITH RECURSIVE r AS (SELECT concat_ws(':', conv_id, turn) AS id, concat_ws(':', conv_id, turn - 1) AS up FROM conversations GROUP BY ALL),
       t AS (SELECT id, up AS root, CAST(1 AS BIGINT) AS depth FROM r WHERE up NOT IN (SELECT id FROM r) UNION ALL SELECT r.id, t.root, t.depth + 1 FROM r JOIN t ON r.up = t.id)
       SELECT id, root, depth, 'orphan' AS state FROM t""",
    "stream_high_water": """WITH m AS (SELECT CAST(user_id AS VARCHAR) AS source, max(ts) AS latest FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id),
       s AS (SELECT *, greatest(latest + INTERVAL 1 SECOND, TIMESTAMP '2024-01-30 12:05:00') AS start FROM m)
       SELECT source, strftime(latest, '%Y-%m-%d %H:%M:%S.%f') AS latest, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, '2024-02-06 11:59:30.000000' AS stop,
              CAST(floor(epoch(start)) - floor(epoch(latest)) - 1 AS BIGINT) AS gap FROM s""",
    "snapshot_publish": f"""WITH {SCORED} SELECT id, round(-score, 9) AS score, CAST(2 AS BIGINT) AS version FROM scored""",
    "keyword_match": """SELECT CAST(doc_id AS VARCHAR) AS id, source AS "user" FROM documents WHERE contains(lower(text), 'thound')""",
    "strip_html": rf"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{SPACE}+', ' ', 'g'), '^ ', ''), ' $', '')) AS text_md5 FROM pages""",
    "url_only": rf"""WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '  ' || url WHEN 1 THEN url || ' read' ELSE url END AS x FROM pages)
       SELECT page_id, regexp_matches(coalesce(x, ''), '^\s*{_URL}(\s+{_URL})*\s*$') AS url_only FROM t""",
    "empty_text": r"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ' || chr(9) || chr(10) || ' ' WHEN 1 THEN NULL ELSE text END AS x FROM documents) SELECT doc_id, NOT regexp_matches(coalesce(x, ''), '\S') AS empty_text FROM t""",
    "label_thresholds": f"WITH {SCORED} SELECT id, {LABEL('score')} AS label, {STRICT('score')} AS strict_label FROM scored",
    "lexicon_score": rf"""WITH lex AS (SELECT * FROM (VALUES {LEX}) AS t(word, weight)),
       w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}'']+')) AS word FROM documents),
       m AS (SELECT doc_id, avg(weight) AS mean FROM w JOIN lex USING (word) GROUP BY doc_id),
       s AS (SELECT d.doc_id, round(coalesce(m.mean, 0.0), 4) AS score FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id)
       SELECT doc_id, score AS score_lexicon, {LABEL("score")} AS label_lexicon FROM s""",
    "weighted_label": f"""SELECT event_id, round(({PROBS[2]} - {PROBS[0]}) / ({TOTAL})::DOUBLE, 4) AS score,
       CASE WHEN {PROBS[0]} >= {PROBS[1]} AND {PROBS[0]} >= {PROBS[2]} THEN 'negative' WHEN {PROBS[1]} >= {PROBS[2]} THEN 'neutral' ELSE 'positive' END AS label FROM events""",
    "report_format": f"""WITH {SCORED} SELECT id, 'search-' || tier || '_a-b' AS file, tier AS slug, 'x|' || tier AS list, printf('%+.4f', score) AS signed FROM scored""",
    "restore_scores": f"""WITH {SCORED}, {CURRENT} SELECT c.id, round(CASE WHEN c.score_vader IS NULL THEN p.score_vader ELSE c.score_vader END, 9) AS score_vader, CASE WHEN c.score_vader IS NULL THEN p.label_vader ELSE c.label_vader END AS label_vader FROM cur c LEFT JOIN prior p ON p.id = c.id""",
    "restore_checkpoint": f"""WITH {SCORED}, {CURRENT} SELECT c.id, round(coalesce(p.score_vader, c.score_vader), 9) AS score_vader, CASE WHEN p.score_vader IS NULL THEN c.label_vader ELSE p.label_vader END AS label_vader FROM cur c LEFT JOIN prior p ON p.id = c.id""",
    "checkpoint_coverage": f"WITH {SCORED}, {CURRENT} SELECT count(*) AS rows, count(p.id) AS hits, count(*) = count(p.id) AS complete FROM cur c LEFT JOIN prior p ON p.id = c.id",
    "restore_repeated": f"""WITH {SCORED}, {CURRENT} SELECT c.id, round(CASE WHEN c.score_vader IS NULL THEN p.score_vader - 0.25 ELSE c.score_vader END, 9) AS score_vader, CASE WHEN c.score_vader IS NULL THEN {LABEL("(p.score_vader - 0.25)")} ELSE c.label_vader END AS label_vader FROM cur c LEFT JOIN prior p ON p.id = c.id""",
    "pending_scores": r"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND regexp_matches(coalesce(text, ''), '\S')",
    "pick_score_column": "SELECT event_type AS tier, CASE WHEN event_type = 'click' THEN 'score_transformer' ELSE 'score_vader' END AS picked FROM events GROUP BY event_type",
    "parse_llm_json": f"""SELECT event_id, CASE WHEN event_id % 5 < 3 THEN round({NUMBER}, 9) END AS score, CASE WHEN event_id % 5 < 2 THEN 'positive' WHEN event_id % 5 = 2 THEN {STRICT(NUMBER)} END AS label, event_id % 5 < 3 AS ok FROM events""",
    "parse_stance_json": """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'neutral_other' ELSE 'error' END AS stance, CASE WHEN event_id % 3 < 2 THEN round((event_id % 10) / 10.0, 9) ELSE 0.0 END AS confidence,
       CASE WHEN event_id % 3 < 2 THEN 'r' || event_id ELSE 'not JSON' END AS reason, event_id % 3 < 2 AS ok FROM events""",
    "metrics_json": """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CAST(props->>'$.k' AS BIGINT) AS mapped, '{"id":' || event_id || coalesce(',"k":' || (props->>'$.k'), '') || '}' AS line FROM events""",
    "jsonl_posts": f"""WITH {POSTS} SELECT id, "user", md5(text) AS text_md5, lang, strftime(created_at, '%Y-%m-%d') AS day FROM posts WHERE id IS NOT NULL AND id <> ''""",
    "jsonl_corrupt": 'SELECT CAST(event_id AS VARCHAR) AS id, event_type AS "user" FROM events WHERE event_id % 3 <> 0',
    "replies_by_slug": f"""WITH {SCORED} SELECT id, "user", round(score, 9) AS score FROM scored WHERE tracked_slug = 'click'""",
    "published_sorted": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS crossed FROM events",
    "source_totals": "SELECT count(*) AS posts, count(DISTINCT event_type) AS slugs, count(*) FILTER (event_id % 10 = 0) AS url_only, count(*) FILTER (event_id % 11 = 0) AS errors FROM events",
    "stream_daily_means": "SELECT event_type AS tier, strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, round(avg(value), 9) AS mean, count(value) AS n FROM events GROUP BY event_type, date_trunc('day', ts)",
    "stream_dedupe": "SELECT DISTINCT CAST(event_id AS VARCHAR) AS id FROM events",
}
