"""The queries of the training-data operators: thin wrappers that derive each contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import op1_pii, op2_bpe, op3_quality, op4_license, op5_mixing, op6_embedding, op7_importance, op8_simhash, op9_rollup, op10_chat, op11_align, op12_suffix, op13_audit
from tidemark.llm.common import scratch_path, table, written

#: The tokenizer file of op2, by name in the public_tokenizers package.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii.detect(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = op3_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_license.scan(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_mixing.mix(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_embedding.dedup(table(spark, sf_dir, "embeddings"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_importance.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_simhash.dedup(table(spark, sf_dir, "documents"))


#: Tokenizer versions of op9: white-space words, then runs of ASCII letters and digits.
COUNTERS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[0-9A-Za-z]+"}


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches: load all documents, recount the English ones, erase the toxic ones, and the recount again."""
    count = lambda name: F.regexp_count(F.coalesce("text", F.lit("")), F.lit(COUNTERS[name])).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", count("words-1").alias("old"), F.when(F.col("lang") == "en", count("words-2")).alias("new"))
    docs = written(docs, "op9-counts")
    load = docs.select(F.lit("insert").alias("op"), "source", "lang", F.lit("words-1").alias("tokenizer"), F.col("old").alias("tokens"))
    recount = docs.where("new is not null").select(F.lit("revise").alias("op"), "source", "lang", F.lit("words-2").alias("tokenizer"), F.col("new").alias("tokens"), F.lit("words-1").alias("old_tokenizer"), F.col("old").alias("old_tokens"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    erase = docs.join(toxic, "doc_id", "left_semi").select(F.lit("delete").alias("op"), "source", "lang", F.when(F.col("new").isNull(), "words-1").otherwise("words-2").alias("tokenizer"), F.coalesce("new", "old").alias("tokens"))
    rollup = op9_rollup.Rollup(spark, scratch_path(spark, "op9-rollup"))
    for batch, changes in (("load", load), ("recount", recount), ("erase", erase), ("recount", recount)):
        rollup.apply(batch, changes)
    return rollup.totals()


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w1,
         len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+')) AS w2
  FROM documents)
SELECT source, lang, CASE WHEN lang = 'en' THEN 'words-2' ELSE 'words-1' END AS tokenizer,
       count(*) AS n_docs, CAST(sum(CASE WHEN lang = 'en' THEN w2 ELSE w1 END) AS BIGINT) AS n_tokens
FROM d WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
GROUP BY ALL
"""


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_chat.format_pairs(*op10_chat.swapped_pairs(table(spark, sf_dir, "conversations")))


OP10_SQL = """
WITH base AS (SELECT DISTINCT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT pair_id, max(turn) AS last, arg_max(coalesce(text, ''), {'t': turn, 'r': role, 'x': text}) AS other FROM base GROUP BY pair_id),
rejected AS (
  SELECT b.pair_id, b.turn, b.role, CASE WHEN b.turn = l.last AND n.other IS NOT NULL THEN n.other ELSE b.text END AS text
  FROM base b JOIN last l ON l.pair_id = b.pair_id LEFT JOIN last n ON n.pair_id = b.pair_id + 1),
sides AS (SELECT 'c' AS side, * FROM base UNION ALL SELECT 'r', * FROM rejected),
clean AS (SELECT DISTINCT side, pair_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM sides),
shown AS (
  SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS part,
         row_number() OVER (PARTITION BY side, pair_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place
  FROM clean),
placed AS (SELECT *, sum(length(part)) OVER (PARTITION BY side, pair_id ORDER BY place) AS stop FROM shown),
common AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.place, r.place) AS place,
         coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM (SELECT * FROM placed WHERE side = 'c') c FULL JOIN (SELECT * FROM placed WHERE side = 'r') r ON c.pair_id = r.pair_id AND c.place = r.place),
prefix AS (SELECT pair_id, coalesce(min(place) FILTER (NOT same), max(place) + 1) AS n FROM common GROUP BY pair_id)
SELECT p.pair_id, p.n AS n_prompt_turns,
       coalesce(string_agg(part, '' ORDER BY place) FILTER (side = 'c' AND place < n), '') AS prompt,
       coalesce(string_agg(part, '' ORDER BY place) FILTER (side = 'c' AND place >= n), '') AS chosen,
       coalesce(string_agg(part, '' ORDER BY place) FILTER (side = 'r' AND place >= n), '') AS rejected,
       coalesce(string_agg(CAST(stop - length(text) - 11 AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY place) FILTER (side = 'c' AND place >= n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(CAST(stop - length(text) - 11 AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY place) FILTER (side = 'r' AND place >= n AND role = 'assistant'), '') AS rejected_mask
FROM prefix p JOIN placed s ON s.pair_id = p.pair_id GROUP BY p.pair_id, p.n
"""


#: The tokenizer files of op11, byte-level and by pieces.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op11_align.align(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return op12_suffix.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256", "n_shared_words")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
f AS (
  SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, [a, b, c, d, e] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM k p, k q, k r, k s, k t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
st AS (SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM o),
x AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, good, toxic,
         fails[ascii(substr(filter_order, step, 1)) - 64] AS fail,
         len(list_filter(range(1, step), lambda i: fails[ascii(substr(filter_order, i::INT, 1)) - 64])) > 0 AS earlier,
         len(list_filter(fails, lambda v: v)) AS n_fails
  FROM m, st),
y AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT fail AND NOT earlier), 0) AS kept,
         coalesce(sum(n) FILTER (fail AND NOT earlier), 0) AS removed,
         coalesce(sum(n) FILTER (fail AND earlier), 0) AS redundant,
         coalesce(sum(n) FILTER (fail AND n_fails = 1), 0) AS unique_fails,
         coalesce(sum(n) FILTER (fail AND NOT earlier AND good), 0) AS good_lost,
         coalesce(sum(n) FILTER (fail AND NOT earlier AND toxic), 0) AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM y
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_spans": op1_pii_spans,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_quality_rules": op3_quality_rules,
        "op4_license_scan": op4_license_scan,
        "op5_source_mix": op5_source_mix,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_importance_resampling": op7_importance_resampling,
        "op8_simhash_dedup": op8_simhash_dedup,
        "op9_token_rollup": op9_token_rollup,
        "op10_preference_format": op10_preference_format,
        "op11_token_alignment": op11_token_alignment,
        "op12_suffix_dedup": op12_suffix_dedup,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    """Oracles of the queries that SQL can express; tests/llm holds the others against brute force."""
    return {"op9_token_rollup": OP9_SQL, "op10_preference_format": OP10_SQL, "op13_filter_audit": OP13_SQL}
