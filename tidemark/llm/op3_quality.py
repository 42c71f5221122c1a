"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Each rule rejects a document whose metric is above a cutoff; a document goes if any rule rejects it. For every stratum
(language) the labelled good documents are split in two by a hash of their id. The first half orders all (rule, cutoff)
pairs by how many of its documents each rejects: that is a path, on which the rules' cutoffs get tighter step by step.
The second half tests the path's steps in this fixed sequence: with n documents of which k are rejected by some rule
at the cutoffs so far, the exact binomial test rejects "the false-rejection rate is above RISK" when
P(X <= k | n, RISK) <= LEVEL / strata. The sequence ends at the first failure, so its steps need no correction, and
over strata it is Bonferroni's. The last step that passed is used. So with probability 1 - LEVEL the rules together reject
at most RISK of the good documents of every stratum (of those that the base rule leaves: that one is fixed and not
controlled). Where no step passes (few labels) the rules reject nothing.

Edge cases: a null or empty text has no words and fails the base rule (n_words < 20). Documents without
a language form a stratum of their own. Labels that are null, repeated or in conflict: a document is
good if its least label is 1. Rows that share a doc_id are one trial of the holdout: in their least language, rejected where any of
them is, so repeated rows certify nothing. No labels at all: only the base rule rejects. Repeated documents give
repeated results. Texts are read whole; a document's arrays live in one row, no rows are exploded. Windows of words are
compared by 64-bit hashes: in a text of a million words two differ but are taken as equal with probability 3e-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, broadcast_if_small, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
RISK, LEVEL = 0.02, 0.05
#: Rules and the cutoffs tried for each, from the loosest to the tightest.
GRID: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (4.0, 3.0, 2.5, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "marks_per_word": (4.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2),
    "dup_line_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_word_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "chars_per_word": (60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0),
}
TERMS = 2000


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more; *windows* has the hash at each start."""
    pairs = F.array_sort(F.arrays_zip(windows.alias("h"), F.sequence(F.lit(0), F.size(windows) - 1).alias("i")))
    twins = F.zip_with(pairs, F.slice(pairs, 2, F.size(pairs)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    starts = F.array_sort(F.array_distinct(F.flatten(twins)))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n")),
    )
    return covered["n"]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base counts and the rules' metrics, one row per document.

    Window hashes are built by doubling: pairs of words, of pairs, of fours; a row's arrays are hashed
    once and only texts that hold a repeated window are sorted.
    """

    def doubled(col: Column, step: int) -> Column:
        return F.zip_with(F.slice(col, 1, F.greatest(F.size(col) - step, F.lit(0))), F.slice(col, 1 + step, F.size(col)), lambda a, b: F.xxhash64(a, b))

    t = F.col("text")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), F.coalesce(t, F.lit("")).alias("text"))
    base = base.withColumn("bare", F.btrim(t, F.lit(SPACES)))
    base = base.withColumns({
        "words": F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", r"[\x20\x09-\x0D]+")),
        "lines": F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
    })
    counted = base.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        without(t, SPACES).cast("long").alias("word_chars"),
        (F.length(t) - without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(t) - without(t, "!?")).cast("long").alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("w1"),
    )
    step = 1
    while step < WINDOW:
        counted = counted.withColumn(f"w{2 * step}", doubled(F.col(f"w{step}"), step)).drop(f"w{step}")
        step *= 2
    w = F.col(f"w{WINDOW}")
    counted = counted.withColumn("n_repeat_words", F.when(F.size(F.array_distinct(w)) < F.size(w), repeated_words(w)).otherwise(0).cast("long")).drop(f"w{WINDOW}")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.withColumns({
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_word_share": share("n_repeat_words", "n_words"),
        "chars_per_word": share("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    })


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 by Stirling's series at x + 8; exact to about 1e-13."""
    y = x + F.lit(8.0)
    shift = sum((F.log(x + F.lit(float(i))) for i in range(1, 8)), F.log(x))
    series = F.lit(1 / 12.0) / y - F.lit(1 / 360.0) / F.pow(y, F.lit(3.0)) + F.lit(1 / 1260.0) / F.pow(y, F.lit(5.0)) - F.lit(1 / 1680.0) / F.pow(y, F.lit(7.0))
    return (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), where k < n p; 1 elsewhere.

    From the largest term down, each is the one above it times i (1-p) / ((n-i+1) p) < 1. TERMS of them
    are summed and a geometric bound of the rest is added, so the value is never too small.
    """
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    fall = lambda i: i * F.lit(1 - p) / ((n - i + 1) * F.lit(p))
    steps = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.lit(float(TERMS))).cast("int")),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, j: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * F.greatest(fall(k - j), F.lit(0.0))).alias("term")),
    )
    rest = F.when(k > TERMS, steps["term"] / (1 - fall(k - TERMS))).otherwise(0.0)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.exp(top) * (steps["sum"] + rest), F.lit(1.0)))


#: (rule, place in its grid, cutoff) from the loosest on.
STEPS = [(r, i, c) for r, cuts in GRID.items() for i, c in enumerate(cuts)]
RULES = list(GRID)


def paths(tuning: DataFrame) -> DataFrame:
    """stratum, path: all steps (k, rule, i, cutoff) ordered by the documents that each rejects."""
    rejected = [F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r, i, c in STEPS]
    steps = F.array(*(F.struct(F.col(f"{r}_{i}").alias("k"), F.lit(RULES.index(r)).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff")) for r, i, c in STEPS))
    return tuning.groupBy("stratum").agg(*rejected).select("stratum", F.array_sort(steps).alias("path"))


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum and a cutoff for each rule (infinity: rejects nothing), from the labelled good documents."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    # Rows of one id are one trial, which fails if any of them does.
    trials = measured.where("not base_failed").join(good, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("stratum").alias("stratum"), *(F.max(r).alias(r) for r in RULES))
    held = trials.select("stratum", *RULES, (F.pmod(F.xxhash64(F.lit("holdout"), "doc_id"), F.lit(2)) == 0).alias("tunes"))
    held = written(held, "op3-holdout")
    tests = max(1, held.select("stratum").distinct().count())
    path = broadcast_if_small(paths(held.where("tunes")).withColumnRenamed("stratum", "of"))
    seen = held.where("not tunes").join(path, F.col("stratum").eqNullSafe(F.col("of"))).drop("of")
    metrics = F.array(*RULES)
    first = F.array_position(F.transform("path", lambda p: F.element_at(metrics, p["rule"] + 1) > p["cutoff"]), F.lit(True))
    counts = seen.groupBy("stratum", first.alias("first")).agg(F.count("*").alias("c"))  # first: 0 for never
    told = counts.groupBy("stratum").agg(F.sum("c").alias("n"), F.collect_list(F.struct("first", "c")).alias("hits"))  # a row for each step at most
    told = told.join(path, F.col("stratum").eqNullSafe(F.col("of"))).drop("of")
    step = told.select("stratum", "n", "hits", "path", F.explode(F.sequence(F.lit(1), F.lit(len(STEPS)))).alias("step"))
    k = F.aggregate(F.filter("hits", lambda h: (h["first"] > 0) & (h["first"] <= F.col("step"))), F.lit(0).cast("long"), lambda acc, h: acc + h["c"])
    failed = step.withColumn("failed", binomial_tail(k, F.col("n"), risk) > level / tests).where("failed").groupBy("stratum").agg(F.min("step").alias("stop"))
    stops = told.join(failed.withColumnRenamed("stratum", "at"), F.col("stratum").eqNullSafe(F.col("at")), "left")
    used = F.slice("path", F.lit(1), F.coalesce(F.col("stop") - 1, F.lit(len(STEPS))))
    cut = lambda n: F.coalesce(F.array_min(F.transform(F.filter(used, lambda p: p["rule"] == n), lambda p: p["cutoff"])), F.lit(float("inf")))
    return stops.select("stratum", *(cut(n).alias(f"cut_{r}") for n, r in enumerate(RULES)))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Counts, metrics and verdict of every document."""
    measured = written(features(docs), "op3-features")
    cutoffs = broadcast_if_small(written(calibrate(measured, labels, risk, level).withColumnRenamed("stratum", "of"), "op3-cutoffs"))
    joined = measured.join(cutoffs, F.col("stratum").eqNullSafe(F.col("of")), "left").drop("of")
    above = [F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r in GRID]
    verdict = ~F.greatest(*(a.cast("int") for a in above)).cast("boolean")
    return joined.withColumn("kept", ~F.col("base_failed") & verdict)
