"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

Per source the document rates w minimise sum w ln w - w under sum w size = target and w <= CAP. The
solution is an exponential tilt, w = min(CAP, exp(lambda size / mean size)); lambda solves the convex dual
by Newton steps, each one distributed aggregation over the table of (source, size, documents), safeguarded
by a bracket. Its sums are of decimals, so they don't depend on the order of rows and reruns agree bit for bit.
Rates become copies through one threshold per source: copy c of a document has the key
(c - u) / w with u a hash of its id and text, and the copies with the smallest keys are taken while their words
stay within the target. That is systematic rounding (a document gets floor(w + u) copies at threshold 1)
whose threshold is moved so that the words meet the target to within one document. The threshold is found
by refining histograms, so no source is sorted or gathered in one task. Sources are ranked by a distributed sort and
the shares' water level is found by sums over them, so there may be as many as there are domains.

Edge cases: a null text has size 0; documents of size 0 take 0 words; a null source is a source, last in
order; sources of size 0 have target 0. An empty table gives no rows. Rows that lack or share an id are documents of
their own: the text is part of the hash, and rows that are equal in id, source and text are numbered, each with a u of its
own, so a source of equal rows meets its target too. Which of such rows is taken is open, how many are is not. mix()
reads doc_id, text and source alone; mixed() keeps all columns, whatever their names. Reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, SPACES, broadcast_if_small, drop_scratch, join_hot, written

CAP = 3
WEIGHTS = 3
NEWTON, BINS, REFINE = 40, 512, 4
#: Fixed seed of the rounding.
SEED = "mix"
#: Rows of a file that are numbered together, where rows are equal.
BLOCK = 65_536
#: Sums of words that don't depend on the order of rows.
EXACT = "decimal(38,12)"
GOLDEN = 0.6180339887498949


def size() -> Column:
    bare = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")


def scans_files(docs: DataFrame) -> bool:
    """The frame is a scan of files under projections and filters alone, so a row of a file is one row at most and is the same
    when it is read again."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    if plan.children().length():
        return False
    hidden = plan.metadataOutput()
    return any(hidden.apply(i).name() == "_metadata" and "row_index" in hidden.apply(i).dataType().json() for i in range(hidden.length()))


def placed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """row (all columns), file and at: a name of each row that holds whenever the rows are read again; and the columns.

    Scans of files have it. All other frames are written first: after a join or an explode several rows come from one row of a file.
    """
    names = docs.columns
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    whole = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    return (docs if scans_files(docs) else written(docs, "op5-docs")).select(whole, *place), names


def measured(rows: DataFrame) -> DataFrame:
    """placed() rows with doc_id, source, of, size, hash."""
    doc_id, text, source = F.col("row.doc_id").cast("long"), F.col("row.text"), F.col("row.source").cast("string")
    flat = rows.withColumns({"doc_id": doc_id, "text": F.coalesce(text, F.lit("")), "source": source})
    told = F.xxhash64(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text", F.coalesce("source", F.lit("")))
    return flat.withColumns({"of": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")), "size": size(), "hash": told}).drop("text")


def sizes(rows: DataFrame) -> DataFrame:
    """file, at, doc_id, source, of (the source as a key that is never null), size, hash; from placed() rows."""
    return measured(rows).select("file", "at", "doc_id", "source", "of", "size", "hash")


def repeats(sized: DataFrame) -> DataFrame | None:
    """file, at, number: the equal rows after the first of each kind, numbered from 1; None if there are none.

    A kind may hold a third of all rows, so it is numbered in blocks of a file, and the blocks' counts are added up.
    """
    twice = sized.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    twice = written(twice, "op5-twice")
    if not twice.head(1):
        return None
    rows = join_hot(sized.select("file", "at", "hash"), twice, "hash").withColumn("block", F.floor(F.col("at") / BLOCK))
    rows = written(rows, "op5-equal")
    blocks = rows.groupBy("hash", "file", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("hash").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("hash", "file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("hash", "file", "block").orderBy("at")) - 1
    numbered = rows.withColumn("own", own).join(blocks, ["hash", "file", "block"])
    return written(numbered.select("file", "at", (F.col("before") + F.col("own")).alias("number")).where("number > 0"), "op5-repeats")


def unit(rows: DataFrame, numbers: DataFrame | None) -> DataFrame:
    """Adds u in (0, 1): the hash's fraction, moved on by the golden ratio for each equal row before."""
    first = (F.shiftrightunsigned("hash", 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    if numbers is None:
        return rows.withColumn("u", first)
    moved = first + F.coalesce("number", F.lit(0)) * F.lit(GOLDEN)
    return rows.join(broadcast_if_small(numbers), ["file", "at"], "left").withColumn("u", F.greatest(moved - F.floor(moved), F.lit(1e-16))).drop("number")


def ranked(by_source: DataFrame) -> DataFrame:
    """by_source with weight: 1, 2, 3, repeating in the order of sources. A distributed sort numbers the rows of each range,
    and the ranges' counts, one row each, are added up."""
    order = by_source.orderBy(F.col("source").asc_nulls_last())
    order = written(order.withColumns({"part": F.spark_partition_id(), "line": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "op5-order")
    counts = order.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return order.join(F.broadcast(before), "part").withColumn("weight", F.pmod(F.col("before") + F.col("line"), F.lit(WEIGHTS)) + 1).drop("part", "line", "before")


def targets(by_source: DataFrame) -> DataFrame:
    """Adds limit and target: the share by weight, filled up to CAP times a source's size like water.

    The level t satisfies sum min(CAP size, t weight) = total. From the level of all sources on, those that are at their
    limit are taken out and the level of the rest is set anew, until none is above: each step is one sum over sources,
    of whole numbers, and the level only rises.
    """
    of = written(ranked(by_source), "op5-ranked")
    total, weights = of.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / weights if weights else 0.0
    while weights:
        full = CAP * F.col("source_size") <= F.lit(float(level)) * F.col("weight")
        held, open_ = of.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - CAP * held) / open_ if open_ else level
        if new <= level:
            break
        level = new
    limit = CAP * F.col("source_size").cast("double")
    return of.withColumns({"limit": limit, "target": F.least(limit, F.lit(float(level)) * F.col("weight"))}).drop("weight")


def keyed(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    """Left join with a table that has a row for each source, by its key *of*; broadcast if they are few."""
    return left.join(F.broadcast(right), "of", "left") if few else join_hot(left, right, "of", "left")


def tilts(compact: DataFrame, goals: DataFrame, few: bool, steps: int = NEWTON) -> DataFrame:
    """of, lam, mean: Newton's iterations on every source's dual at once.

    *compact*: of, size, n. A step that leaves the bracket is replaced by its middle.
    """
    # The first guess tilts all sizes alike; a source at its limit takes CAP of everything, without steps.
    start = F.when(F.col("target") >= F.col("limit"), F.lit(float("inf"))).when(F.col("target") > 0, F.log(CAP * F.col("target") / F.col("limit"))).otherwise(0.0)
    state = written(goals.select("of", "target", "mean", start.alias("lam"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"), F.lit(False).alias("near")), "op5-state")
    exact = lambda c: F.sum(c.cast(EXACT)).cast("double")
    for _ in range(steps):
        at = keyed(compact.where("size > 0"), state, few)
        z = F.col("size") / F.col("mean")
        w = F.exp(F.least(F.col("lam") * z, F.log(F.lit(float(CAP)))))
        inner = F.col("lam") * z < F.log(F.lit(float(CAP)))
        sums = at.groupBy("of").agg(
            exact(F.col("n") * F.col("size") * w).alias("words"),
            exact(F.when(inner, F.col("n") * F.col("size") * z * w).otherwise(0.0)).alias("slope"),
        )
        new = keyed(state, sums, few)
        short = F.col("words") < F.col("target")
        new = new.withColumns({"low": F.when(short, F.col("lam")).otherwise(F.col("low")), "high": F.when(short, F.col("high")).otherwise(F.col("lam"))})
        newton = F.col("lam") + F.when(F.col("slope") > 0, (F.col("target") - F.col("words")) / F.col("slope"))
        middle = (F.col("low") + F.col("high")) / 2
        near = F.abs(F.col("words") - F.col("target")) <= 1e-6 * F.col("target")
        lam = F.when(F.col("words").isNull() | near, F.col("lam")).when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle)
        after = written(new.select("of", "target", "mean", lam.alias("lam"), "low", "high", F.coalesce(near, F.lit(True)).alias("near")), "op5-state")
        drop_scratch(state)
        state = after
        if not state.where("not near").head(1):
            break
    return state.select("of", "lam", "mean")


def thresholds(copies: DataFrame, goals: DataFrame, few: bool) -> DataFrame:
    """of, cut: the largest key up to which the copies' words stay within the target.

    *copies*: of, key (0 to CAP + 1 and above), size. Each pass sums words over BINS bins of the
    interval that still holds the cut, per source, and narrows it; partial sums meet before the shuffle.
    """
    state = written(goals.select("of", "target", F.lit(0.0).alias("low"), F.lit(2.0 * CAP).alias("high"), F.lit(0.0).alias("before")), "op5-cut")
    for _ in range(REFINE):
        at = keyed(copies, state, few).where((F.col("key") > F.col("low")) & (F.col("key") <= F.col("high")))
        bin_ = F.greatest(F.ceil((F.col("key") - F.col("low")) / ((F.col("high") - F.col("low")) / BINS)) - 1, F.lit(0))
        summed = written(at.groupBy("of", F.least(bin_, F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.sum("size").alias("words")), "op5-bins")
        run = F.col("before") + F.sum("words").over(Window.partitionBy("of").orderBy("bin"))
        run_ = keyed(summed, state, few).withColumn("run", run)
        over = run_.where(F.col("run") > F.col("target")).groupBy("of").agg(F.min("bin").alias("bin"))
        under = run_.where(F.col("run") <= F.col("target")).groupBy("of").agg(F.max("run").alias("held"))
        width = (F.col("high") - F.col("low")) / BINS
        new = keyed(keyed(state, over, few), under, few)
        # No bin goes over: all copies are within the target, and the cut is the interval's end.
        after = written(
            new.select(
                "of",
                "target",
                F.when(F.col("bin").isNull(), F.col("high")).otherwise(F.col("low") + F.col("bin") * width).alias("low"),
                F.when(F.col("bin").isNull(), F.col("high")).otherwise(F.col("low") + (F.col("bin") + 1) * width).alias("high"),
                F.coalesce("held", "before").cast("double").alias("before"),
            ),
            "op5-cut",
        )
        drop_scratch(state, summed)
        state = after
    return state.select("of", F.col("low").alias("cut"))


def rate() -> Column:
    return F.when(F.col("size") > 0, F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.log(F.lit(float(CAP)))))).otherwise(0.0)


def key(copy: int) -> Column:
    return (F.lit(copy) - F.col("u")) / F.col("rate")


def plan(sized: DataFrame) -> tuple[DataFrame, bool]:
    """of, source_size, target, lam, mean, cut for each source of sizes() with u, and whether they are few."""
    compact = written(sized.groupBy("of", "source", "size").agg(F.count("*").alias("n")), "op5-compact")
    words, filled = F.sum(F.col("size") * F.col("n")), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0))
    by_source = written(compact.groupBy("of", "source").agg(words.alias("source_size"), (words / F.greatest(filled, F.lit(1))).alias("mean")), "op5-sources")
    few = by_source.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    goals = written(targets(by_source), "op5-goals")
    lam = written(tilts(compact.select("of", "size", "n"), goals, few), "op5-tilts")
    each = keyed(sized.where("size > 0").select("of", "size", "u"), lam, few).withColumn("rate", rate()).where("rate > 0")
    each = each.select("of", "size", F.explode(F.array(*(key(c) for c in range(1, CAP + 1)))).alias("key"))
    cuts = thresholds(each, goals, few)
    out = written(keyed(keyed(goals.drop("limit", "mean", "source"), lam, few), cuts, few), "op5-plan")
    drop_scratch(compact, by_source, goals, lam)
    return out, few


def copies() -> Column:
    taken = (F.when((F.col("rate") > 0) & (key(c) <= F.col("cut")), 1).otherwise(0) for c in range(1, CAP + 1))
    return reduce(lambda a, b: a + b, taken).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, rate, copies, taken: one row per document."""
    rows, _ = placed(docs.select("doc_id", "text", "source"))
    sized = written(sizes(rows), "op5-sizes")
    sized = unit(sized, repeats(sized))
    by_source, few = plan(sized)
    done = keyed(sized, by_source, few).withColumn("rate", rate()).withColumn("copies", copies())
    return done.select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents with their columns, each row as often as the mix takes it. No text is shuffled (unless very many rows
    are equal): a row's copies follow from its size, its hash and its source's plan."""
    rows, names = placed(docs)
    sized = written(sizes(rows), "op5-sizes")
    numbers = repeats(sized)
    by_source, few = plan(unit(sized, numbers))
    whole = unit(measured(rows).select("row", "file", "at", "of", "size", "hash"), numbers)
    taken = keyed(whole, by_source, few).withColumn("rate", rate()).withColumn("copies", copies()).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select(*(F.col("row").getField(n).alias(n) for n in names))
