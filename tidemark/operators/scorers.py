"""Scorers as plug-ins: a lexicon in Catalyst; valence rules, models and remote classifiers through Arrow.

The lexicon scorer is this library's own; it is not, and doesn't claim to be, any published one.
"""

from __future__ import annotations

import hashlib
import re
import resource
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.score import label
from tidemark.functions.text import empty_text, prompt, sentiment_reply, stance_reply, url_only
from tidemark.operators.calls import Policy, answers
from tidemark.operators.valence import valence
from tidemark.session import scratch
from tidemark.sources.files import exists
from tidemark.sources.sinks import _files, _move


class Scorer(Protocol):
    """Adds score_<name> and label_<name> to rows that lack them."""

    name: str

    def score(self, posts: DataFrame) -> DataFrame: ...


#: Words of a lexicon up to which Catalyst looks them up (it searches a map from its beginning); larger ones are a dictionary in each task.
SMALL_LEXICON = 64


class LexiconScorer:
    """Mean weight of a text's lexicon words; 0 without any. Small lexicons are all in Catalyst: no Python at run time."""

    def __init__(self, weights: dict[str, float], name: str = "vader"):
        self.name, self.weights = name, weights

    def fresh(self) -> Column:
        """A text's score between -1 and 1."""
        if len(self.weights) > SMALL_LEXICON:
            return self.looked_up()
        table = F.create_map(*(F.lit(x) for kv in self.weights.items() for x in kv)) if self.weights else F.create_map().cast("map<string,double>")
        words = self.words()
        hits = F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull())
        mean = F.when(F.size(hits) > 0, F.aggregate(hits, F.lit(0.0), lambda a, x: a + x) / F.size(hits)).otherwise(0.0)
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean))

    @staticmethod
    def words() -> Column:
        return F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}']+"), lambda w: w != "")

    def looked_up(self) -> Column:
        """The same score by a dictionary; words are still split by Spark."""
        weights = self.weights

        @F.pandas_udf("double")
        def run(texts: pd.Series) -> pd.Series:
            hits = ([weights[w] for w in words if w in weights] for words in texts)
            return pd.Series([sum(h) / len(h) if h else 0.0 for h in hits], dtype="float64")

        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), run(self.words())))

    def score(self, posts: DataFrame) -> DataFrame:
        s, lab = f"score_{self.name}", f"label_{self.name}"
        old = F.col(s) if s in posts.columns else F.lit(None).cast("double")
        out = posts.withColumn("_new", old.isNull()).withColumn(s, F.coalesce(old, F.round(self.fresh(), 4)))
        kept = F.col(lab) if lab in posts.columns else F.lit(None).cast("string")
        return out.withColumn(lab, F.when(F.col("_new") | kept.isNull(), label(F.col(s))).otherwise(kept)).drop("_new")


class ValenceScorer(LexiconScorer):
    """Valence rules (valence.py) over a lexicon of any size: a dictionary in each task, texts in Arrow batches."""

    def fresh(self) -> Column:
        weights = self.weights

        @F.pandas_udf("double")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([valence(t or "", weights) for t in texts], dtype="float64")

        return run("text")


#: Words of a text that a model sees, and resident megabytes at which a task stops asking it.
TOKENS, CEILING_MB = 512, 6144
WORD = re.compile(r"\S+")


def truncated(text: str, tokens: int = TOKENS) -> str:
    """The text up to its last token that a model takes; tokens are words here, of which each is one or more of a model's own."""
    end = 0
    for i, m in enumerate(WORD.finditer(text), 1):
        end = m.end()
        if i == tokens:
            return text[:end]
    return text


def resident_mb() -> float:
    """Resident memory of this process."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * resource.getpagesize() / 1e6


def in_batches(model: Callable, texts: list[str], batch: int, tokens: int, ceiling: float, memory: Callable[[], float]) -> list[tuple]:
    """(score, label, error) of each text. Texts of like length go together, the shortest first, so that a batch is hardly padded. A batch
    that fails is a null with its error. At the ceiling the rest stays without scores, so the task ends and its part is kept."""
    cut = [truncated(t, tokens) for t in texts]
    order = sorted(range(len(cut)), key=lambda i: len(cut[i]))
    out: list[tuple] = [(None, None, None)] * len(cut)
    for at in range(0, len(order), batch):
        own = order[at : at + batch]
        if memory() >= ceiling:
            for i in order[at:]:
                out[i] = (None, None, f"memory ceiling of {ceiling:.0f} MB")
            return out
        try:
            said = [(float(s), str(lab), None) for s, lab in model([cut[i] for i in own])]
            if len(said) != len(own):
                raise ValueError(f"{len(said)} answers to {len(own)} texts")
        except Exception as e:  # noqa: BLE001  a bad batch must not end the job
            said = [(None, None, (str(e) or type(e).__name__)[:200])] * len(own)
        for i, row in zip(own, said, strict=True):
            out[i] = row
    return out


class ModelScorer:
    """A model that is loaded once per task and sees texts in batches of like length, cut to *tokens* words. A failed batch gives nulls,
    an error mark and its error, and so do the rows that are left at the memory ceiling: a later run scores them."""

    def __init__(self, load: Callable[[], Callable[[Sequence[str]], Sequence[tuple[float, str]]]], name: str = "transformer", batch: int = 16, tokens: int = TOKENS, ceiling_mb: float = CEILING_MB):
        self.load, self.name, self.batch, self.tokens, self.ceiling_mb = load, name, batch, tokens, ceiling_mb

    def score(self, posts: DataFrame) -> DataFrame:
        load, batch, tokens, ceiling = self.load, self.batch, self.tokens, self.ceiling_mb

        @F.pandas_udf("score double, label string, error string")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = load()
            for texts in parts:
                yield pd.DataFrame(in_batches(model, texts.tolist(), batch, tokens, ceiling, resident_mb), columns=["score", "label", "error"]).astype({"score": "float64", "label": object, "error": object})

        s, lab, err = f"score_{self.name}", f"label_{self.name}", f"error_{self.name}"
        old = F.col(s) if s in posts.columns else F.lit(None).cast("double")
        blank = empty_text(F.col("text"))
        base = posts.withColumns({"_old": old, "empty_text": blank})
        # The cheap tests come first: only rows that need the model cross to Python.
        todo = base.where(F.col("_old").isNull() & ~F.col("empty_text")).withColumn("_m", run("text"))
        done = base.where(F.col("_old").isNotNull() | F.col("empty_text"))
        kept = F.col(lab) if lab in posts.columns else F.lit(None).cast("string")
        filled = done.withColumns({s: F.coalesce("_old", F.lit(0.0)), lab: F.when(F.col("_old").isNull(), "neutral").otherwise(kept), "score_failed": F.lit(False), err: F.lit(None).cast("string")})
        scored = todo.withColumns({s: F.col("_m.score"), lab: F.col("_m.label"), "score_failed": F.col("_m.error").isNotNull(), err: F.col("_m.error")}).drop("_m")
        return filled.unionByName(scored.select(*filled.columns)).drop("_old")


def _ask(posts: DataFrame, client: Callable[[str, str], str], policy: Policy, template: str | None = None) -> DataFrame:
    """Adds reply, the client's answer for each row, and error, what it raised at last instead.

    The client gets the text, or where there is a *template* the prompt made of it, and the user.
    """

    @F.pandas_udf("reply string, error string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, user in parts:
            rows = ((t or "", u or "") for t, u in zip(text, user, strict=True))
            yield pd.DataFrame(list(answers(client, rows, policy)), columns=["reply", "error"], dtype=object)

    said = F.col("text") if template is None else prompt(template, text=F.col("text"), user=F.col("user"))
    asked = posts.withColumn("_said", said).withColumn("_a", run("_said", "user"))
    return asked.withColumns({"reply": F.col("_a.reply"), "error": F.col("_a.error")}).drop("_said", "_a")


class RemoteScorer:
    """A remote sentiment model for chosen tiers or accounts; URL-only texts are off_topic without a call.

    error_<name> says what a row without a score was answered: the client's last error, or that the answer could not be read.
    """

    def __init__(self, client: Callable[[str, str], str], tiers: Sequence[str] | None = None, accounts: Sequence[str] | None = None, threads: int = 5, name: str = "llm", template: str | None = None, policy: Policy | None = None):
        self.client, self.tiers, self.accounts, self.name, self.template = client, tiers, accounts, name, template
        self.policy = policy or Policy(threads)

    def score(self, posts: DataFrame) -> DataFrame:
        s, lab = f"score_{self.name}", f"label_{self.name}"
        old = F.col(s) if s in posts.columns else F.lit(None).cast("double")
        kept = F.col(lab) if lab in posts.columns else F.lit(None).cast("string")
        wanted = F.lit(self.tiers is None and self.accounts is None)
        wanted = wanted | (F.col("tier").isin(list(self.tiers)) if self.tiers else F.lit(False)) | (F.col("user").isin(list(self.accounts)) if self.accounts else F.lit(False))
        err = f"error_{self.name}"
        base = posts.withColumns({s: old, lab: kept, err: F.col(err) if err in posts.columns else F.lit(None).cast("string")})
        base = base.withColumn("_case", F.when(F.col(s).isNotNull() | ~F.coalesce(wanted, F.lit(False)) | empty_text(F.col("text")), 0).when(url_only(F.col("text")), 1).otherwise(2))
        asked = _ask(base.where("_case = 2"), self.client, self.policy, self.template).withColumn("_r", sentiment_reply(F.col("reply")))
        unread = F.when(F.col("_r.score").isNull(), F.concat(F.lit("unreadable: "), F.substring(F.coalesce("reply", F.lit("")), 1, 80)))
        asked = asked.withColumns({s: F.col("_r.score"), lab: F.col("_r.label"), err: F.coalesce("error", unread)}).select(*base.columns)
        links = base.where("_case = 1").withColumns({s: F.lit(0.0), lab: F.lit("off_topic")})
        return base.where("_case = 0").unionByName(links).unionByName(asked).drop("_case")


def classify_stance(sample: DataFrame, client: Callable[[str, str], str], score: str = "score", threads: int = 5, template: str | None = None) -> DataFrame:
    """id, tracked_slug, user, text (100 characters), score, stance, confidence, reason; failures are stance error, and their
    reason is what the client raised."""
    asked = _ask(sample.withColumn("_whole", F.col("text")).withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, 500)), client, Policy(threads), template)
    r = stance_reply(F.col("reply"))
    reason = F.when(F.col("error").isNotNull(), F.substring("error", 1, 80)).otherwise(F.col("_r.reason"))
    return asked.withColumn("_r", r).select("id", "tracked_slug", "user", F.substring("text", 1, 100).alias("text"), score, F.col("_r.stance").alias("stance"), F.col("_r.confidence").alias("confidence"), reason.alias("reason"))


def signature(x: object) -> str:
    """What a scorer or a part of it does, as text: names, parameters and the code of functions, never addresses."""
    if isinstance(x, (str, bytes, int, float, bool, type(None))):
        return repr(x)
    if isinstance(x, Mapping):
        return "{" + ",".join(sorted(f"{signature(k)}:{signature(v)}" for k, v in x.items())) + "}"
    if isinstance(x, (set, frozenset)):
        return "{" + ",".join(sorted(map(signature, x))) + "}"
    if isinstance(x, Sequence):
        return "[" + ",".join(map(signature, x)) + "]"
    if isinstance(x, partial):
        return f"partial({signature(x.func)},{signature(x.args)},{signature(x.keywords)})"
    code = getattr(x, "__code__", None)
    if code is not None:
        held = [c.cell_contents for c in x.__closure__ or ()]
        consts = [c for c in code.co_consts if not hasattr(c, "co_code")]
        inner = [c.co_code for c in code.co_consts if hasattr(c, "co_code")]
        return f"{x.__module__}.{x.__qualname__}({signature([code.co_code, code.co_names, consts, inner, held, x.__defaults__ or ()])})"
    kind = x if isinstance(x, type) else type(x)
    return f"{kind.__module__}.{kind.__qualname__}({'' if isinstance(x, type) else signature(getattr(x, '__dict__', {}))})"


def resumable(posts: DataFrame, scorers: Sequence[Scorer], path: str, batches: int = 16, key: str = "id") -> DataFrame:
    """Score in parts of hashed keys, each committed when it is done; a run after a break scores only what is missing.

    Posts are read once: they are dealt out into one folder for each part, and counted and hashed as they are written. The folder's name
    is a digest of their keys and texts and of what the scorers do (signature()), so neither other posts nor another lexicon,
    template or client meet an old checkpoint. A part is written aside and moved into place, so a part is there whole or not at all.
    """
    spark = posts.sparkSession
    seen = Observation()
    told = F.xxhash64(key, "text").cast("decimal(38,0)")
    dealt = f"{path}/dealt-{scratch(spark, 'x').rsplit('-', 1)[-1]}"
    counted = posts.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(told).alias("digest"))
    counted.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")).write.partitionBy("_part").parquet(dealt)
    rows = seen.get
    digest = hashlib.sha256(f"{rows['n']} {rows['digest']} {batches} {signature(list(scorers))} {posts.schema.json()}".encode()).hexdigest()[:20]
    place = f"{path}/{digest}"
    fs, at = _files(spark, place)
    if exists(spark, f"{place}/posts/_SUCCESS"):
        fs.delete(at(dealt), True)
    else:
        fs.delete(at(f"{place}/posts"), True)
        fs.mkdirs(at(place))
        _move(fs, at, dealt, f"{place}/posts")
    parts = []
    for i in range(batches):
        done = f"{place}/scored/part={i}"
        if not exists(spark, f"{done}/_SUCCESS"):
            source = f"{place}/posts/_part={i}"
            if not exists(spark, source):
                continue  # no key falls here
            part = spark.read.schema(posts.schema).parquet(source)
            for scorer in scorers:
                part = scorer.score(part)
            aside = f"{place}/scored/.part={i}"
            part.write.mode("overwrite").parquet(aside)
            fs.delete(at(done), True)
            _move(fs, at, aside, done)
        parts.append(done)
    if not parts:  # no posts at all
        for scorer in scorers:
            posts = scorer.score(posts)
        return posts
    return spark.read.parquet(*parts)


def analyze(posts: DataFrame, scorers: Sequence[Scorer], prior: DataFrame | None = None, checkpoint: str | None = None, batches: int = 16) -> DataFrame:
    """Restore earlier scores, then let each scorer see what is still open, cheap ones first; resumable with a *checkpoint*."""
    from tidemark.operators.restore import restore

    if prior is not None:
        names = tuple(s.name for s in scorers if f"score_{s.name}" in posts.columns and f"score_{s.name}" in prior.columns)
        posts = restore(posts, prior, names) if names else posts
    if checkpoint is not None:
        return resumable(posts, scorers, checkpoint, batches)
    for scorer in scorers:
        posts = scorer.score(posts)
    return posts
