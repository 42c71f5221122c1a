"""Text functions as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \s knows ASCII alone; (?U) makes it Unicode's white space.
URL_ONLY = r"(?U)^\s*https?://\S+(\s+https?://\S+)*\s*$"


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space. Two passes, as one alternation backtracks."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def strip_html(html: Column) -> Column:
    """Tags become a space and white space is collapsed; entities stay as they are."""
    return strip(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"(?U)\s+", " "))


def url_only(text: Column) -> Column:
    """Does the text hold URLs and nothing else?"""
    return F.coalesce(text, F.lit("")).rlike(URL_ONLY)


def empty_text(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def has_keyword(text: Column, keyword: Column) -> Column:
    """Case-insensitive substring; a null text holds nothing."""
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(keyword))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur; one inside another counts for both."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))


def head(text: Column, n: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def ellipsis(text: Column, most: int = 36, mark: str = "..") -> Column:
    """Longer texts end in a mark, at the same width."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark))).otherwise(text)


def safe_file_name(name: Column) -> Column:
    """A source's name as a file name; not invertible."""
    return F.translate(name, ' :/"', "_--")


def remove_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def csv_list(text: Column) -> Column:
    """Comma-separated parts, trimmed; empty parts are left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def bar(value: Column, scale: int) -> Column:
    """Block glyphs in proportion to |value|; none for null."""
    return F.repeat(F.lit("█"), F.coalesce(F.floor(F.abs(value) * scale).cast("int"), F.lit(0)))


def signed(value: Column, digits: int = 3) -> Column:
    return F.format_string(f"%+.{digits}f", value)


def interval(low: Column, high: Column, digits: int = 3) -> Column:
    return F.format_string(f"[%+.{digits}f, %+.{digits}f]", low, high)


def prompt(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by that value (null: empty). Braces inside a value stay as they are."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def json_line(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def unfence_first(text: Column) -> Column:
    """A fenced reply without its first line and its trailing fence."""
    t = strip(F.coalesce(text, F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(t, r"(?s)^```[^\n]*\n?", ""), r"(?s)```\s*$", "")
    return strip(F.when(F.startswith(t, F.lit("```")), inner).otherwise(t))


def unfence_all(text: Column) -> Column:
    """A fenced reply without any line that begins with a fence."""
    t = strip(F.coalesce(text, F.lit("")))
    return strip(F.when(F.startswith(t, F.lit("```")), F.regexp_replace(t, r"(?m)^[ \t]*```.*$", "")).otherwise(t))


def sentiment_reply(text: Column) -> Column:
    """struct(score, label, ok) of a model's JSON reply. A score that is no number makes the reply invalid; a missing
    label is derived from the score."""
    body = unfence_first(text)
    raw = F.get_json_object(body, "$.score")
    quoted = F.regexp_like(body, F.lit(r'"score"\s*:\s*"'))
    score = F.when(~quoted, raw.try_cast("double"))
    label = F.get_json_object(body, "$.label")
    derived = F.when(score > 0.05, "positive").when(score < -0.05, "negative").otherwise("neutral")
    return F.struct(score.alias("score"), F.when(score.isNotNull(), F.coalesce(label, derived)).alias("label"), score.isNotNull().alias("ok"))


def stance_reply(text: Column) -> Column:
    """struct(stance, confidence, reason, ok) of a stance reply; bad JSON gives stance error with confidence 0."""
    body = unfence_all(text)
    parsed = F.from_json(body, "stance string, confidence double, reason string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    ok = parsed["_bad"].isNull() & parsed.isNotNull() & F.startswith(body, F.lit("{"))
    return F.struct(
        F.when(ok, parsed["stance"]).otherwise(F.lit("error")).alias("stance"),
        F.when(ok, parsed["confidence"]).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(ok, parsed["reason"]).otherwise(head(F.lit("not JSON"), 80)).alias("reason"),
        ok.alias("ok"),
    )
