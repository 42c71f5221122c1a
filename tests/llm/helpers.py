from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, langs=None, ids=None):
    """documents from texts; further columns, some with names that operators use themselves."""
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, langs[n] if langs else "en", sources[n] if sources else "s", len(t) if t is not None else None) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("size", "rate", "fp", "key", "kept", "copies", "words", "target", "bucket", "spans", "ids", "stratum", "log_weight", "component_id", "cell")})
