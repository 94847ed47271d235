"""Small document tables with the odd cases: nulls, empty texts, ties, repeats, clashing column names, a very long text."""

from __future__ import annotations

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, lang="en", parts=3):
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def clash(df):
    """Extra columns with names that operators might use themselves."""
    for name in ("part", "body", "bucket", "part_id", "n_words", "kept", "h", "key", "value", "component_id"):
        df = df.withColumn(name, F.lit("x"))
    return df


ODD = [None, "", " ", "\n\n", "word", "word", "a b c\n\na b c\n", "Ünïcode é x  y\t\tz", "x" * 50_000, "the cat sat on the mat " * 2_000, "\x00\x01 odd   signs 𝔘"]
