"""Small tables and plain versions that the operators are held against."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows, /, **extra):
    """documents from (doc_id, text) or (doc_id, text, source); ``extra`` adds constant columns."""
    from pyspark.sql import functions as F
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def words(text):
    return WORDS.findall(text or "")


def odd_rows():
    """Nulls, empty and blank texts, repeated rows, equal ids, ties, one very long text."""
    long = " ".join(f"word{i % 997} says, again." for i in range(40_000)) + "\n" + "x" * 5000
    return [(1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, "é"),
            (7, "one two three four five six"), (7, "one two three four five six"), (7, "quite another text"),
            (None, "a text without an id"), (None, None), (8, "tail\n\ntail\n"), (9, "one two three four five six", None)]
