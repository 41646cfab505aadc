"""The corpus pipeline: from documents to the digests of their token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; the driver (or
:func:`run`) writes it as Parquet and reads it as the next stage's ``docs``.
All stages but the last return the columns of ``documents``.

1. ``quality``: documents that the quality classifier rejects go.
2. ``line_dedup``: the boilerplate lines of a source are cut from its texts.
3. ``near_duplicates``: one document of each group of near copies stays
   (sets of 5-word shingles, Jaccard similarity 0.8 or more).
4. ``mix``: sources meet their target weights; a document can come up to
   three times.
5. ``encode``: byte-level BPE, encoded and decoded; digests per document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm import bpe, linededup, mixing, ngramjoin, quality
from adlens.session import write_table


def _counted(docs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``n_chars``, where the table has it, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects.  It is fitted on
    labelled documents of the table itself, without the held-out fold."""
    model = quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the boilerplate lines of each source; no document goes."""
    return _counted(linededup.drop_lines(docs, by_length=True, copies_once=True), dict(docs.dtypes))


def keep_firsts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngramjoin.keep_one(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their targets, in whole documents."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", cut_lines),
    ("near_duplicates", keep_firsts),
    ("mix", mix),
    ("encode", encode),
]

#: Neither a trained classifier nor BPE can be put in SQL; tests/llm has the
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
