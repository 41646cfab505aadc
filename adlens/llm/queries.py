"""Registered queries of the training-data operators.

Each ``opN_<name>(spark, sf_dir)`` applies one operator, with production
parameters, to its whole table.  ``ORACLES`` has the SQL where SQL can express
the operator; the others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bpe, divergence, fingerprints, linededup, merkle, mixing, ngramjoin, pii, quality, substrings,
               tokenfiles, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_byte_bpe(spark, sf_dir):
    """Byte-level BPE of every document, encoded and decoded again."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def held_out(holdout: int, remainder: int):
    return (F.crc32(F.col("doc_id").cast("string")) % holdout == remainder).alias("held_out")


@query
def op1_quality(spark, sf_dir):
    """Quality score of every document; fitted without the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out(5, 0), "score", "predicted")


@query
def op9_toxicity(spark, sf_dir):
    """Toxicity score of every document; fitted without the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, grammar).select("doc_id", held_out(4, 2), "score", "predicted",
                                                *toxicity.CLASSES)


@query
def op6_mixing(spark, sf_dir):
    """Words that the mix takes of every document."""
    return mixing.plan(table(spark, sf_dir, "documents"))


ORACLES["op6_mixing"] = mixing.SQL


@query
def op10_line_dedup(spark, sf_dir):
    """Every document without the boilerplate lines of its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_lines(docs, report=True, by_length=True, copies_once=True)


ORACLES["op10_line_dedup"] = linededup.SQL


@query
def op4_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, with likenesses."""
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


#: Key of the registered query; production passes a secret of its own.
PII_KEY = b"key of the registered query"


@query
def op3_pii(spark, sf_dir):
    """Every document with its personal data under pseudonyms, counted by kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, counts=True)


@query
def op8_nearest(spark, sf_dir):
    """The 5 nearest vectors found of every 50th vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op2_ngram_join(spark, sf_dir):
    """Components of the documents whose 4-word shingle sets have Jaccard 0.85 or more."""
    return ngramjoin.near_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


@query
def op7_token_files(spark, sf_dir):
    """Token ids of every document, written to range-coded files and read back."""
    files = tokenfiles.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.summary(files)


@query
def op11_merkle_manifest(spark, sf_dir):
    """Merkle proofs of every document, folded again after some texts were tampered with."""
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


ORACLES["op11_merkle_manifest"] = merkle.SQL


@query
def op12_source_divergence(spark, sf_dir):
    """Distances of the sources of a language, and the terms that mark each of them."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = divergence.SQL


@query
def op13_substring_dedup(spark, sf_dir):
    """Every document without the passages of 50 words or more that an earlier one has."""
    return substrings.digests(table(spark, sf_dir, "documents"))


ORACLES["op13_substring_dedup"] = substrings.SQL
