"""How the sources of a language differ: smoothed term shares, compared exactly.

Terms are maximal runs of letters A-Z, a-z and characters from U+0080, only A-Z
lower-cased.  A language keeps the V terms that at least ``MIN_DOCS`` of its
documents have.  A group is a (language, source) that occurs, with or without
terms; a count c of N kept terms in a group (or in the whole language) becomes
``p = 1 + floor(SCALE * (c + 5) / (N + 5 V))``.

* Part ``pair``: for a group every other source of the language, with the sum of
  ``abs(p - q)`` over the kept terms.
* Part ``term``: for a group its terms with ``p`` above the language's ``q``, the
  ``TOP`` of highest ``p - q``.

**Counts.**  Each batch of texts is cut into terms and counted inside the task (terms
are compared as strings, by Arrow's dictionary), so only counts are shuffled.

**Terms: a dominance skyband.**  ``p - q`` does not fall when the group count rises or
the language count falls, so a term with ``TOP`` others of no lower group count, no
higher language count and earlier UTF-8 bytes cannot be among the first ``TOP``.
Every partition of a group's terms (``PART_TERMS`` of them on average) keeps the terms with fewer than
``TOP`` such others; the bands are merged ``MERGE`` by ``MERGE`` until a group has one, and
only its terms are ranked, by the exact values.

**Pairs: tiles.**  Sources are numbered in their language and dealt in blocks of ``SOURCES``;
a task holds two blocks and one part of the terms as dense rows, and gives the pairs' sums over
the terms that stand in either block.  All other terms of the language have the smoothed zero count on both
sides, so they are added by number.  No (term, source, source) rows are made.

Null text, language and source count as empty strings; every row is a document, repeated
rows too.  A language without kept terms has pairs of value 0 and no ``term`` rows; a
language with one source has no pairs.  An empty table gives no rows.  Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .textkit import LOWER, chunks, map_batches

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Terms of a group in one partition, and bands that are merged at a time.
PART_TERMS, MERGE = 4096, 8
#: Sources in a block of a tile, and terms of a language in one part of it.
SOURCES, TILE_TERMS = 64, 8192
#: Bytes of text that are counted together.
COUNT_BYTES = 8 << 20

#: Bytes of terms: A-Z, a-z and all bytes of characters from U+0080.
_TERM = np.zeros(256, dtype=bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True

_COUNTS = "lang string, source string, term string, n long, docs long"


def _batch_counts(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Term counts and document counts by (lang, source), a chunk at a time."""
    groups = pd.MultiIndex.from_arrays([langs.to_pandas(), sources.to_pandas()])
    group_of, names = groups.factorize()
    for chunk in chunks(texts, COUNT_BYTES):
        data = LOWER[chunk.data]
        inner = _TERM[data]
        text_start = np.zeros(len(data) + 1, dtype=bool)
        text_start[chunk.offsets] = True
        before = np.empty(len(data), dtype=bool)
        before[:1] = False
        before[1:] = inner[:-1]
        starts = np.flatnonzero(inner & ~(before & ~text_start[:-1]))
        if not len(starts):
            continue
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inner[1:]
        ends = np.flatnonzero(inner & ~(after & ~text_start[1:])) + 1
        # one string array over the bytes as they stand: terms at even, the gaps between them at odd places
        edges = np.empty(2 * len(starts), dtype=np.int64)
        edges[0::2], edges[1::2] = starts, ends
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        code = coded.indices.to_numpy()[0::2].astype(np.int64)
        width = len(coded.dictionary)
        doc = np.searchsorted(chunk.offsets, starts, side="right") - 1
        group = group_of[chunk.first + doc].astype(np.int64)
        key, n = np.unique(group * width + code, return_counts=True)
        # each (document, term) once
        once = np.unique(doc * width + code)
        with_doc = group_of[chunk.first + once // width].astype(np.int64) * width + once % width
        docs = np.bincount(np.searchsorted(key, with_doc), minlength=len(key))
        named = names[key // width]
        yield pa.RecordBatch.from_arrays(
            [pa.array(named.get_level_values(0), pa.string()), pa.array(named.get_level_values(1), pa.string()),
             coded.dictionary.take(pa.array(key % width)).cast(pa.large_string()).cast(pa.string()),
             pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= COUNT_BYTES:
            yield from _of_tables(held)
            held, size = [], 0
    if held:
        yield from _of_tables(held)


def _of_tables(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(held)
    yield from _batch_counts(*[pa.concat_arrays(t.column(c).cast(pa.large_string()).chunks) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of a group."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return (map_batches(rows, _count, _COUNTS).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _share(n: str, total: str, v: str):
    """``1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH v))``, in whole decimals, so counts may have any size."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + {SMOOTH} AS DECIMAL(20,0)))"
                  f" div CAST({total} + {SMOOTH} * {v} AS DECIMAL(20,0))")


def skyband(n: np.ndarray, lang_n: np.ndarray, terms: list[str], k: int) -> np.ndarray:
    """Which points fewer than ``k`` others dominate: ``n`` no lower, ``lang_n`` no higher, the term earlier in UTF-8.

    A dominator stands before its point in the order (n falling, lang_n rising, term rising), and a
    point with ``k`` dominators has ``k`` among those that are kept, so each is held against the kept ones only.
    """
    place = np.empty(len(terms), dtype=np.int64)
    place[sorted(range(len(terms)), key=lambda i: terms[i].encode())] = np.arange(len(terms))
    keep = np.zeros(len(terms), dtype=bool)
    kept_l, kept_u, m = np.empty(len(terms), dtype=np.int64), np.empty(len(terms), dtype=np.int64), 0
    for i in np.lexsort((place, lang_n, -n)):
        if m < k or np.count_nonzero((kept_l[:m] <= lang_n[i]) & (kept_u[:m] < place[i])) < k:
            keep[i] = True
            kept_l[m], kept_u[m] = lang_n[i], place[i]
            m += 1
    return keep


def top_terms(kept: DataFrame, parts: int, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) from ``kept(lang, source, term, n, lang_n, p, q)``."""
    def band(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[skyband(rows["n"].to_numpy(), rows["lang_n"].to_numpy(), list(rows["term"]), top)]

    bands = kept.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    while True:
        bands = bands.groupBy("lang", "source", "part").applyInPandas(band, bands.schema)
        if parts == 1:
            break
        parts = -(-parts // MERGE)
        bands = bands.withColumn("part", F.col("part") % parts)
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (bands.where(F.col("p") > F.col("q"))
            .select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top))


def _tile(key: tuple, rows: pd.DataFrame, sources: int) -> pd.DataFrame:
    """Sums over one part of the terms for the pairs of two blocks of ``sources`` sources."""
    lang, low, high, _ = key
    zero = rows[rows["term"].isna()].drop_duplicates("at").sort_values("at")
    told = rows[rows["term"].notna()]
    at, base = zero["at"].to_numpy(), zero["p"].to_numpy()
    code, terms = pd.factorize(told["term"])
    dense = np.repeat(base[:, None], len(terms), axis=1)
    dense[np.searchsorted(at, told["at"].to_numpy()), code] = told["p"].to_numpy()
    block = at // sources
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    out = []
    for i in left:
        others = right[at[right] > at[i]]
        out.append(pd.DataFrame({"lang": lang, "a": at[i], "b": at[others], "present": len(terms),
                                 "part_sum": np.abs(dense[others] - dense[i]).sum(axis=1)}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "present": [], "part_sum": []})


def source_pairs(kept: DataFrame, groups: DataFrame, parts: int) -> DataFrame:
    """(lang, source, item, value, rank) from ``kept`` and ``groups(lang, source, at, blocks, v, base)``."""
    sources = SOURCES

    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _tile(key, rows, sources)

    block = F.floor(F.col("at") / sources)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    told = (kept.join(groups.select("lang", "source", "at", "blocks"), ["lang", "source"])
            .select("lang", "at", "p", "term", F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part"), other))
    zero = (groups.select("lang", "at", F.col("base").alias("p"), F.lit(None).cast("string").alias("term"), "blocks",
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
            .select("lang", "at", "p", "term", "part", other))
    tiles = told.unionByName(zero).select(
        "lang", F.least("other", block).alias("low"), F.greatest("other", block).alias("high"), "part", "at", "p", "term")
    sums = (tiles.groupBy("lang", "low", "high", "part")
            .applyInPandas(tile, "lang string, a long, b long, present long, part_sum long")
            .groupBy("lang", "a", "b").agg(F.sum("present").alias("present"), F.sum("part_sum").alias("part_sum")))
    one, two = ([F.col(c).alias(f"{c}_{x}") for c in ("lang", "source", "at", "base", "v")] for x in "ab")
    named = (sums.join(groups.select(*one), (F.col("lang") == F.col("lang_a")) & (F.col("a") == F.col("at_a")))
             .join(groups.select(*two), (F.col("lang") == F.col("lang_b")) & (F.col("b") == F.col("at_b"))))
    value = F.col("part_sum") + (F.col("v_a") - F.col("present")) * F.abs(F.col("base_a") - F.col("base_b"))
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
                             F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (named.select("lang", both.alias("pair"), value.alias("value"))
            .select("lang", "pair.source", "pair.item", "value").withColumn("rank", F.row_number().over(first)))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    counts = write_table(term_counts(docs), "divergence-counts")
    vocabulary = (counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                  .where(F.col("docs") >= min_docs).drop("docs"))
    kept = write_table(counts.join(vocabulary, ["lang", "term"]), "divergence-kept")
    languages = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = (docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
              .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
              .join(languages, "lang", "left").fillna(0, ["total", "v", "lang_total"]))
    of_lang = Window.partitionBy("lang")
    groups = write_table(
        groups.withColumn("at", F.row_number().over(of_lang.orderBy("source")).cast("long") - 1)
        .withColumn("blocks", F.floor((F.count("*").over(of_lang) - 1) / SOURCES) + 1)
        .withColumn("base", F.when(F.col("v") > 0, _share("0", "total", "v")).otherwise(F.lit(0).cast("long"))), "divergence-groups")
    most = groups.agg(F.max("v")).first()[0] or 1
    shares = (kept.join(groups.select("lang", "source", "total", "lang_total", "v"), ["lang", "source"])
              .select("lang", "source", "term", "n", "lang_n", _share("n", "total", "v").alias("p"),
                      _share("lang_n", "lang_total", "v").alias("q")))
    pairs = source_pairs(shares, groups, -(-most // TILE_TERMS))
    terms = top_terms(shares, -(-most // PART_TERMS), top)
    return (pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
            .select("lang", "source", "part", "item", "value", "rank"))


#: The same in DuckDB, over every (group, kept term).
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT x.lang, source, term, n, 1 + ({SCALE}::HUGEINT * (n + {SMOOTH})) // (x.total + {SMOOTH} * v.v) AS p,
    1 + ({SCALE}::HUGEINT * (lang_n + {SMOOTH})) // (v.total + {SMOOTH} * v.v) AS q
  FROM grid x JOIN v ON x.lang = v.lang),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((
    SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
term AS (
  SELECT lang, source, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank
  FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, rank::INTEGER FROM term WHERE rank <= {TOP}
"""
