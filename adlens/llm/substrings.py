"""Passages that stand in an earlier document, removed: fixed-block anchors.

A window is ``WINDOW`` consecutive words of one document.  A word goes if a window
that covers it also starts in a document of smaller id; all windows are judged on
the input.

**Method.**  The words of every document are cut into non-overlapping reference blocks of
``BLOCK = WINDOW // 2`` words.  Wherever a window of an earlier document returns, the first block
that begins in it lies wholly inside it, so the block's hash meets a rolling hash of the
later document.

1. *Index and probe.*  Blocks (hash, smallest id) and the rolling hashes of every
   document go to the part of their hash.  A part's task loads its index, then reads the probes as a stream and
   answers each document with one bit per probe: does a smaller id have the block.  Then the
   blocks pass once more and learn whether a larger id probed them.
2. *Extend.*  Only around hits, the later document's windows that contain the hit, and the reference's windows
   that begin at most ``BLOCK - 1`` words before the block, are compared by hash in the same
   way: smallest id of every window, then the probes.  The union of the windows found is the document's
   maximal repeats of ``WINDOW`` words or more.
3. *Cut.*  Spans are joined to their texts and the covered words go.

No pairs of documents are made: a passage shared by m documents costs m entries.  A task holds
the distinct block hashes of its part, whose number of parts follows the bytes of text; probes stream by.
Words, blocks and windows are told apart by 64-bit hashes (windows by the hash that deals out the
parts as well).  Texts travel only where a document has hits; the list of their keys is broadcast if its bytes, measured, are few, else joined.

Null text has no words and stays null.  Rows without an id come after all ids: they
lose what any document with an id has, and nothing is removed for their sake.  Documents of equal id
do not remove each other's words.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checked_broadcast, write_table
from .textkit import SegmentHasher, chunks, map_batches, mix, ragged

WINDOW = 50
#: Bytes of text for each part of the index (64 MB: 400,000 blocks), and the least and most parts.
PART_BYTES, LEAST_PARTS, MOST_PARTS = 64 << 20, 32, 1 << 14
#: Bytes of text that are hashed together.
HASH_BYTES = 2 << 20

_U = np.uint64
_NO_ID = np.iinfo(np.int64).max
#: Odd factors of the two rolling hashes (v2(b*b - 1) = 3, so few powers lie close).
_FACTORS = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)

_ROUTED = "part int, kind int, keys binary, ids binary, counts binary, hashes binary"
_BITS = "key long, part int, kind int, bits binary"
_SPANS = "key long, spans binary"


def _powers(n: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _U(factor)), np.full(n, _U(pow(factor, -1, 1 << 64)))
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


class Rolling:
    """Hashes of all windows of a sequence of word hashes."""

    def __init__(self, words: np.ndarray, factor: int):
        up, self.down = _powers(len(words) + 1, factor)
        self.total = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[:-1], out=self.total[1:])

    def __call__(self, starts: np.ndarray, width: int) -> np.ndarray:
        return mix((self.total[starts + width] - self.total[starts]) * self.down[starts])


class Words:
    """Word hashes of a chunk's texts, and the windows of ``width`` words of texts with ``least`` words."""

    def __init__(self, chunk, width: int, least: int):
        starts, ends, text = chunk.words()
        self.hashes = SegmentHasher(chunk.data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.n = np.bincount(text, minlength=chunk.n)
        self.first = np.cumsum(self.n) - self.n
        count = np.where(self.n >= least, self.n - width + 1, 0)
        self.starts = ragged(self.first, count)
        self.text = np.repeat(np.arange(chunk.n), count)

    def anchors(self, width: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by part of the windows, their part boundaries and their hashes (in that order)."""
        h = Rolling(self.hashes, _FACTORS[0])(self.starts, width)
        part = ((h >> _U(32)) % _U(parts)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(parts + 1)), (h & _U(0xFFFFFFFF)).astype(np.uint32)[order]


def _row(part: int, kind: int, keys, ids, counts, hashes) -> tuple:
    return part, kind, keys.tobytes(), ids.tobytes(), counts.tobytes(), hashes.tobytes()


def _least(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with their smallest id."""
    order = np.lexsort((ids, hashes))
    h, i = hashes[order], ids[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    return h[new], i[new]


def _by_text(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal numbers: the numbers and the lengths."""
    at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    return text[at], np.diff(np.append(at, len(text))).astype(np.uint32)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_ROUTED_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("keys", "ids", "counts", "hashes"))])


def _probes(batches: Iterator[pa.RecordBatch], parts: int, window: int) -> Iterator[pa.RecordBatch]:
    """Index (kind 0), probes (1) and blocks (2) of every chunk, by part of the hash."""
    block = window // 2
    for batch in batches:
        ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
        for chunk in chunks(batch.column("text"), HASH_BYTES):
            w = Words(chunk, block, window)
            order, bounds, hashes = w.anchors(block, parts)
            text = w.text[order]
            fixed = (w.starts[order] - w.first[text]) % block == 0
            rows = []
            for part in np.flatnonzero(np.diff(bounds)):
                at = slice(bounds[part], bounds[part + 1])
                t, f, h = text[at] + chunk.first, fixed[at], hashes[at]
                least, low = _least(h[f], ids[t[f]])
                none = np.zeros(0, np.uint32)
                if len(least):
                    rows.append(_row(part, 0, none, low, none, least))
                for kind, which in ((1, slice(None)), (2, f)):
                    docs, counts = _by_text(t[which])
                    if len(docs):
                        rows.append(_row(part, kind, keys[docs], ids[docs], counts, h[which]))
            if rows:
                yield _batch(rows, _ROUTED_ARROW)


class _Index:
    """Distinct hashes of a part with their smallest id, and the largest id that probed them."""

    def __init__(self, hashes: list[np.ndarray], ids: list[np.ndarray], dtype):
        self.hashes, self.ids = _least(np.concatenate(hashes or [np.zeros(0, dtype)]), np.concatenate(ids or [np.zeros(0, np.int64)]))
        self.probed = np.full(len(self.hashes), np.iinfo(np.int64).min)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def probe(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at, same = self.find(hashes)
        np.maximum.at(self.probed, at[same], ids[same])
        return same & (self.ids[at] < ids) if len(self.ids) else same

    def probed_by_larger(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at, same = self.find(hashes)
        return same & (self.probed[at] > ids) if len(self.ids) else same


_BITS_ARROW = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("bits", pa.binary())])


def _answers(batches: Iterator[pa.RecordBatch], dtype) -> Iterator[pa.RecordBatch]:
    """For sorted rows of (part, kind): the index, then an answer of bits to every document of the others."""
    now, index, hashes, low = None, None, [], []
    for batch in batches:
        part, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
        blobs = {c: batch.column(c) for c in ("keys", "ids", "counts", "hashes")}
        for i in range(batch.num_rows):
            if part[i] != now:
                now, index, hashes, low = part[i], None, [], []
            h = np.frombuffer(blobs["hashes"][i].as_buffer(), dtype)
            ids = np.frombuffer(blobs["ids"][i].as_buffer(), np.int64)
            if kind[i] == 0:
                hashes.append(h)
                low.append(ids)
                continue
            if index is None:
                index, hashes, low = _Index(hashes, low, dtype), [], []
            counts = np.frombuffer(blobs["counts"][i].as_buffer(), np.uint32).astype(np.int64)
            hit = (index.probe if kind[i] == 1 else index.probed_by_larger)(h, np.repeat(ids, counts))
            if not hit.any():
                continue
            # every document's bits begin at a byte
            room = -(-counts // 8) * 8
            bits = np.zeros(room.sum(), dtype=bool)
            bits[ragged(np.cumsum(room) - room, counts)] = hit
            ends = np.cumsum(room) // 8
            doc = np.repeat(np.arange(len(counts)), counts)
            some = np.flatnonzero(np.bincount(doc[hit], minlength=len(counts)))
            keys = np.frombuffer(blobs["keys"][i].as_buffer(), np.int64)[some]
            packed = np.packbits(bits).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(np.full(len(some), part[i], np.int32)), pa.array(np.full(len(some), kind[i], np.int32)),
                 pa.array([packed[ends[d] - room[d] // 8:ends[d]] for d in some], pa.binary())], schema=_BITS_ARROW)


def _near(hits: np.ndarray, before: int, n: int) -> np.ndarray:
    """Which of ``n`` starts lie at a hit or at most ``before`` places before one."""
    edge = np.zeros(max(n, hits.max(initial=0) + 2), dtype=np.int64)
    np.add.at(edge, np.maximum(hits - before, 0), 1)
    np.add.at(edge, hits + 1, -1)
    return np.cumsum(edge)[:n] > 0


def _candidates(w: Words, i: int, hits, parts: int, window: int, order, bounds, text) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the probing and of the reference windows of text ``i``, from its answers."""
    block = window // 2
    found = {1: [], 2: []}
    for hit in hits:
        part, kind = hit["part"].as_py(), hit["kind"].as_py()
        lo, hi = bounds[part] + np.searchsorted(text[bounds[part]:bounds[part + 1]], [i, i + 1])
        at = w.starts[order[lo:hi]] - w.first[i]
        if kind == 2:
            at = at[at % block == 0]
        bits = np.unpackbits(np.frombuffer(hit["bits"].as_buffer(), np.uint8), count=len(at))
        found[kind].append(at[bits.astype(bool)])
    n = w.n[i] - window + 1
    return tuple(np.flatnonzero(_near(np.concatenate(found[k] or [np.zeros(0, np.int64)]), block - 1, n)) for k in (1, 2))


def _windows(batches: Iterator[pa.RecordBatch], parts: int, window: int) -> Iterator[pa.RecordBatch]:
    """Windows around the hits: smallest ids of the references (kind 0) and the probes (1)."""
    for batch in batches:
        ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
        told = batch.column("hits")
        for chunk in chunks(batch.column("text"), HASH_BYTES):
            w = Words(chunk, window // 2, window)
            order, bounds, _ = w.anchors(window // 2, parts)
            text = w.text[order]
            probes, refs = [], []
            for i in range(chunk.n):
                p, r = _candidates(w, i, told[chunk.first + i], parts, window, order, bounds, text)
                probes.append(p + w.first[i])
                refs.append(r + w.first[i])
            one, two = (Rolling(w.hashes, f) for f in _FACTORS)
            sides = []
            for side in (refs, probes):
                at = np.concatenate(side)
                doc = np.repeat(np.arange(chunk.n), [len(x) for x in side]) + chunk.first
                part = (two(at, window) % _U(parts)).astype(np.uint16)
                o = np.argsort(part, kind="stable")
                sides.append((doc[o], one(at, window)[o], np.searchsorted(part[o], np.arange(parts + 1))))
            (rdoc, rhash, rb), (pdoc, phash, pb) = sides
            rows, none = [], np.zeros(0, np.uint32)
            for part in range(parts):
                if rb[part + 1] > rb[part]:
                    h, low = _least(rhash[rb[part]:rb[part + 1]], ids[rdoc[rb[part]:rb[part + 1]]])
                    rows.append(_row(part, 0, none, low, none, h))
                if pb[part + 1] > pb[part]:
                    docs, counts = _by_text(pdoc[pb[part]:pb[part + 1]])
                    rows.append(_row(part, 1, keys[docs], ids[docs], counts, phash[pb[part]:pb[part + 1]]))
            if rows:
                yield _batch(rows, _ROUTED_ARROW)


def _spans(batches: Iterator[pa.RecordBatch], parts: int, window: int) -> Iterator[pa.RecordBatch]:
    """The maximal repeats of every text, as word numbers (start, end), from the answers to its windows."""
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        told, answers = batch.column("hits"), batch.column("answers")
        out = []
        for chunk in chunks(batch.column("text"), HASH_BYTES):
            w = Words(chunk, window // 2, window)
            order, bounds, _ = w.anchors(window // 2, parts)
            text = w.text[order]
            two = Rolling(w.hashes, _FACTORS[1])
            for i in range(chunk.n):
                at, _ = _candidates(w, i, told[chunk.first + i], parts, window, order, bounds, text)
                part = two(at + w.first[i], window) % _U(parts)
                covered = np.zeros(w.n[i] + 1, dtype=np.int64)
                for answer in answers[chunk.first + i]:
                    mine = at[part == answer["part"].as_py()]
                    bits = np.unpackbits(np.frombuffer(answer["bits"].as_buffer(), np.uint8), count=len(mine))
                    s = mine[bits.astype(bool)]
                    covered[s] += 1
                    covered[s + window] -= 1
                gone = np.cumsum(covered) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]))).astype(np.int64)
                out.append((int(keys[chunk.first + i]), edges.tobytes()))
        if out:
            yield _batch(out, pa.schema([("key", pa.int64()), ("spans", pa.binary())]))


def _routed(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")


def _answered(rows: DataFrame, parts: int, dtype) -> DataFrame:
    """One row for each key that has hits, with its answers."""
    return (map_batches(_routed(rows, parts), partial(_answers, dtype=dtype), _BITS)
            .groupBy("key").agg(F.collect_list(F.struct("part", "kind", "bits")).alias("hits")))


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): rows of one key are equal in id and text."""
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
                     F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, spans): the words of a row that stand in a document of smaller id; rows without any are left out."""
    docs = _hashed(df, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(-(-size // PART_BYTES), LEAST_PARTS), MOST_PARTS)
    hits = write_table(_answered(map_batches(docs, partial(_probes, parts=parts, window=window), _ROUTED), parts, np.uint32), "substring-hits")
    near = docs.join(checked_broadcast(hits.select("key"), name="substring-keys"), "key", "left_semi").dropDuplicates(["key"])
    texts = write_table(near.join(hits, "key"), "substring-texts")
    answers = _answered(map_batches(texts, partial(_windows, parts=parts, window=window), _ROUTED), parts, np.uint64)
    return map_batches(texts.join(answers.withColumnRenamed("hits", "answers"), "key"), partial(_spans, parts=parts, window=window), _SPANS)


def _cut(batches: Iterator[pa.RecordBatch], text_col: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n_words, n_removed = [], [], []
        for text, spans in zip(batch.column(text_col).cast(pa.large_binary()).to_pylist(), batch.column("_spans").to_pylist()):
            words = text.split() if text else []  # bytes split at 0x20 and 0x09-0x0D
            n_words.append(len(words))
            if spans:
                keep, last = [], 0
                for start, end in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
                    keep += words[last:start]
                    last = end
                words = keep + words[last:]
            n_removed.append(n_words[-1] - len(words))
            texts.append(None if text is None else b" ".join(words))
        new = {text_col: pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
               "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with its texts as the words that stay, joined by a space, and ``n_words``, ``n_removed``
    (in place of columns of these names)."""
    spans = checked_broadcast(repeats(df, id_col, text_col, window), name="substring-spans").select(
        F.col("key").alias("_key"), F.col("spans").alias("_spans"))
    kept = [c for c in df.columns if c not in ("n_words", "n_removed")]
    rows = df.select(*kept, F.xxhash64(id_col, text_col).alias("_hash"))
    rows = rows.join(spans, F.col("_hash") == F.col("_key"), "left").drop("_hash", "_key")
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return map_batches(rows, partial(_cut, text_col=text_col, names=schema.names), schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of ``documents``."""
    return drop_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The same in DuckDB, window by window.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id, coalesce(doc_id, {_NO_ID}) AS id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
w AS (
  SELECT doc, id, s, array_to_string(words[s:s + {WINDOW - 1}], ' ') AS seq
  FROM (SELECT doc, id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS s FROM d WHERE len(words) >= {WINDOW})),
least AS (SELECT seq, min(id) AS id FROM w GROUP BY seq),
gone AS (SELECT DISTINCT w.doc, unnest(range(w.s, w.s + {WINDOW})) AS place FROM w JOIN least l ON w.seq = l.seq AND l.id < w.id),
lost AS (SELECT doc, list(place) AS places FROM gone GROUP BY doc),
cut AS (
  SELECT d.doc_id, len(d.words) AS n_words, CASE WHEN l.places IS NULL THEN d.words
    ELSE list_filter(d.words, lambda x, i: NOT list_contains(l.places, i)) END AS kept FROM d LEFT JOIN lost l ON d.doc = l.doc)
SELECT doc_id, n_words, n_words - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM cut
"""
