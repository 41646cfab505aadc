"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line) is hashed to a wide vector, and a document's fingerprint
is the sum of its paragraphs' vectors, lane by lane: in ``STRONG`` lanes modulo
2**64, of which every bit depends on the whole paragraph, and in ``SOFT`` lanes
modulo 2**16, where a paragraph is itself the sum of +1/-1 vectors of its pieces
(about ``PIECE`` words each and twice as many at most, cut where a word's hash
  says so).  So

* the order of paragraphs does not matter, and equal texts are always equal;
* paragraphs can be inserted and deleted by adding and subtracting vectors
  (:func:`insert`, :func:`delete`) without seeing the rest of the document;
* the distance of two soft parts counts the pieces in which two documents
  differ, which gives a likeness from 0 to 1 (1 for equal fingerprints).

Null texts count as empty, and an empty text is one empty paragraph; repeated
rows get equal fingerprints; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import in_order
from .textkit import Chunk, SegmentHasher, chunks, map_batches, mix

STRONG, SOFT, PIECE = 8, 256, 8
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _by_text(values: np.ndarray, at: np.ndarray, dtype) -> np.ndarray:
    """Sums of runs of rows: rows ``at[i] .. at[i + 1] - 1`` for each i."""
    out = np.zeros((len(at) - 1, values.shape[1]), dtype=dtype)
    some = np.flatnonzero(np.diff(at) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, at[some], axis=0, dtype=dtype)
    return out


def fingerprints(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(strong, soft): one row of uint64 and one of int16 lanes per text."""
    data = chunk.data
    hasher = SegmentHasher(data)
    # paragraphs: cut behind every newline and at every text's end
    newline = np.flatnonzero(data == 10)
    per_text = np.searchsorted(newline, chunk.offsets)
    starts = np.sort(np.concatenate([chunk.offsets[:-1], newline + 1]), kind="stable")
    # a newline's next paragraph belongs to the newline's text
    owner = np.concatenate([np.arange(chunk.n), np.searchsorted(chunk.offsets, newline, side="right") - 1])
    key = np.concatenate([chunk.offsets[:-1], newline + 1])
    order = np.lexsort((key, owner))
    starts, owner = key[order], owner[order]
    at = np.arange(chunk.n + 1) + per_text
    ends = np.append(starts[1:] - 1, 0)
    ends[at[1:] - 1] = chunk.offsets[1:]
    h = hasher(starts, ends)
    # a second hash with other byte codes makes 128 bits of every paragraph
    g = mix(SegmentHasher(data ^ np.uint8(0x5A))(starts, ends) + _STEP)
    lanes = np.arange(1, STRONG + 1, dtype=np.uint64)
    strong = _by_text(mix(h[:, None] + lanes * _STEP) ^ mix(g[:, None] ^ (lanes << _U(32))), at, np.uint64)

    # pieces: runs of words, ended by one word in PIECE or by the paragraph
    w_start, w_end, w_text = chunk.words()
    if len(w_start) == 0:
        return strong, np.zeros((chunk.n, SOFT), dtype=np.int16)
    words = hasher(w_start, w_end)
    para = np.searchsorted(newline, w_start) + w_text  # strictly rises with every paragraph
    last = np.ones(len(words), dtype=bool)
    last[:-1] = (para[1:] != para[:-1]) | (words[:-1] % _U(PIECE) == 0)
    begin = np.append(0, np.flatnonzero(last)[:-1] + 1)
    along = np.arange(len(words)) - np.repeat(begin, np.diff(np.append(begin, len(words))))
    last |= along % (2 * PIECE) == 2 * PIECE - 1
    piece_end = np.flatnonzero(last)
    piece_start = np.append(0, piece_end[:-1] + 1)
    soft = np.empty((chunk.n, SOFT), dtype=np.int16)
    p = hasher(w_start[piece_start], w_end[piece_end])
    bits = mix(p[:, None] + np.arange(11, 11 + SOFT // 64, dtype=np.uint64) * _STEP)
    ones = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1)
    cut = np.searchsorted(w_text[piece_start], np.arange(chunk.n + 1))
    total = _by_text(ones, cut, np.int32)
    soft[:] = (2 * total - np.diff(cut)[:, None]).astype(np.int16)
    return strong, soft


def insert(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of the paragraphs of both."""
    return a[0] + b[0], a[1] + b[1]


def delete(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of ``a`` without the paragraphs of ``b``."""
    return a[0] - b[0], a[1] - b[1]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each pair of rows: the part of the pieces that agree."""
    x, y = a[1].astype(np.int64), b[1].astype(np.int64)
    apart = ((a[1] - b[1]).astype(np.int64) ** 2).sum(axis=1)
    whole = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    near = np.clip(1 - apart / np.maximum(whole, 1), 0, 1)
    same = (a[0] == b[0]).all(axis=1)
    near[whole == 0] = 0.0
    near[same] = 1.0
    return near


def render(f: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The fingerprints as base64 strings (little-endian lanes)."""
    strong, soft = f[0].astype("<u8"), f[1].astype("<i2")
    return [base64.b64encode(s.tobytes() + t.tobytes()).decode() for s, t in zip(strong, soft)]


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    def run(batches):
        for b in batches:
            out = [x for c in chunks(b.column(1)) for x in render(fingerprints(c))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, fingerprint string")


COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def _of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [fingerprints(c) for c in chunks(pa.array(texts, pa.large_string()))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _take(f, i):
    return f[0][i], f[1][i]


#: Characters of text whose documents are compared together.
_TOGETHER = 1 << 20


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document, its edited text and the next document by ascending id.

    The edited text has the last floor(n / 4) of n characters replaced by the
    first as many (or all) of the next document; behind the last comes the
    first.  Rows of equal id follow each other by text; null ids come first.
    """
    rows = in_order(df.select(F.col(id_col).cast("long").alias("doc_id"),
                              F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")),
                    "doc_id", "text", lookahead=True)

    def flush(ids, texts):
        """All documents but the last, which is only the next of the one before."""
        n = [len(t) for t in texts[:-1]]
        edited = [t[:k - k // 4] + x[:k // 4] for t, x, k in zip(texts, texts[1:], n)]
        own, changed = _of(texts), _of(edited)
        here, after = _take(own, slice(0, -1)), _take(own, slice(1, None))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[:-1], pa.int64()), pa.array(n, pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
             pa.array(render(here), pa.string()), pa.array(render(changed), pa.string()),
             pa.array(likeness(here, changed)), pa.array(likeness(here, after))],
            [c.split()[0] for c in COMPARED.split(", ")])

    def run(batches):
        piece, done, ids, texts, size = None, False, [], [], 0
        for b in batches:
            for p, a, i, t in zip(*(b.column(k).to_pylist() for k in range(4))):
                if p != piece:
                    piece, done, ids, texts, size = p, False, [], [], 0
                if done:
                    continue  # equal ids at the head of the next piece: the first is the next
                ids.append(i)
                texts.append(t)
                size += len(t)
                done = a == 1
                if len(texts) > 1 and (done or size >= _TOGETHER):
                    yield flush(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])

    return map_batches(rows.select("_piece", "_ahead", "doc_id", "text"), run, COMPARED)
