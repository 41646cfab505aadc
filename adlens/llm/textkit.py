"""Vectorised text helpers shared by the training-data operators.

Everything here works on one chunk of texts at a time, inside a Spark task:
the texts of a chunk are laid end to end in one byte array and cut, hashed and
counted with numpy, so the cost per word is a few array operations.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Null texts
count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that travel to a Python worker at once.  Spark's default of 10,000 whole
#: texts can take hundreds of megabytes on either side.
BATCH_ROWS = 1000
#: Bytes of text that are processed together (one longer text is its own chunk).
CHUNK_BYTES = 1 << 19

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Longer words are hashed by blake2b: a polynomial modulo 2**64 has known
#: collisions among very long words, a digest has none.
LONG_WORD = 256

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit hashes (the splitmix64 steps)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of ``BATCH_ROWS`` rows at most.

    The session's own setting holds where it is lower; otherwise it is lowered
    for the session, as it is read when the plan runs.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


class _Powers:
    """Powers of the hash base and of its inverse, extended on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            steps = np.full(size, _BASE)
            steps[0] = 1
            cls.up = np.cumprod(steps)
            steps[1:] = _BASE_INV
            cls.down = np.cumprod(steps)
        return cls.up, cls.down


class SegmentHasher:
    """64-bit hashes of byte segments of one array (prefix sums, made once)."""

    def __init__(self, data: np.ndarray):
        self.data = data
        up, self.down = _Powers.upto(len(data) + 1)
        self.total = np.empty(len(data) + 1, dtype=np.uint64)
        self.total[0] = 0
        np.cumsum(BYTE_CODES[data] * up[:len(data)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = (self.total[ends] - self.total[starts]) * self.down[starts]
        out = mix(out + (ends - starts).astype(np.uint64))
        for i in np.flatnonzero(ends - starts > LONG_WORD):
            digest = hashlib.blake2b(self.data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
        return out


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte segment ``data[starts[i]:ends[i]]``."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    return SegmentHasher(data)(starts, ends)


class Chunk:
    """Texts ``first .. first + n - 1`` of a batch, end to end in ``data``."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the text number of each."""
        inner = ~SPACE[self.data]
        edge = np.zeros(len(inner) + 1, dtype=bool)  # a text begins here
        edge[self.offsets] = True
        before = np.empty(len(inner) + 1, dtype=bool)
        before[0] = False
        before[1:] = inner
        before[edge] = False
        starts = np.flatnonzero(inner & ~before[:-1])
        after = np.empty(len(inner), dtype=bool)
        after[:-1] = inner[1:]
        if len(after):
            after[-1] = False
        after[edge[1:]] = False
        ends = np.flatnonzero(inner & ~after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole texts."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    bufs = texts.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Chunk(lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def shingles(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of every text, words lower-cased (A-Z).

    Returns (hashes, offsets, words per text): the hashes of text ``i`` are
    ``hashes[offsets[i]:offsets[i + 1]]``, ascending.  A text of fewer words
    has one shingle, its whole word sequence; one without words has none.
    """
    data = LOWER[chunk.data]
    starts, ends, text = chunk.words()
    words = segment_hashes(data, starts, ends)
    per_text = np.bincount(text, minlength=chunk.n)
    first = np.concatenate([[0], np.cumsum(per_text)])
    n = len(words)
    parts_h, parts_t = [], []
    full = max(n - width + 1, 0)
    if full:
        h = np.full(full, _U(width))
        for k in range(width):
            h = mix(h * _U(0x2545F4914F6CDD1D) + words[k:k + full])
        whole = text[:full] == text[width - 1:width - 1 + full]
        parts_h.append(h[whole])
        parts_t.append(text[:full][whole])
    for i in np.flatnonzero((per_text > 0) & (per_text < width)):
        h = np.array([per_text[i]], dtype=np.uint64)
        for w in words[first[i]:first[i + 1]]:
            h = mix(h * _U(0x2545F4914F6CDD1D) + w)
        parts_h.append(h)
        parts_t.append(np.array([i]))
    if not parts_h:
        return np.zeros(0, np.uint64), np.zeros(chunk.n + 1, np.int64), per_text
    h, t = np.concatenate(parts_h), np.concatenate(parts_t)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[keep], t[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(t, minlength=chunk.n))]), per_text


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i], starts[i] + 1, ...`` (``lengths[i]`` of each), end to end."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return out + np.repeat(starts - before, lengths)
