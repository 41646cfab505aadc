"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves every pre-token
that is itself a vocabulary entry, for a whole chunk of texts at once; the
bytes found there are compared, so a stranger never passes for an entry.
Tier 2: the distinct misses of a chunk are merged with a heap over a linked
list of their bytes; results are kept in a bounded table per Python worker.

The vocabulary (a rank file of fixed size) is read on the driver from the
path parameter and shipped to the tasks as a broadcast of ``MAX_VOCAB_BYTES``
at most.  Null texts encode as empty; repeated rows are encoded each; an empty
table gives an empty result; extra columns are kept by :func:`encode` and
:func:`decode` unless they have the name of the added column, which is then
replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import boundaries
from .textkit import Chunk, chunks, map_batches, mix, ragged, segment_hashes

MAX_VOCAB_BYTES = 64 << 20
#: Entries of the table of merged misses; it is emptied when full.
MISS_ENTRIES = 300_000


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys (hash and displace).

    Keys fall into as many buckets as there are keys.  A bucket of several
    keys has a displacement that sends them to free slots; a bucket of one
    names a free slot directly (stored as ``-slot - 1``).
    """

    def __init__(self, keys: np.ndarray):
        n = self.n = len(keys)
        self.displace = np.zeros(max(n, 1), dtype=np.int64)
        self.slot_key = np.zeros(n, dtype=np.int64)  # slot -> position of its key
        if n == 0:
            return
        bucket = (keys % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        names, first, size = np.unique(bucket[order], return_index=True, return_counts=True)
        free = np.ones(n, dtype=bool)
        for i in np.argsort(-size, kind="stable"):
            members = order[first[i]:first[i] + size[i]]
            if size[i] == 1:
                break
            d = 1
            while True:
                slots = self._slots(keys[members], np.full(len(members), d))
                if free[slots].all() and len(set(slots.tolist())) == len(slots):
                    break
                d += 1
            self.displace[names[i]] = d
            free[slots] = False
            self.slot_key[slots] = members
        alone = names[size == 1]
        members = order[first[size == 1]]
        slots = np.flatnonzero(free)
        self.displace[alone] = -slots - 1
        self.slot_key[slots] = members

    def _slots(self, keys: np.ndarray, d: np.ndarray) -> np.ndarray:
        seeded = keys + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mix(seeded) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of the only key that each of ``keys`` could be."""
        if self.n == 0:
            return np.zeros(len(keys), dtype=np.int64)
        d = self.displace[(keys % np.uint64(self.n)).astype(np.int64)]
        return self.slot_key[np.where(d < 0, -d - 1, self._slots(keys, d))]


class Vocabulary:
    """Tokens by rank, their perfect hash, and the ranks as a plain lookup."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.get)
        self.ids = np.array([ranks[t] for t in tokens], dtype=np.uint32)
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.lengths = lengths
        self.hash = PerfectHash(segment_hashes(self.data, self.starts, self.ends))
        by_id = np.full(int(self.ids.max()) + 1 if len(tokens) else 1, -1, dtype=np.int64)
        by_id[self.ids] = np.arange(len(tokens))
        self.by_id = by_id
        self._ranks: dict[bytes, int] | None = None

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        """From a rank file: base64 token, blank, rank on each line."""
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            return cls({base64.b64decode(t): int(r) for t, r in pairs})

    def __getstate__(self):
        return self.__dict__ | {"_ranks": None}

    @property
    def ranks(self) -> dict[bytes, int]:
        if self._ranks is None:
            raw = self.data.tobytes()
            self._ranks = {raw[s:e]: int(i) for s, e, i in zip(self.starts, self.ends, self.ids)}
        return self._ranks

    def whole(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
        """Tier 1: (position of the entry, whether the segment is that entry)."""
        keys = segment_hashes(data, starts, ends)
        at = self.hash.find(keys)
        size = ends - starts
        same = (self.lengths[at] == size) if self.hash.n else np.zeros(len(at), dtype=bool)
        hit = np.flatnonzero(same)
        for n in np.unique(size[hit]):
            rows = hit[size[hit] == n]
            step = np.arange(n)
            same[rows] = (data[starts[rows][:, None] + step]
                          == self.data[self.starts[at[rows]][:, None] + step]).all(axis=1)
        return at, same

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the byte offset before each id (and the end)."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.by_id) or (self.by_id[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        at = self.by_id[ids]
        lengths = self.lengths[at]
        return (self.data[ragged(self.starts[at], lengths)],
                np.concatenate([[0], np.cumsum(lengths)]))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tier 2: merge neighbouring parts, lowest rank first, leftmost on ties.

    ``ahead[i]`` is where the part after the one at ``i`` begins; a heap entry
    is stale when the part it would merge has changed since.
    """
    n = len(piece)
    ahead = list(range(1, n + 1))
    behind = list(range(-1, n - 1))
    alive = [True] * n

    def offer(i: int) -> None:
        j = ahead[i]
        if j < n:
            rank = ranks.get(piece[i:ahead[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, j, ahead[j]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if not alive[i] or ahead[i] != j or not alive[j] or ahead[j] != end:
            continue
        alive[j] = False
        ahead[i] = end
        if end < n:
            behind[end] = i
        offer(i)
        if behind[i] >= 0:
            offer(behind[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:ahead[i]]])
        i = ahead[i]
    return out


class Codec:
    """Encodes chunks of texts; keeps the misses it has merged."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.merged: dict[bytes, bytes] = {}  # piece -> its ids, packed

    def _misses(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.merged) > MISS_ENTRIES:
            self.merged.clear()
        out = []
        for p in pieces:
            got = self.merged.get(p)
            if got is None:
                got = array("I", merge(p, self.v.ranks)).tobytes()
                if len(p) <= 64:
                    self.merged[p] = got
            out.append(got)
        return out

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the chunk, and the offset of each text's ids."""
        at, first = boundaries(chunk)
        return encode_pieces(chunk.data, at, first, self.v.whole, self.v.ids, self._misses)


def encode_pieces(data, at, first, whole, entry_ids, misses):
    """Ids of pre-tokens: entries by ``whole``, distinct others by ``misses``."""
    starts, ends = at[:-1], at[1:]
    entry, hit = whole(data, starts, ends)
    counts = np.ones(len(starts), dtype=np.int64)
    lost = np.flatnonzero(~hit)
    if len(lost):
        keys = segment_hashes(data, starts[lost], ends[lost])
        _, one, which = np.unique(keys, return_index=True, return_inverse=True)
        raw = data.tobytes()
        found = misses([raw[s:e] for s, e in zip(starts[lost[one]].tolist(), ends[lost[one]].tolist())])
        sizes = np.array([len(x) // 4 for x in found], dtype=np.int64)
        counts[lost] = sizes[which]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    ids = np.empty(int(offsets[-1]), dtype=np.uint32)
    kept = np.flatnonzero(hit)
    ids[offsets[kept]] = entry_ids[entry[kept]]
    if len(lost):
        flat = np.frombuffer(b"".join(found), dtype=np.uint32)
        begins = np.cumsum(sizes) - sizes
        ids[ragged(offsets[lost], sizes[which])] = flat[ragged(begins[which], sizes[which])]
    return ids, offsets[first]


_codecs: dict[int, Codec] = {}


def _codec(shared: Broadcast) -> Codec:
    """The worker's codec of a broadcast vocabulary (the last one is kept)."""
    v = shared.value
    if id(v) not in _codecs:
        _codecs.clear()
        _codecs[id(v)] = Codec(v)  # the codec holds v, so its id stays taken
    return _codecs[id(v)]


def share(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary at ``path`` as a broadcast of checked size."""
    v = Vocabulary.read(path)
    size = v.data.nbytes + 7 * 8 * len(v.ids)
    if size > MAX_VOCAB_BYTES:
        raise ValueError(f"the vocabulary takes {size} bytes; the bound is {MAX_VOCAB_BYTES}")
    return spark.sparkContext.broadcast(v)


def _with_column(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text (array of long)."""
    shared = share(df.sparkSession, vocab_path)

    def run(batches):
        codec = _codec(shared)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            parts, sizes = [], []
            for c in chunks(texts):
                ids, offsets = codec.encode(c)
                parts.append(ids)
                sizes.append(np.diff(offsets))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
            values = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
            keep = [n for n in b.schema.names if n != ids_col]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in keep] + [ids],
                                             [*keep, ids_col])

    return map_batches(df, run, _with_column(df, ids_col, T.ArrayType(T.LongType())))


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each array of ids stands for (null: empty)."""
    shared = share(df.sparkSession, vocab_path)

    def run(batches):
        v = shared.value
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids_col))
            out = [v.decode(np.array(x.as_py() or [], dtype=np.int64))[0].tobytes() for x in lists]
            keep = [n for n in b.schema.names if n != bytes_col]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(n)) for n in keep] + [pa.array(out, pa.binary())],
                [*keep, bytes_col])

    return map_batches(df, run, _with_column(df, bytes_col, T.BinaryType()))


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id count, digest of the ids (little-endian unsigned 32-bit) and
    of the bytes they decode to.  Encodes and decodes in one pass, so the ids
    of a text never leave their task; a null id column stays null."""
    shared = share(df.sparkSession, vocab_path)

    def run(batches):
        codec = _codec(shared)
        sha = hashlib.sha256
        for b in batches:
            counts, ids_hex, bytes_hex = [], [], []
            for c in chunks(b.column(1)):
                ids, offsets = codec.encode(c)
                back, at = codec.v.decode(ids)
                counts.append(np.diff(offsets))
                raw, text = ids.astype("<u4").tobytes(), back.tobytes()
                cut = offsets.tolist()
                ids_hex += [sha(raw[4 * s:4 * e]).hexdigest() for s, e in zip(cut, cut[1:])]
                cut = at[offsets].tolist()
                bytes_hex += [sha(text[s:e]).hexdigest() for s, e in zip(cut, cut[1:])]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n.astype(np.int64)), pa.array(ids_hex, pa.string()),
                 pa.array(bytes_hex, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, DIGEST_SCHEMA)
