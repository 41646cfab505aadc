"""Token ids in files: written in id order, read back block by block.

A *unit* is one row of a file: a run of whole documents in ascending id order
with their ids in independently reset, checksummed blocks of the range coder.
Units hold about ``UNIT`` ids (a longer document is a unit of its own), so a
file can be read by many tasks and a damaged block is found where it is read.
Each unit knows how many ids of its piece come before it; the number of ids
before a piece follows from one row per piece.

Ids are those of the tokenizers library: it encodes every distinct pre-token
that the worker does not remember, many in one text, and the ids are laid out again for every occurrence
(byte-level BPE never merges across pre-tokens).  Strings of the tokenizer's added tokens
are cut out of the texts first, as the library does; each is its one id.  Its file is read on the
driver and shipped as a broadcast of bounded size.  Ids of 65536 and more raise an error, as does an added
token that takes blanks around it or only whole words.

Null texts count as empty: their ids are the end id alone.  Null document ids
come first, rows of equal id by text; an empty table gives empty files; other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from . import rangecoder
from .bpe import MAX_VOCAB_BYTES
from .ordered import in_order
from .pretokens import boundaries
from .textkit import Chunk, SegmentHasher, chunks, map_batches, ragged

UNIT = 1 << 16
#: Distinct pre-tokens that a worker remembers.
REMEMBERED = 1_500_000
#: New pre-tokens that are joined for the library.
JOINED = 200
END_ID = 2


class LibraryCodec:
    """Ids of whole chunks by the tokenizers library, one call for the new pre-tokens."""

    def __init__(self, spec: str):
        # Spark's tasks share the cores; threads of the library's own would only cost time
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        added = json.loads(spec).get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must be plain strings")
        self.added = {t["content"].encode(): t["id"] for t in added}
        # of strings that begin at one place the longest
        self.find = re.compile(b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if added else None
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        blank, newline = ([e.tokens[0] for e in self.tokenizer.encode_batch([x], add_special_tokens=False) if len(e) == 1] for x in " \n")
        # ids that begin with a blank, and the one of a line break
        self.led, self.newline = np.zeros(1 << 16, dtype=bool), np.zeros(1 << 16, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if i < 1 << 16 and blank and newline:
                self.led[i], self.newline[i] = token.startswith(blank[0]), token == newline[0]
        self._forget()

    def _forget(self) -> None:
        # open addressing by hash; 0 is a free slot
        self.keys, self.entry = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int32)
        self.starts, self.sizes, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of every hash, -1 if it is not remembered."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (hashes & mask).view(np.int64)
        there = self.keys.take(slot, mode="clip")
        out = np.where(there == hashes, self.entry.take(slot, mode="clip"), -1)
        left = np.flatnonzero((there != hashes) & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & int(mask)
            there = self.keys[slot]
            hit = there == hashes[left]
            out[left[hit]] = self.entry[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], slot[on]
        return out

    def _remember(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New entries, for different hashes that are not remembered."""
        n, used = self.n + len(hashes), self.used + len(ids)
        if n > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.starts, self.sizes))
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(used, np.uint32)])
        self.starts[self.n:n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n:n] = sizes
        self.flat[self.used:used] = ids
        number = np.arange(self.n, n, dtype=np.int32)
        self.n, self.used = n, used
        if 2 * n > len(self.keys):
            old = np.flatnonzero(self.keys)
            hashes, number = np.concatenate([self.keys[old], hashes]), np.concatenate([self.entry[old], number])
            self.keys, self.entry = (np.zeros(1 << (2 * n).bit_length(), x.dtype) for x in (self.keys, self.entry))
        mask = len(self.keys) - 1
        slot = (hashes & np.uint64(mask)).view(np.int64)
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]  # one of several
            left = self.keys[slot] != hashes
            self.entry[slot[~left]] = number[~left]
            hashes, number, slot = hashes[left], number[left], (slot[left] + 1) & mask

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the pre-tokens, their ids in it, end to end, and the number of each one's ids.

        Where two do not end in white space, a blank that the second begins with
        cuts them apart, and so does a line break between them, which is a
        pre-token of its own.  So many of them are one text for the library.
        """
        order, ids, sizes = [], [], []
        plain = [i for i, x in enumerate(pieces) if not x[-1].isspace()]
        for between, some in (("", [i for i in plain if pieces[i][0] == " "]), ("\n", [i for i in plain if pieces[i][0] != " "])):
            groups = [some[i:i + JOINED] for i in range(0, len(some), JOINED)]
            for group, e in zip(groups, self.batch([between.join([pieces[i] for i in g]) for g in groups], add_special_tokens=False)):
                got = np.array(e.ids, dtype=np.uint32)
                if got.max() >= 1 << 16:
                    continue
                cut = np.flatnonzero((self.newline if between else self.led)[got])
                if between:
                    got, cut = np.delete(got, cut), np.append(0, cut - np.arange(len(cut)))
                if len(cut) == len(group) and cut[0] == 0:
                    order += group
                    ids.append(got)
                    sizes.append(np.diff(np.append(cut, len(got))))
        alone = sorted(set(range(len(pieces))) - set(order))
        for i, e in zip(alone, self.batch([pieces[i] for i in alone], add_special_tokens=False)):
            order.append(i)
            ids.append(np.array(e.ids, dtype=np.uint32))
            sizes.append([len(e.ids)])
        return np.array(order), np.concatenate(ids), np.concatenate(sizes)

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the chunk, and the offset of each text's ids."""
        raw = chunk.data.tobytes()
        if not (self.find and self.find.search(raw)):
            return self._ordinary(chunk)
        # added tokens and the texts between them, each a text of its own
        own: dict[int, int] = {}
        cuts = set(chunk.offsets.tolist())
        for lo, hi in zip(chunk.offsets.tolist(), chunk.offsets[1:].tolist()):
            for m in self.find.finditer(raw, lo, hi):
                own[m.start()] = self.added[m.group()]
                cuts |= {m.start(), m.end()}
        cuts = np.array(sorted(cuts), dtype=np.int64)
        ids, offsets = self._ordinary(Chunk(chunk.first, chunk.data, cuts))
        parts = [np.array([own[c]], np.uint32) if c in own else ids[offsets[i]:offsets[i + 1]] for i, c in enumerate(cuts[:-1].tolist())]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        return np.concatenate(parts), ends[np.searchsorted(cuts, chunk.offsets)]

    def _ordinary(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        at, first = boundaries(chunk)
        if len(at) < 2:
            return np.zeros(0, np.uint32), np.zeros(chunk.n + 1, np.int64)
        hashes = SegmentHasher(chunk.data)(at[:-1], at[1:])
        hashes[hashes == 0] = 1
        entry = self._find(hashes)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, one = np.unique(hashes[missing], return_index=True)
            if self.n + len(new) > REMEMBERED and self.n:
                self._forget()
                return self._ordinary(chunk)
            raw = chunk.data.tobytes()
            order, ids, sizes = self._library([raw[at[i]:at[i + 1]].decode() for i in missing[one].tolist()])
            self._remember(new[order], ids, sizes)
            entry[missing] = self._find(hashes[missing])
        counts = self.sizes.take(entry)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        return self.flat.take(ragged(self.starts.take(entry), counts)), offsets[first]


_UNITS = ("piece int, unit int, first long, n long, doc_ids array<long>, doc_sizes array<long>, "
          "block_ids array<int>, checks array<long>, payloads array<binary>")


def _codec(shared) -> LibraryCodec:
    spec = shared.value
    if id(spec) not in _codecs:
        _codecs.clear()
        _codecs[id(spec)] = LibraryCodec(spec), spec  # the text is kept, so its id stays taken
    return _codecs[id(spec)][0]


_codecs: dict = {}


def write(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID) -> DataFrame:
    """Encode every text, append ``end_id``, write the files; the written table."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > MAX_VOCAB_BYTES:
        raise ValueError(f"the tokenizer file takes {len(spec)} bytes; the bound is {MAX_VOCAB_BYTES}")
    shared = df.sparkSession.sparkContext.broadcast(spec)
    rows = in_order(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
                    "doc_id", "text").select("_piece", "doc_id", "text")

    def run(batches):
        codec = _codec(shared)
        piece, unit, first = None, 0, 0
        docs, sizes, parts, held = [], [], [], 0
        ready: list[tuple] = []  # units whose blocks are coded together

        def close():
            nonlocal unit, first, docs, sizes, parts, held
            if docs:
                ready.append((piece, unit, first, held, docs, sizes, np.concatenate(parts)))
                unit, first = unit + 1, first + held
            docs, sizes, parts, held = [], [], [], 0

        def flush():
            out = _coded(ready)
            ready.clear()
            return out

        for b in batches:
            for c in chunks(b.column(2)):
                ids, offsets = codec.encode(c)
                for i in range(c.n):
                    p = b.column(0)[c.first + i].as_py()
                    if p != piece:
                        close()
                        piece, unit, first = p, 0, 0
                    own = np.append(ids[offsets[i]:offsets[i + 1]], np.uint32(end_id))
                    if held and held + len(own) > UNIT:
                        close()
                    docs.append(b.column(1)[c.first + i].as_py())
                    sizes.append(len(own))
                    parts.append(own)
                    held += len(own)
                if sum(u[3] for u in ready) >= rangecoder.LANES * rangecoder.BLOCK:
                    yield flush()
        close()
        if ready:
            yield flush()

    return write_table(map_batches(rows, run, _UNITS), "token-files")


def _coded(units: list[tuple]) -> pa.RecordBatch:
    """Units as rows; the blocks of all of them are coded side by side."""
    block, lanes, lengths, counts = rangecoder.BLOCK, [], [], []
    for *_, ids in units:
        if len(ids) and ids.max() >= 1 << 16:
            raise ValueError("the file format holds ids below 65536")
        n = -(-len(ids) // block)
        padded = np.zeros(n * block, dtype=np.uint16)
        padded[:len(ids)] = ids
        lanes.append(padded.reshape(n, block))
        lengths += [block] * (n - 1) + [len(ids) - (n - 1) * block]
        counts.append(n)
    rows, sizes = np.concatenate(lanes), np.array(lengths)
    payloads = [p for i in range(0, len(rows), rangecoder.LANES)
                for p in rangecoder.encode(rows[i:i + rangecoder.LANES], sizes[i:i + rangecoder.LANES])]
    checks = [zlib.crc32(r[:n].astype("<u2").tobytes()) for r, n in zip(rows, lengths)]
    cut = np.concatenate([[0], np.cumsum(counts)]).tolist()
    spans = list(zip(cut, cut[1:]))
    return pa.RecordBatch.from_arrays([
        pa.array([u[0] for u in units], pa.int32()), pa.array([u[1] for u in units], pa.int32()),
        pa.array([u[2] for u in units], pa.int64()), pa.array([u[3] for u in units], pa.int64()),
        pa.array([u[4] for u in units], pa.list_(pa.int64())), pa.array([u[5] for u in units], pa.list_(pa.int64())),
        pa.array([lengths[i:j] for i, j in spans], pa.list_(pa.int32())),
        pa.array([checks[i:j] for i, j in spans], pa.list_(pa.int64())),
        pa.array([payloads[i:j] for i, j in spans], pa.list_(pa.binary()))],
        ["piece", "unit", "first", "n", "doc_ids", "doc_sizes", "block_ids", "checks", "payloads"])


def _decoded(batches):
    """(unit's row, its ids) of every unit, decoded many blocks at a time."""
    rows, lanes = [], 0

    def flush():
        payloads = [p for r in rows for p in r["payloads"]]
        checks = [c for r in rows for c in r["checks"]]
        sizes = np.array([n for r in rows for n in r["block_ids"]])
        ids = rangecoder.unpack(payloads, checks, sizes)
        at = 0
        for r in rows:
            yield r, ids[at:at + r["n"]]
            at += r["n"]

    for b in batches:
        for i in range(b.num_rows):
            rows.append({name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)})
            lanes += len(rows[-1]["payloads"])
            if lanes >= rangecoder.LANES:
                yield from flush()
                rows, lanes = [], 0
    if rows:
        yield from flush()


def _placed(files: DataFrame) -> DataFrame:
    """Units with ``before``, the ids of all pieces before theirs (one row per
    piece is summed in one place and broadcast; pieces are a few per partition)."""
    pieces = files.groupBy(F.col("piece").alias("_piece")).agg(F.sum("n").alias("n"))
    order = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_piece", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return files.join(F.broadcast(pieces), F.col("piece") == F.col("_piece")).drop("_piece")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document in the files."""
    def run(batches):
        for r, ids in _decoded(batches):
            ends = np.concatenate([[0], np.cumsum(r["doc_sizes"])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int64)))], ["doc_id", "ids"])

    return map_batches(files, run, "doc_id long, ids array<long>")


def summary(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit)."""
    def run(batches):
        for r, ids in _decoded(batches):
            ends = np.concatenate([[0], np.cumsum(r["doc_sizes"])]).astype(np.int64)
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array(r["before"] + r["first"] + ends[:-1]),
                 pa.array(r["doc_sizes"], pa.int64()),
                 pa.array([zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(ends.tolist(), ends[1:].tolist())], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(_placed(files), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
