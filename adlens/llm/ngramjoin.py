"""N-gram Jaccard join by set-relation skipping.

A document is the set of its distinct word shingles; two documents link when
``100 * intersection >= percent * union``.  Links are exact.

*Block-skip index lists.*  A set's shingles stand in hash order, cut at fixed
positions into one block more than two linked sets of that size can differ in
(plus a few), so two linked sets agree on at least one whole non-empty block.
The index has a list for each block content at each position: a set meets only
the sets of the blocks it shares and skips all others unread.  Sizes are
handled in classes no wider than the threshold allows; a set is indexed in its
own class and the next.

Shingles of very many documents (a passage that is copied everywhere) are left
out of the blocks: without them two sets differ no more than with them, so the
count of blocks still holds, and the passage brings nobody together.  A set
that this leaves with more empty blocks than the few allowed for is also
indexed whole, and under its empty blocks if even so it has too many.  Which
shingles are left out changes the work, never the result.

*Answers from a similar set.*  Equal sets are one set.  In every list the set
that shares most blocks with others leads; each member is compared with its
leader once, by its shingles.  Pairs of members are then answered from their
differences with the leader alone: the leader's shingles that both kept plus
the added ones that both have.  Members that link to the leader are one
component already, so only pairs with an unlinked member are looked at, and
only links that join components are written: pairs are never emitted.  The
members of a leader are dealt out in blocks of bounded size; pairs across
blocks are answered block against block.

Words are runs of bytes other than white space, A-Z lower-cased; shingles are
64-bit hashes.  Documents without words (or text) link with nothing.  Null ids
take part in links but never name a component.  Repeated rows are equal sets.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import checked_broadcast, write_table
from .components import components
from .textkit import CHUNK_BYTES, Chunk, chunks, map_batches, mix, shingles

_U = np.uint64
#: Bytes of index entries that one task sorts, about.
BUCKET_BYTES = 16 << 20
#: Index entries that a task collects before it passes them on.
HELD = 400_000
#: Members of a leader that one task holds, times the leader's shingles.
MEMBER_CELLS, MEMBERS = 8 << 20, 1024
#: Bytes of sets that are dealt out at once, about: a set goes to each of its goals.
DEALT_BYTES = 4 << 20
#: Most 64-bit words of the filter in front of the second reading of the texts.
FILTER_WORDS = 1 << 20


@dataclass
class Classes:
    """Size classes: ``low[k] <= size < low[k + 1]``; ``blocks[k]`` positions of
    class k (0: only equal sets link), of which ``spare[k]`` may be empty."""

    low: np.ndarray
    blocks: np.ndarray
    spare: np.ndarray

    @classmethod
    def of(cls, percent: int, largest: int = 1 << 31) -> "Classes":
        low = [1]
        while low[-1] <= largest:
            low.append(low[-1] * 100 // percent + 1)
        blocks, spare = [], []
        for k, high in enumerate(x - 1 for x in low[1:]):
            differ = (100 - percent) * 2 * high // (100 + percent)
            if differ == 0:
                blocks.append(0)
                spare.append(0)
                continue
            extra, before = 1, 0
            while extra != before:  # allow for the empty blocks of the smallest sets, amply
                before = extra
                empty = np.exp(-low[max(k - 1, 0)] / (differ + 1 + extra)) * (differ + 1 + extra)
                extra = min(int(1.5 * empty + 3 * np.sqrt(empty)) + 1, 2 * differ + 2)
            blocks.append(differ + 1 + extra)
            spare.append(extra)
        return cls(np.array(low), np.array(blocks), np.array(spare))


def set_keys(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set of shingles (two sums of mixed hashes)."""
    n = len(offsets) - 1
    some = np.flatnonzero(np.diff(offsets) > 0)
    k1, k2 = np.zeros(n, _U), np.zeros(n, _U)
    if len(some):
        k1[some] = np.add.reduceat(mix(h + _U(1)), offsets[some])
        k2[some] = np.add.reduceat(mix(h ^ _U(0xD1B54A32D192ED03)), offsets[some])
    return k1, k2


def signatures(h: np.ndarray, offsets: np.ndarray, which: np.ndarray, classes: Classes,
               common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(block signature, set number) of the sets ``which`` in both their classes,
    without the shingles in ``common`` (ascending)."""
    sizes = np.diff(offsets)
    wanted = np.zeros(len(sizes), dtype=bool)
    wanted[which] = True
    owner = np.repeat(np.arange(len(sizes)), sizes)
    kept = wanted[owner]
    h, owner = h[kept], owner[kept]
    own = np.searchsorted(classes.low, sizes, side="right") - 1
    if common is None or len(common) == 0:
        return _blocks(h, owner, wanted, own, classes, 0)[:2]
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    rare = common[at] != h
    s, o, short = _blocks(h[rare], owner[rare], wanted, own, classes, 1)
    again = short[owner]
    s2, o2, _ = _blocks(h[again], owner[again], short, own, classes, 0)
    return np.concatenate([s, s2]), np.concatenate([o, o2])


def _blocks(h, owner, wanted, own, classes, kind):
    """Signatures and sets of the filled blocks, and which sets have too many
    empty ones; those of kind 0 (whole sets) are listed under the empty ones too."""
    n = len(own)
    short = np.zeros(n, dtype=bool)
    sigs, sets = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for step in (0, 1):
        cls = own + step
        m = classes.blocks[cls]
        use = m[owner] > 0
        g, o = h[use], owner[use]
        place = ((g >> _U(32)) * m[o].astype(_U)) >> _U(32)
        first = np.ones(len(g), dtype=bool)
        first[1:] = (o[1:] != o[:-1]) | (place[1:] != place[:-1])
        at = np.flatnonzero(first)
        content = np.add.reduceat(mix(g + _U(2)), at) if len(at) else np.zeros(0, _U)
        o, place = o[at], place[at]
        filled = np.bincount(o, minlength=n)
        odd = wanted & (m > 0) & (m - filled > classes.spare[cls])
        short |= odd
        for i in np.flatnonzero(odd) if kind == 0 else ():
            gaps = np.setdiff1d(np.arange(m[i], dtype=_U), place[o == i])
            content = np.append(content, np.zeros(len(gaps), _U))
            place, o = np.append(place, gaps), np.append(o, np.full(len(gaps), i))
        name = place * _U(0x9E3779B97F4A7C15) + (cls[o] * 2 + kind).astype(_U) + _U(1)
        sigs.append(mix(content ^ mix(name)))
        sets.append(o)
    return np.concatenate(sigs), np.concatenate(sets), short


#: A shingle is left out of the blocks if windows of about ``WINDOW`` shingles
#: that hold it ``IN_WINDOW`` times or more hold it in ``COMMON_SHARE`` of all
#: documents together (``COMMON_LEAST`` at least).  At most (shingles per
#: document) / ``COMMON_SHARE`` shingles can be; of more than ``COMMON_MOST``
#: the most frequent are taken.
WINDOW, IN_WINDOW, COMMON_LEAST, COMMON_SHARE, COMMON_MOST = 1 << 19, 4, 16, 1e-3, 1 << 19


def _common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """The shingles that are left out of the blocks, ascending."""
    def count(batches):
        held, n = [], 0

        def flush():
            names, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= IN_WINDOW
            return pa.RecordBatch.from_arrays([pa.array(names[often].view(np.int64)), pa.array(counts[often])],
                                              ["shingle", "n"])

        for b in batches:
            for c in chunks(b.column(0)):
                h = shingles(c, width)[0]
                held.append(h)
                n += len(h)
                if n >= WINDOW:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    least = max(COMMON_LEAST, int(docs.count() * COMMON_SHARE))
    rows = (map_batches(docs.select("text"), count, "shingle long, n long").groupBy("shingle")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            .orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).select("shingle").toArrow())
    return np.sort(rows.column("shingle").to_numpy().view(np.uint64))


_INDEX = "kind int, row long, list long, doc_id long, n long, k1 long, k2 long"


def _index(docs: DataFrame, width: int, classes: Classes) -> DataFrame:
    """One written table: a row per document (kind 0) and per index entry in a
    list of several sets (kind 1).  ``docs`` has doc_id and text."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = spark.sparkContext.broadcast(_common_shingles(docs, width))
    # about 0.8 bytes of entries for each byte of text
    buckets = max(4 * parts, -(-int(0.8 * size) // BUCKET_BYTES))

    def cut(batches):
        task = TaskContext.get().partitionId() << 33
        seen: set[tuple[int, int]] = set()
        row = task
        sigs, rows, held = [], [], 0

        def flush():
            s, r = np.concatenate(sigs), np.concatenate(rows)
            bucket = ((s >> _U(32)) * _U(buckets)) >> _U(32)
            order = np.argsort(bucket, kind="stable")
            s, r, bucket = s[order].astype("<u4"), r[order].astype("<i8"), bucket[order].astype(np.int32)
            names, at = np.unique(bucket, return_index=True)
            ends = np.append(at[1:], len(bucket))
            return pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(np.ones(len(names), np.int32)),
                 pa.array([s[i:j].tobytes() + r[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())],
                ["bucket", "kind", "data"])

        for b in batches:
            for c in chunks(b.column(1)):
                h, offsets, _ = shingles(c, width)
                n = np.diff(offsets)
                k1, k2 = set_keys(h, offsets)
                own = np.arange(row, row + c.n)
                row += c.n
                ids = b.column(0).slice(c.first, c.n)
                info = [own, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().cast(pa.int64()).to_numpy(zero_copy_only=False),
                        n, k1.view(np.int64), k2.view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(own[0] // max(c.n, 1)) % buckets], pa.int32()), pa.array([0], pa.int32()),
                     pa.array([np.stack(info).astype("<i8").tobytes()], pa.binary())], ["bucket", "kind", "data"])
                new = []
                for i, key in enumerate(zip(k1.tolist(), k2.tolist())):
                    if n[i] and key not in seen:
                        seen.add(key)
                        new.append(i)
                s, o = signatures(h, offsets, np.array(new, dtype=np.int64), classes, common.value)
                if len(s):
                    sigs.append(s)
                    rows.append(own[o])
                    held += len(s)
                if held > HELD:
                    yield flush()
                    sigs, rows, held = [], [], 0
        if held:
            yield flush()

    def gather(group):
        kinds, data = group.column("kind").to_pylist(), group.column("data").to_pylist()
        bucket = group.column("bucket")[0].as_py()
        info = [np.frombuffer(d, "<i8").reshape(6, -1) for k, d in zip(kinds, data) if k == 0]
        docs_ = np.concatenate(info, axis=1) if info else np.zeros((6, 0), np.int64)
        sig = [np.frombuffer(d[:len(d) // 3], "<u4") for k, d in zip(kinds, data) if k == 1]
        row = [np.frombuffer(d[len(d) // 3:], "<i8") for k, d in zip(kinds, data) if k == 1]
        sig = np.concatenate(sig) if sig else np.zeros(0, np.uint32)
        row = np.concatenate(row) if row else np.zeros(0, np.int64)
        order = np.argsort(sig, kind="stable")
        sig, row = sig[order], row[order]
        alone = np.ones(len(sig), dtype=bool)
        if len(sig):
            same = sig[1:] == sig[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
        sig, row = sig[~alone].astype(np.int64) | (bucket << 32), row[~alone]
        d, e = docs_.shape[1], len(sig)

        def column(first, second):
            return pa.concat_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())])

        none = pa.nulls(e, pa.int64())
        return pa.table({
            "kind": pa.array(np.repeat([0, 1], [d, e]).astype(np.int32)), "row": column(docs_[0], row),
            "list": pa.concat_arrays([pa.nulls(d, pa.int64()), pa.array(sig, pa.int64())]),
            "doc_id": pa.concat_arrays([pa.array(docs_[1], mask=docs_[2] == 1), none]),
            "n": pa.concat_arrays([pa.array(docs_[3], pa.int64()), none]),
            "k1": pa.concat_arrays([pa.array(docs_[4], pa.int64()), none]),
            "k2": pa.concat_arrays([pa.array(docs_[5], pa.int64()), none])})

    cut_rows = map_batches(docs.select("doc_id", "text"), cut, "bucket int, kind int, data binary")
    return write_table(cut_rows.groupBy("bucket").applyInArrow(gather, _INDEX), "ngram-index")


def _stars(entries: DataFrame, row_rep: DataFrame) -> DataFrame:
    """(leader, node): each set of a list with the list's leader, once."""
    lists = entries.join(row_rep, "row").select("list", "rep").distinct()
    size = lists.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    lists = write_table(lists.join(size, "list"), "ngram-lists")
    shared = lists.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("shared"))
    ranked = lists.join(shared, "rep").select("list", "rep", F.struct("shared", (-F.col("rep")).alias("rep")).alias("rank"))
    leaders = ranked.groupBy("list").agg((-F.max("rank")["rep"]).alias("leader"))
    pairs = lists.join(leaders, "list").where("rep <> leader").select("leader", F.col("rep").alias("node")).distinct()
    return write_table(pairs, "ngram-stars")


def _filtered(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most rows whose id is not in ``ids``: a bit table of about 16 bits
    for each id, ``FILTER_WORDS`` long words at most, is broadcast; the exact join follows."""
    words = max(1 << 12, min(FILTER_WORDS, ids.count() // 4))
    word = F.expr(f"pmod(shiftright(xxhash64(doc_id), 6), {words})")
    bit = F.expr("shiftleft(1L, cast(xxhash64(doc_id) & 63 as int))")
    table = ids.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return (docs.join(F.broadcast(table), word == F.col("_word"))
            .where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits"))


def _texts_of(docs: DataFrame, goals: DataFrame, width: int) -> DataFrame:
    """(text, node, goals): the texts of the sets in ``goals``.

    The set's key is part of the join, so rows without ids, or of one id, meet only the goals of
    their own set; rows that repeat within a batch go on once.
    """
    def key(batches):
        for b in batches:
            seen, ids = set(), b.column(0)
            for c in chunks(b.column(1)):
                h, offsets, _ = shingles(c, width)
                k1, k2 = (k.view(np.int64) for k in set_keys(h, offsets))
                id_ = ids.slice(c.first, c.n).to_pylist()
                keep = []
                for i, name in enumerate(zip(id_, k1.tolist(), k2.tolist())):
                    if offsets[i] < offsets[i + 1] and name not in seen:
                        seen.add(name)
                        keep.append(i)
                at = np.array(keep, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + c.first)), b.column(1).take(pa.array(at + c.first)),
                                                  pa.array(k1[at]), pa.array(k2[at])], ["_id", "text", "_k1", "_k2"])

    read = _filtered(docs, goals.select("doc_id"))
    keyed = map_batches(read.select("doc_id", "text"), key, "_id long, text string, _k1 long, _k2 long")
    return (keyed.join(goals, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
            .select("text", "node", "goals"))


def _dealt(read: DataFrame, width: int) -> DataFrame:
    """(leader, block, blocks, node, data, packed): the set of each row once for each of its goals,
    as its compressed text (``packed``) or as its shingles, whichever takes fewer bytes."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())

    def dealt_rows(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)],
                                          ["leader", "block", "blocks", "node", "data", "packed"])

    def deal(batches):
        for b in batches:
            nodes, goals_ = b.column(1).to_pylist(), b.column(2).to_pylist()
            for c in chunks(b.column(0)):
                h, offsets, _ = shingles(c, width)
                out, held = [], 0
                for i in range(c.n):
                    j = c.first + i
                    data = zlib.compress(c.data[c.offsets[i]:c.offsets[i + 1]].tobytes(), 1)
                    packed = len(data) < 8 * int(offsets[i + 1] - offsets[i])
                    if not packed:
                        data = h[offsets[i]:offsets[i + 1]].astype("<u8").tobytes()
                    for g in goals_[j]:
                        out.append((g["leader"], g["block"], g["blocks"], nodes[j], data, packed))
                        held += len(data)
                        if held >= DEALT_BYTES:
                            yield dealt_rows(out)
                            out, held = [], 0
                if out:
                    yield dealt_rows(out)

    return map_batches(read, deal, "leader long, block int, blocks int, node long, data binary, packed boolean")


def _sets(packed: pa.Array, data: pa.Array, width: int):
    """The sets of dealt rows, in order; texts are cut into shingles about ``CHUNK_BYTES`` at a time."""
    held, size = [], 0

    def cut():
        texts = [raw for is_text, raw in held if is_text]
        if texts:
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            h, offsets, _ = shingles(Chunk(0, np.frombuffer(b"".join(texts), np.uint8), ends), width)
        at = 0
        for is_text, raw in held:
            if is_text:
                yield h[offsets[at]:offsets[at + 1]]
                at += 1
            else:
                yield np.frombuffer(raw, "<u8")

    for is_text, value in zip(packed, data):
        is_text, raw = is_text.as_py(), value.as_py()
        held.append((is_text, zlib.decompress(raw) if is_text else raw))
        size += len(held[-1][1])
        if size >= CHUNK_BYTES:
            yield from cut()
            held, size = [], 0
    yield from cut()


class _Members:
    """A leader's members: their sizes, what they kept of it and added to it."""

    def __init__(self, nodes, sizes, linked, kept, added):
        self.nodes, self.sizes, self.linked, self.kept, self.added = nodes, sizes, linked, kept, added


def _common(a: _Members, rows: np.ndarray, b: _Members) -> np.ndarray:
    """Shingles that each of ``a``'s ``rows`` has in common with each of ``b``."""
    out = a.kept[rows].astype(np.float32) @ b.kept.astype(np.float32).T
    mine = [a.added[i] for i in rows]
    x = np.concatenate([*mine, np.zeros(0, _U)])
    y = np.concatenate([*b.added, np.zeros(0, _U)])
    shared = np.intersect1d(x, y)
    if len(shared) == 0:
        return out

    def holders(added, values):
        owner = np.repeat(np.arange(len(added)), [len(s) for s in added])
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[at] == values
        return owner[hit], at[hit]

    xo, xt = holders(mine, x)
    yo, yt = holders(b.added, y)
    step = max(1, (4 << 20) // max(len(mine) + len(b.added), 1))
    for lo in range(0, len(shared), step):
        left = np.zeros((len(mine), min(step, len(shared) - lo)), np.float32)
        right = np.zeros((len(b.added), left.shape[1]), np.float32)
        for m, o, t in ((left, xo, xt), (right, yo, yt)):
            here = (t >= lo) & (t < lo + step)
            m[o[here], t[here] - lo] = 1
        out += left @ right.T
    return out


def _answers(a: _Members, b: _Members, percent: int) -> list[tuple[int, int]]:
    """Links between ``a`` and ``b`` (may be the same) that join components."""
    links: list[tuple[int, int]] = []
    nodes = np.concatenate([a.nodes, b.nodes])
    label = np.concatenate([np.where(a.linked, -1, np.arange(len(a.nodes))),
                            np.where(b.linked, -1, len(a.nodes) + np.arange(len(b.nodes)))])
    if a is b:
        label[len(a.nodes):] = label[:len(a.nodes)]

    def find(p: _Members, q: _Members, p_at: int, q_at: int, rows: np.ndarray) -> None:
        for part in np.array_split(rows, max(1, len(rows) // 256)):
            if len(part) == 0:
                continue
            both = _common(p, part, q)
            union = p.sizes[part][:, None] + q.sizes[None, :] - both
            near = 100 * both >= percent * union
            for i, hits in zip(part, near):
                js = np.flatnonzero(hits)
                js = js[label[q_at + js] != label[p_at + i]]
                _, first = np.unique(label[q_at + js], return_index=True)
                for j in js[first]:
                    x, y = label[p_at + i], label[q_at + j]
                    if x != y:
                        links.append((int(nodes[p_at + i]), int(nodes[q_at + j])))
                        label[label == max(x, y)] = min(x, y)

    find(a, b, 0, len(a.nodes), np.flatnonzero(~a.linked))
    if a is not b:  # linked ones of a against unlinked ones of b
        find(b, a, len(a.nodes), 0, np.flatnonzero(~b.linked))
    return links


_RESOLVED = ("kind int, a long, b long, block int, blocks int, n long, linked boolean, kept binary, added binary")
_NAMES = [c.split()[0] for c in _RESOLVED.split(", ")]


def _resolved(links: list[tuple[int, int]], leader: int, block: int, blocks: int, m: _Members | None
              ) -> pa.RecordBatch:
    """Links (kind 0) and, for other blocks to meet them, members (kind 1)."""
    k = len(m.nodes) if m else 0
    n = len(links)
    pad = [None] * n
    return pa.RecordBatch.from_arrays([
        pa.array([0] * n + [1] * k, pa.int32()),
        pa.array([x for x, _ in links] + [leader] * k, pa.int64()),
        pa.array([y for _, y in links] + (m.nodes.tolist() if m else []), pa.int64()),
        pa.array(pad + [block] * k, pa.int32()), pa.array(pad + [blocks] * k, pa.int32()),
        pa.array(pad + (m.sizes.tolist() if m else []), pa.int64()),
        pa.array(pad + (m.linked.tolist() if m else []), pa.bool_()),
        pa.array(pad + ([np.packbits(r).tobytes() for r in m.kept] if m else []), pa.binary()),
        pa.array(pad + ([x.astype("<u8").tobytes() for x in m.added] if m else []), pa.binary())], _NAMES)


def _compare(leader: int, base: np.ndarray, nodes: list[int], sets: list[np.ndarray], percent: int
             ) -> tuple[list[tuple[int, int]], _Members]:
    """Compare every member with its leader, by their shingles."""
    kept = np.zeros((len(sets), len(base)), dtype=bool)
    added, links, linked = [], [], np.zeros(len(sets), dtype=bool)
    for i, s in enumerate(sets):
        at = np.minimum(np.searchsorted(base, s), len(base) - 1)
        hit = base[at] == s
        kept[i, at[hit]] = True
        added.append(s[~hit])
        both = int(hit.sum())
        if 100 * both >= percent * (len(base) + len(s) - both):
            linked[i] = True
            links.append((nodes[i], leader))
    return links, _Members(np.array(nodes, dtype=np.int64), np.array([len(s) for s in sets]), linked, kept, added)


def _links(docs: DataFrame, info: DataFrame, stars: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between sets, enough to join every component."""
    size = info.select(F.col("row").alias("leader"), F.col("n").alias("base"))
    per = F.greatest(F.lit(8), F.least(F.lit(MEMBERS), F.floor(F.lit(MEMBER_CELLS) / F.col("base"))))
    blocks = (stars.groupBy("leader").agg(F.count("*").alias("members")).join(size, "leader")
              .select("leader", F.ceil(F.col("members") / per).cast("int").alias("blocks")))
    blocks = write_table(blocks, "ngram-blocks")
    member = (stars.join(blocks, "leader")
              .select("node", "leader", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks"))
    lead = blocks.select(F.col("leader").alias("node"), "leader",
                         F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks")
    goals = (member.unionByName(lead).groupBy("node")
             .agg(F.collect_list(F.struct("leader", "block", "blocks")).alias("goals")))
    goals = write_table(goals.join(info.withColumnRenamed("row", "node"), "node")
                        .select("node", "doc_id", "k1", "k2", "goals"), "ngram-goals")
    read = _texts_of(docs, goals, width)

    def resolve(batches):
        now, base, blocks_, nodes, sets = None, None, 1, [], []

        def done():
            links, m = _compare(now[0], base, nodes, sets, percent)
            if not m.linked.all():
                links += _answers(m, m, percent)
            return _resolved(links, now[0], now[1], blocks_, m if blocks_ > 1 else None)

        for b in batches:
            names = zip(*(b.column(i).to_pylist() for i in range(4)))
            for (leader, block, count, node), s in zip(names, _sets(b.column(5), b.column(4), width)):
                if (leader, block) != now:
                    if nodes:
                        yield done()
                    now, base, blocks_, nodes, sets = (leader, block), None, count, [], []
                if node == leader:  # comes first; a repeated row of it comes again
                    base = s
                elif base is not None and (not nodes or nodes[-1] != node):
                    nodes.append(node)
                    sets.append(s)
        if nodes:
            yield done()

    sorted_ = _dealt(read, width).repartition("leader", "block").sortWithinPartitions("leader", "block", F.col("node") != F.col("leader"), "node")
    first = write_table(map_batches(sorted_, resolve, _RESOLVED), "ngram-links")

    # members of one leader in several blocks: only unlinked members have anything left to
    # answer, so they go to every other block and linked ones to the blocks that have unlinked ones
    left = (first.where("kind = 1 AND NOT linked").groupBy("a")
            .agg(F.collect_set("block").alias("open"), F.max("blocks").alias("_blocks")))
    left = write_table(left, "ngram-open")
    found = first.where("kind = 0").select("a", "b")
    if left.isEmpty():
        return found
    # by block as well, so that the members of a large leader are not one key
    left = left.select("a", "open", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))
    others = F.when(F.col("linked"), F.col("open")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    across = (first.where("kind = 1").join(left, ["a", "block"])
              .withColumn("other", F.explode(others)).where("other <> block")
              .select("a", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                      "block", "b", "n", "linked", "kept", "added"))

    def cross(batches):
        now, rows = None, []

        def done():
            width_ = max(len(r[3]) for r in rows) * 8
            sides = []
            for side in (now[1], now[2]):
                own = [r for r in rows if r[5] == side]
                kept = np.array([np.unpackbits(np.frombuffer(r[3], np.uint8), count=width_) for r in own],
                                dtype=bool).reshape(len(own), width_)
                sides.append(_Members(np.array([r[0] for r in own], dtype=np.int64), np.array([r[1] for r in own]),
                                      np.array([r[2] for r in own], dtype=bool), kept,
                                      [np.frombuffer(r[4], "<u8") for r in own]))
            if not all(s.linked.all() for s in sides) and all(len(s.nodes) for s in sides):
                return _answers(*sides, percent)
            return []

        def out(links):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()),
                                               pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        for b in batches:
            for a, lo, hi, block, node, n, linked, kept, added in zip(*(b.column(i).to_pylist() for i in range(9))):
                if (a, lo, hi) != now:
                    if rows:
                        yield out(done())
                    now, rows = (a, lo, hi), []
                rows.append((node, n, linked, kept, added, block))
        if rows:
            yield out(done())

    more = map_batches(across.repartition("a", "lo", "hi").sortWithinPartitions("a", "lo", "hi", "block", "b"),
                       cross, "a long, b long")
    return found.unionByName(more)


def _grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, n, k1, k2) and their sets (n, k1, k2, least, component), ``least`` the smallest id of the set's rows."""
    index = _index(docs, width, Classes.of(percent))
    rows = index.where("kind = 0").select("row", "doc_id", "n", "k1", "k2")
    # equal sets are one: named by a row with an id where there is one
    reps = rows.where("n > 0").groupBy("n", "k1", "k2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    reps = write_table(reps.select("n", "k1", "k2", F.col("first.row").alias("rep"),
                                   F.col("first.doc_id").alias("least")), "ngram-sets")
    row_rep = rows.where("n > 0").join(reps, ["n", "k1", "k2"]).select("row", "rep")
    stars = _stars(index.where("kind = 1").select("list", "row"), row_rep)
    info = reps.select(F.col("rep").alias("row"), F.col("least").alias("doc_id"), "n", "k1", "k2")
    joined = components(_links(docs, info, stars, width, percent))
    whole = reps.join(joined, reps["rep"] == joined["node"], "left").select(
        "n", "k1", "k2", "least", F.coalesce("component", "rep").alias("component"))
    return rows, write_table(whole, "ngram-components")


def near_groups(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, whole = _grouped(docs, width, percent)
    ids = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    named = whole.join(ids, "component").select("n", "k1", "k2", "component_id")
    linked = rows.where("n > 0").join(named, ["n", "k1", "k2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of near copies, and all rows without words.

    The row of smallest id stays (rows without id come last), of these the one of smallest
    set key, of rows of equal id and set the one of lowest text hash, then of lowest hash of all columns.  A
    row is named by its id where no other row has that id; rows of repeated or null ids are named by id
    and set, so unlike texts of one id each stay for their own group.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, whole = _grouped(docs, width, percent)
    firsts = whole.groupBy("component").agg(
        F.min(F.struct(F.col("least").isNull().alias("none"), "least", "k1", "k2", "n")).alias("first")).select(
        F.col("first.least").alias("first_id"), F.col("first.k1").alias("first_k1"), F.col("first.k2").alias("first_k2"),
        F.col("first.n").alias("first_n"))
    often = write_table(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("its_id")),
                        "ngram-repeated-ids")
    stay = firsts.select(F.col("first_id").alias("its_id")).unionByName(rows.where("n = 0").select(F.col("doc_id").alias("its_id")))
    stay = stay.where("its_id IS NOT NULL").distinct().join(often, "its_id", "left_anti")
    own_id = df[id_col].cast("long")
    out = df.join(stay, own_id == stay["its_id"], "left_semi")
    nameless = df.where(df[id_col].isNull())
    unnamed = nameless
    if not often.isEmpty():
        few = checked_broadcast(often, name="ngram-repeated")
        unnamed = nameless.unionByName(df.join(few, own_id == few["its_id"], "left_semi"))
    elif rows.where("doc_id IS NULL").isEmpty():
        return out
    packed = unnamed.select(F.struct(*(F.col(c) for c in df.columns)).alias("doc"), F.col(id_col).cast("long").alias("id"),
                            F.col(text_col).cast("string").alias("text"), F.xxhash64(*df.columns).alias("hash"))

    def sets(batches):
        for b in batches:
            n, k1, k2 = [], [], []
            for c in chunks(b.column(2)):
                h, offsets, _ = shingles(c, width)
                one, two = set_keys(h, offsets)
                n.append(np.diff(offsets))
                k1.append(one.view(np.int64))
                k2.append(two.view(np.int64))
            keys = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (n, k1, k2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *keys], ["doc", "id", "hash", "n", "k1", "k2"])

    schema = StructType([packed.schema["doc"], *(StructField(c, LongType()) for c in ("id", "hash", "n", "k1", "k2"))])
    keyed = map_batches(packed, sets, schema).withColumn("text_hash", F.xxhash64(F.col("doc")[text_col]))
    chosen = (keyed.where("n > 0").join(firsts, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("k1") == F.col("first_k1"))
                                        & (F.col("k2") == F.col("first_k2")) & (F.col("n") == F.col("first_n")))
              .groupBy("id", "k1", "k2", "n").agg(F.min_by("doc", F.struct("text_hash", "hash")).alias("doc")))
    return out.unionByName(chosen.select("doc.*")).unionByName(keyed.where("n = 0").select("doc.*"))
