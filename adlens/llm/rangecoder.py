"""An adaptive context-mixing range coder for token ids.

Ids are cut into blocks of ``BLOCK`` that share nothing: every block starts
from the same state and has its own checksum, so any block can be read alone.
Within a block the coder predicts each id from the ids before it:

* order 2 and order 1: tables of the id last seen after the last two ids, and
  after the last id, each with a confidence;
* order 0: how often each group of ids has occurred in the block where the
  candidate was wrong.  Groups are finer for small ids, which are the frequent
  ones: eight for each power of two.

The order-2 prediction (order 1 where there is none) is the candidate.  Three
adaptive estimates that it is right -- by the order-2 confidence, by the
order-1 confidence and agreement, and by the block's hit rate -- are mixed in
the logistic domain with weights learned in the block.  A range coder then
codes "the candidate", or "another id" with the order-0 odds of its group, and
its place in the group.  Tables change with every id; estimates, weights and
order-0 odds are renewed from all ids so far, often at first (``RENEWALS``).

All arithmetic is on integers (those of the interval in doubles, below 2**53
and so exact), and every machine decodes alike.  Blocks are coded side by
side: each numpy operation advances all blocks by one id, or by all ids up to
the next renewal.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 4096
#: Blocks that are coded side by side.
LANES = 2048
#: Slots of the order-2 and order-1 tables of a block (powers of two).
SLOTS2, SLOTS1 = 2048, 1024
#: Ids of a block after which estimates, weights and odds are renewed.
RENEWALS = [16, 64, 160, 320, 640, *range(1024, BLOCK, 512)]

#: Ids of each block that the encoder models at once.
STEPS = 16

_ONE = 1 << 12
_WORD, _SHORT = 2.0 ** 16, 2.0 ** 32
_LONGEST = max(b - a for a, b in zip([0, *RENEWALS], [*RENEWALS, BLOCK]))
_SHIFT = np.array([1, _WORD])
_EACH, _HIGH = np.uint64(0x0001000100010001), np.uint64(0x8000800080008000)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """stretch(p) = ln(p / (1 - p)) and its inverse, 12-bit fixed point.

    The inverse is interpolated between a few fixed points in integers, and
    stretch is searched for in it, so no table depends on a maths library.
    """
    points = [1, 2, 3, 6, 10, 16, 27, 45, 73, 120, 194, 310, 488, 747, 1101, 1546, 2047, 2549, 2994, 3348, 3607, 3785,
              3901, 3975, 4024, 4050, 4068, 4079, 4085, 4089, 4092, 4093, 4094]
    x = np.arange(4096)
    at, w = x >> 7, x & 127
    p = np.array(points)
    squash = (p[at] * (128 - w) + p[at + 1] * w + 64) >> 7
    stretch = np.searchsorted(squash, np.arange(4096)).clip(0, 4095) - 2048
    return squash.astype(np.int32), stretch.astype(np.int32)


def _groups() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of every id, and each group's first id and number of ids."""
    first, size = list(range(16)), [1] * 16
    for bits in range(4, 16):
        for part in range(8, 16):
            first.append(part << (bits - 3))
            size.append(1 << (bits - 3))
    return np.repeat(np.arange(len(size)), size).astype(np.int32), np.array(first, np.float64), np.array(size, np.float64)


_SQUASH, _STRETCH = _tables()
_GROUP, _FIRST, _SIZE = _groups()
#: Number of groups; also the number that stands for "the candidate", which needs no place.
_N = len(_SIZE)
_FIRST, _SHARE = np.append(_FIRST, 0), np.append(1 / _SIZE, 1)
#: States of a lane: order-2 confidence; order-1 confidence and agreement.
_STATES = 32
#: Confidence after a prediction: by the one before if it was right, else (4) the first.
_NEXT = np.array([1, 2, 3, 3, 1], dtype=np.int32)


class _Model:
    """The state of all lanes, the same for both sides; the lane is the last axis of all that is renewed.

    The interval is cut into 2**24: the groups, by ``miss`` (out of 4096) times
    their odds (out of 4096), and behind them the candidate.
    """

    def __init__(self, lanes: int):
        self.n = lanes
        self.lane = np.arange(lanes, dtype=np.int64)
        self.t2 = np.zeros(lanes * SLOTS2, dtype=np.int32)  # id << 2 | confidence
        self.t1 = np.zeros(lanes * SLOTS1, dtype=np.int32)
        self.at2, self.at1 = self.lane * SLOTS2, self.lane * SLOTS1
        self.counts = np.ones((_N, lanes))
        self.seen = np.zeros((2, 4, 8, lanes), dtype=np.int64)  # misses, hits
        self.weights = np.tile(np.array([[26000], [20000], [20000]]), lanes)
        self.cum = np.zeros((_N + 1, lanes))
        # odds below each group, and odds of an id of it, side by side
        self.pairs = np.full((_N + 1, lanes), _ONE * 1j, dtype=np.complex64)
        # ends of every fourth group, and those of four groups in the 16-bit parts of a word
        self.ends = np.empty((_N // 4, lanes), dtype=np.int16)
        self.fours = np.full((_N // 4 + 1, lanes), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        self.odds()
        self.chances()

    def odds(self) -> None:
        """Order-0 odds of the groups, out of 4096, each 1 at least."""
        cum = self.cum[1:]
        cum[0] = self.counts[0]
        for i in range(1, _N):
            np.add(cum[i - 1], self.counts[i], out=cum[i])
        cum *= _ONE - _N
        cum /= cum[-1] / (_ONE - _N)
        np.floor(cum, out=cum)
        cum += np.arange(1, _N + 1)[:, None]
        self.pairs[1:].real = cum
        self.pairs[:-1].imag = (cum - self.cum[:-1]) * _SHARE[:-1, None]
        self.ends[:] = cum[3::4]
        self.fours[:-1] = (cum[0::4] + cum[1::4] * _WORD).astype(np.uint64)
        self.fours[:-1] += (cum[2::4] + cum[3::4] * _WORD).astype(np.uint64) << np.uint64(32)
        self.fours[:-1] |= _HIGH

    def group(self, value: np.ndarray) -> np.ndarray:
        """The group (or the candidate, _N) that holds a value of 0 to 4096: the number of ends up to it."""
        value = value.astype(np.int16)
        group = (self.ends <= value).view(np.uint8).sum(0, dtype=np.uint8).astype(np.int64)
        four = self.fours.take(group * self.n + self.lane, mode="clip")
        value += 1
        four -= value.astype(np.uint64) * _EACH
        four &= _HIGH  # an end above the value
        group += 1
        group *= 4
        group -= np.bitwise_count(four)
        return group

    def chances(self) -> None:
        """Odds, out of 4096, that the candidate is wrong, for every state."""
        def estimate(s):
            return _STRETCH.take((s[1] * 2 + 1) * _ONE // ((s[0] + s[1]) * 2 + 2))

        by2 = self.seen.sum(2)
        self.s2, self.s1, self.s0 = estimate(by2), estimate(self.seen.sum(1)), estimate(by2.sum(1))
        w2, w1, w0 = self.weights
        dot = (w2 * self.s2 >> 16)[:, None] + (w1 * self.s1 >> 16) + (w0 * self.s0 >> 16)
        self.hit = _SQUASH.take(dot.clip(-2047, 2047) + 2048).clip(16, _ONE - 16)
        self.miss = (_ONE - self.hit).astype(np.float32)

    def renew(self, cells: np.ndarray, states: np.ndarray) -> None:
        """Take in the ids since the last renewal: groups and states by lane (``states`` is used up)."""
        n = self.n
        np.add(states, _STATES * n, out=states, where=cells >= _N * n)  # those of hits behind those of misses
        self.counts += np.bincount(cells.reshape(-1), minlength=(_N + 1) * n)[:_N * n].reshape(_N, n) * 24.0
        new = np.bincount(states.reshape(-1), minlength=2 * _STATES * n).reshape(2, 4, 8, n)
        err = new[1] * _ONE - (new[0] + new[1]) * self.hit
        by2 = err.sum(1)
        step = np.stack([(by2 * self.s2).sum(0), (err.sum(0) * self.s1).sum(0), by2.sum(0) * self.s0])
        self.weights = (self.weights + (step >> 12)).clip(-200_000, 200_000)
        self.seen += new
        self.odds()
        self.chances()


def _store(table: np.ndarray, at: np.ndarray, was: np.ndarray, coded: np.ndarray) -> None:
    """What a table predicts from now on; ``coded`` is id << 2."""
    k = was ^ coded
    np.minimum(k.view(np.uint32), 4, out=k.view(np.uint32))
    k = _NEXT.take(k, mode="clip")
    k |= coded
    table[at] = k


def _slots(c1: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the last two ids and of the last (32-bit products, top bits)."""
    h1, h2 = c1 * np.uint32(0x9E3779B1), c2 * np.uint32(0x85EBCA77)
    h2 += h1
    h2 >>= np.uint32(33 - SLOTS2.bit_length())
    h1 >>= np.uint32(33 - SLOTS1.bit_length())
    return h2, h1


def _look(e2: np.ndarray, e1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State and candidate."""
    k2, k1 = e2 & 3, e1 & 3
    candidate = np.where(k2, e2, e1)
    candidate >>= 2
    k2 <<= 2
    k2 |= k1
    k2 <<= 1
    k2 |= (e2 ^ e1).view(np.uint32) < 4
    return k2, candidate


def _spans(longest: int, most: int):
    """(begin, end, the last renewal, whether one follows) of the runs of ids, ``most`` at once."""
    cuts = [0, *(t for t in RENEWALS if t < longest), longest]
    for begin, end in zip(cuts, cuts[1:]):
        for t in range(begin, end, most):
            yield t, min(t + most, end), begin, t + most >= end and end < longest


def encode(blocks: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Code the first ``lengths[i]`` ids of each row (uint16) of ``blocks``."""
    if len(blocks) == 0:
        return []
    lanes, longest = len(blocks), int(lengths.max())
    m = _Model(lanes)
    low, size = np.zeros(lanes), np.full(lanes, 2.0 ** 48)
    width = longest * 2 + 8
    out = np.zeros(lanes * width, dtype=np.int32)  # 16 bits and a carry
    at = m.lane * width
    every = np.zeros((longest + 2, lanes), dtype=np.uint16)
    every[2:] = blocks[:, :longest].T
    states, cells = np.empty((2, _LONGEST, lanes), dtype=np.int64)
    for begin, end, since, renewal in _spans(longest, STEPS):
        ids = every[begin:end + 2].astype(np.uint32)
        slot2, slot1 = _slots(ids[1:-1], ids[:-2])
        slot2, slot1 = slot2 + m.at2, slot1 + m.at1
        now = ids[2:].view(np.int32)
        coded = now << 2
        e2, e1 = np.empty_like(now), np.empty_like(now)
        for t in range(end - begin):
            m.t2.take(slot2[t], out=e2[t], mode="clip")
            m.t1.take(slot1[t], out=e1[t], mode="clip")
            _store(m.t2, slot2[t], e2[t], coded[t])
            _store(m.t1, slot1[t], e1[t], coded[t])
        state, candidate = _look(e2, e1)
        hit = candidate == now
        state = np.multiply(state, lanes, out=states[begin - since:end - since])
        state += m.lane
        miss = m.miss.take(state, mode="clip").astype(np.float64)
        group = _GROUP.take(now, mode="clip")
        np.copyto(group, _N, where=hit)
        cell = cells[begin - since:end - since]
        np.multiply(group, lanes, out=cell)
        cell += m.lane
        pair = m.pairs.take(cell, mode="clip")
        below, part = miss * pair.real, np.abs(miss - hit * float(_ONE))
        part *= pair.imag
        inner = now - _FIRST.take(group, mode="clip")
        inner[hit] = 0
        ended = lengths <= np.arange(begin, end)[:, None]
        if ended[-1].any():
            below[ended], part[ended], inner[ended] = 0, 2.0 ** 24, 0
        for t in range(end - begin):
            size *= 2.0 ** -24
            np.floor(size, out=size)
            low += size * below[t]
            size *= part[t]
            np.floor(size, out=size)
            low += size * inner[t]
            go = size < _SHORT
            word = low * 2.0 ** -32
            np.floor(word, out=word)
            out[at] = word
            at += go
            word *= go
            word *= _SHORT
            low -= word
            shift = _SHIFT.take(go.view(np.int8), mode="clip")
            low *= shift
            size *= shift
            lane = np.flatnonzero(size < _SHORT)
            while len(lane):
                word = np.floor(low[lane] * 2.0 ** -32)
                out[at[lane]] = word
                at[lane] += 1
                low[lane] = (low[lane] - word * _SHORT) * _WORD
                size[lane] *= _WORD
                lane = lane[size[lane] < _SHORT]
        if renewal:
            m.renew(cells[:end - since], states[:end - since])
    out[at] = np.ceil(low * 2.0 ** -32)  # all words behind it are zero
    at += 1
    used = at - m.lane * width
    out = out.reshape(lanes, width)[:, :used.max()]
    words = out.astype("<u2")
    for i in range(lanes):
        where = np.flatnonzero(out[i] >> 16)
        while len(where):  # a carry that fills the word before goes on
            where = where[where > 0] - 1
            words[i, where] += np.uint16(1)
            where = where[words[i, where] == 0]
    return [words[i, :n].tobytes() for i, n in enumerate(used.tolist())]


def decode(payloads: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The blocks again: rows of uint16, zero behind each length.

    A damaged block gives ids of no meaning, and so does, inside, a lane behind its length
    (of any size: tables are read at clipped places).
    """
    lanes = len(payloads)
    longest = int(lengths.max()) if lanes else 0
    if longest == 0:
        return np.zeros((lanes, 0), dtype=np.uint16)
    m = _Model(lanes)
    words = max(len(p) for p in payloads) // 2 + 4
    data = np.zeros((lanes, words), dtype=np.uint16)
    for i, p in enumerate(payloads):
        data[i, :len(p) // 2] = np.frombuffer(p, "<u2")
    code = data[:, 0] * 2.0 ** 32 + data[:, 1] * 2.0 ** 16 + data[:, 2]
    data, at = data.reshape(-1), m.lane * words + 3
    size = np.full(lanes, 2.0 ** 48)
    out = np.zeros((longest, lanes), dtype=np.uint16)
    states, cells = np.empty((2, _LONGEST, lanes), dtype=np.int64)
    c1 = c2 = np.zeros(lanes, dtype=np.uint32)
    with np.errstate(all="ignore"):
        for begin, end, since, renewal in _spans(longest, longest):
            for t in range(begin, end):
                slot2, slot1 = _slots(c1, c2)
                slot2, slot1 = slot2 + m.at2, slot1 + m.at1
                e2, e1 = m.t2.take(slot2, mode="clip"), m.t1.take(slot1, mode="clip")
                state, candidate = _look(e2, e1)
                state = np.multiply(state, lanes, out=states[t - begin])
                state += m.lane
                size *= 2.0 ** -24
                np.floor(size, out=size)
                miss = size * m.miss.take(state, mode="clip")
                value = code / miss
                np.minimum(value, _ONE, out=value)
                group = m.group(value)
                hit = value == _ONE
                cell = np.multiply(group, lanes, out=cells[t - begin])
                cell += m.lane
                pair = m.pairs.take(cell, mode="clip")
                code -= miss * pair.real
                size *= hit * float(_ONE)
                size -= miss
                np.abs(size, out=size)
                size *= pair.imag
                np.floor(size, out=size)
                inner = code / size
                np.floor(inner, out=inner)
                code -= inner * size
                inner += _FIRST.take(group, mode="clip")
                ids = inner.astype(np.int32)
                np.copyto(ids, candidate, where=hit)
                go = size < _SHORT
                shift = _SHIFT.take(go.view(np.int8), mode="clip")
                code *= shift
                size *= shift
                code += data.take(at, mode="clip") * go
                at += go
                lane = np.flatnonzero(size < _SHORT)
                while len(lane):
                    code[lane] = code[lane] * _WORD + data.take(at[lane], mode="clip")
                    at[lane] += 1
                    size[lane] *= _WORD
                    lane = lane[size[lane] < _SHORT]
                out[t] = ids
                c2, c1 = c1, ids.view(np.uint32)
                ids = ids << 2
                _store(m.t2, slot2, e2, ids)
                _store(m.t1, slot1, e1, ids)
            if renewal:
                m.renew(cells[:end - begin], states[:end - begin])
    out = np.ascontiguousarray(out.T)
    out[np.arange(longest) >= lengths[:, None]] = 0
    return out


def pack(ids: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Payload and checksum of each block of a run of ids (below 65536)."""
    if len(ids) == 0:
        return [], []
    n = -(-len(ids) // BLOCK)
    padded = np.zeros(n * BLOCK, dtype=np.uint16)
    padded[:len(ids)] = ids
    blocks = padded.reshape(n, BLOCK)
    lengths = np.full(n, BLOCK)
    lengths[-1] = len(ids) - (n - 1) * BLOCK
    payloads = [p for i in range(0, n, LANES) for p in encode(blocks[i:i + LANES], lengths[i:i + LANES])]
    return payloads, [zlib.crc32(b[:k].astype("<u2").tobytes()) for b, k in zip(blocks, lengths)]


def unpack(payloads: list[bytes], checks: list[int], lengths: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks, end to end; a damaged block is an error."""
    parts = []
    for i in range(0, len(payloads), LANES):
        k = lengths[i:i + LANES]
        blocks = decode(payloads[i:i + LANES], k)
        for row, n, check in zip(blocks, k.tolist(), checks[i:i + LANES]):
            part = row[:n]
            if zlib.crc32(part.astype("<u2").tobytes()) != check:
                raise ValueError("a block of token ids is damaged: its checksum differs")
            parts.append(part)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint16)
