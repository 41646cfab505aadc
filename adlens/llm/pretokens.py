"""Pre-token boundaries of byte-level BPE, found for many texts at once.

The public pattern cuts a text into contractions, runs of letters, numbers or
other characters (each with at most one leading blank), and white space.  The
tokens tile the text, so a boolean array of token starts says everything; it
is built from the runs of equal character class with array operations.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from .textkit import Chunk

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: The code points of the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028,
               0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Character class of every code point."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)),
                        dtype=np.uint8, count=0x110000)
    table[WHITE_SPACE] = _SPACE
    return table


def boundaries(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens of a chunk (with the end as last entry),
    and for each text the number of its first pre-token (one more at the end)."""
    text = chunk.data.tobytes().decode("utf-8")
    cp = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    n = len(cp)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(chunk.n + 1, np.int64)
    wide = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.empty(n + 1, dtype=np.int64)
    at[0] = 0
    np.cumsum(wide, out=at[1:])
    text_at = np.searchsorted(at, chunk.offsets)  # code point at which each text begins
    edge = np.zeros(n + 1, dtype=bool)
    edge[text_at] = True
    edge[n] = True

    kind = classes()[cp]
    cut = np.empty(n, dtype=bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut |= edge[:n]
    run = np.flatnonzero(cut)
    stop = np.append(run[1:], n)
    cls = kind[run]
    last = edge[stop]  # the run ends its text
    blank = cls == _SPACE
    # a blank right before a run of the same text goes with that run
    gives = blank & ~last & (cp[stop - 1] == 0x20)
    takes = np.zeros(len(run), dtype=bool)
    takes[1:] = gives[:-1]

    start = np.zeros(n + 1, dtype=bool)
    start[run[~blank] - takes[~blank]] = True
    long = stop - run >= 2
    start[run[blank & (last | long | ~gives)]] = True
    start[stop[blank & ~last & ~gives & long] - 1] = True

    # contractions: a lone apostrophe, no blank taken, letters right behind
    q = np.flatnonzero((cls == _OTHER) & (stop - run == 1) & ~takes & ~last & (cp[run] == 0x27))
    q = q[cls[q + 1] == _LETTER] if len(q) else q
    for i in q:
        a, b = int(run[i + 1]), int(stop[i + 1])
        head = text[a:min(a + 2, b)]
        size = 1 if head[:1] in ("s", "t", "m", "d") else 2 if head in ("re", "ve", "ll") else 0
        if size:
            start[a] = False
            if a + size < b:
                start[a + size] = True
    begin = np.flatnonzero(start[:n])
    return np.append(at[begin], at[n]), np.searchsorted(begin, text_at)
