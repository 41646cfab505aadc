import sys
import os

sys.path.insert(0, os.path.dirname(__file__))

import pyarrow as pa
from helpers import LOWER, words

from adlens.llm.textkit import chunks, shingles

TEXTS = ["", None, "A b c D e", "a b  c\td\x0be", "one", "two  ", "x y z", "é é é é é", "a b c d a b c d", "w" * 700 + " q"]


def test_words_and_chunks():
    for size in (1, 7, 1 << 20):
        got = []
        for c in chunks(pa.array(TEXTS), size):
            starts, ends, text = c.words()
            per = [[] for _ in range(c.n)]
            for s, e, t in zip(starts, ends, text):
                per[t].append(c.data[s:e].tobytes().decode())
            got += per
        assert got == [words(t) for t in TEXTS]


def test_shingles_are_sets_of_word_runs():
    for width in (1, 3, 4):
        for size in (5, 1 << 20):
            sets = []
            for c in chunks(pa.array(TEXTS), size):
                h, at, _ = shingles(c, width)
                sets += [tuple(h[at[i]:at[i + 1]]) for i in range(c.n)]
            plain = []
            for t in TEXTS:
                w = words((t or "").translate(LOWER))
                plain.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width
                             else {tuple(w)} if w else set())
            assert [len(s) for s in sets] == [len(p) for p in plain]
            for i in range(len(TEXTS)):
                for j in range(len(TEXTS)):
                    assert len(set(sets[i]) & set(sets[j])) == len(plain[i] & plain[j])
