import hashlib
import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

import numpy as np
from helpers import docs, odd_rows

from adlens.llm import fingerprints as P


def test_multiset_of_paragraphs():
    f = P._of(["", "a b\nc d", "c d\na b", "a b", "c d", "\n", "a b\na b", "x " * 9])
    assert P.render(P._take(f, [1])) == P.render(P._take(f, [2]))
    both = P.insert(P._take(f, [3]), P._take(f, [4]))
    assert P.render(both) == P.render(P._take(f, [1]))
    assert P.render(P.delete(both, P._take(f, [4]))) == P.render(P._take(f, [3]))
    assert len(set(P.render(f))) == 7  # only the reordered text is equal to another
    twice = P.insert(P._take(f, [3]), P._take(f, [3]))
    assert P.render(twice) == P.render(P._take(f, [6]))


def test_likeness_follows_the_share_kept():
    rng = np.random.default_rng(1)
    lines = [" ".join(f"w{rng.integers(10 ** 6)}" for _ in range(12)) for _ in range(300)]
    whole = "\n".join(lines[:200])
    for share in (0.25, 0.5, 0.75):
        k = int(200 * share)
        other = "\n".join(lines[:k] + lines[200:400 - k])
        f = P._of([whole, other])
        assert abs(P.likeness(P._take(f, [0]), P._take(f, [1]))[0] - share) < 0.15
    f = P._of([whole, "\n".join(lines[200:])])
    assert P.likeness(P._take(f, [0]), P._take(f, [1]))[0] < 0.25


def plain(rows):
    """Ascending id (null first), ties by text hash: compared one by one."""
    texts = [t or "" for _, t in rows]
    out = []
    for (i, _), t, x in zip(rows, texts, texts[1:] + texts[:1]):
        k = len(t) // 4
        edited = t[:len(t) - k] + x[:k]
        f = P._of([t, edited, x])
        a, b, c = (P._take(f, [j]) for j in range(3))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), P.render(a)[0], P.render(b)[0],
                    float(P.likeness(a, b)[0]), float(P.likeness(a, c)[0])))
    return sorted(map(str, out))


def test_edited_and_next(spark):
    rows = [(i * 7 - 50, f"text {i} " + "word " * (i % 13) + "\n" + "é" * (i % 5)) for i in range(300)]
    df = docs(spark, rows, fingerprint="x", near_next=2).repartition(7)
    got = sorted(str((r["doc_id"], *list(r)[1:])) for r in P.compare_edited(df).collect())
    assert got == plain(rows)
    assert P.compare_edited(df.limit(0)).collect() == []
    one = P.compare_edited(docs(spark, [(1, "only one")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_odd_rows(spark):
    rows = [r[:2] for r in odd_rows()]
    got = P.compare_edited(docs(spark, rows)).collect()
    assert sorted(str((r["doc_id"], r["n_chars"])) for r in got) == sorted(str((i, len(t or ""))) for i, t in rows)
    again = P.compare_edited(docs(spark, rows).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))  # ties are settled by the texts
    alone = {r["doc_id"]: r["fingerprint"] for r in P.fingerprint(docs(spark, rows)).collect() if r["doc_id"] != 7}
    assert all(alone[r["doc_id"]] == r["fingerprint"] for r in got if r["doc_id"] not in (7, None))
