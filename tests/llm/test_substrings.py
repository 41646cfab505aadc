import hashlib
import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))

import pytest
from helpers import docs, odd_rows, words
from pyspark.sql import functions as F

from adlens.llm import substrings as S

NO_ID = 1 << 63


def plain(rows, window=50):
    all_words = [words(r[1]) for r in rows]
    ids = [NO_ID if r[0] is None else r[0] for r in rows]
    least = {}
    for i, w in zip(ids, all_words):
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            least[k] = min(least.get(k, NO_ID), i)
    out = []
    for r, i, w in zip(rows, ids, all_words):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if least[tuple(w[s:s + window])] < i:
                gone[s:s + window] = [True] * window
        out.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def run(df, window=50):
    out = S.drop_repeats(df, window=window).withColumn("text", F.coalesce("text", F.lit("")))
    return sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "text").collect()), key=str)


def passage(k, n):
    return [f"p{k}x{i}" for i in range(n)]


def own(i, n):
    return [f"d{i}y{j}" for j in range(n)]


def test_planted_passages(spark):
    rows = [(1, own(1, 30) + passage(0, 50) + own(2, 13)), (2, own(3, 7) + passage(0, 50)), (3, passage(0, 49) + own(4, 60)),
            (4, passage(0, 50)[1:] + own(5, 60)), (5, own(6, 3) + passage(1, 120)), (9, own(7, 41) + passage(1, 120)[20:95] + own(8, 9)),
            (6, passage(1, 120) + passage(1, 120)), (7, own(9, 200) + own(9, 200)), (8, own(6, 3) + passage(1, 60) + passage(0, 50))]
    rows = [(i, " \n".join(w)) for i, w in rows]
    got = run(docs(spark, rows).repartition(3))
    assert got == plain(rows)
    removed = {r[0]: r[2] for r in got}
    assert removed == {1: 0, 2: 50, 3: 0, 4: 0, 5: 0, 6: 240, 7: 0, 8: 113, 9: 75}


@pytest.mark.parametrize("window", [8, 9, 50])
def test_random_repeats(spark, window):
    rnd = random.Random(window)
    pool = [[f"{rnd.randrange(40)}" for _ in range(rnd.randrange(5, 200))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rnd.randrange(5)):
            p = rnd.choice(pool)
            a = rnd.randrange(len(p))
            w += p[a:a + rnd.randrange(150)] + own(i, rnd.randrange(12))
        rows.append((rnd.randrange(60) if i % 10 else None, rnd.choice([" ", "\t", " \r\n"]).join(w)))
    assert run(docs(spark, rows).repartition(4), window) == plain(rows, window)


def test_hot_group_of_copies(spark):
    text = " ".join(passage(3, 200))
    near = [(100 + i, " ".join(passage(3, 200)[:60 + i] + own(i, 1) + passage(3, 200)[61 + i:])) for i in range(60)]
    rows = [(i, text) for i in range(80)] + near + [(500 + i, " ".join(own(1000 + i, 80))) for i in range(60)]
    got = run(docs(spark, rows).repartition(6))
    assert got == plain(rows)
    assert all(r[2] == 0 for r in got if r[0] == 0 or r[0] >= 500)


def test_odd_rows(spark):
    rows = odd_rows() + [(20, odd_rows()[4][1]), (None, odd_rows()[4][1])]
    df = docs(spark, rows, id="clash", key="clash", hits=1, part=2, n_words="clash", n_removed="clash", spans="x")
    plain_rows = [(r[0], r[1]) for r in rows]
    assert run(df.repartition(3)) == plain(plain_rows)
    out = S.drop_repeats(df)
    assert set(out.columns) == set(df.columns)
    assert out.where("text is null").count() == sum(r[1] is None for r in rows)
    assert run(df.limit(0)) == []


def test_digests(spark):
    rows = [(1, " ".join(passage(0, 80))), (2, " ".join(own(0, 3) + passage(0, 80))), (3, None)]
    got = sorted(tuple(r) for r in S.digests(docs(spark, rows)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == [(1, 80, 0, sha(rows[0][1])), (2, 83, 80, sha(" ".join(own(0, 3)))), (3, 0, 0, sha(""))]


def test_answers_do_not_depend_on_the_broadcast(spark, monkeypatch):
    rows = [(i, " ".join(passage(i % 3, 70))) for i in range(12)]
    want = run(docs(spark, rows))
    import adlens.session as session
    monkeypatch.setattr(S, "checked_broadcast", lambda df, **k: session.checked_broadcast(df, max_bytes=0, **k))
    assert run(docs(spark, rows)) == want == plain(rows)
