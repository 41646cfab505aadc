import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.llm import ann as A

SF = "/root/testdata/sf0.1"


def table(spark, vectors, **extra):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


def exact(vectors, asked, k):
    """Brute force over the distinct valid rows of the usual length."""
    good = {}
    for i, v in vectors:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i, tuple(v)] = np.array(v, dtype=np.float32).astype(np.float64)
    size = max({len(v) for v in good.values()}, key=lambda n: sum(len(v) == n for v in good.values()), default=0)
    good = {i: v for (i, _), v in good.items() if len(v) == size}
    out = []
    for q in good:
        if asked(q):
            cos = {i: float(good[q] @ v / np.sqrt((good[q] @ good[q]) * (v @ v))) for i, v in good.items() if i != q}
            for r, i in enumerate(sorted(cos, key=lambda i: (-round(cos[i], 9), i))[:k]):
                out.append((q, r + 1, i, round(cos[i], 6)))
    return sorted(out)


def test_every_leaf_gives_exact_answers(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, v) for i, v in enumerate(np.round(rng.standard_normal((300, 6)), 3).tolist())]
    same = vectors[7][1]
    vectors += [(1000 + 10 * i, same) for i in range(40)]  # a crowd of copies, queries among them
    vectors += [(5000, None), (5010, []), (5020, [0.0] * 6), (5030, [1.0] * 5), (5040, [None] * 6),
                (5050, [float("nan")] * 6), (5060, [float("inf")] * 6), (None, [1.0] * 6), (0, vectors[0][1])]
    got = A.nearest(table(spark, vectors, point=1, query=2, rank="x", score="y"), F.col("vec_id") % 10 == 0,
                    leaf=16, leaves=10 ** 6)
    rows = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got.collect())
    assert rows == exact(vectors, lambda q: q % 10 == 0, 5)


def test_a_crowded_leaf_is_many_tasks(spark, monkeypatch):
    """Points and queries of one leaf beyond a block: every pair of blocks meets once."""
    monkeypatch.setattr(A, "BLOCK", 16)
    monkeypatch.setattr(A, "ASKED", 8)
    monkeypatch.setattr(A, "SLICE", 3)
    rng = np.random.default_rng(4)
    vectors = [(i, v) for i, v in enumerate(np.round(rng.standard_normal((120, 6)), 3).tolist())]
    got = A.nearest(table(spark, vectors), F.col("vec_id") % 2 == 0, leaf=1000)  # one leaf a tree
    rows = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got.collect())
    assert rows == exact(vectors, lambda q: q % 2 == 0, 5)


def test_few_rows(spark):
    for n in (0, 1, 3):
        vectors = [(i * 10, [1.0 + i, 2.0]) for i in range(n)]
        rows = A.nearest(table(spark, vectors), F.col("vec_id") % 10 == 0).collect()
        assert len(rows) == n * max(n - 1, 0)


@pytest.mark.parametrize("k", [5])
def test_recall(spark, k):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = A.nearest(df, F.col("vec_id") % 50 == 0, k=k).toPandas()
    p = df.toPandas()
    x = np.stack(p.embedding).astype(np.float64)
    ids = p.vec_id.to_numpy()
    u = x / np.sqrt((x * x).sum(1))[:, None]
    hit = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        s = u @ u[at]
        s[at] = -2
        top = set(ids[np.lexsort((ids, -s))[:k]])
        mine = got[got.query_id == ids[at]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, k + 1))
        hit, total = hit + len(top & set(mine.vec_id)), total + k
    assert hit / total >= 0.9


def test_trees_hold_every_point_once():
    x = np.repeat(np.random.default_rng(0).standard_normal((50, 4)).astype(np.float32), 4, axis=0)
    t = A.fit_tree(x, 1, 8)
    leaf = t.leaf_of(x)
    assert leaf.min() >= 0 and leaf.max() < t.leaves
    found = A.search([t], x[0], 10 ** 6)
    assert sorted(found) == [(0, i) for i in range(t.leaves)]
    assert found[0] == (0, leaf[0])
