import os
import sys
import zlib

sys.path.insert(0, os.path.dirname(__file__))

import numpy as np
import pyarrow as pa
from helpers import docs, odd_rows

from adlens.llm import quality as Q
from adlens.llm.textkit import chunks

SF = "/root/testdata/sf0.1"


def features_one_by_one(text):
    """The features of one text without arrays: words, pairs, pieces."""
    c = next(chunks(pa.array([text])))
    return [sorted(b.tolist()) for b, _ in Q.features(c)]


def test_texts_do_not_mix():
    texts = ["one two two", "", "éé x", "  ", "a", "one two two"]
    c = next(chunks(pa.array(texts)))
    for bucket, owner in Q.features(c):
        assert (np.diff(np.sort(owner)) >= 0).all()
    for i, t in enumerate(texts):
        per = [sorted(b[o == i].tolist()) for b, o in Q.features(c)]
        assert per == (features_one_by_one(t) if t else [[], [], []])
    per = features_one_by_one("one two two")
    assert [len(x) for x in per[:2]] == [3, 2] and Q.REPEAT in per[1]


def test_scores_are_the_linear_form_of_shares():
    texts = ["one two two three", "", "x"]
    c = next(chunks(pa.array(texts)))
    m = Q.Model(np.random.default_rng(0).standard_normal(Q.BUCKETS), 0.3)
    z = [m.bias + float(share @ m.weights[names]) if len(names) else m.bias for names, share in Q.shares(c)]
    assert np.allclose(m.scores(c), 1 / (1 + np.exp(-np.array(z))))


def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.fit_on(d, labels, max_docs=2500)
    again = Q.fit_on(d.repartition(3), labels.repartition(5), max_docs=2500)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias
    held = labels.toPandas()
    held = held[[zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]]
    out = Q.score(d, model).toPandas().merge(held, on="doc_id")
    assert len(out) == len(held)
    right = (out.predicted == out.quality).mean()
    rank = out.score.rank()
    good = (out.quality == 1).sum()
    auc = (rank[out.quality == 1].sum() - good * (good + 1) / 2) / (good * (len(out) - good))
    assert right > 0.97 and auc > 0.99
    assert (out.predicted[out.quality == 1] == 1).mean() > 0.98  # clean documents stay


def test_odd_rows_and_missing_labels(spark):
    df = docs(spark, odd_rows(), score=1.0, predicted="x", label=5)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flat = Q.fit_on(df, none)
    rows = Q.score(df, flat).collect()
    assert len(rows) == len(odd_rows()) and all(r["score"] == 0.5 for r in rows)
    some = spark.createDataFrame([(1, 1), (2, 0), (3, None), (5, 0), (7, 1), (8, 0), (9, 1)], "doc_id long, quality int")
    model = Q.fit_on(df, some)
    rows = Q.score(df, model).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    bias = [r["score"] for r in rows if r["doc_id"] in (2, 3, 4)]
    assert len(set(bias)) == 1
    kept = Q.keep(df, model)
    assert kept.columns == df.columns
    assert kept.count() == sum(r["predicted"] for r in rows)
    assert Q.score(df.limit(0), model).collect() == [] and Q.keep(df.limit(0), model).collect() == []
