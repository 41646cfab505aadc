import os
import sys
import zlib

sys.path.insert(0, os.path.dirname(__file__))

import numpy as np
import pyarrow as pa
from helpers import docs, odd_rows

from adlens.llm import toxicity as X
from adlens.llm.textkit import chunks

SF = "/root/testdata/sf0.1"
FIXED = X.Lexicon.of(np.unique(X._word_keys(X.WORDS[X.INSULT])))


def classes_of(text):
    out = np.concatenate([X.clauses(c, FIXED) for c in chunks(pa.array([text]))])[0]
    return {k: int(n) for k, n in zip(X.CLASSES, out) if n}


def test_clause_classes():
    cases = {
        "What an idiot.": {"insult": 1},
        "You are an IDIOT!!": {"insult_at_target": 1},
        "You are not an idiot": {"insult_negated": 1},
        "The witness said he was an idiot.": {"insult_reported": 1},
        "Trash### here": {"insult": 1},
        "I will kill you": {"threat": 1},
        "Nobody will kill you": {"threat_negated_or_reported": 1},
        "They said they will kill him": {"threat_negated_or_reported": 1},
        "We will kill the lights": {},
        "not now. idiot": {"insult": 1},
        "idiot\nnot idiot\nclown": {"insult": 2, "insult_negated": 1},
        "an idiotical trashcan": {},
        "": {},
    }
    for text, want in cases.items():
        assert classes_of(text) == want, text


def test_composition_equals_the_parts():
    table, kinds = X.composed()
    parts = (X._insult, X._threat, X._target, X._scope)
    rng = np.random.default_rng(0)
    for _ in range(500):
        state, each = 0, (0, 0, 0, 0)
        for x in rng.integers(0, X.END, rng.integers(0, 12)):
            state = table[state, x]
            each = tuple(f(s, x) for f, s in zip(parts, each))
        aside = each[3] in (1, 2)
        want = (5 if aside else 4) if each[1] == 3 else \
            ({1: 2, 2: 3}.get(each[3], 1 if each[2] else 0) if each[0] else -1)
        assert kinds[state] == want


def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    grammar = X.fit_on(d, labels)
    held = labels.toPandas()
    held = held[[zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]]
    out = X.score(d, grammar).toPandas().merge(held, on="doc_id")
    assert len(out) == len(held)
    caught = (out.predicted[out.toxic == 1] == 1).mean()
    wrong = (out.predicted[out.toxic == 0] == 1).mean()
    assert caught > 0.75 and wrong < 0.02  # a part of the toxic labels stands on harmless texts


def test_learned_arcs_explain_toxic_texts():
    keys = np.array([5, 5, 5, 7, 7, 9, 11], dtype=np.uint64)
    texts = np.array([1, 2, 3, 3, 4, 1, 2])
    # 5 explains 1, 2, 3; then 7 adds only 4; 9 and 11 add nothing
    assert X.choose(keys, texts, 4).tolist() == [5]


def test_odd_rows(spark):
    df = docs(spark, [*odd_rows(), (20, "you pathetic loser")], score=1, predicted=2, insult="x", label=3)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    grammar = X.fit_on(df, none)
    rows = X.score(df, grammar).collect()
    assert len(rows) == len(odd_rows()) + 1
    assert {r["doc_id"] for r in rows if r["predicted"]} == {20}
    some = spark.createDataFrame([(1, 0), (20, 1), (2, None), (5, 0), (3, 1)], "doc_id long, toxic int")
    assert X.score(df, X.fit_on(df, some)).count() == len(rows)
    assert X.score(df.limit(0), grammar).collect() == []
