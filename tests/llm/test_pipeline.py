import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))

import hashlib

import pytest
from helpers import docs, odd_rows

import corpus_pipeline as C
from adlens.llm import linededup as L
from adlens.llm import quality
from adlens.session import write_table
from test_linededup import plain as plain_lines
from test_ngramjoin import plain_groups

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_their_promise(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = d.columns, {"documents": d}
    for name, stage in C.STAGES:
        d = write_table(stage(spark, d, SF), f"test-{name}")
        seen[name] = d
        if name != C.STAGES[-1][0]:
            assert d.columns == columns and d.dtypes == seen["documents"].dtypes
    all_, good, lines, firsts, mixed, out = (
        [tuple(r) for r in x.collect()] for x in seen.values())
    # 1: exactly what the classifier rejects is gone
    model = quality.fit_on(seen["documents"], spark.read.parquet(f"{SF}/labels.parquet"))
    ok = {r["doc_id"] for r in quality.score(seen["documents"], model).collect() if r["predicted"] == 1}
    assert sorted(r for r in all_ if r[0] in ok) == sorted(good)
    # 2: line for line
    want = plain_lines([(r[0], r[1], r[3]) for r in good], L.RATIO, L.MIN_PAGES)
    cut = {r[0]: r for r in lines}
    assert sorted(str((r[0], r[1], r[3])) for r in lines) == sorted(str(eval(w, {})[:3]) for w in want)
    assert all(r[4] == len(r[1]) for r in lines)
    # 3: the smallest id of each group of near copies
    groups = [eval(x, {}) for x in plain_groups([(r[0], r[1]) for r in lines], 5, 80)]
    assert sorted(r[0] for r in firsts) == sorted(i for i, _, c in groups if i == c)
    assert all(cut[r[0]] == r for r in firsts)
    # 4: whole documents, three times at most, and only those of the stage before
    assert {r[0] for r in mixed} <= {r[0] for r in firsts}
    assert max(sum(r[0] == i for r in mixed) for i in {r[0] for r in mixed}) <= 3
    # 5: a row for every document of the mix
    assert sorted(r[0] for r in out) == sorted(r[0] for r in mixed)
    text = {r[0]: r[1] for r in mixed}
    assert all(r[3] == hashlib.sha256(text[r[0]].encode()).hexdigest() for r in out)


def test_run_equals_the_stages(spark):
    out = C.run(spark, SF).collect()
    again = C.run(spark, SF).collect()
    assert out and sorted(map(str, out)) == sorted(map(str, again))


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_odd_tables(spark, rows):
    d = docs(spark, rows or [(1, "x")], kept="a", size=3, _id="z")
    d = d if rows else d.limit(0)
    for name, stage in C.STAGES:
        d = write_table(stage(spark, d, SF), f"odd-{name}")
    assert d.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert (d.count() > 0) == bool(rows)

