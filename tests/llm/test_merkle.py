import hashlib
import os
import sys
import zlib

sys.path.insert(0, os.path.dirname(__file__))

import pytest
from helpers import SCHEMA, docs, odd_rows

from adlens.llm import merkle as M


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def climb(nodes):
    """Root of a list of nodes, and the (left, right) siblings of each upwards."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            lo = p - p % 16
            paths[i].append(("".join(nodes[lo:p]), "".join(nodes[p + 1:lo + 16])))
        nodes = [h("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return nodes[0], paths


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    first = lambda x: (x is not None, x)
    groups = {}
    for r in rows:
        text = r[4]
        if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(r[1], []).append((first(r[0]), leaf(r), leaf((*r[:4], text)), r[0]))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {s: climb([x[1] for x in sorted(groups[s])]) for s in names}
    root, over = climb([trees[s][0] for s in names]) if names else (None, [])
    out = []
    for s, above in zip(names, over):
        for row, path in zip(sorted(groups[s]), trees[s][1]):
            path = path + above
            at = row[2]
            for left, right in path:
                at = h(left + at + right)
            out.append((row[3], row[1], trees[s][0], root, h("".join(a + b for a, b in path)), at, at == root))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in M.tamper_check(df).collect()), key=str)


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 32)  # many windows for one source


def test_proofs(spark, small_blocks):
    rows = [(i * 3, f"src{i % 3}" if i % 2 else "hot", "en", i, f"Text {i} of ÉCOLE") for i in range(700)]
    rows += [(5000 + i, f"one{i:02d}", None, None, "Lone" if i else None) for i in range(20)] + [(1, None, "é", 3, "NULL source")]
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], SCHEMA).repartition(5)
    got = run(df)
    assert got == plain(rows)
    assert {r[6] for r in got} == {True, False}
    assert all(r[6] for r in got if zlib.crc32(str(r[0]).encode()) % 5)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 257])
def test_last_runs(spark, n):
    rows = [(i, "a", "en", 1, f"t{i}") for i in range(n)]
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], SCHEMA)
    assert run(df) == plain(rows)


def test_odd_rows(spark):
    df = docs(spark, odd_rows(), grp="x", pos=1, n=2, digest="d", left="l", right="r", path="p", part=3, idx=4, root="z")
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in df.collect()]
    assert run(df.repartition(3)) == plain(rows)
    assert run(df.limit(0)) == []


def test_only_the_tampered_fail(spark):
    text = "x" * 10
    df = docs(spark, [(i, text) for i in range(40)])  # nothing to lower-case
    assert all(r[6] for r in run(df))


def test_leaf_names_every_field(spark):
    # the same characters in other fields, or an empty text for a null one, give other leaves
    rows = [(1, "ab", "c", 1, "t"), (1, "a", "bc", 1, "t"), (1, "a", "bc", 1, None), (1, "a", "bc", 1, "")]
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], SCHEMA)
    assert len({r[1] for r in run(df)}) == 4
