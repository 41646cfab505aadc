import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))

import pytest
from helpers import docs, odd_rows, words
from pyspark.sql import functions as F

from adlens.llm import mixing as M


def shared_again(sizes):
    """The targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        goal = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if goal[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else goal[s] for s in order}
        full |= over


def corpus(seed, sources, per):
    rng = random.Random(seed)
    rows, i = [], 0
    for k, s in enumerate(sources):
        for _ in range(per[k]):
            rows.append((i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 60))), s))
            i += 1
    return rows


@pytest.mark.parametrize("sources,per", [
    (["a", "b", "c"], [50, 50, 50]),
    (["b", "Z", "é", "a", None], [200, 3, 10, 1, 5]),  # most sources are full
    (["a"], [20]),
])
def test_targets_are_met(spark, sources, per):
    rows = corpus(len(sources), sources, per)
    df = docs(spark, rows, place=1, target="x", stop=3, block=4, slot=5)
    out = M.plan(df, block=16).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    want = shared_again(size)
    source = {i: s for i, _, s in rows}
    taken = {s: 0 for s in want}
    assert len(out) == len(rows)
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == len(words(rows[r["doc_id"]][1])) and r["source_size"] == size[s]
        assert abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(want[s] - 16 - 0.5 <= taken[s] <= want[s] + 0.5 for s in want)  # within a block
    assert all(taken[s] > 0 for s in want if size[s])
    again = M.plan(df.repartition(5), block=16).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


SQRT2 = 116590752822205  # 2^48 * (sqrt(2) - 1), odd: another sequence of points


def scheduled_one_by_one(stops, block, step):
    """(place, block, slot) by walking through the slots."""
    need = {p: -(-s // block) for p, s in stops.items()}
    total, low, bounds = sum(need.values()), 0, {}
    for p in sorted(need):
        bounds[p] = (low * 2**48 // total, (low + need[p]) * 2**48 // total)
        low += need[p]
    have, rows = {p: 0 for p in need}, []
    for k in range(total):
        point = (k + 1) * step % 2**48
        p = next(p for p, (lo, hi) in bounds.items() if lo <= point < hi)
        if have[p] < need[p]:
            rows.append((p, have[p], k))
            have[p] += 1
    rest = sorted((b, p) for p in need for b in range(have[p], max(1, stops[p] // block)) if need[p])
    return rows + [(p, b, total + i) for i, (b, p) in enumerate(rest)]


@pytest.mark.parametrize("step", [M.STEP, SQRT2])
def test_schedule_is_the_walk_through_the_slots(spark, step):
    stops = {0: 1000, 1: 5, 2: 333, 3: 0, 4: 7777}
    goals = spark.createDataFrame(list(stops.items()), "place int, stop long")
    got = sorted(tuple(r) for r in M.schedule(goals, 10, step).select("place", "block", "slot").collect())
    assert got == sorted(scheduled_one_by_one(stops, 10, step))
    assert len({slot for _, _, slot in got}) == len(got)
    if step == M.STEP:  # low discrepancy: every prefix of the schedule is close to the shares
        first = [p for p, _, _ in sorted(got, key=lambda r: r[2])]
        for n in range(10, len(first)):
            assert abs(first[:n].count(4) - n * 778 / 913) < 4


def test_large_slots_have_exact_points(spark):
    slots = [0, 1, 2**24 - 1, 2**24, 2**39 + 12345]
    rows = spark.createDataFrame([(k,) for k in slots], "slot long")
    got = {r["slot"]: r["point"] for r in M.point_of(rows).collect()}
    assert got == {k: (k + 1) * M.STEP % 2**48 for k in slots}


def test_the_points_decide_what_is_taken(spark):
    rows = corpus(7, [f"s{i:02}" for i in range(24)], [3 + 5 * i % 17 for i in range(24)])
    df = docs(spark, rows)
    plans = [{r["doc_id"]: (r["taken"], r["target"]) for r in M.plan(df, block=16, step=step).collect()}
             for step in (M.STEP, SQRT2)]
    assert plans[0] != plans[1]
    assert {i: x[1] for i, x in plans[0].items()} == {i: x[1] for i, x in plans[1].items()}


def test_odd_rows(spark):
    out = M.plan(docs(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows())
    assert all(r["taken"] == 0 for r in out if r["size"] == 0)
    assert M.plan(docs(spark, odd_rows()).limit(0)).collect() == []


def test_whole_documents(spark):
    rows = corpus(4, ["a", "b", "c"], [40, 40, 4])
    df = docs(spark, rows, goal=1, bucket=2, copy=3, first=4, source_size=5)
    out = M.mix_documents(df)
    assert out.columns == df.columns
    copies = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").agg(F.count("*").alias("count")).collect()}
    assert max(copies.values()) <= 3
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    want, most = shared_again(size), max(len(words(t)) for _, t, _ in rows)
    for s in want:
        got = sum(copies.get(i, 0) * len(words(t)) for i, t, x in rows if x == s)
        assert want[s] - M.BLOCK - 0.5 <= got <= want[s] + most
    assert M.mix_documents(df.limit(0)).collect() == []
    assert M.mix_documents(docs(spark, odd_rows())).count() >= len(odd_rows()) - 9
