import os
import random
import subprocess
import sys

sys.path.insert(0, os.path.dirname(__file__))

import pytest
from helpers import LOWER, docs, odd_rows, words

from adlens.llm import ngramjoin
from adlens.llm.components import components


def sets_of(texts, width):
    out = []
    for t in texts:
        w = words((t or "").translate(LOWER))
        out.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width
                   else {tuple(w)} if w else set())
    return out


def plain_groups(rows, width, percent):
    """All pairs, union-find; smallest id of each component."""
    s = sets_of([r[1] for r in rows], width)
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both) and s[j]:
                top[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(s[i]), min(ids, default=None) if s[i] else r[0]))
    return sorted(map(str, out))


def family(rng, size, length, rate, first):
    """A text and copies with words changed, dropped and added."""
    vocab = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
    base = [rng.choice(vocab) for _ in range(length)]
    rows = []
    for i in range(size):
        w = list(base)
        for _ in range(rng.randint(0, max(1, int(length * rate)))):
            k = rng.randrange(len(w))
            w[k:k + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
        rows.append((first + i, " ".join(w)))
    return rows


def got(df, width, percent):
    return sorted(str(tuple(r)) for r in ngramjoin.near_groups(df, width, percent).collect())


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_groups_match_all_pairs(spark, monkeypatch, width, percent):
    rng = random.Random(width)
    rows = []
    for k, (size, length) in enumerate([(60, 60), (40, 200), (30, 20), (30, 12), (25, 8), (20, 5), (10, 900)]):
        rows += family(rng, size, length, 0.04, 1000 * (k + 1))
    passage = " ".join(f"common{i}" for i in range(50))  # shared by texts that do not link
    rows += [(9000 + i, passage + " " + " ".join(f"own{i}x{j}" for j in range(rng.randint(10, 60)))) for i in range(40)]
    rng.shuffle(rows)
    # small blocks, so that members of one leader meet across blocks too
    monkeypatch.setattr(ngramjoin, "MEMBERS", 9)
    assert got(docs(spark, rows).repartition(5), width, percent) == plain_groups(rows, width, percent)


def test_odd_rows(spark):
    rows = [r[:2] for r in odd_rows()]
    df = docs(spark, rows, list="x", row=1, rep=2, goals="g", node=3)
    assert got(df, 4, 85) == plain_groups(rows, 4, 85)
    assert got(df.limit(0), 4, 85) == []


def kept(df):
    return sorted(str((r["doc_id"], r["text"])) for r in ngramjoin.keep_one(df).collect())


def test_keep_one(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (9, "quite another text of its own"), (9, "one more of equal id"),
            (None, "no id"), (None, "no id"), (4, None), (6, "")]
    df = docs(spark, rows, rows=1, first=2, hash=3, doc="d", id=7, n=8, k1=9, its_id=10)
    assert ngramjoin.keep_one(df).columns == ["doc_id", "text", "lang", "source", "n_chars", "rows", "first", "hash", "doc", "id", "n", "k1", "its_id"]
    # unlike texts of one id both stay; of equal rows one
    assert kept(df) == sorted(map(str, [(3, "a b c d e f g"), (9, "quite another text of its own"), (9, "one more of equal id"),
                                        (None, "no id"), (4, None), (6, "")]))


def test_keep_one_names_rows_not_ids(spark):
    same, other = "one two three four five six seven", "a text unlike the first one in every word"
    for rows, want in (
            ([(9, same), (9, other)], [(9, same), (9, other)]), ([(9, same), (9, same)], [(9, same)]),
            ([(9, same), (9, other), (2, other)], [(9, same), (2, other)]), ([(None, same), (None, other)], [(None, same), (None, other)]),
            ([(None, same), (None, same)], [(None, same)]), ([(None, same), (8, same)], [(8, same)]),
            ([(9, ""), (9, None), (9, same), (None, "")], [(9, ""), (9, None), (9, same), (None, "")]),
            ([(9, same.upper()), (9, same)], None)):
        got = kept(docs(spark, rows).repartition(2))
        assert got == (sorted(map(str, want)) if want else got) and len(got) == len(want or [1])


def test_keep_one_of_many_without_ids(spark):
    rows = [(None, " ".join(f"t{i // 4}w{k}" for k in range(30)) + (f" end{i % 4}" if i % 2 else "")) for i in range(80)]
    got = kept(docs(spark, rows).repartition(3))
    assert len(got) == 20 and len({x.split("w0")[0] for x in got}) == 20


def test_rows_without_ids_meet_their_own_goals_only(spark, monkeypatch):
    """Pairs of near copies, none with an id: as many rows come out of the join of texts and goals as there are goals."""
    rows = [(None, " ".join(f"t{i // 2}w{k}" for k in range(30)) + (" end" if i % 2 else "")) for i in range(3000)]
    seen, texts_of = [], ngramjoin._texts_of

    def spy(df, goals, width):
        out = texts_of(df, goals, width).cache()
        seen.append((goals.count(), out.count()))
        return out

    monkeypatch.setattr(ngramjoin, "_texts_of", spy)
    assert len(kept(docs(spark, rows).repartition(4))) == 1500
    assert seen == [(3000, 3000)]


@pytest.mark.parametrize("far", [0, 1, 25])
def test_blocks_meet_where_members_are_unlinked(spark, monkeypatch, far):
    """One large family in many blocks, of which ``far`` members are too far from each other's leader."""
    rng = random.Random(far)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base + [f"own{i}"])) for i in range(150)]
    for i in range(far):
        w = list(base)
        for k in rng.sample(range(120), 4):
            w[k] = f"far{i}x{k}"
        rows.append((500 + i, " ".join(w)))
        rows.append((600 + i, " ".join(w + ["more"])))
    monkeypatch.setattr(ngramjoin, "MEMBERS", 9)
    assert got(docs(spark, rows).repartition(3), 4, 85) == plain_groups(rows, 4, 85)


def test_sets_are_dealt_in_few_bytes(spark, monkeypatch):
    """Families of prose go to their goals in fewer bytes than their shingles take, texts of long
    words as their shingles, and texts that come from compressed bytes give the sets of the texts."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for k in range(12):
        base = [rng.choice(vocab) for _ in range(500)]
        for i in range(10):
            w = list(base)
            w[rng.randrange(500)] = f"Own{i}\u00e9"
            rows.append((100 * k + i, " ".join(w)))
    passage = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(40))
    rows += [(5000 + i, f"{passage} end{i % 5}") for i in range(10)]
    links, dealt, seen = ngramjoin._links, ngramjoin._dealt, []

    def spy(read, width):
        out = dealt(read, width).cache()
        for r in out.collect():
            seen.append((r["packed"], len(r["data"]), r["node"]))
        return out

    def spy_links(docs_, info, *rest):
        sizes.update((r["row"], r["n"]) for r in info.collect())
        return links(docs_, info, *rest)

    sizes = {}
    monkeypatch.setattr(ngramjoin, "_dealt", spy)
    monkeypatch.setattr(ngramjoin, "_links", spy_links)
    monkeypatch.setattr(ngramjoin, "CHUNK_BYTES", 9000)
    assert got(docs(spark, rows).repartition(3), 4, 85) == plain_groups(rows, 4, 85)
    assert {packed for packed, *_ in seen} == {True, False}
    assert all(size <= 8 * sizes[node] for _, size, node in seen)
    assert sum(size for _, size, _ in seen) < 0.6 * sum(8 * sizes[node] for *_, node in seen)


def test_size_classes_cover_every_pair():
    for percent in (50, 80, 85, 95):
        c = ngramjoin.Classes.of(percent, 10_000)
        for n in (1, 2, 3, 7, 50, 333, 5000):
            k = max(i for i, low in enumerate(c.low) if low <= n)
            most = n * 100 // percent
            assert most < c.low[k + 2]
            if c.blocks[k + 1]:
                differ = (100 - percent) * (n + min(most, c.low[k + 2] - 1)) // (100 + percent)
                assert c.blocks[k + 1] - c.spare[k + 1] > differ


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (12, 11), (12, 13), (20, 20)] + [(100, 100 + i) for i in range(1, 50)] \
        + [(i, i + 1) for i in range(500, 560)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10} | {100 + i: 100 for i in range(50)} | {i: 500 for i in range(500, 561)}
    assert got == want


def test_python_workers_do_not_hold_pandas():
    """What a worker of the join imports; pandas takes about 50 MB of each worker's memory."""
    found = subprocess.run([sys.executable, "-c", "import sys, adlens.llm.ngramjoin; print('pandas' in sys.modules)"],
                           cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), capture_output=True, text=True)
    assert found.stdout.strip().endswith("False"), found.stderr


def test_sets_are_dealt_out_in_bounded_batches(spark, monkeypatch):
    rows = family(random.Random(8), 60, 80, 0.2, 0)
    want = plain_groups(rows, 3, 80)
    monkeypatch.setattr(ngramjoin, "DEALT_BYTES", 700)
    sizes = []
    map_batches = ngramjoin.map_batches

    def watched(df, function, schema):
        if function.__name__ != "deal":
            return map_batches(df, function, schema)
        batches = df.toArrow().combine_chunks().to_batches()
        sizes.extend(sum(map(len, b.column(4).to_pylist())) for b in function(iter(batches)))
        return map_batches(df, function, schema)

    monkeypatch.setattr(ngramjoin, "map_batches", watched)
    assert got(docs(spark, rows), 3, 80) == want
    assert len(sizes) > 5 and max(sizes) < 700 + 80 * 8
