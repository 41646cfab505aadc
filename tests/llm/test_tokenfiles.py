import os
import sys
import zlib

sys.path.insert(0, os.path.dirname(__file__))

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from helpers import docs, odd_rows
from tokenizers import Tokenizer

from adlens.llm import rangecoder as R
from adlens.llm import tokenfiles as T
from adlens.llm.textkit import chunks

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def there_and_back(ids):
    payloads, checks = R.pack(ids)
    sizes = np.array([min(R.BLOCK, len(ids) - i) for i in range(0, len(ids), R.BLOCK)])
    return payloads, checks, sizes


@pytest.mark.parametrize("ids", [
    np.zeros(0, int), np.array([5]), np.zeros(9000, int), np.full(5000, 65535), np.arange(4097),
    np.tile(np.arange(50), 300), np.random.default_rng(0).integers(0, 50257, 10_000),
    np.random.default_rng(1).zipf(1.3, 20_000) % 50257])
def test_round_trip(ids):
    payloads, checks, sizes = there_and_back(ids)
    assert (R.unpack(payloads, checks, sizes) == ids).all()
    # any block can be read alone
    for i in range(len(payloads)):
        alone = R.unpack(payloads[i:i + 1], checks[i:i + 1], sizes[i:i + 1])
        assert (alone == ids[i * R.BLOCK:(i + 1) * R.BLOCK]).all()


def test_predictable_ids_take_little():
    payloads, *_ = there_and_back(np.tile(np.arange(50), 300))
    assert sum(map(len, payloads)) < 15_000 * 2 / 20


def test_damage_is_found():
    ids = np.random.default_rng(2).integers(0, 50257, 6000)
    payloads, checks, sizes = there_and_back(ids)
    broken = bytearray(payloads[1])
    broken[40] ^= 4
    with pytest.raises(ValueError):
        R.unpack([payloads[0], bytes(broken)], checks, sizes)


def test_same_ids_as_the_library(library):
    texts = ["", None, "don't  stop\n\n now 's", "<|endoftext|> is text", "é中😀  x" * 9, "a" * 500, "don't"]
    codec, got = T.LibraryCodec(open(PATH, encoding="utf-8").read()), []
    for c in chunks(pa.array(texts, pa.string()), 40):
        ids, at = codec.encode(c)
        got += [ids[at[i]:at[i + 1]].tolist() for i in range(c.n)]
    assert got == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def want(library, rows):
    out, start = [], 0
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files(spark, library, monkeypatch):
    monkeypatch.setattr(T, "UNIT", 300)
    rows = [(i * 3 - 100, f"document {i} " + "word " * (i % 70)) for i in range(400)]
    df = docs(spark, rows, piece=1, unit=2, first=3, n=4, ids="x").repartition(6)
    files = T.write(df, PATH)
    got = sorted(tuple(r) for r in T.summary(files).collect())
    assert got == want(library, rows)
    ids = {r["doc_id"]: r["ids"] for r in T.read(files).collect()}
    assert all(ids[i] == library.encode(t, add_special_tokens=False).ids + [2] for i, t in rows)
    empty = T.write(df.limit(0), PATH)
    assert T.summary(empty).collect() == [] and T.read(empty).collect() == []


def test_odd_rows(spark, library):
    rows = [r[:2] for r in odd_rows()]
    got = T.summary(T.write(docs(spark, rows), PATH)).collect()
    plain = want(library, rows)
    assert sorted(str((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in got) == sorted(str((i, n, c)) for i, _, n, c in plain)
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted(
        [i for i, _ in rows], key=lambda i: (i is not None, i or 0))


def test_added_tokens(spark, library):
    import json
    with open(PATH, encoding="utf-8") as f:
        names = [t["content"] for t in json.load(f)["added_tokens"]]
    assert names
    texts = []
    for x in names:
        texts += [x, x + x, f"a{x}b", f" {x} ", f"{x}'s", f"don't{x}", f"{x[:-1]}", f"<{x}>", f"\n{x}\n\n{x} 12{x}34", f"é{x}字", f"{x} " * 40, "", "plain"]
    rows = list(enumerate(texts))
    want = [library.encode(t, add_special_tokens=False).ids + [T.END_ID] for t in texts]
    assert library.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]
    got = {r["doc_id"]: r["ids"] for r in T.read(T.write(docs(spark, rows).repartition(3), PATH)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_new_pre_tokens_go_to_the_library_many_at_once(library, monkeypatch):
    words = [f"w{i:x} é{i} {i}'s 　{i * i}\n\n\t ..{i}" for i in range(900)]
    texts = [" ".join(words[i:i + 30]) for i in range(0, 900, 30)] * 2
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for remembered in (T.REMEMBERED, 700):  # 700: forgotten again and again
        monkeypatch.setattr(T, "REMEMBERED", remembered)
        codec, given, got = T.LibraryCodec(open(PATH, encoding="utf-8").read()), [], []
        batch = codec.batch
        codec.batch = lambda x, **k: given.extend(x) or batch(x, **k)
        for c in chunks(pa.array(texts, pa.string()), 2000):
            ids, at = codec.encode(c)
            got += [ids[at[i]:at[i + 1]].tolist() for i in range(c.n)]
        assert got == want
        if remembered > 700:
            assert codec.n > 2000 and len(given) < codec.n / 10


def test_small_frequent_ids_take_less_than_their_group_of_256():
    ids = np.random.default_rng(3).choice([10, 90, 130, 200], 40_000, p=[.7, .1, .1, .1])
    payloads, checks, sizes = there_and_back(ids)
    assert sum(map(len, payloads)) < 40_000 * 3.2 / 8
    assert (R.unpack(payloads, checks, sizes) == ids).all()


def test_many_lanes_of_any_length():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 700, 300)
    blocks = (rng.zipf(1.2, (300, 700)) % 65536).astype(np.uint16)
    blocks[:60, 50:] = 65535
    got = R.decode(R.encode(blocks, lengths), lengths)
    for a, b, n in zip(blocks, got, lengths):
        assert (a[:n] == b[:n]).all() and not b[n:].any()


def test_noise_is_damage():
    rng = np.random.default_rng(5)
    payloads = [rng.bytes(2 * n) for n in range(40)] + [b"\xff" * 900]
    with pytest.raises(ValueError):
        R.unpack(payloads, [1] * len(payloads), np.full(len(payloads), 3000))
