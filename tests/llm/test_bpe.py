import base64
import hashlib
import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
import tiktoken
from helpers import docs, odd_rows

from adlens.llm import bpe
from adlens.llm.textkit import chunks

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(vocab, texts):
    codec, out = bpe.Codec(vocab), []
    for c in chunks(pa.array(texts, pa.string()), 4000):
        ids, at = codec.encode(c)
        assert vocab.decode(ids)[0].tobytes() == c.data.tobytes()
        out += [ids[at[i]:at[i + 1]].tolist() for i in range(c.n)]
    return out


def test_perfect_hash_is_minimal(vocab):
    assert sorted(vocab.hash.slot_key.tolist()) == list(range(len(vocab.ids)))
    for n in (0, 1, 2, 1000):
        keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        assert (bpe.PerfectHash(keys).find(keys) == np.arange(n)).all()


def test_same_ids_as_the_library(vocab, library):
    rng = random.Random(5)
    letters = " \n\t'sdtmrevlABC12!.,é中😀　\x1c\x85​\xa0"
    texts = ["", None, " ", "don't've", " 's", "\n's", "''s", "he'll 'Re", "a  \n b ", "x" * 3000, "ab" * 2000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert encoded(vocab, texts) == [library.encode_ordinary(t or "") for t in texts]


def test_every_character_falls_in_its_class(vocab, library):
    texts = [f"a{chr(i)}1{chr(i)}{chr(i)}" for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    assert encoded(vocab, texts) == [library.encode_ordinary(t) for t in texts]


def test_digests_and_columns(spark, library):
    df = docs(spark, odd_rows(), ids="a clashing column", n_tokens=1, raw="x")
    rows = bpe.digests(df, PATH).collect()
    want = []
    for i, text, *_ in odd_rows():
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    both = bpe.decode(bpe.encode(df, PATH), PATH, bytes_col="raw")
    assert set(both.columns) == {*df.columns}
    assert all(bytes(r["raw"]).decode() == (r["text"] or "") for r in both.collect())
    assert bpe.digests(df.limit(0), PATH).collect() == []


def test_unknown_ids_are_an_error(vocab):
    with pytest.raises(ValueError):
        vocab.decode(np.array([60_000]))
