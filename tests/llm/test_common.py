"""Word scans, ids of the byte-pair encoder, permutations."""

import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from skald.llm import common, shards
from skald.llm.tokens import BytePairs, default_path

TEXTS = ["", None, " a  b ", "x", "A-b c1 é!", "\n", "日本 語", "end ", " start", "a" * 5000]


def test_words_equal_a_plain_split(split):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(" \t\nabC1-é日!") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for table, kind in ((common.ALNUM, "alnum"), (common.SPACED, "spaced")):
        raw, at = common.buffers(pa.array(texts))
        words = common.Words(raw, at, table)
        name = {}
        for i, t in enumerate(texts):
            plain = split(t, kind)
            a, b = words.at[i], words.at[i + 1]
            assert b - a == len(plain)
            for w, h, s, e in zip(plain, words.hash[a:b], words.start[a:b], words.end[a:b]):
                assert name.setdefault(w, h) == h
                assert bytes(raw[s:e]).decode().translate(str.maketrans("ABC", "abc")) == w.translate(str.maketrans("ABC", "abc"))
        assert len(set(name.values())) == len(name)


def test_buffers_of_slices():
    col = pa.array(["aa", None, "b", "cc"]).slice(1, 2)
    raw, at = common.buffers(col)
    assert (bytes(raw), at.tolist()) == (b"b", [0, 0, 1])


def test_byte_pairs_equal_the_tokenizer():
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(" \n\t'asdé日　 𝒳.!1") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|> x", "it's don't 'll we'", "x " + "y" * 3000 + " " * 50]
    plain = Tokenizer.from_file(default_path())
    plain.encode_special_tokens = True
    bpe = BytePairs(default_path())
    for _ in range(2):  # the second time from what has been learnt
        ids, at = bpe.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_forgetting_keeps_results():
    bpe = BytePairs(default_path())
    bpe.MOST = 8
    texts = [f"a b{i} c{i * 3}" for i in range(300)]
    first = bpe.encode(pa.array(texts))[0]
    assert np.array_equal(first, bpe.encode(pa.array(texts))[0])


def test_permutation_is_a_keyed_bijection():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        a, b = shards.permute(np.arange(n), n, 1), shards.permute(np.arange(n), n, 2)
        assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n))
        if n > 60:
            assert (a != b).any() and (a != np.arange(n)).any()
