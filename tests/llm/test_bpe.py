"""Encoding against tiktoken: several chunks, words of any length, odd texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from lodestone.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_equals_tiktoken_over_chunks(spark):
    r = random.Random(4)
    ranks = bpe.load_ranks(PATH)
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    letters = "abcdefgehinrst" * 3 + "éßñüç中文"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    texts = [None, "", " ", "\n\n  x", "a  b\t\tc", "it's 12345 o'clock!!", "<|endoftext|>", "x y\x1cz", "퟿\U0001f600 \U0001f600́"]
    texts += [word(n) for n in (1, 63, 64, 65, 200, 1000, 5000, 9000)] + ["a" * 20_000, "中" * 3000, " " * 500, "-" * 700, "the" * 900]
    texts += [" ".join(word(r.randint(1, 14)) for _ in range(r.randint(1, 60))) for _ in range(300)]
    rows = [(i if i % 50 else None, t, "chunk") for i, t in enumerate(texts)] + [(5, texts[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    found = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, chunk_bytes=4000).collect()
    expected = []
    for doc_id, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        expected.append((doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256, x.ids) for x in found), key=key) == sorted(expected, key=key)
    assert bpe.encode_documents(docs.limit(0), ranks, public_tokenizers.PATTERN).collect() == []


def test_parts_hold_whole_words():
    ranks = bpe.load_ranks(PATH)
    held, pairs = bpe.inner_pairs(ranks), bpe.pair_ranks(ranks)
    r = random.Random(2)
    for _ in range(200):
        word = bytes(r.choice(b"aeiourst\xc3\xa9\xe4\xb8\xad") for _ in range(r.randint(1, 80)))
        parts = bpe.parts_of(word, held)
        assert b"".join(parts) == word and sum((bpe.merge(p, ranks, pairs) for p in parts), []) == bpe.merge(word, ranks, pairs)


def test_numbers_are_joined_by_parts():
    numbers = np.random.default_rng(0).integers(0, bpe.WORDS, 10_000).astype("<u4")
    planes = numbers.view(np.uint8).reshape(-1, 4).T.copy()
    for start, stop in ((0, 0), (0, 1), (17, 4000), (9_999, 10_000), (0, 10_000)):
        assert (bpe.joined(planes, start, stop) == numbers[start:stop]).all()
