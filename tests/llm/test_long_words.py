"""Words without a break, for which a fold would cost the square of their length."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken

from siftwall.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "long", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}
    )


def encoded(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()
    return {r.id: [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)] for r in got}


def test_unbroken_words(spark, library):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [
        "a" * 100_000,
        "".join(rng.choice(letters) for _ in range(100_000)),
        "".join(rng.choice("日本語中文字") for _ in range(5_000)) + " end",
        *("".join(rng.choice(letters + "éß") for _ in range(n)) for n in (510, 511, 512, 513, 1025)),
        "the same the same the same",
    ]
    assert encoded(spark, texts) == {k: library.encode_ordinary(t) for k, t in enumerate(texts)}


def test_heap_and_library_agree(library):
    ranks = byte_bpe.read_ranks(RANKS)
    first, second = byte_bpe.merge_tables(ranks)
    mask = (1 << 17) - 1
    merged = {(c >> 34, (c >> 17) & mask): c & mask for c in (*first, *second) if c >= 0}
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 60, 900, 20_000):
        for alphabet in ("a", "ab", "etaoinshr"):
            word = "".join(rng.choice(alphabet) for _ in range(n))
            start = [ranks[bytes([b])] for b in word.encode()]
            assert byte_bpe.merge_long(start, merged) == library.encode_ordinary(word)
