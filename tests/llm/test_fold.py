"""The fold of a word walks over it once a step and gives what the library gives."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from siftwall.llm import byte_bpe, common

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def folded(spark, words):
    ranks = byte_bpe.read_ranks(RANKS)
    first, second = byte_bpe.merge_tables(ranks)
    mask = (1 << 17) - 1
    merged = {(c >> 34, (c >> 17) & mask): c & mask for c in (*first, *second) if c >= 0}
    byte_ids = [ranks[bytes([b])] for b in range(256)]
    numbers = byte_bpe._numbers
    table = F.struct(
        numbers(first).alias("a"), numbers(second).alias("b"), numbers(byte_bpe.byte_merges(byte_ids, merged)).alias("c")
    )
    rows = [(k, [byte_ids[b] for b in w.encode()]) for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "k long, w array<bigint>")
    sizes, stride = (len(first), len(second)), max(byte_ids) + 1
    return df.select("k", F.get(F.transform(F.array(table), lambda t: byte_bpe.encode_word(F.col("w"), t, sizes, stride)), F.lit(0)).alias("ids"))


def test_words_of_all_lengths(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice(a) for _ in range(n)) for a in ("a", "ab", "etaoinshr", "é日x") for n in (1, 2, 3, 9, 40, 170)]
    words += ["x" * byte_bpe.LONG, "ab" * (byte_bpe.LONG // 2)]
    library = tiktoken.Encoding(
        "fold", pat_str=r"(?s).+", mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}
    )
    got = {r.k: r.ids for r in folded(spark, words).collect()}
    assert got == {k: library.encode_ordinary(w) for k, w in enumerate(words)}


def test_a_step_is_one_walk(spark):
    plan = folded(spark, ["ab"])._jdf.queryExecution().analyzed().toString()
    assert "filter(" not in plan and plan.count("array_remove(") == 1


def test_decoded_outside_the_plan(spark):
    docs = spark.createDataFrame([(1, "the same é日 the same"), (2, ""), (3, None), (4, "x" * 2000)], "doc_id long, text string")
    got = byte_bpe.encode_documents(docs, RANKS, r"\S+|\s+")
    assert "unhex(" not in got._jdf.queryExecution().analyzed().toString()
    assert {r.id: r.decoded for r in got.collect()} == {1: "the same é日 the same".encode(), 2: b"", 3: b"", 4: b"x" * 2000}


def test_strings():
    column = pa.array(["", "a", "\U0001f600 b", "\x00", "é"], pa.large_string())
    assert common.strings(column) == column.to_pylist() and common.strings(column.slice(5)) == []
    assert all(type(s) is str for s in common.strings(column))
