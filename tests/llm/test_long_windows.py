"""Repeated windows of very long texts."""

from __future__ import annotations

from itertools import product

import xxhash
from pyspark.sql import functions as F

from siftwall.llm import quality_rules


def colliding() -> tuple[list[str], list[str]]:
    """Two windows whose hashes share the 33 high bits."""
    seen: dict[int, list[str]] = {}
    for words in product([f"x{k}" for k in range(700)], [f"y{k}" for k in range(700)], ["z"]):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        if h >> 31 in seen:
            return seen[h >> 31], list(words)
        seen[h >> 31] = list(words)
    raise AssertionError("no collision")


def test_windows_with_equal_high_bits(spark):
    a, b = colliding()
    head = " ".join([*a, "p", *b, "q", *a, "r"])
    rest = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1 << 20)), lambda i: F.concat(F.lit("w"), i)), " ")
    words = F.split(F.concat(F.lit(head + " "), rest), " ")
    row = spark.range(1).select(words.alias("w")).select(quality_rules._repeated_words(F.col("w")).alias("n"))
    assert row.first().n == 6


def test_windows_with_equal_bits_in_shorter_texts(spark):
    """Three words that share 44 hash bits with three others, between two equal windows."""
    head = "x790 y601 z p x3093 y3226 z q x790 y601 z r".split()
    for n in (70_000, 3_000, 10):
        row = spark.range(1).select(F.lit([*head, *[f"u{k}" for k in range(n)]]).alias("w"))
        assert row.select(quality_rules._repeated_words(F.col("w")).alias("n")).first().n == 6
