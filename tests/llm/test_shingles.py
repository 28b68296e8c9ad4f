"""Shingles are hashed side by side, and few passes decide which sets are compared."""

from __future__ import annotations

import random
import sys

import pyarrow as pa
import pytest
from test_jaccard import brute_components, near_copies, same, shingles

from siftwall.llm import jaccard_join

ODD = [
    None, "", " \t\r\n", "a", "A b", "a B c d e", "a b c d e f", "a b c d e a b c d e", "a\x0bb\x0cc\x1cd e f g",
    "nul\x00 nul\x00\x00 nul x y z", "é É ß 漢字 e f", "x" * 7, "x" * 8, "x" * 9, "x" * 64, "x" * 65, "X" * 66,
    " ".join("y" * n for n in range(1, 90)), " ".join("Y" * n for n in range(1, 90)), "a b c d e" + "z" * 5000,
    "12345678abc 1234567 12345678 87654321 abc12345678", "a b c d e", "a b c d", "abc de",
]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_shingles_are_those_of_the_words(kind):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["a", "b", "Ab", "c" * 20]) for _ in range(rng.randrange(30))) for _ in range(80)]
    column = pa.array(["cut off"] + texts + ["cut off"], kind).slice(1, len(texts))
    got = [set(s.tolist()) for s in jaccard_join.shingle_sets(column, 5)]
    want = [shingles(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    assert all(len(g & h) == len(v & w) for g, v in zip(got, want) for h, w in zip(got, want))
    assert all(s.tolist() == sorted(s.tolist()) for s in jaccard_join.shingle_sets(column, 5))
    assert jaccard_join.shingle_sets(column.slice(0, 0), 5) == []


def test_words_are_no_python_objects():
    import xxhash

    column = pa.array([" ".join(f"word{k}" for k in range(5000))] * 2)
    calls = []

    def seen(frame, event, function):
        if event == "c_call" and function is xxhash.xxh3_64_intdigest:
            calls.append(function)

    sys.setprofile(seen)
    try:
        sets = jaccard_join.shingle_sets(column, 5)
    finally:
        sys.setprofile(None)
    assert [len(s) for s in sets] == [4996, 4996] and not calls


def test_a_set_is_placed_in_three_shuffles(spark):
    blocks = spark.createDataFrame([(t, k, 50) for k in range(9) for t in range(8)], "token long, node long, n int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = jaccard_join._placed(blocks, 80)
        # with the plainest join: no table is small enough for a broadcast here
        plan = placed.hint("merge")._jdf.queryExecution().optimizedPlan().toString()
        assert placed.count() == 72
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1


def test_few_candidates_are_compared_at_once(spark, monkeypatch):
    compared, linked = [], jaccard_join._linked

    def watched(pairs, *rest):
        compared.append(pairs.count())
        return linked(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    monkeypatch.setattr(jaccard_join, "_linked", watched)
    docs = [row for seed in (5, 6) for row in near_copies(seed)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    same(got, brute_components(docs))
    # all but the first two rounds, one over leaders and one a pair of groups
    assert len(compared) <= 3
