from __future__ import annotations

import brute
import corpus_pipeline
import pytest
from test_jaccard import brute_components

from siftwall.llm import stages

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """What every stage returned, and what it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, function in corpus_pipeline.STAGES:
        given = docs
        docs = corpus_pipeline.stage(function(spark, docs, SF), f"test-{name}")
        out.append((given, docs))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_whole_rows_of_their_input(steps):
    for given, kept in steps[:-1]:
        assert kept.columns == given.columns
        a, b = given.collect(), kept.collect()
        assert set(b) <= set(a) and len(set(b)) == len(b)


def test_each_decision(spark, steps):
    quality = {r["doc_id"]: r["quality"] for r in brute.rows("labels", SF)}
    given, kept = (texts(x) for x in steps[0])
    assert all(i in kept for i in given if quality.get(i) == 1)
    bad = [i for i in given if quality.get(i) == 0]
    assert sum(i not in kept for i in bad) > len(bad) / 2
    given, kept = (texts(x) for x in steps[1])
    for i, t in given.items():
        assert i not in kept or not brute.quality(t)[-1]
        assert i in kept or brute.quality(t)[-1] or quality.get(i) != 1
    given, kept = (texts(x) for x in steps[2])
    last = {t: i for i, t in sorted(given.items())}
    assert set(kept) == set(last.values())
    given, kept = (texts(x) for x in steps[3])
    assert set(kept) == {i for i, _, c in brute_components(list(given.items())) if i == c}
    given = texts(steps[4][0])
    pieces = steps[4][1].collect()
    assert {p.doc_id for p in pieces} == set(given)


@pytest.mark.parametrize("name, function", corpus_pipeline.STAGES)
def test_stages_on_edges(spark, name, function):
    docs = spark.createDataFrame(
        [(i, t, None, "s", 0) for i, t in brute.EDGES], "doc_id long, text string, lang string, source string, n_chars long"
    )
    out = function(spark, docs, SF)
    if name != "packing":
        assert out.columns == docs.columns
    if name == "exact_dedup":
        assert sorted((r.text or "") for r in out.collect()) == sorted({t or "" for _, t in brute.EDGES})
    assert out.count() <= docs.count() or name == "packing"
    assert function(spark, docs.limit(0), SF).count() == 0


def test_rows_without_ids_are_not_lost_to_others(spark):
    docs = spark.createDataFrame(
        [(None, "a b c d e f g"), (None, "h i j k l m n"), (1, "a b c d e f g")], "doc_id long, text string"
    )
    assert {r.text for r in stages.exact_dedup(spark, docs, SF).collect()} == {"a b c d e f g", "h i j k l m n"}
