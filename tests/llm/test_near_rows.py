"""The near-duplicate stage on rows that share an id or have none."""

from __future__ import annotations

from collections import Counter

from siftwall.llm import stages

ONE, OTHER, LAST = (" ".join(f"{w}{k}" for k in range(60)) for w in ("one", "other", "last"))
ROWS = [
    (5, ONE),
    (6, ONE + " end"),
    (3, OTHER),
    (5, OTHER + " end"),
    (None, LAST),
    (None, LAST + " end"),
    (None, LAST + " more"),
    (8, "alone in its words as it is"),
    (None, ""),
]


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return Counter((r.doc_id, r.text) for r in stages.ngram_jaccard(spark, docs, "").collect())


def test_one_row_of_each_group(spark):
    got = kept(spark, ROWS)
    groups = [[t for t in got.elements() if t[1].startswith(w)] for w in ("one", "other", "last")]
    assert [len(g) for g in groups] == [1, 1, 1]
    assert (5, ONE) in got and (3, OTHER) in got
    assert got[(8, ROWS[7][1])] == got[(None, "")] == 1 and sum(got.values()) == 5


def test_repeated_rows(spark):
    assert sum(kept(spark, [(5, ONE), (5, ONE), (6, ONE + " end")]).values()) == 1
