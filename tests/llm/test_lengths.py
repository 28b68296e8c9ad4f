"""Exact dedup hashes prefixes only where a length is shared."""

from __future__ import annotations

from siftwall.llm import exact_dedup


def test_prefixes_of_shared_lengths_only(spark, monkeypatch):
    staged = {}

    def keep(df, name, stage=exact_dedup.stage):
        staged[name] = stage(df, name)
        return staged[name]

    monkeypatch.setattr(exact_dedup, "stage", keep)
    docs = spark.createDataFrame(
        [(1, "a"), (2, "bb"), (3, "bb"), (4, "cc"), (5, "ddd"), (6, None)], "doc_id long, text string"
    )
    got = {r.id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {1: (1, True), 2: (3, False), 3: (3, True), 4: (4, True), 5: (5, True), 6: (6, True)}
    assert [r.n for r in staged["dedup-lengths"].collect()] == [2]
