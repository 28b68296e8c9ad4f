from __future__ import annotations

from collections import defaultdict

import brute
import pytest

from siftwall.llm import exact_dedup, quality_rules, queries


def test_exact_dedup_edges(spark):
    got = exact_dedup.exact_dedup(brute.edge_frame(spark), hash_all=True).collect()
    groups = defaultdict(list)
    for i, t in brute.EDGES:
        groups[t or ""].append(i)
    assert len(got) == len(brute.EDGES)
    by = {brute.sha(t): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by[r.fingerprint]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.fingerprint] += r.kept
        assert not r.kept or r.id == r.keep_id
    assert set(kept.values()) == {1}  # of rows that repeat an id one stays


def test_exact_dedup_hashes_survivors_only(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "long one")], "doc_id long, text string")
    got = {r.id: r.fingerprint for r in exact_dedup.exact_dedup(docs).collect()}
    assert got[1] == got[3] == brute.sha("aa") and got[2] is None and got[4] is None


def test_exact_dedup_hot_group(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', 'x' || id) AS text")
    got = exact_dedup.exact_dedup(docs).where("kept").count()
    assert got == 4001


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, quality_rules.quality_rules])
def test_empty_table(spark, run):
    assert run(brute.empty_frame(spark)).count() == 0


def test_quality_counts(spark):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = sorted((str(i), *brute.quality(t)) for i, t in brute.EDGES)
    got = quality_rules.quality_rules(brute.edge_frame(spark)).collect()
    assert sorted((str(r.id), *(r[n] for n in names)) for r in got) == want
    docs = {d["doc_id"]: d["text"] for d in brute.rows("documents")}
    for r in queries.op2_quality_rules(spark, brute.SMALL).collect():
        assert tuple(r[n] for n in names) == brute.quality(docs[r.doc_id])


def test_quality_verdict(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: (r.kept, r.base_failed) for r in queries.op2_quality_rules(spark, sf).collect()}
    for row in brute.rows("labels", sf):
        stays, short = kept[row["doc_id"]]
        if row["quality"] == 1:
            assert stays or short  # clean documents stay unless the base rules bar them


def test_line_rules(spark):
    good = "This is a plain sentence with some words in it."
    lines = [
        good,
        "Home | About | Contact | Help",
        "WIN!! BIG!! MONEY!! NOW!!",
        "Please enable JavaScript to view this page.",
        "spam spam spam spam spam spam spam spam spam spam spam spam spam",
    ]
    text = "\n".join(lines + [good.replace("plain", w) for w in "a b c d e f".split()])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = quality_rules.quality_rules(docs).first()
    assert row.n_failed_lines == 4 and "JavaScript" not in row.clean_text and good in row.clean_text
