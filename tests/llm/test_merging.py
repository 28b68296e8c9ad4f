"""Groups are merged from the links alone, and a text meets its many partners once a part."""

from __future__ import annotations

from test_jaccard import brute_components, near_copies, same

from siftwall.llm import jaccard_join
from siftwall.session import stage


def test_merging_reads_no_shingles(spark, monkeypatch):
    plans, merge = [], jaccard_join.components

    def watched(edges):
        plans.append(edges._jdf.queryExecution().optimizedPlan().toString())
        return merge(edges)

    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    monkeypatch.setattr(jaccard_join, "components", watched)
    docs = near_copies(9)[:60]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    same(jaccard_join.jaccard_components(frame).collect(), brute_components(docs))
    # one merge after the round, one at least among the candidates, one of all links for the names
    assert len(plans) >= 3 and not any("Join" in p for p in plans[:-1])


def test_partners_over_several_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PARTNERS", 2)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base)] + [" ".join([*base, *(f"x{i}y{k}" for k in range(i))]) for i in range(1, 24)]
    docs = stage(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "test-docs")
    sizes = stage(jaccard_join._sizes(docs, 5), "test-sizes").where("token IS NULL").select("id", "n", "node")
    of = {r.id: r.node for r in sizes.collect()}
    rows = [(of[0], of[i], -i, i) for i in range(1, 24)] + [(of[i], of[i + 1], 100 + i, i) for i in range(1, 23)]
    pairs = stage(spark.createDataFrame(rows, "a long, b long, ga long, gb long"), "test-pairs")
    got = jaccard_join._linked(pairs, docs, sizes, 5, 80)
    # 56 shingles, and one more for each word added
    want = [r for r in rows[:23] if 100 * 56 >= 80 * (56 + r[3])]
    want += [r for r in rows[23:] if 100 * 56 >= 80 * (56 + r[3] + r[3] + 1)]
    assert sorted(tuple(r) for r in got.select("a", "b", "ga", "gb").collect()) == sorted(want)
