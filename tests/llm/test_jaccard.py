from __future__ import annotations

import random
from collections import defaultdict

import brute
import pytest

from siftwall.llm import jaccard_join, queries
from siftwall.llm.components import components

AZ = {i: i + 32 for i in range(65, 91)}


def shingles(text: str | None) -> frozenset:
    words = brute.WORD.findall((text or "").translate(AZ))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def find(parent: dict, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(docs: list[tuple]) -> list[tuple]:
    """Every pair of texts that share a shingle, compared; rows as (id, n, component)."""
    rows = [shingles(t) for _, t in docs]
    sets = list(set(rows))
    parent = {s: s for s in sets}
    where = defaultdict(list)
    for s in sets:
        for g in s:
            where[g].append(s)
    done = set()
    for s in sets:
        for other in {o for g in s for o in where[g]}:
            pair = frozenset((s, other))
            if other == s or pair in done:
                continue
            done.add(pair)
            if 100 * len(s & other) >= 80 * len(s | other):
                parent[find(parent, s)] = find(parent, other)
    smallest: dict = {}
    for (i, _), s in zip(docs, rows):
        root = find(parent, s)
        if i is not None:
            smallest[root] = min(smallest.get(root, i), i)
    return [
        (i, len(s), (smallest.get(find(parent, s)) if s else i)) for (i, _), s in zip(docs, rows)
    ]


def same(got, want):
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_edges(spark):
    got = jaccard_join.jaccard_components(brute.edge_frame(spark)).collect()
    same(got, brute_components(brute.EDGES))
    assert jaccard_join.jaccard_components(brute.empty_frame(spark)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [(d["doc_id"], d["text"]) for d in brute.rows("documents", path)]
    got = queries.op6_ngram_jaccard(spark, path).collect()
    assert any(r.component_id != r.doc_id for r in got)
    same(got, brute_components(docs))


def near_copies(seed: int) -> list[tuple]:
    """Families of texts a few words apart, so that many pairs lie near the limit."""
    rng = random.Random(seed)
    docs = []
    common = [f"hot{k}" for k in range(30)]
    for family in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(6, 80))]
        if family % 3 == 0:
            base[:0] = common
        for _ in range(rng.randrange(2, 40)):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                at = rng.randrange(len(text))
                kind = rng.randrange(3)
                if kind == 0:
                    text[at] = f"x{rng.randrange(50)}"
                elif kind == 1:
                    del text[at]
                else:
                    text.insert(at, f"y{rng.randrange(50)}")
                text = text or ["z"]
            docs.append((rng.randrange(10_000), " ".join(text)))
            base = text if rng.random() < 0.5 else base  # chains of small steps
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_no_link_is_lost(spark, seed):
    docs = near_copies(seed)
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    same(got, brute_components(docs))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7), (500, 499)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(300)} | {499: 499, 500: 499}
    # 399 and 499 belong to the star as well
    want |= {k: 100 for k in range(100, 400)}
    assert got == want
