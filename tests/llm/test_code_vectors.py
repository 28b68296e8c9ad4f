from __future__ import annotations

import math

import brute
import numpy as np
import pytest

from siftwall.llm import code_vectors as cv


def plain(rows: list[tuple], parts: int, entries: int, rounds: int):
    """Full search in Python integers: codes and errors by place in ``rows``, and the codebooks."""
    kept = []
    for place, (i, v, *_) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((place, i, [math.floor(256 * x) for x in v]))
    width = len(kept[0][2]) // parts
    first = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:entries]

    def part(v, p):
        return v[p * width : (p + 1) * width]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book))

    books = [[part(v, p) for _, _, v in first] for p in range(parts)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups: dict[int, list] = {}
            for _, _, v in kept:
                groups.setdefault(nearest(part(v, p), book)[1], []).append(part(v, p))
            for e, members in groups.items():
                book[e] = [sum(c) // len(members) for c in zip(*members)]
    out = {}
    for place, _, v in kept:
        found = [nearest(part(v, p), books[p]) for p in range(parts)]
        out[place] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found))
    return out, books


def frame(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, code string, id int, part int"
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], schema).repartition(3)


def vectors(n: int, dim: int, spread: float, seed: int) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(size=(n, dim)) * spread, 3).astype(np.float32).tolist()


def test_against_full_search(spark):
    made = vectors(240, 8, 0.2, 1)
    rows = [(k * 3, v, k % 4 if k % 5 else None) for k, v in enumerate(made)]
    rows += [(k, made[7], 9) for k in range(2000, 2100)]  # equal vectors
    rows += [(5, None, 1), (6, [0.0] * 7 + [None], 1), (7, [0.0] * 7 + [math.inf], 1), (8, [math.nan] * 8, 1)]
    rows += [(9, [], 1), (10, [1.0] * 4, 1), (None, made[3], 2), (0, made[0], 0)]
    expected, books = plain([r if len(r[1] or []) == 8 else (r[0], None) for r in rows], 4, 16, 2)
    got = cv.compress_vectors(frame(spark, rows), parts=4, entries=16).collect()
    want = sorted((str(rows[k][0]), str(rows[k][2]), *found) for k, found in expected.items())
    assert sorted((str(r.id), str(r.label), r.code, r.error) for r in got) == want
    sums: dict = {}
    for k, (_, error) in expected.items():
        sums[rows[k][2]] = sums.get(rows[k][2], 0) + error
    assert all(r.label_error == sums[r.label] for r in got)
    assert {r.codebooks_sha256 for r in got} == {cv.fingerprint(np.array(books))}


def test_whole_query_against_full_search(spark):
    from siftwall.llm import queries

    rows = [(r["vec_id"], r["embedding"]) for r in brute.rows("embeddings")][:500]
    expected, _ = plain(rows, 16, 64, 2)
    got = {r.vec_id: (r.code, r.error) for r in queries.op12_code_vectors(spark, brute.SMALL).collect()}
    assert got == {rows[k][0]: found for k, found in expected.items()}


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0, 2.0, 3.0], 1)]])
def test_nothing_to_code(spark, rows):
    found = cv.compress_vectors(frame(spark, rows), parts=4, entries=4)
    assert found.columns == ["id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert found.collect() == []


def test_without_label_and_with_large_components(spark):
    limit = cv.LARGEST / math.sqrt(4)
    rows = [(1, [limit] * 4), (2, [-limit] * 4), (3, [1.01 * limit] * 4), (4, [0.0] * 4)]
    source = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: r for r in cv.compress_vectors(source, parts=2, entries=2, rounds=0).collect()}
    assert set(got) == {1, 2, 4}
    assert got[4].code == "0000" and got[4].error == 4 * int(256 * limit) ** 2
    assert got[1].label is None and got[1].label_error == got[4].error


@pytest.mark.parametrize("n, width, entries, spread", [(3000, 4, 64, 40), (900, 1, 7, 2), (1, 3, 5, 9), (2000, 16, 256, 30)])
def test_trees_equal_full_search(n, width, entries, spread):
    rng = np.random.default_rng(n)
    rows = np.round(rng.normal(size=(n, width)) * spread).astype(np.int64)
    rows[: n // 3] = rows[0]
    book = np.round(rng.normal(size=(entries, width)) * spread).astype(np.int64)
    book[-1] = book[0]  # a tie throughout
    expected = ((rows[:, None] - book[None]) ** 2).sum(-1).argmin(1)
    tree = cv._entry_tree(book)
    assert (cv.assign(rows, book, tree) == expected).all()
    total = np.zeros((entries, 1 + width), dtype=np.int64)
    np.add.at(total, expected, np.column_stack([np.ones(n, dtype=np.int64), rows]))
    assert (cv.sums(rows, book, tree) == total).all()


def test_nodes_go_to_an_entry_as_a_whole():
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [10_000, 0], [0, 10_000], [10_000, 10_000]])
    rows = np.concatenate([c + rng.integers(-50, 50, (500, 2)) for c in centres])
    distinct, _, times = cv._folded(rows)
    tree = cv.Tree(distinct, times, cv.LEAF)
    whole = [len(n) for n, points, _ in cv.nearest(tree, distinct, cv._entry_tree(centres), centres) if points is None]
    assert sum(whole) <= 16  # rather than 2000 points
    assert (tree.count[0], tree.total[0].tolist()) == (2000, rows.sum(axis=0).tolist())
