from __future__ import annotations

import hashlib
import zlib

import brute
import pytest

from siftwall.llm import prefix_trie as pt
from siftwall.llm import queries

SCHEMA = "conv_id long, turn int, role string, text string, depth int, part int, id string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)


def plain(rows: list[tuple]) -> list[tuple]:
    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            halves = [int(digest[k : k + 16], 16) for k in (0, 16)]
            signed = [h - (1 << 64) if h >> 63 else h for h in halves]
            own.setdefault(conv, []).append((turn is not None, turn or 0, signed, (role or "", text or "")))
    seqs = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, turns in seqs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        paths[c] = tuple(seqs.get(base, [])[:h] + turns[h:])
    nodes: dict[tuple, list[int]] = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    children: dict[tuple, int] = {}
    for k in nodes:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, members in nodes.items():
        words = len(brute.WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(members) - 1) * words
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if paths[c] == k)
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(members), len(k), parent, len(members), children.get(k, 0), leaves[k], saved[k], brute.sha(ends)))
    return sorted(out, key=str)


def got(found) -> list[tuple]:
    assert found.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ]
    return sorted(map(tuple, found.collect()), key=str)


EDGES = (
    [(c, t, "user" if t % 2 == 0 else "assistant", f"say {t} to {c % 3 if t else 0}") for c in range(45) for t in range(5)]
    + [(c, None, None, None) for c in (3, 4)]
    + [(50, 1, "user", "tie a"), (50, 1, "user", "tie b"), (50, 1, "user", "tie b"), (50, None, "user", "first")]
    + [(None, 1, "user", "nowhere"), (-7, 0, "user", "minus"), (-21, 0, "a", ""), (-20, 0, "b", None)]
    + [(101, 0, "user", "only one turn, no base"), (102, 0, "user", "x"), (103, 0, "user", "x")]
    + [(60, 0, "user", "w " * 100_000), (61, 0, "user", "w " * 100_000), (61, 1, "us", "erx"), (60, 1, "user", "x")]
)


@pytest.mark.parametrize("band", [2, 3, 16])
def test_against_plain_version(spark, band):
    rows = EDGES + [(200, t, "user", f"t{t // 2}") for t in range(40)] + [(201, t, "user", f"t{t // 2}") for t in range(33)]
    assert got(pt.prefix_trie(frame(spark, rows).repartition(5), band)) == plain(rows)


def test_one_conversation_with_most_turns_and_one_opening_for_all(spark):
    rows = [(20, t, "user", f"turn {t}") for t in range(700)]
    rows += [(c, t, "user", "hello there" if t < 2 else f"{c % 5}") for c in range(300, 420) for t in range(3)]
    turns = pt.turn_rows(frame(spark, rows))
    shares = [r["count"] for r in turns.where("conv = 20").groupBy("part").count().collect()]
    assert len(shares) > 3  # the long one is dealt out
    assert got(pt.prefix_trie(frame(spark, rows), 4)) == plain(rows)


def test_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in brute.rows("conversations")]
    assert got(queries.op13_prefix_trie(spark, brute.SMALL)) == plain(rows)


def test_empty(spark):
    assert got(pt.prefix_trie(frame(spark, []))) == []


def test_long_id_lists_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 50)
    source = spark.range(3000).selectExpr("id % 2 AS k", "id - 7 AS v").repartition(4)
    found = {r.k: r.sha256 for r in pt.joined_hashes(source, ["k"], "v").collect()}
    assert found == {k: brute.sha(",".join(str(i - 7) for i in range(3000) if i % 2 == k)) for k in (0, 1)}
