from __future__ import annotations

import math
import re
from collections import Counter

import brute

from siftwall.llm import licenses, queries


def own(text: str | None):
    """Best notice of a text as (score, licence), or None."""
    vectors, idf, other = licenses.template_weights()
    best = None
    for k, line in enumerate((text or "").split("\n")):
        if not any(m in line.lower() for m in licenses.MARKERS):
            continue
        c = Counter(re.findall(licenses._TOKEN, line.lower()))
        w = {t: n * idf.get(t, other) for t, n in c.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        score, name = max(
            (round(sum(e * w.get(t, 0.0) for t, e in v.items()) / norm, 9), name) for name, v in vectors.items()
        )
        if score >= licenses.MIN_COSINE and (best is None or score > best[0]):
            best = (score, name)
    return best


def inherited(files: list[tuple]) -> list[tuple]:
    """files: (id, path, text, is_licence_file); rows as (id, own licence, licence, from)."""
    governing: dict[str, list] = {}
    found = {i: own(t) for i, _, t, _ in files}
    for i, path, _, named in files:
        if named and found[i]:
            governing.setdefault(path.rpartition("/")[0], []).append((-found[i][0], found[i][1]))
    out = []
    for i, path, _, _ in files:
        mine, at = found[i], path.rpartition("/")[0]
        if mine:
            out.append((i, mine[1], mine[1], None))
            continue
        while at and at not in governing:
            at = at.rpartition("/")[0]
        at = at if at in governing else None
        out.append((i, None, min(governing[at])[1] if at is not None else None, at))
    return out


def test_query(spark):
    files = []
    for d in brute.rows("documents", "/root/testdata/sf0.01"):
        opens = re.search("licen[sc]e", d["text"].split("\n")[0].lower()) is not None
        name = f"LICENSE.{d['doc_id']}" if opens else f"{d['doc_id']}.txt"
        path = f"{d['source']}/{d['lang']}/{d['doc_id'] // 100}/{name}"
        files.append((d["doc_id"], path, d["text"], opens))
    got = queries.op9_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.own_licence is not None for r in got) > 10
    assert sorted((r.doc_id, r.own_licence, r.licence, r.inherited_from) for r in got) == sorted(
        inherited(files), key=lambda r: r[0]
    )


def test_tree_and_edges(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    files = [
        (1, "a/LICENSE", mit, "x"),
        (2, "a/b/c/one.py", "no notice", "x"),
        (3, "a/b/COPYING.txt", gpl, "x"),
        (4, "a/b/d/two.py", "code\n# Copyright 2020\n# " + licenses.TEMPLATES["Apache-2.0"] + "\nmore", "x"),
        (5, "a/three.py", None, "x"),
        (6, "b/four.py", "", "x"),
        (7, None, "text", "x"),
        (None, "top.py", "licensed to nobody in any way that one could know", "x"),
        (8, "a/LICENSE.old", gpl, "x"),
    ]
    docs = spark.createDataFrame(files + files[1:2], "doc_id long, path string, text string, id string")
    got = {r.id: r for r in licenses.scan_licences(docs).collect()}
    assert len(got) == 9
    assert {i: (r.licence, r.inherited_from) for i, r in got.items()} == {
        1: ("MIT", None),
        2: ("GPL-3.0", "a/b"),
        3: ("GPL-3.0", None),
        4: ("Apache-2.0", None),
        5: ("GPL-3.0", "a"),
        6: (None, None),
        7: (None, None),
        None: (None, None),
        8: ("GPL-3.0", None),
    }
    assert licenses.scan_licences(docs.limit(0)).count() == 0


def test_every_template_finds_itself():
    assert all(own(text) == (1.0, name) for name, text in licenses.TEMPLATES.items())


def test_root_licence_and_hot_top_directories(spark):
    text = "Released under the MIT License."
    files = [(1, "LICENSE", text, True), (2, "src/main.py", "x = 1", False), (3, "src/a/b.py", "y = 2", False)]
    files += [(4, "/LICENSE", "Licensed under the Apache License, Version 2.0", True), (5, "/abs/c/d.py", "z", False)]
    files += [(100 + k, f"many/d{k}/e/f{k}.py", "w", False) for k in range(300)]
    frame = spark.createDataFrame([f[:3] for f in files if f[0] != 4], "doc_id long, path string, text string")
    got = {r["id"]: r["licence"] for r in licenses.scan_licences(frame).collect()}
    assert got[1] is not None and set(got.values()) == {got[1]}
