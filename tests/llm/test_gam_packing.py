from __future__ import annotations

import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftwall.llm import gam, packing, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op7_quality_classifier(spark, SF).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got.values())
    hit = total = bad = found = 0
    for row in brute.rows("labels", SF):
        r = got[row["doc_id"]]
        assert r.held_out == (brute.crc_mod(row["doc_id"], 5) == 0)
        if r.held_out:
            total += 1
            hit += r.predicted == row["quality"]
            bad += row["quality"] == 0
            found += row["quality"] == 0 and r.predicted == 0
    assert hit / total > 0.9 and found / bad > 0.5


def test_pairs_are_learned():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit_gam(x, y)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_classifier_edges(spark):
    docs = brute.edge_frame(spark)
    labels = spark.createDataFrame(
        [(4, 1), (6, 0), (None, 1), (9, None), (9, 1), (9, 0)], "doc_id long, quality int"
    )
    model = gam.train_quality(docs, labels)
    assert gam.score_quality(docs, model).count() == len(brute.EDGES)
    none = gam.train_quality(docs, labels.limit(0))
    assert {r.score for r in gam.score_quality(docs, none).collect()} == {0.5}
    assert gam.score_quality(brute.empty_frame(spark), model).count() == 0


def check_pieces(pieces, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    # documents may share an id: compare pieces as (crc, length, start, total)
    want = {}
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
        want.setdefault((p[0], p.doc_tokens), []).append(p)
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return ids, padding


def test_packing_query(spark):
    docs = {d["doc_id"]: d["text"] for d in brute.rows("documents")}
    pieces = queries.op8_packing(spark, brute.SMALL).collect()
    ids, padding = check_pieces(pieces, docs.values())
    ids = dict(zip(docs, ids))
    for p in pieces:
        own = ids[p.doc_id]
        raw = np.array(own[p.start : p.start + p.length], "<u4").tobytes()
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(raw)
    assert padding <= 1024


def test_packing_edges(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = brute.edge_frame(spark)
    pieces = packing.pack_documents(docs, path).collect()
    check_pieces(pieces, [t for _, t in brute.EDGES])
    tokens = sum(len(p.ids) // 4 for p in pieces)
    assert tokens == sum(p.length for p in pieces)
    assert packing.pack_documents(brute.empty_frame(spark), path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pack_covers_everything(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in rng.integers(1, [30, 300, 3000][seed % 3], 400)]
    windows = packing.pack(lengths)
    seen = sorted((d, s, n) for w in windows for d, s, n in w)
    place = {}
    for d, s, n in seen:
        assert place.get(d, 0) == s
        place[d] = s + n
    assert [place[d] for d in range(len(lengths))] == lengths
    totals = [sum(n for _, _, n in w) for w in windows]
    assert max(totals) <= 1024 and sum(t & (t - 1) != 0 for t in totals) <= 1
    groups = packing.step_groups(totals, 8 * 1024)
    loads = np.bincount(groups, totals)
    assert loads.max() - loads.min() <= 1024
    assert packing.pack([]) == []
