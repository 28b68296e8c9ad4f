"""Features, tables and scores of the quality classifier, worked out again in plain Python."""

from __future__ import annotations

import math
import re
import unicodedata

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwall.llm import gam, queries


def plain_features(text: str | None) -> list[float]:
    text = text or ""
    words = brute.WORD.findall(text)
    solid = "".join(words)
    lines = [x for x in text.split("\n") if x.strip(" ")]
    size, n, m = len(solid), len(words), len(lines)

    def share(part, whole):
        return part / whole if whole else 0.0

    def count(characters):
        return sum(solid.count(c) for c in characters)

    return [
        math.log1p(size),
        share(size, n),
        share(sum(unicodedata.category(c) == "Lu" for c in solid), size),
        share(count("#*$%&<>@^~_=+\\/"), size),
        share(count("!?"), size),
        share(count("|"), n),
        share(count("0123456789"), size),
        share(count(".,;:"), n),
        share(len(set(words)), n),
        share(len(set(lines)), m),
        share(n, m),
        share(sum(bool(re.search(r"[.!?:;\"'][ \t\n\x0b\f\r]*$", x)) for x in lines), m),
    ]


def plain_score(model: gam.Gam, x: list[float]) -> float:
    def place(edges, v):
        return sum(1 for e in edges if e <= v)

    total = model.base + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.mains, x))
    for a, b, ea, eb, table in model.pairs:
        total += table[place(ea, x[a])][place(eb, x[b])]
    return 1 / (1 + math.exp(-total))


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{brute.SMALL}/{t}.parquet") for t in ("documents", "labels"))
    return gam.train_quality(docs, labels)


def test_features(spark):
    docs = [*brute.EDGES, *[(r["doc_id"], r["text"]) for r in brute.rows("documents")]]
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "k long, text string")
    got = gam.with_features(frame, F.col("text")).orderBy("k").select(*gam.FEATURES).collect()
    for (_, text), row in zip(docs, got):
        assert list(row) == pytest.approx(plain_features(text), rel=1e-12), (text or "")[:60]


def test_training_rows(spark):
    texts = {r["doc_id"]: r["text"] for r in brute.rows("documents")}
    marks = [(r["doc_id"], r["quality"]) for r in brute.rows("labels") if r["quality"] is not None]
    wanted = sorted(
        [*plain_features(texts[i]), float(q)] for i, q in marks if i in texts and brute.crc_mod(i, 5) != 0
    )
    docs, labels = (spark.read.parquet(f"{brute.SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = sorted(list(r) for r in gam.training_sample(docs, labels).collect())
    assert np.allclose(got, wanted)


def test_scores_of_the_query(spark, model):
    texts = {r["doc_id"]: r["text"] for r in brute.rows("documents")}
    got = queries.op7_quality_classifier(spark, brute.SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        score = plain_score(model, plain_features(texts[r.doc_id]))
        assert r.score == pytest.approx(score, abs=1e-9)
        assert r.held_out == (brute.crc_mod(r.doc_id, 5) == 0)
        assert r.predicted == int(r.score >= 0.3)


def test_kept_rows_are_those_that_score_enough(spark, model):
    frame = brute.edge_frame(spark).unionByName(
        spark.read.parquet(f"{brute.SMALL}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True
    )
    for least in (0.3, 0.7):
        kept = gam.keep_good(frame, model, least)
        assert kept.columns == frame.columns
        rows = [(r.doc_id, r.text) for r in kept.collect()]
        wanted = [(r.doc_id, r.text) for r in frame.collect() if plain_score(model, plain_features(r.text)) >= least]
        assert sorted(rows, key=str) == sorted(wanted, key=str)
    assert gam.keep_good(brute.empty_frame(spark), model, 0.3).count() == 0


def test_boosting_steps_are_those_of_the_method():
    """One round over one feature: the shallow tree's leaves, shrunk, as worked out by hand."""
    x = np.array([[0.0], [0.0], [1.0], [1.0], [1.0]])
    y = np.array([0.0, 0.0, 1.0, 1.0, 0.0])
    model = gam.fit_gam(x, y, bins=2, rounds=1, pair_rounds=0, n_pairs=0, rate=0.1)
    base = math.log(3 / 4)
    p = 1 / (1 + math.exp(-base))
    left, right = 2 * (0 - p), 2 * (1 - p) + (0 - p)
    assert model.base == pytest.approx(base)
    at = [int(sum(e <= v for e in model.edges[0])) for v in (0.0, 1.0)]
    assert model.mains[0][at[0]] == pytest.approx(0.1 * left / (2 * p * (1 - p) + 1))
    assert model.mains[0][at[1]] == pytest.approx(0.1 * right / (3 * p * (1 - p) + 1))
