from __future__ import annotations

import math
import tracemalloc
from collections import Counter
from itertools import product

import brute
import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from siftwall.llm import hmm, queries

AZ = {i: i + 32 for i in range(65, 91)}


def tokens(text: str | None) -> list[str]:
    return [*brute.WORD.findall((text or "").translate(AZ)), ""]  # "" is the end


def base_model(docs: list[tuple]):
    """Per row: n_tokens, n_known, N, base score."""
    c = Counter()
    for i, t in docs:
        if brute.crc_mod(i, 7) != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in docs:
        own = tokens(t)
        score = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)
        out.append((i, len(own), sum(c[w] > 0 for w in own), n, score))
    return out


def compare(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], round(r[4], 3))
    got = sorted(((r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-7, abs_tol=1e-9)


def run(docs, **settings):
    held = hmm.F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return hmm.score_corpus(docs, held, settings=hmm.HmmSettings(**settings))


def test_edges_and_rare_words(spark):
    # so few frequent words that most go through the join
    got = run(brute.edge_frame(spark), frequent=5, own_classes=3).collect()
    compare(got, base_model(brute.EDGES))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_query(spark):
    docs = [(d["doc_id"], d["text"]) for d in brute.rows("documents", "/root/testdata/sf0.01")]
    got = queries.op3_hmm_scoring(spark, "/root/testdata/sf0.01").withColumnRenamed("doc_id", "id").collect()
    compare(got, base_model(docs))
    held = [r for r in got if r.held_out]
    assert {r.id for r in held} == {i for i, _ in docs if brute.crc_mod(i, 7) == 2}
    # the latent states explain unseen texts better than frequencies do
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_and_untrained(spark):
    assert run(brute.empty_frame(spark)).count() == 0
    only_held_out = spark.createDataFrame(
        [(i, "a b") for i in range(40) if brute.crc_mod(i, 7) == 2], "doc_id long, text string"
    )
    for r in run(only_held_out).collect():
        assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0


def random_model(k=3, c=4):
    rng = np.random.default_rng(3)
    parts = [rng.random(s) for s in ((k,), (k, k), (k, c))]
    return hmm.Hmm(*(p / p.sum(-1, keepdims=True) for p in parts))


def paths(model, seq):
    """Probability of every path of states."""
    for states in product(range(len(model.start)), repeat=len(seq)):
        p = model.start[states[0]] * model.emits[states[0], seq[0]]
        for a, b, o in zip(states, states[1:], seq[1:]):
            p *= model.moves[a, b] * model.emits[b, o]
        yield states, p


def test_forward_and_counts_against_all_paths():
    model = random_model()
    seqs = [[0, 1, 2], [3], [1, 1, 0, 2, 3]]
    flat = np.concatenate(seqs)
    sizes = np.array([len(s) for s in seqs])
    starts = np.cumsum(sizes) - sizes
    got = hmm.forward_log10(model, flat, starts, sizes)
    start, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))
    for seq, value in zip(seqs, got):
        every = list(paths(model, seq))
        total = sum(p for _, p in every)
        assert math.isclose(value, math.log10(total), rel_tol=1e-9)
        for states, p in every:
            start[states[0]] += p / total
            for a, b in zip(states, states[1:]):
                moves[a, b] += p / total
            for s, o in zip(states, seq):
                emits[s, o] += p / total
    for run in (256, 1, 2, 3):
        counted = hmm.expected_counts(model, flat, starts, sizes, run)
        for a, b in zip(counted, (start, moves, emits)):
            assert np.allclose(a, b)
        assert math.isclose(counted[3], got.sum())


def test_counts_do_not_depend_on_runs():
    rng = np.random.default_rng(9)
    k, c = 8, 500
    parts = [rng.gamma(0.3, 1.0, s) + 1e-9 for s in ((k,), (k, k), (k, c))]
    model = hmm.Hmm(*(p / p.sum(-1, keepdims=True) for p in parts))
    sizes = np.array([1000, 1, 256, 257, 30_000, 512, 12])
    flat = rng.integers(0, c, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    whole = hmm.expected_counts(model, flat, starts, sizes, 1 << 20)
    assert math.isclose(whole[3], hmm.forward_log10(model, flat, starts, sizes).sum(), rel_tol=1e-9)
    assert math.isclose(whole[0].sum(), len(sizes)) and math.isclose(whole[1].sum(), (sizes - 1).sum())
    for run in (256, 7):
        cut = hmm.expected_counts(model, flat, starts, sizes, run)
        for a, b in zip(cut, whole):
            assert np.allclose(a, b, rtol=1e-7, atol=1e-9)


def test_rounds_never_lose_likelihood():
    rng = np.random.default_rng(5)
    flat = rng.integers(0, 4, 3000)
    sizes = np.full(30, 100)
    starts = np.cumsum(sizes) - sizes
    model, last = random_model(), -math.inf
    for _ in range(5):
        s, m, e, loglik = hmm.expected_counts(model, flat, starts, sizes)
        assert loglik >= last - 1e-6
        last = loglik
        model = hmm.Hmm(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True))


def test_ending_class_is_the_same_in_spark(spark):
    settings = hmm.HmmSettings()
    words = ["a", "é", "ab", "xyzé", "\U0001f600b", "日本語", "-", "don't"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", hmm._ending_class(F.col("w"), settings).alias("g")
    )
    assert all(r.g == hmm.ending_class(r.w, settings) for r in got.collect())


def test_training_holds_one_copy_of_its_states():
    rng = np.random.default_rng(1)
    settings = hmm.HmmSettings()
    model = hmm.first_guess(rng.integers(1, 1000, settings.classes).astype(float), settings)
    texts = [rng.integers(0, settings.classes, n).astype("<u2") for n in rng.integers(1, 1500, 1000)]
    column = pa.array([b"", *(t.tobytes() for t in texts)], pa.binary()).slice(1)
    tracemalloc.start()
    try:
        flat, starts, sizes = hmm._sequences(column)
        hmm.expected_counts(model, flat, starts, sizes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all((flat[a : a + n] == t).all() for t, a, n in zip(texts, starts, sizes, strict=True))
    # the states of 2048 runs of 256 tokens are 34 MB
    assert peak < 90e6
    assert [len(x) for x in hmm._sequences(column.slice(0, 0))] == [0, 0, 0]
