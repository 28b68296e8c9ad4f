"""Language model: hidden Markov model over word classes, trained by Baum-Welch.

The most frequent words are classes of their own, every other word belongs to the class of
its ending, and the end of a text is a class. A text's probability is that of its class
sequence, by the scaled forward recursion over the whole text, times that of each word in
its class, from add-one counts over all training texts. Counts of frequent words travel as
a broadcast of bounded size; all others are looked up by a shuffle join, so nothing is
left out however large the vocabulary is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import give_back, text_blocks, word_codes

#: Bytes of text that are counted or coded at once, and of class codes that are trained on at once.
TEXT_BYTES, CODE_BYTES = 8 << 20, 4 << 20


@dataclass(frozen=True)
class HmmSettings:
    states: int = 8
    rounds: int = 4
    #: Words that are classes of their own, and classes of word endings.
    own_classes: int = 2048
    endings: int = 509
    #: Words in the broadcast table of counts, and the longest of them in bytes: at most
    #: 200,000 x 128 bytes.
    frequent: int = 200_000
    frequent_bytes: int = 128
    #: Training works through texts in runs of so many tokens; its counts do not depend on it.
    run_tokens: int = 256

    @property
    def classes(self) -> int:
        return self.own_classes + 1 + self.endings


def ending_class(word: str, settings: HmmSettings) -> int:
    code = zlib.crc32(word[-2:].encode("utf-8"))
    return settings.own_classes + 1 + code % settings.endings


def _ending_class(word: Column, settings: HmmSettings) -> Column:
    code = F.crc32(F.right(word, F.lit(2)).cast("binary"))
    return (F.lit(settings.own_classes + 1) + code % settings.endings).cast("int")


@dataclass
class Hmm:
    """Log-free parameters: start, transitions and emissions by state."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


def first_guess(class_counts: np.ndarray, settings: HmmSettings) -> Hmm:
    """Every state starts near the corpus distribution, disturbed by a fixed random stream."""
    rng = np.random.default_rng(7)
    k = settings.states
    emits = (class_counts + 0.5) * rng.gamma(1.0, 1.0, (k, len(class_counts)))
    moves = np.full((k, k), 0.2 / k) + 0.8 * np.eye(k)
    return Hmm(np.full(k, 1.0 / k), moves, emits / emits.sum(1, keepdims=True))


def _transfers(model: Hmm, codes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Per run, up to a factor, the matrix that takes the distribution before its first token
    to that before the token after its last one."""
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    k, longest = len(model.start), int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(longest), "left")
    emit = np.ascontiguousarray(model.emits.T)
    found = np.tile(np.eye(k), (len(begin), 1, 1))
    for t in range(longest):
        n = int(alive[t])
        ahead = found[:n] * emit[codes[begin[:n] + t]][:, None, :]
        if t % 8 == 7:
            ahead /= ahead.max((1, 2))[:, None, None]
        found[:n] = (ahead.reshape(-1, k) @ model.moves).reshape(n, k, k)
    out = np.empty_like(found)
    out[order] = found / found.max((1, 2))[:, None, None]
    return out


def _run_counts(
    model: Hmm,
    codes: np.ndarray,
    begin: np.ndarray,
    length: np.ndarray,
    entry: np.ndarray,
    after: np.ndarray,
    first: np.ndarray,
    last: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Counts of many runs at once, given what the rest of their texts says about their ends.

    ``entry`` is the distribution before a run's first token, ``after`` the likelihood of all
    that follows the run by the state it starts in. Runs are sorted by length, so that step
    ``t`` works on the runs that are that long.
    """
    order = np.argsort(-length, kind="stable")
    begin, length, entry, after, first, last = (
        x[order] for x in (begin, length, entry, after, first, last)
    )
    k, longest = len(model.start), int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(longest), "left")
    emit = model.emits.T
    alphas, scales, seen = [], [], []
    loglik = 0.0
    for t in range(longest):
        n = int(alive[t])
        codes_t = codes[begin[:n] + t]
        alpha = (entry if t == 0 else alphas[-1][:n] @ model.moves) * emit[codes_t]
        scale = alpha.sum(1)
        loglik += float(np.log10(scale).sum())
        alphas.append(alpha / scale[:, None])
        scales.append(scale)
        seen.append(codes_t)
    moves = np.zeros((k, k))
    beyond = after @ model.moves.T
    beta = np.ones((0, k))
    for t in range(longest - 1, -1, -1):
        n = int(alive[t])
        m = int(alive[t + 1]) if t + 1 < longest else 0
        if m:
            ahead = emit[seen[t + 1]] * beta / scales[t + 1][:, None]
            moves += model.moves * (alphas[t][:m].T @ ahead)
            beta = ahead @ model.moves.T
        # runs that end here: the move into the next run, if there is one, counts as well
        ends = alphas[t][m:]
        total = (ends * beyond[m:n]).sum(1)
        inner = ~last[m:n]
        moves += model.moves * (ends[inner].T @ (after[m:n][inner] / total[inner, None]))
        beta = np.concatenate([beta, beyond[m:n] / total[:, None]])
        alphas[t] *= beta  # from here on the chance of each state
    emits = np.zeros_like(model.emits)
    start = np.zeros(k)
    if longest:
        start = alphas[0][first].sum(0)
        all_codes = np.concatenate(seen)
        gamma = np.concatenate(alphas)
        for s in range(k):
            emits[s] = np.bincount(all_codes, gamma[:, s], emits.shape[1])
    return start, moves, emits, loglik


def expected_counts(
    model: Hmm, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, run_tokens: int = 256
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (start, moves, emits) of whole sequences, and their log10 likelihood.

    Long sequences are worked through in runs, side by side: the product of a run's steps is
    one small matrix, and chains of these give the exact distribution at each run's begin and
    the exact likelihood of what follows it. So the counts do not depend on ``run_tokens``,
    and neither do memory and steps on the length of a text, but for one matrix a run.
    """
    k = len(model.start)
    pieces = -(-sizes // run_tokens)
    heads = np.cumsum(pieces) - pieces
    nth = np.arange(pieces.sum()) - np.repeat(heads, pieces)
    begin = np.repeat(starts, pieces) + nth * run_tokens
    length = np.minimum(run_tokens, np.repeat(sizes, pieces) - nth * run_tokens)
    first, last = nth == 0, nth == np.repeat(pieces, pieces) - 1
    entry = np.tile(model.start, (len(begin), 1))
    after = np.ones((len(begin), k))
    cut = np.flatnonzero(~(first & last))
    if len(cut):
        matrices = np.concatenate(
            [_transfers(model, codes, begin[part], length[part]) for part in _parts(cut)]
        )
        place = np.empty(len(begin), dtype=np.int64)
        place[cut] = np.arange(len(cut))
        # texts with most runs first, so that step r works on the texts that have run r
        order = np.argsort(-pieces, kind="stable")
        heads, counts = heads[order], pieces[order]
        alive = np.searchsorted(-counts, -np.arange(int(counts[0])), "left")
        for r in range(len(alive) - 1):
            own = heads[: alive[r + 1]] + r
            ahead = np.einsum("ni,nij->nj", entry[own], matrices[place[own]])
            entry[own + 1] = ahead / ahead.sum(1, keepdims=True)
        for r in range(len(alive) - 1, 0, -1):
            own = heads[: alive[r]] + r
            back = np.einsum("nij,nj->ni", matrices[place[own]], after[own])
            after[own - 1] = back / back.max(1, keepdims=True)
    sums = [np.zeros_like(x) for x in (model.start, model.moves, model.emits)]
    loglik = 0.0
    for part in _parts(np.arange(len(begin))):
        *counted, value = _run_counts(
            model, codes, *(x[part] for x in (begin, length, entry, after, first, last))
        )
        for total, x in zip(sums, counted):
            total += x
        loglik += value
    return *sums, loglik


def _parts(which: np.ndarray) -> Iterator[np.ndarray]:
    """About half a million tokens of runs at a time."""
    for at in range(0, len(which), 2048):
        yield which[at : at + 2048]


def next_model(start: np.ndarray, moves: np.ndarray, emits: np.ndarray, prior: np.ndarray) -> Hmm:
    """Parameters from counts; ``prior`` keeps every class possible in every state."""
    start = start + 0.1
    moves = moves + 0.1
    emits = emits + prior
    return Hmm(
        start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True)
    )


def forward_log10(model: Hmm, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 likelihood of whole sequences, many at once, scaled at every step."""
    order = np.argsort(-sizes, kind="stable")
    begin, length = starts[order], sizes[order]
    total = np.zeros(len(sizes))
    emit = np.ascontiguousarray(model.emits.T)
    longest = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(longest), "left")
    alpha = np.zeros((0, len(model.start)))
    for t in range(longest):
        n = int(alive[t])
        alpha = (model.start if t == 0 else alpha[:n] @ model.moves) * emit[codes[begin[:n] + t]]
        scale = alpha.sum(1)
        total[:n] += np.log10(scale)
        alpha /= scale[:, None]
    out = np.empty(len(sizes))
    out[order] = total
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """``word, c`` over all texts; blocks are counted before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "t", TEXT_BYTES):
            words, codes, _ = word_codes(batch.column("t"))
            n = np.bincount(codes, minlength=len(words))
            del codes
            found = np.flatnonzero(n)
            words = words.take(pa.array(found)).cast(pa.string())
            for at in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [words.slice(at, 1 << 16), pa.array(n[found[at : at + (1 << 16)]])], ["word", "c"]
                )
            del words, n, found
            give_back()

    return texts.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


_CODED = (
    "k long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, within double, codes binary,"
    " rare array<struct<word: string, n: long>>"
)


def code_texts(
    rows: DataFrame, table: tuple[list[str], np.ndarray], train_docs: int, settings: HmmSettings
) -> DataFrame:
    """Class sequences of texts, sums over their frequent words, and their rare words."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    own = end = settings.own_classes
    kind_of_id = rows.schema["id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known, counts_known = shared.value
        place = {w: i for i, w in enumerate(words_known)}
        logs = np.log10(counts_known + 1.0)
        end_log = float(np.log10(train_docs + 1.0))
        for batch in text_blocks(batches, "t", TEXT_BYTES):
            words, codes, offsets = word_codes(batch.column("t"))
            texts = words.to_pylist()
            rank = np.array([place.get(w, -1) for w in texts], dtype=np.int64)
            kind = np.array(
                [r if 0 <= r < own else ending_class(w, settings) for w, r in zip(texts, rank.tolist())],
                dtype=np.uint16,
            )
            value = np.where(rank >= 0, logs[rank] if len(logs) else 0.0, 0.0)
            n = np.diff(offsets)
            docs = np.repeat(np.arange(len(n)), n)
            word_rank = rank[codes]

            def summed(x: np.ndarray) -> np.ndarray:
                return np.bincount(docs, x, len(n)).astype(float)

            base = summed(value[codes]) + end_log
            within = summed(np.where(word_rank >= own, value[codes], 0.0))
            known = summed((word_rank >= 0).astype(float)).astype(np.int64) + (train_docs > 0)
            sequence = np.full(len(codes) + len(n), end, dtype=np.uint16)
            sequence[np.arange(len(codes)) + docs] = kind[codes]
            raw = sequence.astype("<u2").tobytes()
            ends = (offsets[1:] + np.arange(1, len(n) + 1)) * 2
            begins = np.concatenate([[0], ends[:-1]])
            rare = np.flatnonzero(word_rank < 0)
            pairs, times = np.unique(docs[rare] * max(1, len(texts)) + codes[rare], return_counts=True)
            rare_docs, rare_words = np.divmod(pairs, max(1, len(texts)))
            bounds = np.searchsorted(rare_docs, np.arange(len(n) + 1))
            items = pa.StructArray.from_arrays(
                [words.take(pa.array(rare_words)).cast(pa.string()), pa.array(times, pa.int64())],
                ["word", "n"],
            )
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)
            coded = pa.array([raw[a:b] for a, b in zip(begins.tolist(), ends.tolist())], pa.binary())
            whole = pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("k", "id", "held_out")),
                    *map(pa.array, (n + 1, known, base, within)),
                    coded,
                    lists,
                ],
                ["k", "id", "held_out", "n_tokens", "n_known", "base", "within", "codes", "rare"],
            )
            del words, texts, codes, docs, word_rank, sequence, raw, rare, pairs, times, rare_words, items, lists, coded
            for at in range(0, whole.num_rows, 2048):
                yield whole.slice(at, 2048)
            del whole
            give_back()

    return rows.select("k", "id", "held_out", "t").mapInArrow(code, _CODED.format(kind=kind_of_id))


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class codes of all texts, not copied, and where each text begins and how long it is."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, "<u2"), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype="<u2", count=(bounds[-1] - bounds[0]) // 2, offset=bounds[0])
    sizes = np.diff(bounds) // 2
    return flat, np.cumsum(sizes) - sizes, sizes


def train(coded: DataFrame, class_counts: np.ndarray, settings: HmmSettings) -> Hmm:
    """Baum-Welch over all coded texts; per round, tasks' counts are added up by Spark.

    What reaches the driver is the model's own size, states x classes numbers.
    """
    model = first_guess(class_counts, settings)
    share = (class_counts + 0.5) / (class_counts + 0.5).sum()
    k, c = model.emits.shape
    cells = k + k * k + k * c

    for _ in range(settings.rounds):

        def count(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(cells)
            for batch in text_blocks(batches, "codes", CODE_BYTES):
                counts = expected_counts(model, *_sequences(batch.column("codes")), settings.run_tokens)
                sums += np.concatenate([x.ravel() for x in counts[:3]])
                give_back()
            found = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], ["cell", "v"])

        added = coded.select("codes").mapInArrow(count, "cell long, v double")
        rows = added.groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
        sums = np.zeros(cells)
        sums[rows["cell"].to_numpy()] = rows["v"].to_numpy()
        model = next_model(
            sums[:k], sums[k : k + k * k].reshape(k, k), sums[k + k * k :].reshape(k, c), share * 10.0
        )
    return model


def score_corpus(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: HmmSettings | None = None,
) -> DataFrame:
    """Train on the rows that are not held out and score every row's whole text.

    Returns ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row
    per input row. Tokens are words (A-Z in lower case; blanks, tabs and line ends
    separate) and one end per text; null text is empty and has only its end.
    ``base_score`` is the log10 probability under add-one word frequencies, ``score`` under
    the model. Repeated rows count as often as they occur. Without training rows every word
    is unknown and both models are uniform over what they know; an empty table gives none.
    """
    settings = settings or HmmSettings()
    rows = docs.select(
        F.col(id_col).alias("id"),
        held_out.alias("held_out"),
        F.col(text_col).alias("t"),
        F.monotonically_increasing_id().alias("k"),
    )
    training = rows.where(~F.col("held_out"))
    counts = stage(count_words(training.select("t")), "lm-counts")
    train_docs = training.count()
    sums = counts.agg(F.sum("c"), F.count("*")).first()
    total = int(sums[0] or 0) + train_docs
    distinct = int(sums[1]) + (train_docs > 0)
    top = (
        counts.where(F.octet_length("word") <= settings.frequent_bytes)
        .orderBy(F.desc("c"), "word")
        .limit(settings.frequent)
        .toArrow()
    )
    table = (top["word"].to_pylist(), top["c"].to_numpy())
    # per class: its tokens and its words
    n_class = np.zeros(settings.classes)
    v_class = np.zeros(settings.classes)
    own = min(settings.own_classes, top.num_rows)
    n_class[:own] = table[1][:own]
    n_class[settings.own_classes] = train_docs
    others = counts
    if own:
        own_words = docs.sparkSession.createDataFrame([(w,) for w in table[0][:own]], "word string")
        others = counts.join(F.broadcast(own_words), "word", "left_anti")
    per_class = others.groupBy(_ending_class(F.col("word"), settings).alias("g")).agg(
        F.sum("c").alias("n"), F.count("*").alias("v")
    )
    for r in per_class.collect():
        n_class[r.g], v_class[r.g] = r.n, r.v
    coded = stage(code_texts(rows, table, train_docs, settings), "lm-coded")
    model = train(coded.where(~F.col("held_out")), n_class, settings)
    open_class = np.arange(settings.classes) > settings.own_classes
    norm = np.where(open_class, np.log10(n_class + v_class + 1.0), 0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts, sizes = _sequences(batch.column("codes"))
            # every text has its end at least, so none of these sums is over nothing
            words = batch.column("within").to_numpy() - np.add.reduceat(norm[flat], starts)
            total_log = forward_log10(model, flat, starts, sizes) + words
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), pa.array(total_log)], [*kept, "part"]
            )
            give_back()

    kept = ("k", "id", "held_out", "n_tokens", "n_known", "base")
    kind = rows.schema["id"].dataType.simpleString()
    scored = coded.select(*kept, "within", "codes").mapInArrow(
        score,
        f"k long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, part double",
    )
    rare = (
        coded.select("k", F.explode("rare").alias("r"))
        .select("k", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
        .join(counts, "word", "left")
        .groupBy("k")
        .agg(
            F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_log"),
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        )
    )
    unit = float(np.log10(total + distinct + 1.0))
    joined = scored.join(rare, "k", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return joined.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("part") + rare_log).alias("score"),
    )
