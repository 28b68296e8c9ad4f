"""Quality classifier: a generalised additive model with pairwise interactions.

The model is a sum of lookup tables over binned features: one table per feature and one
per chosen pair. Tables grow by cyclic boosting of shallow trees, one feature at a time
with a small rate, so that no feature takes the credit of another. Fitting needs a bounded
sample; scoring adds up table entries, in generated code or vectorised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_bucket
from .quality_rules import BLANKS, number_of, split_words, without

#: Inputs of the model, in the order of its tables.
FEATURES = (
    "log_chars",
    "word_length",
    "upper_share",
    "symbol_share",
    "shout_share",
    "bar_share",
    "digit_share",
    "stop_share",
    "distinct_words",
    "distinct_lines",
    "words_per_line",
    "closed_lines",
)


def with_features(docs: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """``docs`` with the features of whole texts as further columns.

    Null and empty texts have zeros. The text without blanks, its words and its lines are
    each made once and named; characters are counted by scans that are cheap where there is
    none. Names beginning with ``__gam_`` are taken while it works, and given back.
    """
    named = docs.select("*", F.coalesce(text, F.lit("")).alias("__gam_t")).select(
        "*",
        without(F.col("__gam_t"), BLANKS).alias("__gam_s"),
        split_words(F.col("__gam_t")).alias("__gam_w"),
        F.filter(F.split("__gam_t", "\n"), lambda x: F.trim(x) != "").alias("__gam_l"),
    )
    solid, words, lines = F.col("__gam_s"), F.col("__gam_w"), F.col("__gam_l")
    size, n, m = F.char_length(solid), F.size(words), F.size(lines)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    def dropped(characters: str) -> Column:
        return number_of(solid, characters)

    columns = (
        F.log1p(size),
        share(size, n),
        share(size - F.char_length(F.regexp_replace(solid, r"\p{Lu}", "")), size),
        share(dropped("#*$%&<>@^~_=+\\/"), size),
        share(dropped("!?"), size),
        share(dropped("|"), n),
        share(dropped("0123456789"), size),
        share(dropped(".,;:"), n),
        share(F.size(F.array_distinct(words)), n),
        share(F.size(F.array_distinct(lines)), m),
        share(n, m),
        share(F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(r"[.!?:;\"']\s*$")))), m),
    )
    return named.select(
        *docs.columns, *[c.cast("double").alias(prefix + name) for c, name in zip(columns, FEATURES)]
    )


@dataclass
class Gam:
    """Bin edges per feature, a table per feature, a table per pair, and the intercept."""

    edges: list[np.ndarray]
    mains: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.mains)):
            total += values[np.searchsorted(edges, x[:, j], "right")]
        for a, b, ea, eb, values in self.pairs:
            at = np.searchsorted(ea, x[:, a], "right"), np.searchsorted(eb, x[:, b], "right")
            total += values[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, splits: int) -> np.ndarray:
    """Values per bin of a tree with at most ``splits`` cuts over ordered bins."""
    out = np.empty(len(g))
    spans = [(0, len(g))]
    cg, ch = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
    for _ in range(splits):
        best = None
        for k, (lo, hi) in enumerate(spans):
            if hi - lo < 2:
                continue
            cut = np.arange(lo + 1, hi)
            gl, hl = cg[cut] - cg[lo], ch[cut] - ch[lo]
            gr, hr = cg[hi] - cg[cut], ch[hi] - ch[cut]
            whole = (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + 1.0)
            gain = gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0) - whole
            i = int(gain.argmax())
            if best is None or gain[i] > best[0]:
                best = (gain[i], k, int(cut[i]))
        if best is None or best[0] <= 1e-9:
            break
        lo, hi = spans[best[1]]
        spans[best[1] : best[1] + 1] = [(lo, best[2]), (best[2], hi)]
    for lo, hi in spans:
        out[lo:hi] = _leaf(cg[hi] - cg[lo], ch[hi] - ch[lo])
    return out


def fit_gam(
    x: np.ndarray,
    y: np.ndarray,
    bins: int = 32,
    pair_bins: int = 6,
    rounds: int = 150,
    pair_rounds: int = 40,
    n_pairs: int = 6,
    rate: float = 0.1,
) -> Gam:
    """Cyclic boosting: every round visits each feature once with one shallow tree.

    Pairs are ranked by what a table over both would still explain of the residuals, and
    the best ``n_pairs`` are boosted after the single features. The result depends on the
    rows only, not on their order beyond rounding. Without rows of both classes the model
    is constant.
    """
    d = x.shape[1] if x.ndim == 2 else 0
    positive = float(y.sum())
    base = float(np.log((positive + 1.0) / (len(y) - positive + 1.0)))
    if len(y) == 0 or positive in (0.0, float(len(y))):
        flat = [np.zeros(1) for _ in range(d)]
        return Gam([np.zeros(0)] * d, flat, [], base)
    edges = [_edges(x[:, j], bins) for j in range(d)]
    at = [np.searchsorted(edges[j], x[:, j], "right") for j in range(d)]
    mains = [np.zeros(len(e) + 1) for e in edges]
    margin = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-margin))
        return y - p, p * (1.0 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            size = len(mains[j])
            step = rate * _shallow_tree(
                np.bincount(at[j], g, size), np.bincount(at[j], h, size), splits=3
            )
            mains[j] += step
            margin += step[at[j]]
    coarse = [_edges(x[:, j], pair_bins) for j in range(d)]
    cat = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(d)]
    wide = [len(e) + 1 for e in coarse]
    g, h = slopes()
    gains = []
    for a in range(d):
        for b in range(a + 1, d):
            cell = cat[a] * wide[b] + cat[b]
            sg, sh = np.bincount(cell, g), np.bincount(cell, h)
            gains.append((float((sg**2 / (sh + 1.0)).sum()), -a, -b))
    chosen = [(-a, -b) for _, a, b in sorted(gains, reverse=True)[:n_pairs]]
    tables = [np.zeros(wide[a] * wide[b]) for a, b in chosen]
    for _ in range(pair_rounds):
        for (a, b), values in zip(chosen, tables):
            g, h = slopes()
            cell = cat[a] * wide[b] + cat[b]
            step = rate * _leaf(
                np.bincount(cell, g, len(values)), np.bincount(cell, h, len(values))
            )
            values += step
            margin += step[cell]
    pairs = [
        (a, b, coarse[a], coarse[b], t.reshape(wide[a], wide[b])) for (a, b), t in zip(chosen, tables)
    ]
    return Gam(edges, mains, pairs, base)


def training_sample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = 20_000,
    folds: int = 5,
    held_out: int = 0,
) -> DataFrame:
    """Features and label of at most ``max_rows`` labelled rows outside the held-out fold.

    The sample takes the labelled ids of least hash, so it is the same on every run. Rows
    with a null label or null id are left out; an id labelled twice counts twice.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
        .where(id_bucket(id_col, folds) != held_out)
        .select(F.col(id_col).alias("__id"), F.col("quality").cast("double").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id", "__label")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = texts.join(F.broadcast(chosen), "__id").select("__text", "__label")
    return with_features(rows, F.col("__text")).select(*FEATURES, F.col("__label").alias("label"))


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **columns) -> Gam:
    """Fit on the driver; what it gathers is bounded by ``max_rows`` rows of numbers."""
    rows = training_sample(docs, labels, max_rows=max_rows, **columns).toArrow()
    return fit_gam(np.column_stack([rows[f].to_numpy() for f in FEATURES]), rows["label"].to_numpy())


def score_quality(
    docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, score`` for every row: the probability that the text's label is 1.

    Null text counts as empty, and empty text gets the score of its zero features. Repeated
    rows give repeated results; other columns are not looked at. The model (a few thousand
    numbers) travels with the task; there is no shuffle.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    wide = with_features(texts, F.col("__text")).drop("__text")
    kind = wide.schema["id"].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(False) for f in FEATURES])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(model.score(x))], ["id", "score"]
            )

    return wide.mapInArrow(score, f"id {kind.simpleString()}, score double")


def margin_column(model: Gam, prefix: str = "") -> Column:
    """The model's margin as an expression over feature columns, its tables as literals."""

    def table(values: np.ndarray) -> Column:
        return F.array(*[F.lit(float(v)) for v in values.ravel()])

    def place(edges: np.ndarray, j: int) -> Column:
        if not len(edges):
            return F.lit(0)
        return F.size(F.filter(table(edges), lambda e: e <= F.col(prefix + FEATURES[j])))

    total = F.lit(float(model.base))
    for j, (edges, values) in enumerate(zip(model.edges, model.mains)):
        total = total + F.get(table(values), place(edges, j))
    for a, b, ea, eb, values in model.pairs:
        total = total + F.get(table(values), place(ea, a) * values.shape[1] + place(eb, b))
    return total


def keep_good(docs: DataFrame, model: Gam, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``.

    Scored in generated code, so that no text travels to Python: the tables are literals. Null
    and empty texts have the score of zero features, repeated rows and null ids are judged
    each on their own, very long texts are read whole, and an empty table stays empty.
    """
    mark = "__feature_"
    wide = with_features(docs, F.col(text_col), mark)
    limit = float(np.log(least / (1.0 - least)))
    judged = wide.select(
        *docs.columns,
        (margin_column(model, mark) >= limit).alias("__good"),
        F.monotonically_increasing_id().alias("__mark"),
    )
    # a filter is not moved below a numbered projection; there, it would repeat all the work
    return judged.where("__good AND __mark >= 0").select(*docs.columns)
