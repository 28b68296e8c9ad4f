"""M1: isolation forest (Liu, Ting and Zhou 2008) over per-IP features.

Each tree sees a sample of bounded size, so trees are grown in parallel, one group per
tree, and scoring is one pass over the features with the trees as a small fixed-size
model. All randomness comes from MD5 of (seed, tree, node) and of the IP: the same input
gives the same trees under any partitioning, and any engine with MD5 can grow them again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One row per node. The root is node 1, the children of node k are 2k (values up to the
#: cut) and 2k + 1. A leaf has feature -1; ``size`` is the sampled rows that reach a node.
NODE_SCHEMA = "tree int, node int, feature int, cut double, size int"

#: A prime; draws are numbers below it.
PRIME = (1 << 31) - 1


def _numbers(text: str) -> tuple[int, int]:
    """Two 32-bit numbers from the MD5 of a text."""
    digest = hashlib.md5(text.encode(), usedforsecurity=False).digest()
    return int.from_bytes(digest[:4], "big"), int.from_bytes(digest[4:8], "big")


def tree_factor(seed: int, tree: int) -> int:
    """The factor of a tree's draws, from 1 to PRIME - 1."""
    return 1 + _numbers(f"{seed}:{tree}")[0] % (PRIME - 1)


def sample_per_tree(features: DataFrame, trees: int, sample: int, seed: int) -> DataFrame:
    """``tree`` and the features of up to ``sample`` IPs for each tree.

    With x and y the first two 32-bit numbers of the IP's MD5, a tree's draw of an IP is
    (x * factor + y) mod PRIME; the IPs with the smallest draws form its sample, equal
    draws by IP. A row enters only where its draw falls below about twice the needed share,
    so what is shuffled does not grow with the table.
    """
    n = features.agg(F.count("*").alias("n")).scalar()
    bound = F.least(F.lit(1.0), F.lit(2.0 * sample) / n) * F.lit(float(PRIME))
    digest = F.md5(F.col("ip").cast("binary"))

    def number(at: int) -> Column:
        return F.conv(F.substring(digest, at, 8), 16, 10).cast("long")

    factors = F.array(
        *[F.struct(F.lit(t).alias("tree"), F.lit(tree_factor(seed, t)).cast("long").alias("f")) for t in range(trees)]
    )
    drawn = F.filter(
        F.transform(
            factors,
            lambda t: F.struct(
                t["tree"].alias("tree"), ((F.col("x") * t["f"] + F.col("y")) % PRIME).alias("draw")
            ),
        ),
        lambda t: t["draw"] <= F.col("bound"),
    )
    rows = features.select(
        *features.columns, (number(1) % PRIME).alias("x"), number(9).alias("y"), bound.alias("bound")
    ).select(*features.columns, F.inline(drawn))
    order = Window.partitionBy("tree").orderBy("draw", "ip")
    return (
        rows.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= sample)
        .drop("place", "draw")
    )


def _tree_grower(columns: Sequence[str], seed: int, max_depth: int):
    columns = list(columns)

    def grow(group):
        import numpy as np
        import pandas as pd

        tree = int(group["tree"].iloc[0])
        data = group[columns].to_numpy(dtype=float)
        nodes = []
        todo = [(np.arange(len(data)), 1, 0)]
        while todo:
            rows, node, level = todo.pop()
            part = data[rows]
            usable = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) else []
            if level >= max_depth or len(rows) <= 1 or len(usable) == 0:
                nodes.append((tree, node, -1, 0.0, len(rows)))
                continue
            first, second = _numbers(f"{seed}:{tree}:{node}")
            column = int(usable[int(first / 2.0**32 * len(usable))])
            low, high = part[:, column].min(), part[:, column].max()
            cut = float(low + second / 2.0**32 * (high - low))
            below = part[:, column] <= cut
            nodes.append((tree, node, column, cut, len(rows)))
            todo.append((rows[~below], 2 * node + 1, level + 1))
            todo.append((rows[below], 2 * node, level + 1))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "size"])

    return grow


def _scorer(model, columns: Sequence[str], norm: float, max_depth: int):
    """Scores of feature batches. ``model`` is a broadcast list of node rows by tree."""
    columns = list(columns)

    def score(batches):
        import numpy as np

        trees = []
        for nodes in model.value:
            feature = np.full(2 << max_depth, -1)
            cut, length = np.zeros(2 << max_depth), np.zeros(2 << max_depth)
            for _, node, column, value, size in nodes:
                feature[node], cut[node] = column, value
                length[node] = node.bit_length() - 1 + expected_path(size)
            trees.append((feature, cut, length))
        for batch in batches:
            data = batch[columns].to_numpy(dtype=float)
            rows = np.arange(len(data))
            total = np.zeros(len(data))
            for feature, cut, length in trees:
                node = np.ones(len(data), dtype=np.int64)
                for _ in range(max_depth):
                    column = feature[node]
                    value = data[rows, np.maximum(column, 0)]
                    node = np.where(column < 0, node, 2 * node + (value > cut[node]))
                total += length[node]
            yield batch[["ip"]].assign(score=-np.power(2.0, -(total / len(trees)) / norm))

    return score


def expected_path(size: int) -> float:
    """Mean path length of an unsuccessful search among ``size`` points."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (math.log(size - 1) + 0.5772156649015329) - 2.0 * (size - 1) / size


def sample_size(features: DataFrame, max_samples: int) -> int:
    return min(max_samples, max(2, features.count()))


def depth_limit(sample: int) -> int:
    return max(1, math.ceil(math.log2(sample)))


def grow_forest(
    features: DataFrame, columns: Sequence[str], trees: int, sample: int, seed: int
) -> DataFrame:
    """All nodes of all trees as rows: ``tree, node, feature, cut, size``.

    ``feature`` is a place in ``columns``. A node picks, by its two numbers, one of the
    columns that differ within it and a cut between their extremes.
    """
    drawn = sample_per_tree(features.select("ip", *columns), trees, sample, seed)
    return drawn.groupBy("tree").applyInPandas(
        _tree_grower(columns, seed, depth_limit(sample)), NODE_SCHEMA
    )


def anomaly_scores(
    features: DataFrame,
    columns: Sequence[str],
    trees: int = 200,
    max_samples: int = 256,
    seed: int = 42,
) -> DataFrame:
    """``ip, score``; the lower the score, the more unusual the IP.

    ``features`` is read several times; hand in a stored table. Null features are not
    allowed.
    """
    spark = features.sparkSession
    sample = sample_size(features, max_samples)
    # the model: trees x (2 x sample) nodes at most, whatever the number of IPs
    by_tree: dict[int, list[tuple]] = {}
    for r in grow_forest(features, columns, trees, sample, seed).collect():
        by_tree.setdefault(r["tree"], []).append(tuple(r))
    model = spark.sparkContext.broadcast([by_tree[t] for t in sorted(by_tree)])
    scorer = _scorer(model, columns, expected_path(sample), depth_limit(sample))
    return features.select("ip", *columns).mapInPandas(scorer, "ip string, score double")
