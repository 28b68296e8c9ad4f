"""Vectors compressed to one byte per part, codebooks learned by a dual-tree Lloyd.

Vectors of whole numbers are cut into equal parts; each part position has a codebook.
In a block of vectors, the points of a position are folded by value and put into a tree
whose nodes carry their box, count and sum; the entries are put into a tree of boxes as
well. Pairs of nodes are compared by the distances their boxes allow: an entry that
cannot be nearest to any point of a node is dropped for the node, and a node that is
left with one entry goes to it as a whole, by its stored sum. Only leaves that keep several
entries look at points, in whole numbers. All bounds are exact integers, so the
assignment is that of a full search, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import attach

#: A component may be as large as this, divided by the root of the vector's length (2^18 with
#: 64 components). Beyond it squared distances would not fit into 64 bits.
LARGEST = float(1 << 21)
#: A whole number per 1 / SCALE.
SCALE = 256
#: Points of a leaf of the points' tree.
LEAF = 32
#: Components of the vectors that one step holds at once.
BLOCK = 1 << 20


class Tree:
    """A kd-tree over rows of whole numbers, cut at medians of the widest side.

    ``order`` lists the rows leaf by leaf; node ``k`` holds ``order[first[k]:last[k]]``, lies
    in the box ``low[k]`` to ``high[k]`` and has the children ``left[k]`` and ``right[k]``
    (-1: a leaf). ``count`` and ``total`` are the node's weights and weighted sum.
    """

    def __init__(self, points: np.ndarray, weights: np.ndarray, leaf: int) -> None:
        n = len(points)
        self.order = np.arange(n)
        firsts, lasts = [np.array([0])], [np.array([n])]
        lows, highs, lefts = [], [], []
        known = 1
        while True:
            first, last = firsts[-1], lasts[-1]
            sizes = last - first
            rows, node = self._rows(first, sizes)
            own = points[self.order[rows]]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            low, high = np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)
            lows.append(low)
            highs.append(high)
            split = (sizes > leaf) & (low < high).any(axis=1)
            left = np.full(len(sizes), -1)
            if split.any():
                left[split] = known + 2 * np.arange(int(split.sum()))
            lefts.append(left)
            if not split.any():
                break
            side = np.argmax(high - low, axis=1)
            value = own[np.arange(len(own)), side[node]]
            # within a node by the widest side; other nodes keep their rows
            self.order[rows] = self.order[rows][np.lexsort((np.where(split[node], value, 0), node))]
            middle = first + sizes // 2
            a = np.column_stack([first[split], middle[split]]).ravel()
            b = np.column_stack([middle[split], last[split]]).ravel()
            known += len(a)
            firsts.append(a)
            lasts.append(b)
        self.first, self.last = np.concatenate(firsts), np.concatenate(lasts)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        self.left = np.concatenate(lefts)
        self.right = np.where(self.left < 0, -1, self.left + 1)
        running = np.zeros((n + 1, points.shape[1] + 1), dtype=np.int64)
        weighted = np.column_stack([weights, points * weights[:, None]])
        np.cumsum(weighted[self.order], axis=0, out=running[1:])
        sums = running[self.last] - running[self.first]
        self.count, self.total = sums[:, 0], sums[:, 1:]

    @staticmethod
    def _rows(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of the given nodes, and each one's node."""
        node = np.repeat(np.arange(len(first)), sizes)
        ends = np.cumsum(sizes)
        return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes) + first[node], node


def _apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray):
    """Least and largest squared distance between points of two boxes, row by row."""
    gap = np.maximum(0, np.maximum(low - other_high, other_low - high))
    span = np.maximum(high - other_low, other_high - low)
    return (gap * gap).sum(axis=1), (span * span).sum(axis=1)


def _least(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, groups, values)
    return out


def nearest(points: Tree, rows: np.ndarray, entries: Tree, book: np.ndarray):
    """Which entry each point belongs to, whole nodes first.

    Yields ``(nodes, None, entries)`` for nodes that belong to one entry as a whole and
    ``(None, points, entries)`` for single points. Of equally near entries the lowest
    number counts.
    """
    n = len(points.first)
    node, group = np.array([0]), np.array([0])
    while len(node):
        near, far = _apart(points.low[node], points.high[node], entries.low[group], entries.high[group])
        stay = near <= _least(node, far, n)[node]
        node, group = node[stay], group[stay]
        leaf_pair = (points.left[node] < 0) & (entries.left[group] < 0)
        single = entries.left[group] < 0
        # nodes all of whose entry nodes are leaves: look at the entries themselves
        open_groups = np.zeros(n, dtype=bool)
        open_groups[node[~single]] = True
        ready = ~open_groups[node]
        if ready.any():
            at, size = group[ready], (entries.last - entries.first)[group[ready]]
            places, pair = Tree._rows(entries.first[at], size)
            owner, entry = node[ready][pair], entries.order[places]
            owner, entry = _undominated(points, owner, entry, book, n)
            times = np.bincount(owner, minlength=n)
            alone = times[owner] == 1
            if alone.any():
                yield owner[alone], None, entry[alone]
            leaf = ~alone & (points.left[owner] < 0)
            if leaf.any():
                yield None, *_by_points(points, rows, owner[leaf], entry[leaf], book)
            # what is left goes on with its children and the leaves it still has to do with
            rest = np.zeros(n, dtype=bool)
            rest[owner[~alone & ~leaf]] = True
            keep = ~ready | rest[node]
            node, group, leaf_pair = node[keep], group[keep], leaf_pair[keep]
        if not len(node):
            return
        # children of both sides; a leaf stands for itself
        kids = [np.where(t.left[k] < 0, k, t.left[k]) for t, k in ((points, node), (entries, group))]
        twins = [np.where(t.left[k] < 0, -1, t.right[k]) for t, k in ((points, node), (entries, group))]
        pairs = [(a, b) for a in (kids[0], twins[0]) for b in (kids[1], twins[1])]
        node = np.concatenate([a for a, _ in pairs])
        group = np.concatenate([b for _, b in pairs])
        real = (node >= 0) & (group >= 0)
        node, group = node[real], group[real]


def _undominated(points: Tree, owner: np.ndarray, entry: np.ndarray, book: np.ndarray, n: int):
    """The pairs (node, entry) without those where another entry is nearer throughout the box.

    An entry is held against the one nearest to the middle of the box. The difference of
    two squared distances is linear in the point, so its extreme lies in a corner.
    """
    middle = points.low + points.high
    apart = ((middle[owner] - 2 * book[entry]) ** 2).sum(axis=1)
    order = np.lexsort((entry, apart, owner))
    owner, entry = owner[order], entry[order]
    firsts = np.concatenate([[True], owner[1:] != owner[:-1]])
    best = np.zeros(n, dtype=np.int64)
    best[owner[firsts]] = entry[firsts]
    rival = best[owner]
    slope = 2 * (book[entry] - book[rival])
    worst = np.where(slope > 0, points.high[owner], points.low[owner])
    # largest value of distance(rival) - distance(entry) over the box
    squares = (book * book).sum(axis=1)
    lead = squares[rival] - squares[entry] + (slope * worst).sum(axis=1)
    lost = (lead < 0) | ((lead == 0) & (rival < entry))
    stay = ~lost | (entry == rival)
    return owner[stay], entry[stay]


def _by_points(points: Tree, rows: np.ndarray, owner: np.ndarray, entry: np.ndarray, book: np.ndarray):
    """The nearest of its node's entries for each point of the nodes, by whole numbers."""
    sizes = (points.last - points.first)[owner]
    places, pair = Tree._rows(points.first[owner], sizes)
    point, choice = points.order[places], entry[pair]
    apart = ((rows[point] - book[choice]) ** 2).sum(axis=1)
    order = np.lexsort((choice, apart, point))
    point, choice = point[order], choice[order]
    firsts = np.concatenate([[True], point[1:] != point[:-1]])
    return point[firsts], choice[firsts]


def _folded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the distinct row of each row, and how often each occurs."""
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    fresh = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])
    number = np.empty(len(rows), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    return ordered[fresh], number, np.bincount(number)


def assign(rows: np.ndarray, book: np.ndarray, entries: Tree) -> np.ndarray:
    """The nearest entry of each row."""
    distinct, number, times = _folded(rows)
    tree = Tree(distinct, times, LEAF)
    choice = np.zeros(len(distinct), dtype=np.int64)
    for nodes, points, entry in nearest(tree, distinct, entries, book):
        if nodes is None:
            choice[points] = entry
        else:
            places, pair = Tree._rows(tree.first[nodes], (tree.last - tree.first)[nodes])
            choice[tree.order[places]] = entry[pair]
    return choice[number]


def sums(rows: np.ndarray, book: np.ndarray, entries: Tree) -> np.ndarray:
    """Per entry, the number of its rows and their sum."""
    distinct, _, times = _folded(rows)
    tree = Tree(distinct, times, LEAF)
    out = np.zeros((len(book), 1 + rows.shape[1]), dtype=np.int64)
    for nodes, points, entry in nearest(tree, distinct, entries, book):
        if nodes is None:
            w = times[points]
            found = np.column_stack([w, distinct[points] * w[:, None]])
        else:
            found = np.column_stack([tree.count[nodes], tree.total[nodes]])
        np.add.at(out, entry, found)
    return out


def _usable(vector: Column) -> Column:
    limit = F.lit(LARGEST) / F.sqrt(F.size(vector))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > limit))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.floor(np.asarray(values, dtype=np.float64) * SCALE).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Kept rows with their vectors in whole numbers, a bounded number of components at a time."""
    step, limit = max(LEAF, BLOCK // dim), LARGEST / np.sqrt(dim)
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            vectors = batch.column("vector")
            right = np.nan_to_num(np.asarray(vectors.value_lengths().fill_null(-1))) == dim
            batch = batch.filter(pa.array(right))
            if not batch.num_rows:
                continue
            flat = batch.column("vector").flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(invalid="ignore"):
                fine = (np.abs(values) <= limit).all(axis=1)  # a null reads as NaN
            if not fine.all():
                batch, values = batch.filter(pa.array(fine)), values[fine]
            if batch.num_rows:
                yield batch, whole_numbers(values)


def _seeds(kept: DataFrame, parts: int, entries: int) -> tuple[int, np.ndarray | None]:
    """Length of the vectors to code, and the first codebooks: parts x entries x components."""
    lengths = kept.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    usual = lengths.where((F.col("dim") > 0) & (F.col("dim") % parts == 0)).orderBy(F.desc("n"), F.desc("dim"))
    found = usual.first()
    if found is None:
        return 0, None
    dim = found["dim"]
    first = (
        kept.where(F.size("vector") == dim)
        .orderBy(F.asc_nulls_last("id"), "vector")
        .limit(entries)
        .select("vector")
        .collect()
    )
    seeds = whole_numbers(np.array([r["vector"] for r in first])).reshape(len(first), parts, dim // parts)
    return dim, np.ascontiguousarray(seeds.transpose(1, 0, 2))


def learn_codebooks(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
) -> np.ndarray | None:
    """Codebooks after ``rounds`` of Lloyd: an array parts x entries x components, or None.

    A codebook starts as that part of the ``entries`` vectors with the smallest keys (null
    keys last, equal keys by vector); with fewer vectors it has fewer entries. An entry
    becomes the floored mean of the parts nearest to it, one that nothing is nearest to
    stays. Vectors that are null, hold null, non-finite or too
    large components (see ``LARGEST``), or differ in length from most (of the lengths that ``parts`` divides;
    of equally common ones the larger) take no part; without any, the result is None.
    What reaches the driver are sums per entry, bounded by the size of the codebooks.
    """
    kept = _renamed(vectors, key, vector).where(_usable(F.col("vector")))
    dim, books = _seeds(kept, parts, entries)
    if books is None:
        return None
    width = dim // parts
    source = _renamed(vectors, key, vector).select("vector")
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            trees = [_entry_tree(b) for b in books]
            total = np.zeros((parts, books.shape[1], 1 + width), dtype=np.int64)
            for _, rows in _blocks(batches, dim):
                for p in range(parts):
                    part = np.ascontiguousarray(rows[:, p * width : (p + 1) * width])
                    total[p] += sums(part, books[p], trees[p])
            flat = total.ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], ["slot", "value"])

        # one row per entry and component: the size of the codebooks, whatever the input
        added = (
            source.mapInArrow(run, "slot long, value long")
            .groupBy("slot")
            .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
            .collect()
        )
        total = np.zeros(books.size // width * (1 + width), dtype=object)
        for r in added:
            total[r["slot"]] = int(r["value"])
        total = total.reshape(parts, -1, 1 + width)
        books = books.copy()
        for p, e in zip(*np.nonzero(total[:, :, 0])):
            books[p, e] = [int(s) // int(total[p, e, 0]) for s in total[p, e, 1:]]
    return books


def _entry_tree(book: np.ndarray) -> Tree:
    return Tree(book, np.ones(len(book), dtype=np.int64), 2)


def _renamed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"))


def fingerprint(books: np.ndarray | None) -> str:
    """SHA-256 of all components, by part, entry and place, joined by commas."""
    numbers = [] if books is None else books.ravel().tolist()
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def encode_vectors(
    vectors: DataFrame,
    books: np.ndarray | None,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str | None = "label",
) -> DataFrame:
    """Codes under given codebooks: ``id, label, code, error``, one row per vector that fits.

    ``code`` has two hexadecimal digits per part, ``error`` is the squared distance to the
    entries, summed over parts. Rows are left out as in ``learn_codebooks``, repeated and null
    ids are rows of their own, other columns are ignored. Without codebooks or rows the
    result is empty. Nothing is shuffled.
    """
    named = F.col(label) if label and label in vectors.columns else F.lit(None).cast("int")
    source = vectors.select(F.col(key).alias("id"), named.alias("label"), F.col(vector).alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    if books is None:
        return source.sparkSession.createDataFrame([], schema)
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [_entry_tree(b) for b in books]
        for batch, rows in _blocks(batches, parts * width):
            codes = np.empty((len(rows), parts), dtype=np.uint8)
            error = np.zeros(len(rows), dtype=np.int64)
            for p in range(parts):
                part = np.ascontiguousarray(rows[:, p * width : (p + 1) * width])
                codes[:, p] = choice = assign(part, books[p], trees[p])
                error += ((part - books[p][choice]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("label"),
                    pa.array([c.tobytes().hex() for c in codes], pa.string()),
                    pa.array(error),
                ],
                ["id", "label", "code", "error"],
            )

    return source.mapInArrow(run, schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``, the error summed over rows of the same label, nulls together.

    A label may hold any share of the rows. ``coded`` is stored first.
    """
    keyed = stage(
        coded.withColumn("__none", F.col("label").isNull()).withColumn(
            "__label", F.coalesce(F.col("label").cast("string"), F.lit(""))
        ),
        "coded",
    )
    groups = stage(
        keyed.groupBy("__none", "__label").agg(
            F.sum("error").alias("label_error"), F.count("*").alias("__size")
        ),
        "label-errors",
    )
    joined = attach(keyed, groups, ["__none", "__label"], "__size", F.struct("id", "code"))
    return joined.drop("__none", "__label", "__size")


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Learn codebooks on all vectors and code all of them.

    Returns ``id, label, code, error, label_error, codebooks_sha256``; see
    ``learn_codebooks`` and ``encode_vectors`` for rows that are left out.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte, so 1 to 256 entries")
    books = learn_codebooks(vectors, parts=parts, entries=entries, rounds=rounds)
    coded = with_label_error(encode_vectors(vectors, books))
    return coded.withColumn("codebooks_sha256", F.lit(fingerprint(books)))
