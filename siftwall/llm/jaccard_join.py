"""Exact n-gram Jaccard join by a token-group matrix.

Every distinct shingle set is a node. Under one order of all shingles, rare before
frequent, two sets that are similar enough share a shingle of their first few (the prefix),
so only prefixes are compared. Similar sets are first partitioned into groups: of the sets
that hold a shingle the most central one leads, and each set is compared with the leader it
shares most shingles with, which is linear however many sets agree. The matrix then has a
row per shingle and group, the union of the members' prefixes. For each set and each other
group, the number of its prefix shingles in the group's union bounds the overlap with any
member; only groups that can still hold a partner are opened, and members are compared with
the set itself. No two groups between which there is a link stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import attach, filled, give_back, small, text_blocks
from .components import components

#: Shingles known as frequent when prefixes are chosen; an order, not a filter.
FREQUENT = 1 << 18
#: One of so many sets, by hash, tells which shingles are frequent. For that order only: all sets are compared.
COUNTED = 16
#: Size of the bitmap that spares the shuffle most of the shingles that only one set has.
BITMAP_BITS = 1 << 24

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


#: Rounds in which sets are compared with leaders; the candidates that they leave are all
#: compared. An order of work, not a filter.
ROUNDS = 4
#: Partners of one set that one task compares it with.
PARTNERS = 1024


#: Bytes up to which words are hashed side by side.
LONG_WORD = 64
_BYTES = np.arange(256, dtype=np.uint8)
_IN_WORD = (_BYTES != 0x20) & ((_BYTES < 0x09) | (_BYTES > 0x0D))
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: The lowest bytes of a number, by how many.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

#: Text bytes per block; the sets of a block take many times as much.
BLOCK = 2 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _multiplier(k: int) -> np.uint64:
    return _ODD[k] if k < len(_ODD) else np.uint64((int(_ODD[k % len(_ODD)]) * (2 * k + 1)) % (1 << 64) | 1)


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, A-Z in lower case, and each text's bounds.

    Words are hashed side by side, eight bytes at a time; the few long ones one by one.
    """
    import xxhash

    texts = filled(column)
    if not len(texts):
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _IN_WORD[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    # texts lie next to each other, so a word also ends where its text does
    heads, tails = offsets[:-1][offsets[:-1] < len(raw)], offsets[1:][offsets[1:] > 0] - 1
    opens[heads], closes[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(opens)
    sizes = np.flatnonzero(closes) + 1 - starts
    del inside, opens, closes
    bounds = np.searchsorted(starts, offsets)
    lowered = np.concatenate([_LOWER[raw], np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=lowered, strides=(1,))
    h = sizes.astype(np.uint64) * _ODD[0]
    for k in range(0, LONG_WORD, 8):
        some = np.flatnonzero((sizes > k) & (sizes <= LONG_WORD)) if k else np.flatnonzero(sizes <= LONG_WORD)
        if not len(some):
            break
        chunk = eight[starts[some] + k] & _LOW_BYTES[np.minimum(sizes[some] - k, 8)]
        h[some] = _mixed(_mixed(h[some] ^ chunk) + _ODD[1])
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(lowered[starts[i] : starts[i] + sizes[i]].tobytes())
    return h, bounds


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its ``words``-word shingles.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    h, bounds = _word_hashes(column)
    rolled = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
    for k in range(words):
        rolled += h[k : k + len(rolled)] * _multiplier(k)
    rolled = _mixed(rolled)
    # a run of shingles per text that has enough words, sorted in place
    counts = np.diff(bounds)
    first = bounds[:-1][counts >= words]
    behind = bounds[1:][counts >= words] - words + 1
    for a, b in zip(first.tolist(), behind.tolist()):
        rolled[a:b].sort()
    keep = np.zeros(len(rolled) + 1, dtype=np.int8)
    keep[first] = 1
    keep[behind] -= 1
    keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    again = rolled[1:] == rolled[:-1]
    again[first[first > 0] - 1] = False
    keep[1:] &= ~again
    seen = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    rolled = rolled[keep]
    runs = iter(zip(seen[first].tolist(), seen[behind].tolist()))
    out = []
    for a, n in zip(bounds[:-1].tolist(), counts.tolist()):
        if n >= words:
            x, y = next(runs)
            out.append(rolled[x:y])
        elif n:
            weights = np.array([_multiplier(k) for k in range(n)], dtype=np.uint64)
            whole = (h[a : a + n] * weights).sum(keepdims=True, dtype=np.uint64) + np.uint64(words - n)
            out.append(_mixed(whole))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _node(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))).astype(np.int64))


def prefix_length(n: int, percent: int) -> int:
    """Shingles of which a partner must share one: n less the least overlap, plus one."""
    return n - -(-percent * n // 100) + 1


def _sizes(docs: DataFrame, words: int) -> DataFrame:
    """Rows of texts (``id, n, node``) and, mixed with them, the shingles of one set in COUNTED.

    Counts within a block would miss shingles that are frequent over all blocks only; as part
    of prefixes these would be compared as often as the square of the table's size.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "t", BLOCK):
            sets = shingle_sets(batch.column("t"), words)
            nodes = [_node(s) if len(s) else None for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(nodes, pa.int64()),
                    none,
                    none,
                ],
                names,
            )
            once = [s for node, s in zip(nodes, sets) if node is not None and node % COUNTED == 0]
            once = list({_node(s): s for s in once}.values())
            if once:
                tokens, df = np.unique(np.concatenate(once), return_counts=True)
                tokens = tokens.view(np.int64)
                for at in range(0, len(tokens), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    size = len(tokens[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.nulls(size, batch.schema.field("id").type),
                            *(pa.nulls(size, pa.int64()) for _ in range(2)),
                            pa.array(tokens[part]),
                            pa.array(df[part].astype(np.int64)),
                        ],
                        names,
                    )
            del sets, once
            give_back()

    names = ["id", "n", "node", "token", "df"]
    return docs.mapInArrow(run, f"id {kind}, n long, node long, token long, df long")


def _frequent(sizes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of the counted sets and their counts, at most FREQUENT of them."""
    rows = (
        sizes.where("token IS NOT NULL")
        .groupBy("token")
        .agg(F.sum("df").alias("df"))
        .where("df >= 3")
        .orderBy(F.desc("df"), "token")
        .limit(FREQUENT)
        .toArrow()
    )
    tokens = rows["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["df"].to_numpy()[order]


def _bitmap(several: DataFrame) -> np.ndarray:
    """A bit for the low end of each shingle: BITMAP_BITS bits, whatever the table's size."""
    place = F.col("token").bitwiseAND(F.lit(BITMAP_BITS - 1))
    cells = (
        several.groupBy(F.shiftright(place, 6).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(token & 63 AS int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(BITMAP_BITS >> 6, dtype=np.int64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return out.view(np.uint64)


def _prefixes(docs: DataFrame, frequent, words: int, percent: int) -> DataFrame:
    """``node, n, prefix`` of every set, rare shingles first; a set may occur in several blocks."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = shared.value
        for batch in text_blocks(batches, "t", BLOCK):
            rows: dict[int, tuple[int, np.ndarray]] = {}
            for s in shingle_sets(batch.column("t"), words):
                node = _node(s) if len(s) else None
                if node is None or node in rows:
                    continue
                weight = np.zeros(len(s), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    weight = np.where(known[at] == s, df[at], 0)
                # the shingles are sorted, so a stable order by weight keeps theirs within one weight
                rare = np.argsort(weight, kind="stable")[: prefix_length(len(s), percent)]
                rows[node] = len(s), s[rare].view(np.int64)
            if rows:
                starts = np.cumsum([0, *(len(first) for _, first in rows.values())])
                flat = pa.array(np.concatenate([first for _, first in rows.values()]))
                whole = pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(rows), pa.int64()),
                        pa.array([n for n, _ in rows.values()], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat),
                    ],
                    ["node", "n", "prefix"],
                )
                for at in range(0, whole.num_rows, 1024):
                    yield whole.slice(at, 1024)
                del flat, whole
            del rows
            give_back()

    return docs.select("t").mapInArrow(run, "node long, n int, prefix array<bigint>")


def _marked(prefixes: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``token, node, n`` of the prefix shingles whose bit is set."""
    shared = prefixes.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            lists = batch.column("prefix")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(np.asarray(lists.offsets, dtype=np.int64))
            low = flat.view(np.uint64) & np.uint64(BITMAP_BITS - 1)
            found = (bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1
            columns = [flat, *(np.repeat(batch.column(c).to_numpy(), sizes) for c in ("node", "n"))]
            whole = pa.RecordBatch.from_arrays([pa.array(c[found]) for c in columns], ["token", "node", "n"])
            for at in range(0, whole.num_rows, 1 << 17):
                yield whole.slice(at, 1 << 17)

    return prefixes.mapInArrow(run, "token long, node long, n int")


def _least_overlap(n1: Column, n2: Column, percent: int) -> Column:
    """Shared shingles that two sets of these sizes need."""
    return F.ceil((n1 + n2) * percent / F.lit(100.0 + percent))


def _needed(n1: Column, n2: Column, percent: int) -> Column:
    """Prefix shingles that two sets must share.

    Shared shingles outside both prefixes lie behind the earlier prefix end, so there are
    no more of them than the larger of the two rests.
    """
    rest = F.greatest(F.ceil(n1 * percent / F.lit(100.0)), F.ceil(n2 * percent / F.lit(100.0))) - 1
    return F.greatest(_least_overlap(n1, n2, percent) - rest, F.lit(1))


def _texts(docs: DataFrame, sizes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """``node, text`` of the nodes in ``pairs``, one text of each.

    Rows may share an id, so the node is worked out from the text.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = sizes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("one"))
    ids = small(stage(chosen, "jaccard-chosen").select("one").distinct())
    rows = docs.join(ids, docs["id"].eqNullSafe(ids["one"]), "left_semi").select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "t", BLOCK):
            sets = shingle_sets(batch.column("t"), words)
            nodes = pa.array([_node(s) if len(s) else None for s in sets], pa.int64())
            del sets
            yield pa.RecordBatch.from_arrays([nodes, batch.column("t")], ["node", "text"])
            give_back()

    return rows.mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def _linked(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows ``a, b, ga, gb`` of the staged ``pairs`` whose sets a and b are similar enough, by exact intersection.

    Texts travel rather than sets, which are larger; both are cut into shingles again. A set
    with many partners is dealt to a task for every PARTNERS of them; there its text comes
    once, before the texts of its partners.
    """
    texts = stage(_texts(docs, sizes, pairs, words), "jaccard-texts")
    counts = stage(pairs.groupBy("a").agg(F.count("*").alias("c")), "jaccard-partners")
    parts = F.ceil(F.col("c") / F.lit(float(PARTNERS)))
    dealt = attach(pairs.select("a", "b", "ga", "gb"), counts, ["a"], "c", F.col("b")).select(
        "a", "b", "ga", "gb", F.pmod(F.xxhash64("b"), parts).alias("part")
    )
    none = F.lit(None).cast("long")
    leads = counts.join(texts.select(F.col("node").alias("a"), "text"), "a").select(
        "a", none.alias("b"), none.alias("ga"), none.alias("gb"), "text",
        F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"),
    )
    other = dealt.join(texts.select(F.col("node").alias("b"), "text"), "b")
    both = leads.unionByName(other).repartition("a", "part")
    both = both.sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "ga", "gb"]
        last, x = None, None
        for batch in text_blocks(batches, "text", BLOCK):
            keep = []
            rows = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), shingle_sets(batch.column("text"), words))
            for a, b, y in rows:
                if b is None:
                    # a copy, since the sets of a block may share memory
                    last, x = a, y.copy()
                if b is None or a != last:
                    keep.append(False)
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in names], names)
            give_back()

    return both.select("a", "b", "ga", "gb", "text").mapInArrow(run, "a long, b long, ga long, gb long")


def _alike(n1: str, n2: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def _able(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of those sets that can have a partner, with ``n_lo, n_hi`` of each row's shingle.

    A set needs a certain number of prefix shingles that others hold as well, by its own
    size and the sizes that occur with these shingles. All rows of a set, its prefix, meet
    in one window.
    """
    of_set = Window.partitionBy("node")
    low = F.greatest(F.min("n_lo").over(of_set), F.ceil(F.col("n") * percent / F.lit(100.0)))
    high = F.least(F.max("n_hi").over(of_set), F.floor(F.col("n") * 100 / F.lit(float(percent))))
    needed = F.least(_needed(F.col("n"), F.col("low"), percent), _needed(F.col("n"), F.col("high"), percent)) - 1
    counted = rows.withColumns({"low": low, "high": high, "c": F.count("*").over(of_set)})
    return counted.where((F.col("low") <= F.col("high")) & (F.col("c") >= needed)).drop("low", "high", "c")


def _placed(blocks: DataFrame, percent: int) -> DataFrame:
    """``token, node, n, central, g`` of the sets that can have a partner, each a group of its own.

    A set is central if much of its prefix is in many other sets.
    """
    held = blocks.groupBy("token").agg(F.count("*").alias("df"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"))
    length = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0)) + 1
    weight = F.sum(F.log("df")).over(Window.partitionBy("node"))
    rows = blocks.join(held, "token").withColumn("central", weight / length)
    return _able(rows, percent).select("token", "node", "n", "central", F.col("node").alias("g"))


def _open(placed: DataFrame, percent: int) -> DataFrame:
    """The rows of ``placed`` that can still belong to a link between two groups."""
    across = placed.groupBy("token").agg(
        F.min("g").alias("lo"), F.max("g").alias("hi"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi")
    )
    rows = placed.join(across.where("lo <> hi").drop("lo", "hi"), "token")
    return _able(rows, percent).select(*placed.columns)


def _stars(placed: DataFrame, tested: DataFrame | None, percent: int, shift: float) -> DataFrame:
    """At most one pair ``a, b`` of groups ``ga, gb`` per set ``b``: the leader it shares most shingles with.

    Of the sets of about one size that hold a shingle the most central leads. Of several
    pairs between two groups the one with most shared shingles is kept.
    """
    band = F.floor(F.log(F.col("n")) / F.lit(float(np.log(100.0 / percent))) + F.lit(shift))
    banded = placed.withColumn("band", band)
    leads = banded.groupBy("token", "band").agg(
        F.max(F.struct("central", "node", "n", "g")).alias("lead"), F.min("g").alias("lo"), F.max("g").alias("hi")
    )
    leads = leads.where("lo <> hi").select("token", "band", *(F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("node", "n", "g")))
    agreed = (
        banded.join(leads, ["token", "band"])
        .where("lead_g <> g")
        .where(_alike("n", "lead_n", percent))
        .groupBy(F.col("lead_node").alias("a"), F.col("node").alias("b"), F.col("lead_g").alias("ga"), F.col("g").alias("gb"), "n", "lead_n")
        .agg(F.count("*").alias("c"))
        .where(F.col("c") * 2 >= _needed(F.col("n"), F.col("lead_n"), percent))
    )
    if tested is not None:
        agreed = agreed.join(tested, ["a", "b"], "left_anti")
    best = agreed.groupBy("b", "gb").agg(F.max(F.struct("c", "a", "ga")).alias("x"))
    return (
        best.groupBy("gb", F.col("x.ga").alias("ga"))
        .agg(F.max(F.struct(F.col("x.c").alias("c"), F.col("x.a").alias("a"), "b")).alias("x"))
        .select("x.a", "x.b", "ga", "gb")
    )


def _regrouped(rows: DataFrame, moves: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """``rows`` with the ``node, label`` of merged groups in place of the groups' own names."""
    for g in groups:
        moved = moves.select(F.col("node").alias(g), "label")
        rows = rows.join(moved, g, "left").withColumn(g, F.coalesce("label", g)).drop("label")
    return rows


def _candidates(placed: DataFrame, percent: int) -> DataFrame:
    """``a, b, ga, gb, c``: all pairs of sets of different groups that may be a link."""
    matrix = placed.groupBy("token", F.col("g").alias("to")).agg(
        F.min("n").alias("n_lo"), F.max("n").alias("n_hi")
    )
    matched = (
        placed.join(matrix, "token")
        .where("g < to")
        .where((F.col("n_hi") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("n_lo") * percent))
        .groupBy("node", "n", "to")
        .agg(F.count("*").alias("c"), F.min("n_lo").alias("n_lo"), F.max("n_hi").alias("n_hi"))
    )
    # the bound is lowest at either end of the sizes that a partner may have
    low = F.greatest(F.col("n_lo"), F.ceil(F.col("n") * percent / F.lit(100.0)))
    high = F.least(F.col("n_hi"), F.floor(F.col("n") * 100 / F.lit(float(percent))))
    # one less, since rounding can make it dip by one in between
    bound = F.least(_needed(F.col("n"), low, percent), _needed(F.col("n"), high, percent)) - 1
    opened = matched.where((low <= high) & (F.col("c") >= bound)).select("node", "to")
    queries = placed.join(opened, "node").select(
        "token", F.col("node").alias("a"), F.col("n").alias("an"), F.col("g").alias("ga"), "to"
    )
    members = placed.select("token", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("g").alias("to"))
    return (
        queries.join(members, ["token", "to"])
        .where(_alike("an", "bn", percent))
        .groupBy("a", "b", "an", "bn", "ga", F.col("to").alias("gb"))
        .agg(F.count("*").alias("c"))
        .where(F.col("c") >= _needed(F.col("an"), F.col("bn"), percent))
        .select("a", "b", "ga", "gb", "c")
    )


def _merged(found: DataFrame) -> DataFrame:
    """``node, label`` of the groups that the links ``found`` join, by the groups' names.

    A link carries the names that its groups had when it was chosen, so no shingle is read.
    """
    return components(found.select(F.col("ga").alias("a"), F.col("gb").alias("b")))


def links(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Nodes of all rows and enough links between nodes to give every component.

    ``docs`` has ``id`` and ``t``. Returns ``(sizes, edges)``: ``id, n, node`` per row, and
    ``a, b`` pairs. Every edge is a true link. Links inside a group that others have already
    connected are not all listed, since they join nothing new; two groups between which
    there is a link are always connected.
    """
    mixed = stage(_sizes(docs, words), "jaccard-sizes")
    sizes = mixed.where("token IS NULL").select("id", "n", "node")
    prefixes = stage(_prefixes(docs, _frequent(mixed), words, percent), "jaccard-prefixes")
    # most shingles are in one set only: they are counted, but not shuffled as rows
    nodes_of = prefixes.select("node", F.explode("prefix").alias("token")).groupBy("token").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi")
    )
    several = stage(nodes_of.where("lo <> hi").select("token"), "jaccard-several")
    marked = _marked(prefixes, _bitmap(several))
    blocks = stage(marked.join(small(several), "token").distinct(), "jaccard-blocks")

    placed = stage(_placed(blocks, percent), "jaccard-placed")

    found, tested, compared = [], None, 0
    for k in range(ROUNDS):
        stars = stage(_stars(placed, tested, percent, 0.5 * (k % 2)), "jaccard-stars")
        compared += (stars_found := stars.count())
        if not stars_found:
            break
        pairs = stars.select("a", "b")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found.append(stage(_linked(stars, docs, sizes, words, percent), "jaccard-linked"))
        # once few leaders are links, a further round would read all rows for little
        if k and found[-1].count() * 10 < stars_found:
            break
        placed = stage(_open(_regrouped(placed, _merged(found[-1]), ("g",)), percent), "jaccard-placed")

    left = stage(_candidates(placed, percent), "jaccard-candidates")
    if tested is not None:
        left = stage(left.join(tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti"), "jaccard-candidates")
    merging = True
    while remaining := left.count():
        # once a round merges nothing, or no more is left than was compared, the rest is compared in full
        merging = merging and remaining > compared
        best = left.select("a", "b", "ga", "gb")
        if merging:
            of_pair = left.groupBy(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb"))
            best = of_pair.agg(F.max(F.struct("c", "a", "b")).alias("m")).select("m.a", "m.b", "ga", "gb")
        best = stage(best, "jaccard-best")
        compared += best.count()
        found.append(stage(_linked(best, docs, sizes, words, percent), "jaccard-linked"))
        if not merging:
            break
        merging = not found[-1].isEmpty()
        rest = left.join(best.select("a", "b"), ["a", "b"], "left_anti")
        left = stage(_regrouped(rest, _merged(found[-1]), ("ga", "gb")).where("ga <> gb"), "jaccard-candidates")

    edges = docs.sparkSession.createDataFrame([], "a long, b long")
    for part in found:
        edges = edges.unionByName(part.select("a", "b"))
    return sizes, edges


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id``.

    A text's set is its distinct shingles of ``words`` words (A-Z in lower case); two texts
    link if ``100 * |intersection| >= percent * |union|``, and a component is what links
    reach, named by its smallest id. Texts with fewer words have their sequence as one
    shingle; null and wordless texts have none and link with nothing. Equal sets are one
    node, so copies never meet in pairs. Of a component without any id the name is null;
    rows that share an id are judged by their texts. Sets are compared by 64-bit hashes.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    sizes, edges = links(rows, words, percent)
    labels = components(edges)
    placed = stage(
        sizes.where("node IS NOT NULL")
        .join(labels, "node", "left")
        .select("id", "n", F.coalesce("label", "node").alias("component"), F.monotonically_increasing_id().alias("k")),
        "jaccard-rows",
    )
    names = stage(
        placed.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("c")),
        "jaccard-names",
    )
    named = attach(placed, names, ["component"], "c", F.col("k"))
    alone = sizes.where("node IS NULL").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return named.select("id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
