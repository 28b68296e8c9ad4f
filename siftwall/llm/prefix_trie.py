"""Prefix trie of conversations, totals of subtrees by depth-band rollup.

A node is a distinct sequence of first turns. Its key is the bit-wise sum, without carry, of
128-bit hashes of its turns and their places, so keys of all prefixes are running sums:
they are computed in parts of the order of (conversation, turn), and a conversation of any
length spreads over parts.

Totals of subtrees: depths are cut into bands of fixed height. A node adds its values to its
ancestors within its band only. The roots of bands then form a smaller trie of their own,
with one level per band, which is solved the same way; its completed totals go back to the
ancestors in the band above. A node thus explodes to at most one band of ancestors per
level, and a trie of depth D takes log(D) / log(height) levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import carried, dealt_in_order
from ..session import stage
from .common import attach

#: Depths per band.
BAND = 16
#: Characters of joined ids that one row holds at most, but for the last id.
CHUNK = 1 << 16


def turn_rows(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One narrow row per turn: ``conv, turn, hi, lo, words``; stored, dealt in order by ``part``.

    ``hi`` and ``lo`` are 128 bits of the SHA-256 of role and text, null counting as empty.
    Rows without a conversation are left out. Turns are in ascending order, null first; rows
    that share a turn are in the order of their hashes, repeated rows are turns of their own.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    digest = F.sha2(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said).cast("binary"), 256)

    def bits(at: int) -> Column:
        # 16 hexadecimal digits as a signed number
        halves = [F.conv(F.substring(digest, at + k, 8), 16, 10).cast("long") for k in (0, 8)]
        return F.shiftleft(halves[0], 32).bitwiseOR(halves[1])

    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        bits(1).alias("hi"),
        bits(17).alias("lo"),
        F.regexp_count(said[1], F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
    )
    return dealt_in_order(rows, ["conv", "turn", "hi", "lo"], "turns")


def numbered(turns: DataFrame) -> DataFrame:
    """Add ``pos``, the number of a turn in its conversation, from 1."""
    before = carried(turns, ["conv"], sum_n=F.count("*"))
    inside = Window.partitionBy("part", "conv").orderBy(F.asc_nulls_first("turn"), "hi", "lo")
    return (
        turns.join(before, ["part", "conv"])
        .withColumn("pos", F.row_number().over(inside) + F.coalesce("sum_n", F.lit(0)))
        .drop("sum_n")
    )


def rebuilt_paths(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Rebuilt conversations as paths: ``conv, depth, hi, lo, own_hi, own_lo, words, length``.

    Conversation c starts with the first h turns of conversation c - c % family, h being
    crc32(c) % heads (remainders have the sign of c), and goes on with its own turns after its
    first h. Every conversation has a row of depth 0. ``hi, lo`` is the key of the node at
    ``depth``, ``own_hi, own_lo`` what its last turn adds to the parent's key; ``length`` is
    the number of turns of the rebuilt conversation. Stored.
    """
    placed = stage(numbered(turns), "placed")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = placed.groupBy("conv").agg(F.max("pos").alias("n")).withColumn("h", head)
    base = F.col("conv") - F.col("conv") % family
    opening = placed.where((base == F.col("conv")) & (F.col("pos") < heads)).groupBy(
        F.col("conv").alias("base")
    ).agg(F.array_sort(F.collect_list(F.struct("pos", "hi", "lo", "words"))).alias("opening"))
    # a base has less than 2 * family conversations and less than ``heads`` opening turns
    convs = stage(
        convs.withColumn("base", base)
        .join(opening, "base", "left")
        .withColumn("opening", F.slice(F.coalesce("opening", F.array()), F.lit(1), F.col("h").cast("int")))
        .withColumn("taken", F.size("opening").cast("long"))
        .withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
        .drop("base"),
        "convs",
    )

    def hashed(depth: Column, hi: Column, lo: Column) -> list[Column]:
        return [F.xxhash64(depth, hi, lo).alias("own_hi"), F.xxhash64(lo, depth, hi, depth).alias("own_lo")]

    none = F.lit(0).cast("long")
    opened = convs.select("conv", "length", F.explode("opening").alias("o")).select(
        "conv",
        F.col("o.pos").alias("depth"),
        F.lit(-1).alias("part"),
        "length",
        F.col("o.words").alias("words"),
        *hashed(F.col("o.pos"), F.col("o.hi"), F.col("o.lo")),
    )
    shifts = convs.select("conv", "h", "taken", "length", "n")
    own = (
        attach(placed, shifts, ["conv"], "n", F.struct("part", "pos"))
        .where("pos > h")
        .withColumn("depth", F.col("pos") - F.col("h") + F.col("taken"))
        .select(
            "conv", "depth", "part", "length", "words", *hashed(F.col("depth"), F.col("hi"), F.col("lo"))
        )
    )
    steps = stage(opened.unionByName(own), "steps")
    before = carried(steps, ["conv"], xor_hi=F.bit_xor("own_hi"), xor_lo=F.bit_xor("own_lo"))
    so_far = (
        Window.partitionBy("part", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    )
    keyed = steps.join(before, ["part", "conv"]).select(
        "conv",
        "depth",
        *[
            F.bit_xor(f"own_{k}").over(so_far).bitwiseXOR(F.coalesce(f"xor_{k}", none)).alias(k)
            for k in ("hi", "lo")
        ],
        "own_hi",
        "own_lo",
        "words",
        "length",
    )
    roots = convs.select(
        "conv",
        none.alias("depth"),
        *[none.alias(c) for c in ("hi", "lo", "own_hi", "own_lo", "words")],
        "length",
    )
    return stage(keyed.unionByName(roots), "paths")


def trie_nodes(paths: DataFrame) -> DataFrame:
    """Nodes: ``depth, hi, lo, parent_hi, parent_lo, conv_id, n_convs, words``; stored."""
    nodes = paths.groupBy("depth", "hi", "lo").agg(
        F.min("conv").alias("conv_id"),
        F.count("*").alias("n_convs"),
        # equal for all members of a node
        F.max("words").alias("words"),
        F.max("own_hi").alias("own_hi"),
        F.max("own_lo").alias("own_lo"),
    )
    return stage(
        nodes.select(
            "depth",
            "hi",
            "lo",
            *[F.col(k).bitwiseXOR(F.col(f"own_{k}")).alias(f"parent_{k}") for k in ("hi", "lo")],
            "conv_id",
            "n_convs",
            "words",
        ),
        "nodes",
    )


def _above(nodes: DataFrame, paths: DataFrame, band: int, shift: int) -> DataFrame:
    """Nodes with ``above``: keys of the ancestors in a band, in order of depth.

    With ``shift`` 0 it is the node's own band, up to the node itself, with 1 the band above.
    Nodes and paths are those of one level: ``level`` counts its steps.
    """
    bands = paths.groupBy("conv", F.floor(F.col("level") / band).alias("band")).agg(
        # at most one band's height per group
        F.array_sort(F.collect_list(F.struct("level", "hi", "lo"))).alias("above")
    )
    wanted = nodes.withColumn("band", F.floor(F.col("level") / band) - shift).withColumnRenamed("conv_id", "conv")
    upto = F.lit(band) if shift else (F.col("level") % band + 1).cast("int")
    return wanted.join(bands, ["conv", "band"]).withColumn("above", F.slice("above", F.lit(1), upto))


def _spread(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` per ancestor in ``above``."""
    return (
        nodes.select(F.explode("above").alias("a"), *values)
        .groupBy(F.col("a.level").alias("level"), F.col("a.hi").alias("hi"), F.col("a.lo").alias("lo"))
        .agg(*[F.sum(v).alias(v) for v in values])
    )


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """Sums of ``values`` over each node's subtree: ``level, hi, lo, *values``.

    ``nodes`` has ``level, hi, lo, conv_id, *values``; ``paths`` has ``conv, level, hi, lo``, the
    node of every conversation at each level from 0. The deepest level decides how often
    bands are put on bands.
    """
    if band < 2:
        raise ValueError("a band has at least two levels")
    within = _spread(_above(nodes, paths, band, 0), values)
    deepest = nodes.agg(F.max("level")).first()[0]
    if deepest is None or deepest < band:
        return within
    within = stage(within, "within-bands")
    is_root = F.col("level") % band == 0

    def next_level(rows: DataFrame) -> DataFrame:
        return rows.where(is_root).withColumn("level", F.floor(F.col("level") / band))

    names = nodes.select("level", "hi", "lo", "conv_id")
    roots = next_level(within.join(names, ["level", "hi", "lo"]))
    whole = stage(rollup(roots, next_level(paths), values, band), "band-roots")
    whole = whole.withColumn("level", F.col("level") * band)
    below = _above(whole.where("level > 0").join(names, ["level", "hi", "lo"]), paths, band, 1)
    # a band's root has its total already
    added = _spread(below.withColumn("above", F.filter("above", lambda a: a["level"] % band > 0)), values)
    parts = [within.where(~is_root), added, whole]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("level", "hi", "lo").agg(*[F.sum(v).alias(v) for v in values])


def joined_hashes(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key, the SHA-256 of its values' decimals in ascending order, joined by commas: ``*keys, sha256``.

    Values are put in order and joined chunk by chunk in parts of the whole order, so a key
    with any number of values spreads over parts; the hash itself reads one chunk after
    another and holds only one. Null values are not allowed.
    """
    dealt = dealt_in_order(members.select(*keys, value), [*keys, value], "members")
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    key_schema = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def batch_of(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], [f.name for f in fields]
        )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size, number, done, done_size = None, [], 0, 0, [], 0
        fields: list[pa.Field] = []
        for batch in batches:
            fields = [batch.schema.field(k) for k in (*keys, "part")]
            fields += [pa.field("number", pa.int64()), pa.field("joined", pa.string())]
            rows = zip(*[c.to_pylist() for c in batch.select([*keys, "part"]).columns])
            for row, v in zip(rows, batch.column(value).to_pylist()):
                if row != current or size >= CHUNK:
                    if held:
                        done.append((*current, number, ",".join(held)))
                        done_size += size
                    number = number + 1 if row == current else 0
                    current, held, size = row, [], 0
                held.append(str(v))
                size += len(held[-1]) + 1
                if done_size >= 16 * CHUNK or len(done) >= 8192:
                    yield batch_of(done, fields)
                    done, done_size = [], 0
        if held:
            yield batch_of([*done, (*current, number, ",".join(held))], fields)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, hashlib.sha256(), []
        fields: list[pa.Field] = []
        for batch in batches:
            fields = [*[batch.schema.field(k) for k in keys], pa.field("sha256", pa.string())]
            rows = zip(*[c.to_pylist() for c in batch.select(keys).columns])
            for row, piece in zip(rows, batch.column("joined").to_pylist()):
                if row == current:
                    state.update(b",")
                else:
                    if current is not None:
                        done.append((*current, state.hexdigest()))
                    current, state = row, hashlib.sha256()
                state.update(piece.encode())
            if len(done) >= 8192:
                yield batch_of(done, fields)
                done = []
        if current is not None:
            yield batch_of([*done, (*current, state.hexdigest())], fields)

    dealt_keys = [F.asc_nulls_first(k) for k in keys]
    chunks = (
        dealt.repartition("part", *keys)
        .sortWithinPartitions("part", *dealt_keys, value)
        .mapInArrow(join, f"{key_schema}, part int, number long, joined string")
    )
    return (
        chunks.repartition(*keys)
        .sortWithinPartitions(*dealt_keys, "part", "number")
        .mapInArrow(fold, f"{key_schema}, sha256 string")
    )


def prefix_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """All nodes of the trie of rebuilt conversations.

    Returns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``, one row per node; the root has depth 0 and no parent. ``saved_tokens``
    sums, over the subtree, the words of a node's last turn times its members but one.
    ``conversations`` has ``conv_id, turn, role, text``; null roles and texts are empty, rows
    without ``conv_id`` are left out, ties and repeats are ordered as in ``turn_rows``, texts
    are read whole, other columns are ignored. An empty table has no node at all.
    """
    paths = rebuilt_paths(turn_rows(conversations))
    nodes = trie_nodes(paths)
    children = (
        nodes.where("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo"))
        .agg(F.count("*").alias("n_children"))
    )
    full = stage(
        nodes.join(children, ["depth", "hi", "lo"], "left").withColumn(
            "n_children", F.coalesce("n_children", F.lit(0).cast("long"))
        ),
        "trie",
    )
    own = full.select(
        F.col("depth").alias("level"),
        "hi",
        "lo",
        "conv_id",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    steps = paths.select("conv", F.col("depth").alias("level"), "hi", "lo")
    totals = rollup(own, steps, ["n_leaves", "saved_tokens"], band).withColumnRenamed("level", "depth")
    ends = joined_hashes(paths.where("depth = length"), ["depth", "hi", "lo"], "conv")
    parents = full.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"),
        F.col("hi").alias("parent_hi"),
        F.col("lo").alias("parent_lo"),
        F.col("conv_id").alias("parent_conv_id"),
        "n_children",
    )
    below = full.withColumnRenamed("n_children", "own_children")
    named = attach(below, parents, ["depth", "parent_hi", "parent_lo"], "n_children", F.struct("hi", "lo"))
    return (
        named.join(totals, ["depth", "hi", "lo"])
        .join(ends, ["depth", "hi", "lo"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.col("own_children").alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
