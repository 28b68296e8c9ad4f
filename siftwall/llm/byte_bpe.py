"""Byte-level BPE with Spark higher-order functions.

Texts are cut into words by the pre-tokenizer pattern. Higher-order functions fold the ranked
merges over distinct words as arrays of byte ids, looking ranks up in a literal table. The words of the corpus' most frequent
chunks are folded once, and their ids are a bounded broadcast table; each block of texts
folds only the distinct words that this table lacks. Results are then dealt back to the
texts of the block, and decoded from the texts' ids, whose pieces are gathered. A step of the fold copies its word, so very long words, which would cost
the square of their length, are merged with a heap instead.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import chunk_codes, flat_lists, gathered, give_back, strings, text_blocks

_BITS = 17  # of a token id
_PLACE = 10  # bits of a place in a word that is folded
_NONE = 1 << _BITS  # in place of the merge of a pair that does not merge; above all ids
#: Chunks whose ids are broadcast, and their bytes at most; others are folded block by block.
KNOWN, KNOWN_BYTES = 1 << 19, 48
#: Bytes of a word above which it is merged with a heap.
LONG = 512


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are also their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _prime_above(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def merge_tables(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Two tables that give the id of a pair's merge in at most two looks (cuckoo hashing).

    A pair of ids is the number ``left << 17 | right``; its cell, at that number modulo the
    table's prime size, is ``pair << 17 | merged``, and -1 marks an empty cell.
    """
    if len(ranks) and max(ranks.values()) >= 1 << _BITS:
        raise ValueError("ids must be below 2 ** 17")
    cells = []
    for token, merged in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                cells.append((left << _BITS | right) << _BITS | merged)
    first = _prime_above(max(11, int(1.3 * len(cells))))
    second = _prime_above(first + 1)
    tables = [[-1] * first, [-1] * second]
    for cell in cells:
        side = 0
        for _ in range(500):
            at = (cell >> _BITS) % len(tables[side])
            cell, tables[side][at] = tables[side][at], cell
            if cell == -1:
                break
            side = 1 - side
        else:
            raise ValueError("no place for a pair; make the tables larger")
    return tables[0], tables[1]


def _numbers(values: list[int]) -> Column:
    """A literal array; folded to a constant when the query is planned."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bound(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _merged(left: Column, right: Column, table: Column, sizes: tuple[int, int]) -> Column:
    """The id that two neighbouring ids merge to, or _NONE; a null neighbour is none."""

    def look(pair: Column) -> Column:
        cells = F.array(*(F.get(table[name], (pair % size).cast("int")) for name, size in zip(("a", "b"), sizes)))
        return F.aggregate(
            cells,
            F.lit(_NONE).cast("bigint"),
            lambda found, cell: F.when(F.shiftright(cell, _BITS) == pair, cell.bitwiseAND((1 << _BITS) - 1)).otherwise(
                found
            ),
        )

    return _bound(F.shiftleft(left, _BITS).bitwiseOR(right), look)


def byte_merges(byte_ids: list[int], merged: dict[tuple[int, int], int]) -> list[int]:
    """The merge of ids ``l`` and ``r`` of two bytes at ``l * n + r``, or _NONE; ``n`` is their largest and one."""
    n = max(byte_ids) + 1
    out = [_NONE] * (n * n)
    for left in byte_ids:
        for right in byte_ids:
            out[left * n + right] = merged.get((left, right), _NONE)
    return out


def encode_word(ids: Column, table: Column, sizes: tuple[int, int], stride: int) -> Column:
    """Fold the merges of one word, an array of byte ids, lowest rank and leftmost first.

    The state is one number for each id: the merge with the id after it, its place and the id
    itself. So the least number is the pair to merge next and tells where it is; a step walks
    over the word once, replaces that pair and looks up the two pairs beside it. Pairs of bytes
    have a table of their own, addressed by ``stride``, for the start. A word has at most
    ``LONG`` ids.
    """
    token_mask, one = (1 << _BITS) - 1, 1 << _BITS
    low, dead = (1 << _BITS + _PLACE) - 1, F.lit(-1).cast("bigint")

    def packed(merge: Column, place: Column, token: Column) -> Column:
        place = F.shiftleft(place.cast("bigint"), _BITS)
        return F.shiftleft(merge, _BITS + _PLACE).bitwiseOR(place).bitwiseOR(token)

    def first(x: Column, i: Column) -> Column:
        merge = F.get(table["c"], (x * stride + F.get(ids, i + 1)).cast("int"))
        return packed(F.coalesce(merge, F.lit(_NONE).cast("bigint")), i, x)

    def step(state: Column) -> Column:
        def merge(s: Column, best: Column) -> Column:
            token = F.shiftright(best, _BITS + _PLACE)

            def replaced(p: Column) -> Column:
                following = F.get(state, p + 2).bitwiseAND(token_mask)
                walked = F.transform(
                    state,
                    lambda x, i: F.when(i > p + 1, x - one)
                    .when(i < p - 1, x)
                    .when(i == p, packed(_merged(token, following, table, sizes), p, token))
                    .when(i > p, dead)
                    .otherwise(
                        F.shiftleft(
                            _merged(x.bitwiseAND(token_mask), token, table, sizes), _BITS + _PLACE
                        ).bitwiseOR(x.bitwiseAND(low))
                    ),
                )
                return F.array_remove(walked, dead)

            place = F.shiftright(best, _BITS).bitwiseAND((1 << _PLACE) - 1).cast("int")
            return F.when(token == _NONE, s).otherwise(_bound(place, replaced))

        # a one-element array binds the least number to a name
        return F.aggregate(F.array(F.array_min(state)), state, merge)

    # a word of n bytes has n - 1 merges at most; for one byte the sequence runs down and nothing happens
    steps = F.sequence(F.lit(2), F.size(ids))
    folded = F.aggregate(steps, F.transform(ids, first), lambda s, _: step(s))
    return F.transform(folded, lambda x: x.bitwiseAND(token_mask))


def merge_long(ids: list[int], merged: dict[tuple[int, int], int]) -> list[int]:
    """The merges of one long word with a heap of pairs, lowest rank and leftmost first.

    ``merged`` has the id, which is also the rank, of every pair that merges.
    """
    ids = list(ids)
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(merged[pair], k, *pair) for k, pair in enumerate(zip(ids, ids[1:])) if pair in merged]
    heapq.heapify(heap)
    while heap:
        token, k, left, right = heapq.heappop(heap)
        then = after[k]
        # -1 marks an id that has become part of the one before it
        if ids[k] != left or then >= n or ids[then] != right:
            continue
        ids[k], ids[then] = token, -1
        after[k] = after[then]
        if after[k] < n:
            before[after[k]] = k
        for at in (before[k], k):
            if at >= 0 and after[at] < n:
                pair = ids[at], ids[after[at]]
                if pair in merged:
                    heapq.heappush(heap, (merged[pair], at, *pair))
    return [i for i in ids if i >= 0]


def _words(chunk_list: list[str], pattern) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of chunks, and each chunk's words by number."""
    known: dict[str, int] = {}
    lists = [[known.setdefault(w, len(known)) for w in pattern.findall(c)] for c in chunk_list]
    values, starts = flat_lists(lists, np.int32)
    return list(known), values, starts


def _taken(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered ``which`` one after another, and their bounds."""
    n = np.diff(starts)[which]
    ends = np.cumsum(n, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(starts[which] - (ends - n), n) + np.arange(total, dtype=np.int64)
    return values[index], np.concatenate([[0], ends])


def _frequent_chunks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """``id, t``, both a chunk: the KNOWN most frequent ones or fewer, of those that repeat."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "t", block_bytes):
            chunks, codes, _ = chunk_codes(batch.column("t"), glued=True)
            counts = pa.array(np.bincount(codes, minlength=len(chunks)))
            whole = pa.RecordBatch.from_arrays([pa.array(chunks, pa.string()), counts], ["chunk", "c"])
            del chunks, codes
            for at in range(0, whole.num_rows, 1 << 15):
                yield whole.slice(at, 1 << 15)
            give_back()

    counted = (
        rows.select("t")
        .mapInArrow(count, "chunk string, c long")
        .where(F.octet_length("chunk") <= KNOWN_BYTES)
        .groupBy("chunk")
        .agg(F.sum("c").alias("c"))
        .where("c > 1")
    )
    counted = stage(counted, "bpe-chunks")
    top = F.least("c", F.lit(1 << 16)).alias("c")
    sizes = counted.select(top).groupBy("c").count().orderBy(F.desc("c")).collect()
    least, total = (1 << 16) + 1, 0
    for r in sizes:
        total += r["count"]
        if total > KNOWN:
            break
        least = r["c"]
    return counted.where(F.col("c") >= least).select(F.col("chunk").alias("id"), F.col("chunk").alias("t"))


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """``id, ids, decoded`` of every text: the ids as little-endian unsigned 32-bit numbers.

    Null counts as empty, which has no ids; control strings are ordinary text; repeated rows
    give repeated results, an empty table gives none, and other columns are not looked at.
    ``decoded`` is made from the ids. Only counts of chunks are shuffled; a task holds one
    block of about ``block_bytes`` of text, and a longer text is a block of its own.
    """
    ranks = read_ranks(ranks_path)
    if set(ranks) < {bytes([b]) for b in range(256)}:
        raise ValueError("every byte needs a rank")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    chunks = _frequent_chunks(rows, block_bytes)
    # KNOWN rows of KNOWN_BYTES at most
    known = stage(_encoded(chunks, ranks, pattern, block_bytes, None).select("id", "ids"), "bpe-known").toArrow().combine_chunks()
    return _encoded(rows, ranks, pattern, block_bytes, known)


def _encoded(
    rows: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int, known: pa.Table | None
) -> DataFrame:
    """``id, ids, decoded`` of rows ``id, t``, given ``id, ids`` of known chunks."""
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
    kind = rows.schema["id"].dataType.simpleString()
    first, second = merge_tables(ranks)
    mask = (1 << _BITS) - 1
    pairs: dict[tuple[int, int], int] = {}
    for cell in (c for c in (*first, *second) if c >= 0):
        pairs[cell >> 2 * _BITS, (cell >> _BITS) & mask] = cell & mask
    if known is None or not known.num_rows:
        bounds = np.zeros(1, dtype=np.int64)
        table_of = (pa.array([], pa.string()), np.zeros(0, "<u4"), bounds)
    else:
        ids, ids_starts = _bytes(known["ids"])
        names = known["id"].cast(pa.string())
        table_of = (names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names, ids.view("<u4"), ids_starts // 4)
    shared = rows.sparkSession.sparkContext.broadcast(table_of)
    merges = rows.sparkSession.sparkContext.broadcast(pairs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        # looked up by a dictionary that is made once a task; index_in hashes the whole table for each block
        names = {name: k for k, name in enumerate(strings(shared.value[0]))}
        for batch in text_blocks(batches, "t", block_bytes):
            chunks, codes, offsets = chunk_codes(batch.column("t"), glued=True)
            place = np.array([names.get(c, -1) for c in chunks], dtype=np.int32)
            rest = np.flatnonzero(place < 0)
            place[rest] = len(names) + np.arange(len(rest))
            words, chunk_words, chunk_starts = _words([chunks[k] for k in rest.tolist()], compiled)
            del chunks
            # words that are chunks of the table as well, and not cut there
            at = [names.get(w, -1) for w in words]
            found = [a >= 0 and compiled.findall(w) == [w] for w, a in zip(words, at)]
            number = np.where(found, at, len(names) + np.cumsum(~np.array(found, dtype=bool)) - 1).astype(np.int32)
            chunk_words = number[chunk_words]
            words = [w for w, known in zip(words, found) if not known]
            raw = [w.encode("utf-8") for w in words]
            lists = [byte_ids[np.frombuffer(r, dtype=np.uint8)] for r in raw]
            for k, r in enumerate(raw):
                if len(r) > LONG:
                    lists[k] = np.array(merge_long(lists[k].tolist(), merges.value), dtype=np.int64)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            bytes_of = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("id").to_pylist()], pa.list_(batch.schema.field("id").type)),
                    pa.ListArray.from_arrays(pa.array([0, len(bytes_of)], pa.int32()), bytes_of),
                    *(
                        pa.array([x.astype(t).tobytes()], pa.binary())
                        for x, t in zip((codes, offsets, place, chunk_words, chunk_starts), ("i4", "i8", "i4", "i4", "i8"))
                    ),
                ],
                ["id", "words", *packed],
            )
            del words, raw, lists, flat, bytes_of, codes
            give_back()

    packed = ["codes", "offsets", "place", "chunk_words", "chunk_starts"]
    blocks = rows.mapInArrow(
        cut, f"id array<{kind}>, words array<array<bigint>>, " + ", ".join(f"{c} binary" for c in packed)
    )
    sizes = (len(first), len(second))
    stride = int(byte_ids.max()) + 1
    start = _numbers(byte_merges(byte_ids.tolist(), pairs))
    table = F.struct(_numbers(first).alias("a"), _numbers(second).alias("b"), start.alias("c"))
    # a one-element array binds the table to a name, so that the plan has it once
    encoded = F.get(
        F.transform(
            F.array(table),
            # words above LONG bytes are merged already: ids beyond those of bytes tell, or their number
            lambda tab: F.transform(
                "words",
                lambda w: F.when((F.size(w) > LONG) | (F.array_max(w) >= stride), w).otherwise(
                    encode_word(w, tab, sizes, stride)
                ),
            ),
        ),
        F.lit(0),
    )
    by_id = {i: token for token, i in ranks.items()}
    pieces = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    piece_starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])
    vocabulary = rows.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(pieces), dtype=np.uint8), piece_starts))
    folded = blocks.withColumn("tokens", encoded).select("id", *packed, "tokens")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.slice(k, 1)
                ids = block.column("id").flatten()
                codes, offsets, place, chunk_words, chunk_starts = (
                    np.frombuffer(block.column(c)[0].as_py(), dtype=t)
                    for c, t in zip(packed, ("i4", "i8", "i4", "i4", "i8"))
                )
                known_values, known_starts = shared.value[1:3]
                values, starts = _lists(block.column("tokens"))
                # first the words of a new chunk, then the chunks of the block, all known or new
                folded_values = np.concatenate([known_values, values.astype(known_values.dtype)])
                folded_starts = np.concatenate([known_starts[:-1], starts + len(known_values)])
                new, ends = _taken(folded_values, folded_starts, chunk_words)
                every = np.concatenate([known_values, new])
                bounds = np.concatenate([known_starts[:-1], ends[chunk_starts] + len(known_values)])
                flat, chunk_ends = _taken(every, bounds, place)
                texts = gathered(codes, offsets, flat, chunk_ends, 1 << 18)
                for at in range(0, len(ids), 512):
                    own = list(itertools.islice(texts, 512))
                    joined, cuts = _taken(*vocabulary.value, np.concatenate(own))
                    cuts = cuts[np.cumsum([0, *(len(x) for x in own)])]
                    part = [(x.tobytes(), joined[a:b].tobytes()) for x, a, b in zip(own, cuts[:-1], cuts[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(at, 512),
                            pa.array([a for a, _ in part], pa.binary()),
                            pa.array([b for _, b in part], pa.binary()),
                        ],
                        ["id", "ids", "decoded"],
                    )
                give_back()

    return folded.mapInArrow(deal, f"id {kind}, ids binary, decoded binary")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of the inner lists of a one-row list column."""
    inner = column.flatten()
    starts = np.asarray(inner.offsets, dtype=np.int64)
    return inner.flatten().to_numpy(zero_copy_only=False), starts - starts[0]


def _bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and bounds of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]
