"""Hierarchical packing of documents into sequences of several context sizes.

Every task packs the documents it reads, block by block, so there is no shuffle and a lost
task repeats itself exactly. Pieces of a document are routed to the tier (context size)
that they fill best; gaps of long windows are filled from shorter tiers, cutting a piece
where none fits; what is left at the end goes to windows of ever smaller tiers.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, chunk_codes, gathered, give_back, text_blocks
from .tokenizer import KEPT_PIECES, chunk_encoder

#: Context sizes, longest first; all are powers of two, so full windows need no padding.
TIERS = (1024, 512, 256, 128)


def tier_of(length: int, tiers: Sequence[int] = TIERS) -> int:
    """The smallest context size that holds ``length`` tokens."""
    return next((t for t in reversed(tiers) if t >= length), tiers[0])


def pack(
    lengths: Sequence[int], tiers: Sequence[int] = TIERS
) -> list[list[tuple[int, int, int]]]:
    """Windows of ``(document, start, length)`` pieces that cover all tokens once.

    Documents longer than the longest context give full windows. Remainders are routed to
    tiers and sorted by length. Each remainder opens a window of its tier, longest first,
    and the gap is filled from the longest pieces that fit, of its own or a shorter tier;
    where none fits, a piece is cut to fill the gap exactly and its rest is routed anew. A
    last window that nothing is left to fill is split into smaller tiers where that saves
    padding; only its last part, shorter than the smallest tier, is padded.
    """
    top = tiers[0]
    windows: list[list[tuple[int, int, int]]] = []
    shelves: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for doc, n in enumerate(lengths):
        full = n // top
        windows.extend([(doc, k * top, top)] for k in range(full))
        if n % top:
            shelves[tier_of(n % top, tiers)].append((n % top, doc, full * top))
    for shelf in shelves.values():
        shelf.sort(key=lambda p: (p[0], -p[1], -p[2]))

    def take(room: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``room`` tokens, or a cut one, or None."""
        for t in tiers:
            shelf = shelves[t]
            if shelf and shelf[0][0] <= room:
                return shelf.pop(bisect_right(shelf, room, key=_length) - 1)
        for t in reversed(tiers):
            if shelves[t]:
                n, doc, start = shelves[t].pop()
                rest = n - room
                own = shelves[tier_of(rest, tiers)]
                own.insert(bisect_left(own, rest, key=_length), (rest, doc, start + room))
                return room, doc, start
        return None

    for t in tiers:
        while shelves[t]:
            n, doc, start = shelves[t].pop()
            window, room = [(doc, start, n)], t - n
            while room:
                piece = take(room)
                if piece is None:
                    break
                window.append((piece[1], piece[2], piece[0]))
                room -= piece[0]
            if room:
                windows.extend(_split(window, tiers))
            else:
                windows.append(window)
    return windows


def _length(piece: tuple[int, int, int]) -> int:
    return piece[0]


def _split(window: list[tuple[int, int, int]], tiers: Sequence[int]) -> list[list[tuple[int, int, int]]]:
    """The pieces of a window with a gap, dealt to full windows of smaller tiers."""
    out = []
    total = sum(n for _, _, n in window)
    rest = list(window)
    for t in tiers:
        while total >= t:
            part, room = [], t
            while room:
                doc, start, n = rest.pop(0)
                use = min(n, room)
                part.append((doc, start, use))
                room -= use
                if use < n:
                    rest.insert(0, (doc, start + use, n - use))
            out.append(part)
            total -= t
    if rest:
        out.append(rest)
    return out


def step_groups(totals: Sequence[int], step_tokens: int) -> np.ndarray:
    """A training step for each window, such that steps hold about equally many tokens.

    Longest window first, each goes to the step with the fewest tokens so far.
    """
    steps = max(1, -(-sum(totals) // step_tokens))
    heap = [(0, s) for s in range(steps)]
    out = np.zeros(len(totals), dtype=np.int64)
    for i in sorted(range(len(totals)), key=lambda i: (-totals[i], i)):
        load, s = heapq.heappop(heap)
        out[i] = s
        heapq.heappush(heap, (load + totals[i], s))
    return out


PIECES = (
    "id {kind}, start long, length long, ids_crc32 long, doc_tokens long, block_id long,"
    " window long, offset long, window_tokens long, context long, step_group long, ids binary"
)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    tiers: Sequence[int] = TIERS,
    step_tokens: int = 64 * 1024,
    keep_ids: bool = True,
    block_bytes: int = BLOCK_BYTES,
    kept_pieces: int = KEPT_PIECES,
    part_bytes: int | None = None,
) -> DataFrame:
    """One row per piece of a document: its place in the document and in its sequence.

    Columns ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens, context, step_group, ids`` (``ids`` little-endian unsigned 32-bit, or
    null without ``keep_ids``). ``context`` is the size a sequence is padded to; sequences
    of a power of two need no padding, and of each block of ``block_bytes`` of a task's texts
    at most one sequence does. Each document's tokens are followed by ``end_id``; null text is empty and gives
    that id alone. A repeated row is a document of its own. Step groups are balanced within a block's
    sequences, ``step_tokens`` being the aim. ``tokenizer`` is a path that every executor
    can read; nothing else is gathered, and a task holds one block of texts and its ids. A worker
    keeps the ids of at most ``kept_pieces`` pieces of text, and encodes ``part_bytes`` of a
    block at a time (None: the block), which changes no piece. Other columns are ignored; an
    empty table gives no piece.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = PIECES.format(kind=kind)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    end = np.array([end_id], dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(tokenizer, glued=True, keep=kept_pieces)
        for block, batch in enumerate(text_blocks(batches, "t", block_bytes)):
            tokens: list[np.ndarray] = []
            for part in text_blocks(iter([batch]), "t", part_bytes or block_bytes):
                keys, codes, offsets = chunk_codes(part.column("t"), glued=True)
                values, starts = encode(keys)
                tokens.extend(np.concatenate([x, end]) for x in gathered(codes, offsets, values, starts))
                del part, keys, codes, offsets, values, starts
            windows = pack([len(x) for x in tokens], tiers)
            totals = [sum(n for _, _, n in w) for w in windows]
            groups = step_groups(totals, step_tokens)
            out: list[tuple] = []
            for w, window in enumerate(windows):
                offset, size = 0, totals[w]
                context = size if size & (size - 1) == 0 else tiers[0]
                for doc, start, n in window:
                    ids = tokens[doc][start : start + n].astype("<u4").tobytes()
                    out.append(
                        (doc, start, n, zlib.crc32(ids), len(tokens[doc]), block, w, offset,
                         size, context, int(groups[w]), ids if keep_ids else None)
                    )
                    offset += n
            columns = list(zip(*out)) or [[] for _ in names]
            arrays = [batch.column("id").take(pa.array(columns[0], pa.int64()))]
            arrays += [pa.array(c, pa.int64()) for c in columns[1:-1]]
            arrays.append(pa.array(columns[-1], pa.binary()))
            for at in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([a.slice(at, 4096) for a in arrays], names)
            del batch, tokens, windows, out, columns, arrays
            give_back()

    pieces = rows.mapInArrow(run, schema)
    # a task's number above, its blocks and windows below: unique, and the same on a retry
    number = F.spark_partition_id().cast("long")
    sequence = F.shiftleft(number, 40) + F.shiftleft(F.col("block_id"), 24) + F.col("window")
    return pieces.select(
        "id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        sequence.alias("sequence_id"),
        "offset",
        F.col("window_tokens").alias("sequence_tokens"),
        "context",
        (F.shiftleft(number, 40) + F.shiftleft(F.col("block_id"), 24) + F.col("step_group")).alias("step_group"),
        "ids",
    )
