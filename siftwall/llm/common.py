"""Shared pieces: checked broadcasts, skew-free joins, words and chunks of Arrow text."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many narrow rows.
BROADCAST_ROWS = 1_000_000
#: Text bytes that one Python step holds at once.
BLOCK_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count proves it small, else as it is (shuffle join)."""
    counted = df.limit(rows + 1).count()
    return F.broadcast(df) if counted <= rows else df


def attach(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, spread: Column
) -> DataFrame:
    """Left join of ``rows`` with one ``groups`` row per key, without a hot task.

    ``size`` is the number of rows of a group. Groups above a thousandth of all rows, of
    which there are at most a thousand, are broadcast; their rows are then dealt by
    ``spread`` past the shuffle join, which serves the rest. ``groups`` is read three
    times, so it should be a staged table. The keys must not be null.
    """
    values = [c for c in groups.columns if c not in keys]
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) >= max(1000, total // 1000)
    heavy = groups.where(hot).select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in values])
    rest = groups.where(~hot).withColumn("__spread", F.lit(0))
    salt = F.when(F.col(f"__hot_{size}").isNull(), 0).otherwise(
        1 + F.pmod(F.xxhash64(spread), F.lit(1024)).cast("int")
    )
    joined = (
        rows.join(F.broadcast(heavy), list(keys), "left")
        .withColumn("__spread", salt)
        .join(rest, [*keys, "__spread"], "left")
    )
    for c in values:
        joined = joined.withColumn(c, F.coalesce(F.col(f"__hot_{c}"), F.col(c)))
    return joined.drop("__spread", *[f"__hot_{c}" for c in values])


def text_blocks(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that none holds much more than ``limit`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def give_back() -> None:
    """Return to the system what a Python worker no longer uses; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def filled(column: pa.Array) -> pa.Array:
    """A string column with null as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def strings(column: pa.Array) -> list[str]:
    """The strings of a column without nulls; ``to_pylist`` would make a scalar for each."""
    return column.to_numpy(zero_copy_only=False).tolist()


def word_codes(column: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word number of each word of all texts, and each text's bounds.

    Words are runs of other characters than blanks, tabs and line ends (x09 to x0D);
    ``lower`` maps A-Z only.
    """
    texts = pc.replace_substring_regex(filled(column), "[\\t-\\r]", " ")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.split_pattern(texts, " ")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary
    codes = flat.indices.to_numpy(False)[: offsets[-1] - offsets[0]]
    offsets = offsets - offsets[0]
    filler = pc.index(words, pa.scalar("", words.type)).as_py()
    if filler < 0:
        return words, codes, offsets
    keep = codes != filler
    seen = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    return words, codes[keep], seen[offsets]


_CUT = re.compile(r"(?<=\S) (?=\S)")


def chunk_codes(column: pa.Array, glued: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks of the texts, the chunk number of each chunk, and each text's bounds.

    Texts are cut at blanks between two characters that are not white space: no match of
    the usual pre-tokenizer patterns reaches over such a place, so chunks can be encoded
    one by one. With ``glued`` the blank opens the chunk after it (byte-level vocabularies);
    without, white space is dropped by the tokenizer and may be cut anywhere.
    """
    texts = filled(column)
    lists = pc.split_pattern(texts, " ")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    flat = lists.flatten().dictionary_encode()
    words = strings(flat.dictionary)
    codes = flat.indices.to_numpy(False)[: offsets[-1]].astype(np.int32)
    if not glued:
        return words, codes, offsets
    keys = [" " + w for w in words]
    edge = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words], dtype=bool)
    ragged = np.concatenate([[0], np.cumsum(edge[codes], dtype=np.int64)])
    ragged = np.diff(ragged[offsets]) > 0
    first = offsets[:-1][~ragged]
    if len(first):
        heads, at = np.unique(codes[first], return_inverse=True)
        codes = codes.copy()
        codes[first] = len(keys) + at
        keys.extend(words[h] for h in heads)
    if not ragged.any():
        return keys, codes, offsets
    # texts with runs of white space: cut only where both neighbours are other characters
    known: dict[str, int] = {}
    parts, ends = [], [0]
    for i, odd in enumerate(ragged):
        if odd:
            text = texts[i].as_py()
            pieces = _CUT.split(text) if text else []
            pieces = pieces[:1] + [" " + p for p in pieces[1:]]
            part = [known.setdefault(p, len(keys) + len(known)) for p in pieces]
            parts.append(np.array(part, dtype=np.int32))
        else:
            parts.append(codes[offsets[i] : offsets[i + 1]])
        ends.append(ends[-1] + len(parts[-1]))
    return keys + list(known), np.concatenate(parts), np.array(ends, dtype=np.int64)


def gathered(
    codes: np.ndarray, offsets: np.ndarray, values: np.ndarray, starts: np.ndarray, step: int = 1 << 20
) -> Iterator[np.ndarray]:
    """Per text, the values of its chunks one after another.

    ``values[starts[k]:starts[k + 1]]`` belongs to chunk ``k``. Works through about
    ``step`` chunks at a time.
    """
    lengths = np.diff(starts)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
        to = min(to, len(offsets) - 1)
        own = codes[offsets[at] : offsets[to]]
        n = lengths[own]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        index = np.repeat(starts[own] - (ends - n), n) + np.arange(total, dtype=np.int64)
        flat = values[index]
        cuts = np.concatenate([[0], ends])[offsets[at : to + 1] - offsets[at]]
        for i in range(to - at):
            yield flat[cuts[i] : cuts[i + 1]]
        at = to


def flat_lists(lists: Sequence[Sequence[int]], dtype=np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as one array and the bounds of each list."""
    starts = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    values = np.fromiter((v for x in lists for v in x), dtype=dtype, count=int(starts[-1]))
    return values, starts
