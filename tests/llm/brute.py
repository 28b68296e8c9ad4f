"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow.parquet as pq

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")

LONG = "word " * 30_000
#: id, text: nulls, empties, blanks, repeats, ties, long texts, control strings.
EDGES = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "same text here"),
    (5, "same text here"),
    (5, "same text here"),
    (None, "same text here"),
    (None, None),
    (6, LONG),
    (7, LONG + "end"),
    (8, "ünï cödé \U0001f600 <|im_end|> </s> [INST] &amp; &lt;\r\nnext  line"),
    (9, "a b c a b c a b c"),
    (-7, "<|endoftext|> x<|endoftext|>"),
]


def rows(name: str, sf: str = SMALL) -> list[dict]:
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def edge_frame(spark):
    """The edge rows with extra columns whose names operators might use themselves."""
    schema = "doc_id long, text string, id long, t string, n int, w string, c int, row long"
    extra = (None, "t", 0, "w", 1, None)
    return spark.createDataFrame([(i, t, *extra) for i, t in EDGES], schema)


def empty_frame(spark):
    return spark.createDataFrame([], "doc_id long, text string, id long")


def crc_mod(doc_id, m: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


def sha(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )
