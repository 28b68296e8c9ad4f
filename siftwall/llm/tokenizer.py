"""Bulk encoding of distinct chunks with a ``tokenizers`` file."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

import numpy as np

#: Pieces and chunks whose ids a Python worker keeps from block to block, the first it
#: meets; a matter of speed alone, some 100 MB.
KEPT_PIECES = 1 << 19

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def _plain_word(chunk: str) -> bool:
    """Whether a chunk is surely one word to any pre-tokenizer, in its lower case too."""
    if chunk.isascii():
        return chunk.isalpha()
    lower = chunk.lower()
    return (
        chunk.isalpha()
        and len(lower) == len(chunk)
        and lower.isalpha()
        and unicodedata.is_normalized("NFC", chunk)
    )


_BLANKS = re.compile("[ \\t\\n\\r]+")
#: A run of ASCII marks, without the apostrophe, at the end of a word.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _pieces(chunk: str) -> list[str] | None:
    """Plain words and runs of marks that a chunk consists of; None if it has anything else."""
    out = []
    for word in _BLANKS.split(chunk):
        if not word:
            continue
        core = word.rstrip(_MARKS)
        if core:
            if not _plain_word(core):
                return None
            out.append(core)
        if len(core) < len(word):
            out.append(word[len(core) :])
    return out


@lru_cache(maxsize=2)
def chunk_encoder(path: str, glued: bool, joined: int = 64, keep: int = KEPT_PIECES) -> Encoder:
    """A function from chunks to all their ids, with the bounds of each chunk.

    Control strings are ordinary text. Most of the library's time goes into single calls,
    so pieces whose borders can be told from the ids are encoded ``joined`` at a time: with
    ``glued``, chunks with one blank, at their front, whose first id is one that begins with
    a blank; otherwise the plain words and runs of marks of a chunk, whose last id is one
    that ends a word. If the borders found are not as many as the pieces, these pieces are
    encoded one by one. A Python worker keeps the encoder, and with it the ids of the first
    ``keep`` pieces and chunks, over blocks and tasks.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    vocabulary = tokenizer.get_vocab()
    border = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
    for token, number in vocabulary.items():
        border[number] = token.startswith("Ġ") if glued else token.endswith("</w>")
    kept: dict[str, bytes] = {}

    def binary(ids: list[int]) -> bytes:
        return np.array(ids, dtype=np.uint32).tobytes()

    def singly(chunks: list[str], out: dict[str, bytes]) -> None:
        for at in range(0, len(chunks), 4096):
            own = chunks[at : at + 4096]
            part = tokenizer.encode_batch_fast(own, add_special_tokens=False)
            out.update((c, binary(e.ids)) for c, e in zip(own, part))

    def together(chunks: list[str], out: dict[str, bytes]) -> None:
        glue = "" if glued else " "
        for at in range(0, len(chunks), 4096):
            groups = [chunks[i : i + joined] for i in range(at, min(at + 4096, len(chunks)), joined)]
            part = tokenizer.encode_batch_fast([glue.join(g) for g in groups], add_special_tokens=False)
            for group, encoding in zip(groups, part):
                ids = np.array(encoding.ids, dtype=np.uint32)
                cuts = np.flatnonzero(border[ids])
                if len(cuts) != len(group):
                    singly(group, out)
                    continue
                if glued:
                    bounds = [*(cuts * 4).tolist(), len(ids) * 4]
                else:
                    bounds = [0, *((cuts + 1) * 4).tolist()]
                flat = ids.tobytes()
                if bounds[0] or bounds[-1] != len(flat):
                    singly(group, out)
                    continue
                out.update((c, flat[a:b]) for c, a, b in zip(group, bounds, bounds[1:]))

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = [c for c in chunks if c not in kept]
        composed: dict[str, list[str]] = {}
        hard: list[str] = []
        if glued:
            simple = [c[:1] == " " and c.count(" ") == 1 and len(c) > 1 for c in new]
            easy = [c for c, s in zip(new, simple) if s]
            hard = [c for c, s in zip(new, simple) if not s]
        else:
            words: set[str] = set()
            for c in new:
                if _plain_word(c):
                    words.add(c)
                elif (pieces := _pieces(c)) is None:
                    hard.append(c)
                else:
                    composed[c] = pieces
                    words.update(pieces)
            easy = [w for w in words if w not in kept]
        fresh: dict[str, bytes] = {}
        together(easy, fresh)
        singly(hard, fresh)
        for c, pieces in composed.items():
            fresh[c] = b"".join([kept[x] if x in kept else fresh[x] for x in pieces])
        found = [kept[c] if c in kept else fresh[c] for c in chunks]
        if len(kept) < keep:
            kept.update(islice(fresh.items(), keep - len(kept)))
        starts = np.zeros(len(found) + 1, dtype=np.int64)
        np.cumsum([len(x) // 4 for x in found], out=starts[1:])
        return np.frombuffer(b"".join(found), dtype=np.uint32), starts

    return encode
