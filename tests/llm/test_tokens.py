from __future__ import annotations

import hashlib
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from siftwall.llm import byte_bpe, common, queries, token_files
from siftwall.llm.tokenizer import chunk_encoder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [t or "" for _, t in brute.EDGES if t is None or len(t) < 1000] + [
    "a  b", " a", "a ", "a\n b", "x y  z", "　", "it's we'll I'd", "12 34.5 6", "İstanbul ŒUVRE ﬁ",
    "é ́x", "  \n\n  two   gaps ", "日本語 テキスト", "a\x1cb \x1c c", "don't|stop&$$$ now!!", "ΑΣ ΣΑΣ",
]


@pytest.mark.parametrize("name, glued", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_encode_as_whole_texts(name, glued):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    texts = TEXTS + [d["text"] for d in brute.rows("documents")]
    keys, codes, offsets = common.chunk_codes(pa.array(texts + [None]), glued)
    values, starts = chunk_encoder(path, glued)(keys)
    got = [x.tolist() for x in common.gathered(codes, offsets, values, starts, step=1000)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def library() -> tiktoken.Encoding:
    return tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=byte_bpe.read_ranks(RANKS),
        special_tokens={},
    )


def test_byte_bpe_edges(spark):
    docs = spark.createDataFrame(
        [(i, t, 1) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, id int"
    )
    docs = docs.unionByName(brute.edge_frame(spark).select("doc_id", "text", "n").withColumnRenamed("n", "id"))
    encoding = library()
    got = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = sorted(
        (str(r.doc_id), np.array(encoding.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode())
        for r in docs.collect()
    )
    assert sorted((str(r.id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    none = byte_bpe.encode_documents(brute.empty_frame(spark), RANKS, public_tokenizers.PATTERN)
    assert none.count() == 0


def test_byte_bpe_query(spark):
    encoding = library()
    docs = {d["doc_id"]: d["text"] for d in brute.rows("documents")}
    got = queries.op4_byte_bpe(spark, brute.SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = encoding.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == brute.sha(docs[r.doc_id])


def test_token_files_query(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    start, want = 0, []
    for d in sorted(brute.rows("documents"), key=lambda d: d["doc_id"]):
        ids = tokenizer.encode(d["text"], add_special_tokens=False).ids + [2]
        want.append((d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.op10_token_files(spark, brute.SMALL).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_token_files_random_access(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_token_files(brute.edge_frame(spark), path, 49_408, sequence_length=8)
    rows = manifest.orderBy("file_no").collect()
    assert sum(r.n_docs for r in rows) == len(brute.EDGES)
    got = token_files.read_documents(manifest).orderBy("start").collect()
    ids = [r.id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(got) == len(brute.EDGES)
    for r in rows:
        file = token_files.TokenFile(r.path)
        flat = np.concatenate([d for _, _, d in file.documents()])
        for i in range(r.n_sequences):
            values, mask = file.sequence(i)
            assert len(values) == 8 and values.base is not None
            assert values[mask].tolist() == flat[i * 8 : i * 8 + 8].tolist()
    empty = token_files.write_token_files(brute.empty_frame(spark), path, 49_408)
    assert token_files.read_documents(empty).count() == 0
