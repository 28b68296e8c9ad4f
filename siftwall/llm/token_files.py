"""Token ids as Arrow files of equal-length sequences with masks.

A file holds record batches with two fixed-size-list columns: ``ids`` (unsigned, 16 bits
where the vocabulary allows) and ``mask``. Every batch but a file's last has the same
number of sequences, and nothing is compressed, so sequence ``i`` is found by division
and read without a copy. A second small file lists the documents: id, start and length.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path, stage
from .common import chunk_codes, gathered, text_blocks
from .tokenizer import chunk_encoder

#: Sequences of a record batch.
BATCH_SEQUENCES = 128
MANIFEST = (
    "file_no long, path string, n_docs long, n_tokens long, n_sequences long, sequence_length long"
)


def _list(values: np.ndarray, kind: pa.DataType, length: int) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(pa.array(values, kind), length)


class _Writer:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, folder: str, length: int, kind: pa.DataType, id_kind: pa.DataType):
        self.system, base = pafs.FileSystem.from_uri(folder)
        self.system.create_dir(base, recursive=True)
        # the name is the attempt's own: files of lost attempts are in no manifest
        self.path = f"{folder}/{uuid.uuid4().hex}"
        name = f"{base}/{self.path.rpartition('/')[2]}"
        self.length, self.kind = length, kind
        self.schema = pa.schema(
            [("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))]
        )
        self.index = pa.schema([("id", id_kind), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.system.open_output_stream(name + end) for end in (".tokens.arrow", ".docs.arrow")]
        self.tokens = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], self.index)
        self.buffer: list[np.ndarray] = []
        self.held = self.n_tokens = self.n_docs = self.n_sequences = 0

    def add(self, ids: pa.Array, documents: list[np.ndarray]) -> None:
        sizes = np.array([len(d) for d in documents], dtype=np.int64)
        starts = self.n_tokens + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.docs.write_batch(
            pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(sizes)], schema=self.index)
        )
        self.n_docs += len(documents)
        self.n_tokens += int(sizes.sum())
        self.buffer.extend(documents)
        self.held += int(sizes.sum())
        full = BATCH_SEQUENCES * self.length
        if self.held >= full:
            flat = np.concatenate(self.buffer)
            whole = len(flat) // full * full
            for at in range(0, whole, full):
                self._write(flat[at : at + full], full)
            self.buffer, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        columns = [_list(flat, self.kind, self.length), _list(mask, pa.bool_(), self.length)]
        self.tokens.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.n_sequences += len(flat) // self.length

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.buffer)
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        for writer in (self.tokens, self.docs, *self.sinks):
            writer.close()


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    vocabulary_size: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    sequence_length: int = 1024,
    folder: str | None = None,
) -> DataFrame:
    """Encode all texts, write them in ascending order of id, and return the manifest.

    The manifest has a row per file: ``file_no, path, n_docs, n_tokens, n_sequences,
    sequence_length, first_token``, the last being the number of tokens in all files
    before. Each text's ids are followed by ``end_id``; null text counts as empty. Null ids
    come first, rows that share an id are ordered by a hash of the text, and repeated rows
    are documents of their own. An empty table has an empty manifest.

    Texts are dealt to files by ranges of id, where the position of a row breaks ties, so
    that even a very frequent id is split. Only a file's last sequence is padded. Files go
    to ``folder`` (below ``spark.checkpoint.dir`` if not given), a place that all executors
    reach and that pyarrow can open: a shared mount, HDFS, or an object store. A repeated
    attempt of a task writes files of its own, and the manifest names those of one attempt.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("t"),
        F.xxhash64(text_col).alias("h"),
        F.monotonically_increasing_id().alias("k"),
    )
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("k")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "t")
    kind = pa.uint16() if vocabulary_size <= 1 << 16 else pa.uint32()
    number = np.uint16 if vocabulary_size <= 1 << 16 else np.uint32
    end = np.array([end_id], dtype=number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        encode = None
        for batch in text_blocks(batches, "t"):
            if writer is None:
                encode = chunk_encoder(tokenizer, glued=False)
                writer = _Writer(folder, sequence_length, kind, batch.schema.field("id").type)
            keys, codes, offsets = chunk_codes(batch.column("t"), glued=False)
            values, starts = encode(keys)
            texts = gathered(codes, offsets, values.astype(number), starts)
            writer.add(batch.column("id"), [np.concatenate([x, end]) for x in texts])
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "file_no": TaskContext.get().partitionId(),
                        "path": writer.path,
                        "n_docs": writer.n_docs,
                        "n_tokens": writer.n_tokens,
                        "n_sequences": writer.n_sequences,
                        "sequence_length": sequence_length,
                    }
                ]
            )

    files = stage(dealt.mapInArrow(run, MANIFEST), "token-manifest")
    # one row per file, not per document
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class TokenFile:
    """Random access to one file's sequences."""

    def __init__(self, path: str):
        system, name = pafs.FileSystem.from_uri(path)
        if isinstance(system, pafs.LocalFileSystem):
            sources = [pa.memory_map(name + end) for end in (".tokens.arrow", ".docs.arrow")]
        else:
            sources = [system.open_input_file(name + end) for end in (".tokens.arrow", ".docs.arrow")]
        self.tokens, self.docs = (pa.ipc.open_file(s) for s in sources)
        self.length = self.tokens.schema.field("ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``; the ids are a view of the file."""
        batch = self.tokens.get_batch(i // BATCH_SEQUENCES)
        at = slice(i % BATCH_SEQUENCES * self.length, (i % BATCH_SEQUENCES + 1) * self.length)
        ids = batch.column("ids").values.to_numpy()[at]
        return ids, batch.column("mask").values[at.start : at.stop].to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """Id, start and tokens of every document, in order, a batch of tokens at a time."""
        step = BATCH_SEQUENCES * self.length
        held, flat = -1, np.zeros(0)
        for b in range(self.docs.num_record_batches):
            index = self.docs.get_batch(b)
            ids = index.column("id").to_pylist()
            starts, sizes = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
            for doc, start, n in zip(ids, starts.tolist(), sizes.tolist()):
                parts, at = [], start
                while at < start + n:
                    if at // step != held:
                        held = at // step
                        flat = self.tokens.get_batch(held).column("ids").values.to_numpy()
                    to = min(start + n, (held + 1) * step)
                    parts.append(flat[at - held * step : to - held * step])
                    at = to
                yield doc, start, parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_documents(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Documents as the files have them: ``id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before. Files are dealt to tasks one by one.
    """
    files = max(1, min(manifest.count(), 10_000))
    fields = ("id", "start", "n_tokens", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                rows = []
                for doc, start, ids in TokenFile(file["path"]).documents():
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((doc, file["first_token"] + start, len(ids), crc))
                    if len(rows) == 4096:
                        yield _rows(rows, fields)
                        rows = []
                if rows:
                    yield _rows(rows, fields)

    schema = f"id {id_type}, start long, n_tokens long, ids_crc32 long"
    return manifest.select("path", "first_token").repartition(files).mapInArrow(run, schema)


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], list(names))
