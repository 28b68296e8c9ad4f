"""A block is encoded part by part, which changes no piece."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from siftwall.llm import packing, stages


def test_parts_give_the_pieces_of_whole_blocks(spark):
    texts = [(i, " ".join(f"w{(i * k) % 97}" for k in range(i % 60 * 20))) for i in range(200)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = packing.pack_documents(docs, path, keep_ids=False).orderBy(*"id start".split()).collect()
    parts = packing.pack_documents(docs, path, keep_ids=False, part_bytes=700).orderBy(*"id start".split()).collect()
    assert whole == parts and len(whole) >= 202


def test_the_pipeline_encodes_less_than_a_block_at_once(spark, monkeypatch):
    asked, pack = {}, packing.pack_documents

    def watched(docs, path, **settings):
        asked.update(settings)
        return pack(docs, path, **settings)

    monkeypatch.setattr(packing, "pack_documents", watched)
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    assert stages.packing(spark, docs, "").count() >= 3
    assert asked["part_bytes"] <= 1 << 20 < asked["block_bytes"]
