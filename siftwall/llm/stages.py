"""The operators as pipeline stages: documents in, the documents that stay out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from . import exact_dedup as dedup
from . import gam, jaccard_join, quality_rules as rules
from . import packing as packer
from .common import small, table

#: Text bytes per block, those encoded at once and pieces with kept ids, small since workers serve several stages.
BLOCK, PART, KEPT = 4 << 20, 1 << 20, 1 << 17
#: Least score of a document that stays.
MIN_SCORE = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least MIN_SCORE; the rows keep all columns."""
    model = gam.train_quality(docs, table(spark, sf_dir, "labels"))
    return gam.keep_good(docs, model, MIN_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules; the rows keep all columns.

    Only the verdict on the document is applied: lines that break a rule stay in its text.
    """
    return rules.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every text: the one with the largest id."""
    return dedup.keep_one(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the one that names it, by id and then by text.

    A row is known by its id and the hash of its text, so rows that share an id or have none
    are judged each on their own. Rows with ids name a component before those without.
    """
    of_text = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), of_text.alias("f"))
    keyed = docs.select(key.alias("doc_id"), "text")
    found = stage(jaccard_join.jaccard_components(keyed), "near-found").where("n_shingles > 0")

    def keys(rows: DataFrame) -> DataFrame:
        return small(rows.select(F.col("id.id").alias("__id"), F.col("id.f").alias("__f")).distinct(), 200_000)

    def matches(rows: DataFrame, own_keys: DataFrame):
        return rows["doc_id"].eqNullSafe(own_keys["__id"]) & (of_text == own_keys["__f"])

    dropped = keys(found.where("id <> component_id"))
    kept = docs.join(dropped, matches(docs, dropped), "left_anti")
    again = found.where("id = component_id").groupBy("id").count().where("count > 1")
    if again.isEmpty():
        return kept
    # rows that repeat the id and text of the row that stays
    twice = keys(again)
    once = kept.join(twice, matches(kept, twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, matches(kept, twice), "left_anti").unionByName(once)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packer.pack_documents(docs, path, keep_ids=False, block_bytes=BLOCK, kept_pieces=KEPT, part_bytes=PART)
    return pieces.drop("ids").withColumnRenamed("id", "doc_id")
