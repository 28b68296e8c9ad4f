"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import attach, small


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of every text that stays, with all its columns.

    Only rows that go are joined back, by id and SHA-256 of the text.
    """
    found = stage(exact_dedup(docs, id_col, text_col), "dedup-found")
    lost = found.where("NOT kept")
    other = ~F.col("id").eqNullSafe(F.col("keep_id"))

    def keys(rows: DataFrame) -> DataFrame:
        return small(rows.select(F.col("id").alias("__id"), F.col("fingerprint").alias("__f")).distinct())

    def matches(rows: DataFrame, lost_keys: DataFrame):
        own = F.sha2(F.coalesce(rows[text_col], F.lit("")), 256)
        return rows[id_col].eqNullSafe(lost_keys["__id"]) & (own == lost_keys["__f"])

    gone = keys(lost.where(other))
    kept = docs.join(gone, matches(docs, gone), "left_anti")
    again = lost.where(~other)
    if again.isEmpty():
        return kept
    # rows that repeat the id and text of the row that stays
    twice = keys(again)
    once = kept.join(twice, matches(kept, twice), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(twice, matches(kept, twice), "left_anti").unionByName(once)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    hash_all: bool = False,
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, fingerprint, text_bytes``.

    A group is all rows with the same text, unchanged; null counts as empty text. The row
    with the largest id stays; a null id is the smallest of all, and of rows that repeat an
    id within a group one stays. ``fingerprint`` is the SHA-256 of the text, hashed only
    where another row shares length and prefix hash, else null; ``hash_all`` asks for it
    on every row. An empty table gives an empty result; other columns of ``docs`` are
    ignored.

    The first scan finds the lengths that several rows have, the second hashes the prefixes
    of rows with these, and the third hashes the full content of the survivors. Counting is combined
    map-side, so a group of any size reaches its reducer as one row per task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long")
    prefix = F.xxhash64(F.substring(text, 1, prefix_chars))
    lengths = docs.groupBy(size.alias("n")).agg(F.count("*").alias("c")).where("c > 1")
    shared = small(stage(lengths.select("n"), "dedup-lengths"))
    # a prefix is hashed only if another row has the length
    described = docs.select(size.alias("n"), F.substring(text, 1, prefix_chars).alias("start"))
    heads = (
        described.join(shared, "n", "left_semi")
        .groupBy("n", F.xxhash64("start").alias("p"))
        .agg(F.count("*").alias("c"))
    )
    survivors = stage(heads.where("c > 1").select("n", "p"), "dedup-survivors")
    # rows outside the surviving groups are never hashed in full
    own = docs.select(
        F.col(id_col).alias("id"),
        size.alias("n"),
        text.alias("t"),
    ).join(shared.withColumn("of_length", F.lit(True)), "n", "left")
    own = own.withColumn(
        "p", F.when(F.col("of_length"), F.xxhash64(F.substring("t", 1, prefix_chars)))
    ).join(small(survivors.withColumn("again", F.lit(True))), ["n", "p"], "left")
    rows = stage(
        own.select(
            "id",
            "n",
            "p",
            F.monotonically_increasing_id().alias("row"),
            F.coalesce("again", F.lit(False)).alias("again"),
            F.when(F.lit(hash_all) | F.col("again"), F.sha2("t", 256)).alias("h"),
        ),
        "dedup-rows",
    )
    groups = stage(
        rows.where("again")
        .groupBy("n", F.col("h").alias("f"))
        .agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("c")),
        "dedup-groups",
    )
    # a row of its own gets a key that no group has
    keyed = rows.withColumn("f", F.when(F.col("again"), F.col("h")).otherwise(F.col("row").cast("string")))
    joined = attach(keyed, groups, ["n", "f"], "c", F.col("row"))
    alone = F.col("c").isNull()
    return joined.select(
        F.col("id"),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("c", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("h").alias("fingerprint"),
        F.col("n").alias("text_bytes"),
    )
