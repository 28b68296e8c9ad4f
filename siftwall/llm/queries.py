"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, code_vectors, exact_dedup, gam, hmm, html_text, jaccard_join, licenses, packing
from . import prefix_trie, quality_rules, sql, token_files
from .common import id_bucket, table

#: At most so many labelled rows are gathered to fit the quality classifier.
MAX_LABELLED_ROWS = 20_000


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.col("fingerprint").alias("text_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op3_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hmm.score_corpus(docs, id_bucket("doc_id", 7) == 2).withColumnRenamed("id", "doc_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_documents(
        table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN
    )
    return encoded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as a log of deltas, edits and regenerations, folded, rendered, read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    rendered = chat.render(chat.reconstruct(chat.streamed_events(rows.unionByName(own))))
    back = chat.read_back(rendered)
    whole = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gam.train_quality(docs, table(spark, sf_dir, "labels"), MAX_LABELLED_ROWS)
    return gam.score_quality(docs, model).select(
        F.col("id").alias("doc_id"),
        (id_bucket("id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), path, keep_ids=False)
    return pieces.drop("ids").withColumnRenamed("id", "doc_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, hundred, and one name per document.

    A document that opens with a licence line is the licence file of its folder.
    """
    docs = table(spark, sf_dir, "documents")
    opens = F.rlike(F.lower(F.substring_index("text", "\n", 1)), F.lit("licen[sc]e"))
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    name = F.when(F.coalesce(opens, F.lit(False)), F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(
        F.concat("doc_id", F.lit(".txt"))
    )
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", hundred, name).alias("path"), "text")
    return licenses.scan_licences(files).withColumnRenamed("id", "doc_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), path, 49_408)
    return token_files.read_documents(manifest).withColumnRenamed("id", "doc_id")


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op12_code_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = code_vectors.compress_vectors(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return coded.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256"
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_hmm_scoring": op3_hmm_scoring,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_chat_format": op5_chat_format,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_license_scan": op9_license_scan,
    "op10_token_files": op10_token_files,
    "op11_html_text": op11_html_text,
    "op12_code_vectors": op12_code_vectors,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": sql.EXACT_DEDUP,
    "op11_html_text": sql.HTML_TEXT,
    "op12_code_vectors": sql.CODE_VECTORS,
    "op13_prefix_trie": sql.PREFIX_TRIE,
}
