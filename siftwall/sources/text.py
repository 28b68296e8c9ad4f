"""Raw log lines from files."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FAMILIES, chosen_families

LINE_COLUMNS = "value string, log_source string, file string"
ERROR_COLUMNS = "log_source string, file string, message string"


def read_lines(
    spark: SparkSession,
    sources: Mapping[str, Sequence[str]],
    enabled: Iterable[str] | None = None,
    probe: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Lines of the enabled families and the paths that cannot be read.

    ``sources`` maps a family to its paths; families that are not enabled are not
    touched. Returns ``(lines, errors)`` with the columns ``value, log_source, file``
    and ``log_source, file, message``. Invalid UTF-8 becomes U+FFFD. Absent paths are always
    rows of ``errors``. With ``probe`` so are files that exist but cannot be read to their
    end, at the price of reading all files once more; they give no lines. Without, such a
    file fails the job that reads it, so nothing is lost unseen either way.
    """
    chosen_families(sources)
    chosen = chosen_families(enabled)
    wanted = [f for f in FAMILIES if f in sources and f in chosen]
    parts, problems = [], []
    for family in wanted:
        good, absent = _present(spark, list(sources[family]))
        problems += [(family, path, message) for path, message in absent]
        if not good:
            continue
        lines = spark.read.text(good)
        if probe:
            broken = probe_files(spark, good)
            if broken:
                problems += [(family, path, message) for path, message in broken.items()]
                lines = _tolerant(spark, good).where(~F.col("_metadata.file_path").isin(list(broken)))
        parts.append(
            lines.select(
                F.make_valid_utf8("value").alias("value"),
                F.lit(family).alias("log_source"),
                F.col("_metadata.file_path").alias("file"),
            )
        )
    empty = spark.createDataFrame([], LINE_COLUMNS)
    lines = reduce(DataFrame.unionByName, parts) if parts else empty
    return lines, spark.createDataFrame(problems, ERROR_COLUMNS)


def _present(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """The paths that resolve, and the others with the reason.

    All are listed at once, which Spark does as a job where they are many; one by one only
    if that fails. No file is read.
    """
    if not paths:
        return [], []
    try:
        spark.read.text(paths).schema
        return paths, []
    except AnalysisException as error:
        if len(paths) == 1:
            reason = error.getCondition() or "unreadable"
            return [], [(paths[0], f"Could not read {paths[0]}: {reason}")]
    half = len(paths) // 2
    good, bad = _present(spark, paths[:half])
    more, worse = _present(spark, paths[half:])
    return good + more, bad + worse


def _tolerant(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines up to the first place of each file that cannot be read."""
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.text(paths)


# Endings of compressed files, which alone can break off in their middle.
_COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def probe_files(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """Files below ``paths`` that cannot be read to their end, with a message each.

    One job opens and reads every file and tells which of those with content give no line
    at all. Compressed files that do are read once more without tolerance, all in one
    job; only if it fails are they halved until the broken ones are found, so good files cost
    one job however many they are. The driver holds the names of compressed and of broken files.
    """
    files = spark.read.format("binaryFile").load(list(paths)).where("length > 0")
    names = files.select(F.col("_metadata.file_path").alias("file"))
    opened = _tolerant(spark, list(paths)).select(F.col("_metadata.file_path").alias("file")).distinct()
    found = names.join(opened.withColumn("opened", F.lit(True)), "file", "left").where(
        F.col("opened").isNull() | F.rlike("file", F.lit("(?i)(" + "|".join(map(re.escape, _COMPRESSED)) + ")$"))
    )
    rows = found.collect()
    broken = {r["file"]: f"Could not read {r['file']}: no line" for r in rows if not r["opened"]}
    for file in _breaking(spark, sorted(r["file"] for r in rows if r["opened"])):
        broken[file] = f"Could not read {file}: breaks off"
    return broken


def _breaking(spark: SparkSession, files: list[str]) -> list[str]:
    """Those of ``files`` that a strict read fails on."""
    if not files:
        return []
    try:
        spark.read.option("ignoreCorruptFiles", "false").text(files).agg(F.count("*")).collect()
        return []
    except Exception as error:  # noqa: BLE001 - any failure of a task while it reads
        if len(files) == 1:
            return files if _reads_badly(error) else _raise(error)
    half = len(files) // 2
    return _breaking(spark, files[:half]) + _breaking(spark, files[half:])


def _reads_badly(error: Exception) -> bool:
    """Whether a job failed because of what it read rather than, say, a lost cluster."""
    said = str(error)
    return any(word in said for word in ("FAILED_READ_FILE", "IOException", "EOFException", "ZipException"))


def _raise(error: Exception):
    raise error


def raw_line_view(
    spark: SparkSession,
    sources: Mapping[str, Sequence[str]],
    enabled: Iterable[str] | None = None,
) -> DataFrame:
    """Lines of the chosen families, with an ``[error] …`` row per path that cannot be read."""
    lines, errors = read_lines(spark, sources, enabled, probe=True)
    return lines.select("log_source", "value").unionByName(
        errors.select(
            "log_source", F.concat(F.lit("[error] "), F.col("message")).alias("value")
        )
    )
