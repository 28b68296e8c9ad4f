"""One event table out of several families (S11, O1, O3, P1) and its archive."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT_SCHEMA, chosen_families, conform
from .parsers import PARSERS, rejects
from .text import ERROR_COLUMNS, read_lines


def utc_normalize(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """``column`` as a UTC instant; text and zone-less times are read as UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def merge_events(*tables: DataFrame) -> DataFrame:
    """Union by name; columns a family lacks are null (O3)."""
    if not tables:
        raise ValueError("nothing to merge")
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return conform(merged, EVENT_SCHEMA)


def timeline(events: DataFrame) -> DataFrame:
    """Events in time order (O1).

    The columns after the time break ties, so that a very busy instant can still be
    spread over several sort partitions.
    """
    return events.orderBy("timestamp", "ip", "log_source", "path", "bytes_sent", "count")


def read_events(
    spark: SparkSession,
    sources: Mapping[str, Sequence[str]],
    enabled: Iterable[str] | None = None,
    reference_year: int | None = None,
    labeled: bool = True,
    probe: bool = False,
) -> DataFrame:
    """Parse every enabled source into one event table.

    Paths that cannot be read are left out with a warning; ``read_sources`` returns them.
    ``probe`` is that of ``read_lines``.
    """
    events, errors, _ = read_sources(spark, sources, enabled, reference_year, labeled, probe)
    for row in errors.collect():  # at most one row per configured path
        warnings.warn(f"{row.log_source}: {row.message}", stacklevel=2)
    return events


def read_sources(
    spark: SparkSession,
    sources: Mapping[str, Sequence[str]],
    enabled: Iterable[str] | None = None,
    reference_year: int | None = None,
    labeled: bool = True,
    probe: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, paths that cannot be read, and lines that give no event with the reason."""
    chosen = chosen_families(enabled)
    tables, problems, rejected = [], [], []
    for family in PARSERS:
        if family not in sources or family not in chosen:
            continue
        lines, errors = read_lines(spark, {family: sources[family]}, probe=probe)
        problems.append(errors)
        if family == "auth":
            parsed = PARSERS[family](lines, reference_year=reference_year, labeled=labeled)
        else:
            parsed = PARSERS[family](lines)
        tables.append(parsed)
        rejected.append(rejects(lines, family, reference_year, labeled))
    if not tables:
        return (
            spark.createDataFrame([], EVENT_SCHEMA),
            spark.createDataFrame([], ERROR_COLUMNS),
            spark.createDataFrame([], "log_source string, value string, reason string"),
        )
    return (
        merge_events(*tables),
        reduce(DataFrame.unionByName, problems),
        reduce(DataFrame.unionByName, rejected),
    )


def _full(spark: SparkSession, path: str):
    """The file system of a path and its full, normal form."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(hadoop).toUri().normalize().toString().rstrip("/")


def _refuse_overlap(spark: SparkSession, sources: Iterable[str], target: str) -> None:
    """Raise if ``target`` is one of ``sources``, holds one, or lies below one."""
    _, target = _full(spark, target)
    for source in sources:
        _, other = _full(spark, source)
        if target == other or target.startswith(other + "/") or other.startswith(target + "/"):
            raise ValueError(f"{target} overlaps with the source {other}")


def _aside(path: str) -> str:
    """Where an archive waits while a new one takes its place."""
    return f"{path}.replaced"


def _recover(spark: SparkSession, path: str) -> None:
    """Finish a replacement that was cut off: an archive put aside comes back or goes."""
    system, full = _full(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old = hadoop(_aside(full))
    if not system.exists(old):
        return
    if system.exists(hadoop(full)):
        system.delete(old, True)
    elif not system.rename(old, hadoop(full)):
        raise OSError(f"could not move {_aside(full)} back to {full}")


def _write(spark: SparkSession, path: str, overwrite: bool, write) -> None:
    """``write(path)``; an existing folder is replaced only after a successful write.

    The old one is moved aside, the new one takes its place, and only then is the old one
    deleted. Between two moves a reader finds either the archive or, by ``_recover``, the one
    put aside.
    """
    _recover(spark, path)
    system, full = _full(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not overwrite or not system.exists(hadoop(full)):
        write(path)
        return
    fresh = f"{full}.new-{uuid.uuid4().hex}"
    write(fresh)
    if not system.rename(hadoop(full), hadoop(_aside(full))):
        raise OSError(f"could not move {full} aside")
    moved = False
    try:
        moved = system.rename(hadoop(fresh), hadoop(full))
    finally:
        if not moved:
            _recover(spark, path)
    if not moved:
        raise OSError(f"could not move {fresh} to {full}; the older archive is back")
    system.delete(hadoop(_aside(full)), True)


def archive_events(events: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write events as Parquet by family and day; refuses to overwrite unless asked.

    A folder that overlaps with the files the events come from is refused, and an older
    archive is removed only after the new one is written.

    The rebalance hint gathers the rows of a folder in few files and splits folders
    that hold very many rows.
    """
    dated = events.withColumn("event_date", F.to_date("timestamp"))
    balanced = dated.hint("rebalance", "log_source", "event_date")
    spark = events.sparkSession
    _refuse_overlap(spark, events.inputFiles(), path)
    _write(
        spark,
        path,
        overwrite,
        lambda to: balanced.write.mode("errorifexists")
        .partitionBy("log_source", "event_date")
        .parquet(to),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Events of an archive; filters on family and day prune its folders.

    A replacement that was cut off half-way is undone first.
    """
    _recover(spark, path)
    return conform(spark.read.parquet(path), EVENT_SCHEMA)


def archive_lines(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write the raw lines of one family as text files."""
    spark = lines.sparkSession
    _refuse_overlap(spark, lines.inputFiles(), path)
    values = lines.select("value")
    _write(spark, path, overwrite, lambda to: values.write.mode("errorifexists").text(to))


def archive_source(
    spark: SparkSession,
    sources: Mapping[str, Sequence[str]],
    family: str,
    path: str,
    overwrite: bool = False,
) -> bool:
    """Copy the first configured source of a family (S12); false if there is none.

    A target that is the source, holds it or lies below it is refused.
    """
    configured = list(sources.get(family) or [])
    if not configured:
        return False
    try:
        lines = spark.read.text(configured[0])
    except AnalysisException:
        return False
    _refuse_overlap(spark, [configured[0]], path)
    archive_lines(lines, path, overwrite)
    return True
