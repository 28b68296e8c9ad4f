"""Per-IP burst detection by inactivity gap.

A session of an IP ends where the next row comes more than ``gap`` later. The
straight form, a window over all rows of an IP, puts a hot IP into one task. Here
rows are first folded into *cells*: aligned time slots one gap wide. Two rows of one
cell are always less than a gap apart, so a cell never straddles a session border
and the fold is exact. It combines map-side, so what is left of an IP depends on the
time spanned (at most span / gap cells) and no longer on its number of rows.

Cells are ordered per *chunk* of ``CHUNK_CELLS`` cells, not over the whole span. Only the first
and the last session of a chunk can go on in a neighbouring chunk; these are put in order
among themselves, two rows per chunk, and stitched where the gap allows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import quoted
from ..schema import ALERT_SCHEMA, conform


#: Cells of a chunk: what a window of cells holds at most.
CHUNK_CELLS = 4096


@dataclass(frozen=True)
class BurstRule:
    """One burst detector: which rows, what is measured, and when it alerts.

    ``where`` is a SQL predicate over the event schema. ``measure`` is ``rows``,
    ``sum`` or ``distinct``; the last two look at ``column``.
    """

    kind: str
    where: str
    threshold: int
    gap_seconds: float
    confidence: float
    measure: str = "rows"
    column: str | None = None

    @property
    def gap_micros(self) -> int:
        return round(self.gap_seconds * 1_000_000)

    @property
    def cell_micros(self) -> int:
        """Width of a cell; with no gap allowed, a cell is one instant."""
        return max(1, self.gap_micros)


def burst_sessions(events: DataFrame, rules: Sequence[BurstRule]) -> DataFrame:
    """All sessions of all rules: ``kind, ip, start_us, end_us, amount``.

    Rules of the same sort share one scan and the shuffles of cells, chunks and sessions.
    """
    additive = [r for r in rules if r.measure != "distinct"]
    distinct = [r for r in rules if r.measure == "distinct"]
    parts = []
    if additive:
        parts.append(_additive_sessions(events, additive))
    if distinct:
        parts.append(_distinct_sessions(events, distinct))
    if not parts:
        raise ValueError("no burst rule given")
    return reduce(DataFrame.unionByName, parts)


def burst_alerts(events: DataFrame, rules: Sequence[BurstRule]) -> DataFrame:
    """Sessions whose amount reaches the threshold of their rule, as alerts."""

    def of_rule(attribute: str) -> str:
        pick = " ".join(f"WHEN {quoted(r.kind)} THEN {getattr(r, attribute)}" for r in rules)
        return f"CASE kind {pick} END"

    alerts = burst_sessions(events, rules).where(f"amount >= {of_rule('threshold')}")
    return conform(
        alerts.selectExpr(
            "ip",
            "timestamp_micros(end_us) AS timestamp",
            "kind",
            "amount AS count",
            f"{of_rule('confidence')} AS confidence",
        ),
        ALERT_SCHEMA,
    )


def _hits(events: DataFrame, rules: Sequence[BurstRule], payload) -> DataFrame:
    """One row ``ip, ts, rule, cell, payload`` per event and rule that takes it."""
    any_rule = " OR ".join(f"({r.where})" for r in rules)
    rows = events.where(f"ip IS NOT NULL AND timestamp IS NOT NULL AND ({any_rule})")
    ts = "unix_micros(timestamp)"

    def cell(rule: BurstRule) -> str:
        return f"{ts} - pmod({ts}, {rule.cell_micros}) AS cell"

    if len(rules) == 1:
        # a plain filter, which reaches the scan
        return rows.selectExpr("ip", f"{ts} AS ts", "0 AS rule", cell(rules[0]), payload(rules[0]))
    per_rule = ", ".join(
        f"struct({i} AS rule, {cell(r)}, {payload(r)}, ({r.where}) AS taken)"
        for i, r in enumerate(rules)
    )
    return (
        rows.selectExpr("ip", f"{ts} AS ts", f"inline(array({per_rule}))")
        .where("taken")
        .drop("taken")
    )


def _of_rule(values: list) -> str:
    if len(values) == 1:
        return str(values[0])
    return f"get(array({', '.join(map(str, values))}), rule)"


def _chunk(rules: Sequence[BurstRule]) -> str:
    return f"cell - pmod(cell, {_of_rule([r.cell_micros * CHUNK_CELLS for r in rules])})"


def _with_chunk_starts(cells: DataFrame, rules: Sequence[BurstRule]) -> DataFrame:
    """Add to each cell its chunk and the first instant of its session within the chunk."""
    chunk = Window.partitionBy("ip", "rule", "chunk")
    in_order = chunk.orderBy("cell")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = _of_rule([r.gap_micros for r in rules])
    return (
        cells.withColumn("chunk", F.expr(_chunk(rules)))
        .withColumn("before", F.lag("last_us").over(in_order))
        .withColumn(
            "opened_us",
            F.expr(f"CASE WHEN before IS NULL OR first_us - before > {gap} THEN first_us END"),
        )
        .withColumn("chunk_start", F.max("opened_us").over(so_far))
        .withColumn("chunk_first", F.min("first_us").over(chunk))
        .withColumn("chunk_last", F.max("last_us").over(chunk))
        .drop("before", "opened_us")
    )


def _stitched(parts: DataFrame, rules: Sequence[BurstRule]) -> DataFrame:
    """Add ``start_us``, the first instant of the whole session.

    ``parts`` has one row per session of a chunk: ``ip, rule, chunk, chunk_start, chunk_end,
    chunk_first, chunk_last`` and more. Sessions inside a chunk stay in a group of their
    chunk; only those at its ends meet per (ip, rule).
    """
    at_end = "chunk_start = chunk_first OR chunk_end = chunk_last"
    lane = Window.partitionBy("ip", "rule", "lane")
    in_order = lane.orderBy("chunk_start")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = _of_rule([r.gap_micros for r in rules])
    return (
        parts.withColumn("lane", F.expr(f"CASE WHEN {at_end} THEN NULL ELSE chunk END"))
        .withColumn("before", F.lag("chunk_end").over(in_order))
        .withColumn(
            "opened_us",
            F.expr(
                f"CASE WHEN before IS NULL OR chunk_start - before > {gap} THEN chunk_start END"
            ),
        )
        .withColumn("start_us", F.max("opened_us").over(so_far))
    )


def _named(sessions: DataFrame, rules: Sequence[BurstRule]) -> DataFrame:
    kind = _of_rule([quoted(r.kind) for r in rules])
    return sessions.selectExpr(f"{kind} AS kind", "ip", "start_us", "end_us", "amount")


def _additive_sessions(events: DataFrame, rules: Sequence[BurstRule]) -> DataFrame:
    def payload(rule: BurstRule) -> str:
        one = "1" if rule.measure == "rows" else f"coalesce({rule.column}, 0)"
        return f"cast({one} AS bigint) AS amount"

    cells = (
        _hits(events, rules, payload)
        .groupBy("ip", "rule", "cell")
        .agg(
            F.min("ts").alias("first_us"),
            F.max("ts").alias("last_us"),
            F.sum("amount").alias("amount"),
        )
    )
    ends = ["ip", "rule", "chunk", "chunk_start", "chunk_first", "chunk_last"]
    parts = (
        _with_chunk_starts(cells, rules)
        .groupBy(*ends)
        .agg(F.max("last_us").alias("chunk_end"), F.sum("amount").alias("amount"))
    )
    sessions = (
        _stitched(parts, rules)
        .groupBy("ip", "rule", "lane", "start_us")
        .agg(F.max("chunk_end").alias("end_us"), F.sum("amount").alias("amount"))
    )
    return _named(sessions, rules)


def _distinct_sessions(events: DataFrame, rules: Sequence[BurstRule]) -> DataFrame:
    """Distinct values per session.

    Values are deduplicated per cell before any of them is brought to its session,
    and again per session with the value in the shuffle key, so that one IP trying
    very many values is spread over all tasks.
    """

    def payload(rule: BurstRule) -> str:
        return f"cast({rule.column} AS string) AS item"

    items = (
        _hits(events, rules, payload)
        .where("cell IS NOT NULL")
        .groupBy("ip", "rule", "cell", "item")
        .agg(F.min("ts").alias("first_us"), F.max("ts").alias("last_us"))
    )
    cells = items.groupBy("ip", "rule", "cell").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")
    )
    placed = _with_chunk_starts(cells, rules)
    ends = ["ip", "rule", "chunk", "chunk_start"]
    parts = placed.groupBy(*ends, "chunk_first", "chunk_last").agg(F.max("last_us").alias("chunk_end"))
    starts = (
        placed.select(*ends, "cell")
        .join(_stitched(parts, rules).select(*ends, F.col("start_us").alias("session")), ends)
        .select("ip", "rule", "cell", "session")
    )
    # both uses of items need the same columns, so that its shuffle is shared
    sessions = (
        items.join(starts, ["ip", "rule", "cell"])
        .groupBy("ip", "rule", "session", "item")
        .agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
        .groupBy("ip", "rule", "session")
        .agg(
            F.min("first_us").alias("start_us"),
            F.max("last_us").alias("end_us"),
            F.count("item").alias("amount"),
        )
        .where("start_us IS NOT NULL")
    )
    return _named(sessions, rules)
