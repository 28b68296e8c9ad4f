"""SSH login followed by sudo failures of the same account.

For each login at ``t`` the failures of its account in ``[t, t + window]`` are counted
without pairing logins and failures. Time is cut into slots one window wide, so the
interval of a login reaches from its own slot into the next one and no further.
Slots are cut into short cells. Failures are counted per cell, and running sums over the
at most ``CELLS`` cells of a slot tell what lies before a cell; single rows are put in order
only within cells that hold the end of an interval. The login's count is what remains of
its own slot plus what has passed of the next. A window holds the distinct instants of one
cell (some 2.3 s by default), however many rows an account has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..functions import predicates as P
from ..schema import ALERT_SCHEMA, conform

KIND = "auth_privilege_escalation"

# Confidence of an alert with and without labelled episodes.
LABELED_CONFIDENCE = 0.9
HEURISTIC_CONFIDENCE = 0.75

# Cells of a slot.
CELLS = 256

# Order at equal instants: an interval opens before a failure, which comes before
# the marks that close intervals; both interval ends belong to it.
_OPEN, _FAILURE, _EARLY, _CLOSE = 0, 1, 2, 3


def privilege_escalation(
    events: DataFrame, config: DetectorConfig | None = None, mode: str = "auto"
) -> DataFrame:
    """Alerts on login / sudo-failure chains.

    ``mode`` is ``labeled`` (labelled logins, failures of the same episode),
    ``heuristic`` (all logins), or ``auto``: labelled if any row carries the label.
    """
    config = config or DetectorConfig()
    labeled = _labeled_flag(events, mode)
    totals = _interval_totals(events, labeled, config)
    wanted = F.when(labeled, F.lit(config.priv_esc_labeled_min_failures)).otherwise(
        F.lit(config.priv_esc_heuristic_min_failures)
    )
    alerts = totals.where((F.col("failures") >= wanted) & (F.col("early") >= 1))
    return conform(
        alerts.select(
            "ip",
            F.timestamp_micros("last_us").alias("timestamp"),
            F.lit(KIND).alias("kind"),
            F.col("failures").alias("count"),
            F.when(labeled, F.lit(LABELED_CONFIDENCE))
            .otherwise(F.lit(HEURISTIC_CONFIDENCE))
            .alias("confidence"),
            # identical logins alert once each
            F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
        ),
        ALERT_SCHEMA,
    )


def _labeled_flag(events: DataFrame, mode: str) -> Column:
    if mode == "labeled":
        return F.lit(True)
    if mode == "heuristic":
        return F.lit(False)
    if mode != "auto":
        raise ValueError(f"unknown mode {mode!r}")
    found = events.where(F.col("classification") == KIND).agg(F.count("*").alias("n"))
    return found.scalar() > 0


def _interval_totals(events: DataFrame, labeled: Column, config: DetectorConfig) -> DataFrame:
    width = config.priv_esc_window_seconds * 1_000_000
    grace = config.priv_esc_first_failure_seconds * 1_000_000
    if not 0 <= grace <= width:
        raise ValueError("the first-failure limit must lie within the window")
    login = F.expr(P.SSH_ACCEPTED) & (~labeled | (F.col("classification") == KIND))
    # The chain follows the event id alone, whatever the method says.
    failure = F.expr("path = 'sudo/auth_failure'")
    # Equal rows are folded first: a hot account leaves one failure per instant. A null
    # episode equals none.
    rows = (
        events.where("auth_user IS NOT NULL AND timestamp IS NOT NULL")
        .where(login | failure)
        .select(
            "auth_user",
            F.when(labeled, F.col("count")).otherwise(F.lit(0)).alias("episode"),
            failure.alias("is_failure"),
            F.expr("unix_micros(timestamp) AS ts"),
            "ip",
        )
        .selectExpr(
            "auth_user",
            "episode",
            "CASE WHEN NOT is_failure THEN struct(ip, ts AS t0) END AS login",
            "ts",
        )
        .groupBy("auth_user", "episode", "login", "ts")
        .agg(F.count("*").alias("copies"))
    )

    def marks_at(*ends: tuple[str, int]) -> str:
        return "array(" + ", ".join(f"struct({at} AS at, {o} AS order)" for at, o in ends) + ")"

    failed = marks_at(("ts", _FAILURE))
    opened = marks_at(("ts", _OPEN), (f"ts + {grace}", _EARLY), (f"ts + {width}", _CLOSE))
    marks = rows.selectExpr(
        "auth_user",
        "episode",
        "login",
        "copies",
        f"inline(CASE WHEN login IS NULL THEN {failed} ELSE {opened} END)",
    ).selectExpr(
        "*",
        f"at - pmod(at, {width}) AS slot",
        f"pmod(at, {width}) div {max(1, -(-width // CELLS))} AS cell",
        f"CASE WHEN order = {_FAILURE} THEN copies END AS hits",
        f"CASE WHEN order = {_FAILURE} THEN at END AS hit_at",
    )

    slot = Window.partitionBy("auth_user", "episode", "slot")
    earlier = slot.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        marks.groupBy("auth_user", "episode", "slot", "cell")
        .agg(
            F.sum("hits").alias("cell_hits"),
            F.max("hit_at").alias("cell_last"),
            (F.max("order") != F.min("order")).alias("mixed"),
            F.min("order").alias("some_order"),
        )
        .select(
            "auth_user",
            "episode",
            "slot",
            "cell",
            F.sum("cell_hits").over(earlier).alias("before"),
            F.max("cell_last").over(earlier).alias("before_last"),
            F.sum("cell_hits").over(slot).alias("in_slot"),
            F.max("cell_last").over(slot).alias("slot_last"),
            (F.col("mixed") | (F.col("some_order") != _FAILURE)).alias("has_end"),
        )
        .where("has_end")
        .drop("has_end")
    )
    cell = Window.partitionBy("auth_user", "episode", "slot", "cell")
    so_far = cell.orderBy("at", "order").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counted = (
        marks.join(cells, ["auth_user", "episode", "slot", "cell"])
        .select(
            "auth_user",
            "episode",
            "login",
            "copies",
            "slot",
            "order",
            (F.coalesce("before", F.lit(0)) + F.coalesce(F.sum("hits").over(so_far), F.lit(0))).alias(
                "passed"
            ),
            F.coalesce(F.max("hit_at").over(so_far), "before_last").alias("passed_at"),
            "in_slot",
            "slot_last",
        )
        .where("login IS NOT NULL")
    )

    def at_mark(order: int, value: str) -> Column:
        return F.expr(f"max(CASE WHEN order = {order} THEN {value} END)")

    per_login = counted.groupBy("auth_user", "episode", "login").agg(
        F.max("copies").alias("copies"),
        at_mark(_OPEN, "slot").alias("open_slot"),
        at_mark(_OPEN, "coalesce(in_slot, 0) - passed").alias("rest"),
        at_mark(_OPEN, "passed").alias("open_passed"),
        at_mark(_OPEN, "slot_last").alias("open_last"),
        at_mark(_EARLY, "slot").alias("early_slot"),
        at_mark(_EARLY, "passed").alias("early_passed"),
        at_mark(_CLOSE, "passed").alias("close_passed"),
        at_mark(_CLOSE, "passed_at").alias("close_last"),
    )
    return per_login.selectExpr(
        "login.ip AS ip",
        "copies",
        "rest + close_passed AS failures",
        "early_passed + CASE WHEN early_slot = open_slot THEN -open_passed ELSE rest END AS early",
        "coalesce(close_last, open_last) AS last_us",
    )
