"""Reports on detections and ground truth, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ATTACK_KINDS, FAMILIES, ML_KINDS, NORMAL, kinds_table

# The wording of the reports.
GENERATED = "%s attempts generated: %d"
DETECTED = "%s attempts detected: %d"
ANOMALY_DETECTED = "ML isolation forest identified %d anomalous/ hostile IPs"
SUPERVISED_DETECTED = "ML supervised classifier identified %d likely hostile IPs"
LISTING_HEADING = "%s (%d total):"
ALERT = "ThreatAlert(%s, ip=%s, count=%d)"
ALERT_WITH_TIME = "ThreatAlert(%s, ip=%s, time=%s, count=%d)"
ML_HEADING = "-------------- Machine Learning Behaviour Anomaly Detector --------------"
ML_UNIQUE_IPS = "Unique IPs in this log: %d"
ML_SENSITIVITY = "Outlier sensitivity: %s× "
ML_FEW_IPS = (
    " Only %d IPs here — not enough for the full model. "
    "Only IPs with very extreme attack-like behaviour were considered."
)
ML_FLAGGED = "Flagged as possible hostile IPs: %d (out of %d unique addresses)"
OVER_DETECTED = (
    "%s accuracy: %s%%. Over-detected %d attempts, but only %d were generated."
)
UNDER_DETECTED = (
    "%s accuracy: %s%%. Under-detected %d attempts out of %d generated attacks."
)
ALL_DETECTED = "%s accuracy: 100%%. Detected all %d generated attempts."
ANOMALY_CHECK = (
    "ML Isolation Forest detected %d anomalous/ hostile IPs out of %d total unique "
    "attacking IPs (non-normal profiles in generation metadata)."
)
SUPERVISED_CHECK = (
    "ML Supervised classifier flagged %d likely hostile IPs for review "
    "(reference hostile IP count in generation metadata: %d)."
)
USERS = "- %s: %d users"
LINES = "- %s: %d access log lines, %d auth log lines"


def titled(kind: Column) -> Column:
    """``access_brute_force`` as ``Access Brute Force``."""
    return F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))


def _two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", F.bround(value, F.lit(2)))


def visible(kind: Column, families: Iterable[str]) -> Column:
    """Model kinds always, others by their enabled family."""
    shown = kind.isin(*ML_KINDS)
    for family in families:
        if family in FAMILIES:
            shown = shown | F.startswith(kind, F.lit(f"{family}_"))
    return shown


# -- counts ---------------------------------------------------------------------


def true_counts(events: DataFrame) -> DataFrame:
    """``position, kind, family, true_count``: labelled episodes of all kinds (A3)."""
    labeled = (
        events.where(F.col("classification").isin(*ATTACK_KINDS))
        .groupBy(F.col("classification").alias("kind"))
        .agg(F.count_distinct("count").alias("true_count"))
    )
    return _over_kinds(labeled, "true_count")


def detected_counts(alerts: DataFrame) -> DataFrame:
    """``position, kind, family, detected``: alerts of all kinds (A4)."""
    known = alerts.where(F.col("kind").isin(*ATTACK_KINDS))
    return _over_kinds(known.groupBy("kind").agg(F.count("*").alias("detected")), "detected")


def _over_kinds(counts: DataFrame, value: str) -> DataFrame:
    """``counts``, one row per kind of the fixed sixteen at most, for all of them."""
    kinds = kinds_table(counts.sparkSession)
    return kinds.join(F.broadcast(counts), "kind", "left").select(
        "position", "kind", "family", F.coalesce(value, F.lit(0)).alias(value)
    )


def source_row_counts(events: DataFrame) -> DataFrame:
    """``log_source, n``."""
    return events.groupBy("log_source").agg(F.count("*").alias("n"))


# -- reports --------------------------------------------------------------------


def true_count_report(events: DataFrame) -> DataFrame:
    """One sentence per kind on generated attempts."""
    return (
        true_counts(events)
        .withColumn(
            "message",
            F.format_string(GENERATED, titled(F.col("kind")), F.col("true_count")),
        )
        .orderBy("position")
        .drop("position", "family")
    )


def alert_text() -> Column:
    """An alert as one line."""
    timestamp = F.col("timestamp")
    return F.when(
        timestamp.isNotNull(),
        F.format_string(ALERT_WITH_TIME, "kind", "ip", _stamp(timestamp), "count"),
    ).otherwise(F.format_string(ALERT, "kind", "ip", "count"))


def _stamp(timestamp: Column) -> Column:
    fraction = F.unix_micros(timestamp) % 1_000_000
    whole = F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss")
    return F.concat(
        whole,
        F.when(fraction != 0, F.date_format(timestamp, ".SSSSSS")).otherwise(F.lit("")),
        F.lit("+00:00"),
    )


def alert_listing(alerts: DataFrame, families: Iterable[str] = FAMILIES) -> DataFrame:
    """Alerts by kind with the total of their kind (R2).

    ``alerts`` is read twice; the totals have one row per kind, however many alerts
    one kind has.
    """
    shown = alerts.where(visible(F.col("kind"), list(families)))
    totals = shown.groupBy("kind").agg(F.count("*").alias("kind_total"))
    return (
        shown.join(F.broadcast(totals), "kind")
        .select(
            "kind",
            "kind_total",
            "ip",
            "timestamp",
            "count",
            F.format_string(LISTING_HEADING, F.upper("kind"), F.col("kind_total")).alias(
                "heading"
            ),
            alert_text().alias("message"),
        )
        .orderBy("kind", "timestamp", "ip", "count")
    )


def detection_summary(alerts: DataFrame, families: Iterable[str] = FAMILIES) -> DataFrame:
    """One sentence per kind that has alerts."""
    kind = F.col("kind")
    counts = (
        alerts.where(visible(kind, list(families)))
        .groupBy("kind")
        .agg(F.count("*").alias("detected"))
    )
    message = (
        F.when(kind == "ml_anomaly", F.format_string(ANOMALY_DETECTED, "detected"))
        .when(kind == "ml_supervised", F.format_string(SUPERVISED_DETECTED, "detected"))
        .otherwise(F.format_string(DETECTED, titled(kind), F.col("detected")))
    )
    return counts.withColumn("message", message).orderBy("kind")


def ml_summary_report(summary: DataFrame) -> DataFrame:
    """The lines on the anomaly detector's run (R4): ``line, message``."""
    sensitivity = F.regexp_replace(F.format_string("%.6f", "mad_multiplier"), r"\.?0+$", "")
    lines = F.array(
        F.lit(ML_HEADING),
        F.format_string(ML_UNIQUE_IPS, "unique_ips"),
        F.when(F.col("use_forest"), F.format_string(ML_SENSITIVITY, sensitivity)).otherwise(
            F.format_string(ML_FEW_IPS, "unique_ips")
        ),
        F.format_string(ML_FLAGGED, "flagged_ips", "unique_ips"),
    )
    return summary.select(F.posexplode(lines).alias("line", "message"))


def accuracy_report(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Detected against labelled episodes per kind."""
    detected, true = F.col("detected"), F.col("true_count")
    # sixteen rows on either side
    counts = F.broadcast(detected_counts(alerts).select("kind", "detected"))
    both = true_counts(events).join(counts, "kind")
    accuracy = (
        F.when(detected > true, true / detected * 100)
        .when(detected < true, detected / true * 100)
        .otherwise(F.lit(100.0))
    )
    verdict = (
        F.when(detected > true, F.lit("over"))
        .when(detected < true, F.lit("under"))
        .otherwise(F.lit("equal"))
    )
    label = titled(F.col("kind"))
    percent = _two_decimals(F.col("accuracy"))
    message = (
        F.when(detected > true, F.format_string(OVER_DETECTED, label, percent, detected, true))
        .when(detected < true, F.format_string(UNDER_DETECTED, label, percent, detected, true))
        .otherwise(F.format_string(ALL_DETECTED, label, true))
    )
    return (
        both.withColumn("accuracy", accuracy)
        .withColumn("verdict", verdict)
        .withColumn("message", message)
        .orderBy("position")
        .select("kind", "detected", "true_count", "accuracy", "verdict", "message")
    )


def hostile_actors(events: DataFrame, actors: DataFrame) -> DataFrame:
    """One row ``hostile_ips``: attacking IPs whose actor is not normal."""
    attacking = (
        events.where(F.col("classification") != NORMAL).select("ip").distinct()
    )
    hostile = actors.where(F.col("profile") != NORMAL).select("ip").distinct()
    return attacking.join(hostile, "ip", "left_semi").agg(F.count("*").alias("hostile_ips"))


def ml_accuracy_report(events: DataFrame, alerts: DataFrame, actors: DataFrame) -> DataFrame:
    """Model alerts next to the number of hostile actors.

    The line of the supervised classifier appears only if it raised alerts.
    """
    hostile = hostile_actors(events, actors).scalar()
    kind, detected = F.col("kind"), F.col("detected")
    counts = (
        detected_counts(alerts.where(kind.isin(*ML_KINDS)))
        .where(kind.isin(*ML_KINDS))
        .where((kind == "ml_anomaly") | (detected > 0))
        .withColumn("hostile_ips", hostile)
    )
    message = F.when(
        kind == "ml_anomaly", F.format_string(ANOMALY_CHECK, "detected", "hostile_ips")
    ).otherwise(F.format_string(SUPERVISED_CHECK, "detected", "hostile_ips"))
    return counts.select("kind", "detected", "hostile_ips", message.alias("message"))


def actor_distribution(actors: DataFrame) -> DataFrame:
    """Users per profile."""
    return (
        actors.groupBy("profile")
        .agg(F.count("*").alias("users"))
        .withColumn("message", F.format_string(USERS, "profile", "users"))
        .orderBy("profile")
    )


def role_distribution(events: DataFrame, actors: DataFrame) -> DataFrame:
    """Access and auth lines per actor role.

    An access line has the role of its actor, an auth line that of its label. The
    lines are counted per IP before they meet the actors.
    """
    by_label = (
        F.when(
            F.col("classification").isin("auth_sudo_bruteforce", "auth_privilege_escalation"),
            F.lit("compromised"),
        )
        .when(F.col("classification") != NORMAL, F.lit("attacker"))
        .otherwise(F.lit(NORMAL))
    )
    is_access = F.col("log_source") == "access"
    counted = (
        events.where(F.col("log_source").isin("access", "auth"))
        .groupBy(
            F.when(is_access, F.col("ip")).alias("ip"),
            F.when(~is_access, by_label).alias("label_role"),
        )
        .agg(
            F.count_if(is_access).alias("access_lines"),
            F.count_if(~is_access).alias("auth_lines"),
        )
    )
    roles = actors.groupBy("ip").agg(F.min("profile").alias("profile"))
    role = F.coalesce("label_role", "profile", F.lit(NORMAL))
    return (
        counted.join(roles, "ip", "left")
        .groupBy(role.alias("role"))
        .agg(F.sum("access_lines").alias("access_lines"), F.sum("auth_lines").alias("auth_lines"))
        .withColumn("message", F.format_string(LINES, "role", "access_lines", "auth_lines"))
        .orderBy("role")
    )


def counts_by_family(
    events: DataFrame, alerts: DataFrame, families: Iterable[str] = FAMILIES
) -> DataFrame:
    """Detected next to true counts of the enabled families.

    Of the model kinds this view shows ``ml_anomaly`` only.
    """
    shown = F.col("family").isin(*families) | (F.col("kind") == "ml_anomaly")
    return (
        true_counts(events)
        .join(detected_counts(alerts).select("kind", "detected"), "kind")
        .where(shown)
        .orderBy("position")
        .select("family", "kind", "detected", "true_count")
    )


def family_totals(events: DataFrame) -> DataFrame:
    """Episodes per kind with a total per family, and lines per family.

    ``kind`` is null in the row with the family's total.
    """
    totals = (
        true_counts(events)
        .where(F.col("family").isin(*FAMILIES))
        .rollup("family", "kind")
        .agg(F.sum("true_count").alias("episodes"))
        .where(F.col("family").isNotNull())
    )
    lines = source_row_counts(events).select(
        F.col("log_source").alias("family"), F.col("n").alias("lines")
    )
    return totals.join(lines, "family", "left").select(
        "family",
        "kind",
        "episodes",
        F.when(F.col("kind").isNull(), F.coalesce("lines", F.lit(0))).alias("lines"),
    ).orderBy("family", F.asc_nulls_last("kind"))
