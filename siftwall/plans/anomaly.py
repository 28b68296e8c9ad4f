"""Unsupervised anomaly detection over per-IP behaviour."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AnomalyConfig
from ..operators.features import MODEL_FEATURES, behavior_features
from ..operators.forest import anomaly_scores
from ..operators.ranks import mad_cutoff, metric_ranks
from ..schema import ALERT_SCHEMA, conform
from ..session import stage

KIND = "ml_anomaly"

RISK_METRICS = (
    "path_scan_ratio",
    "error_rate",
    "fraction_4xx",
    "requests_per_minute",
    "burstiness",
    "post_fraction",
)


@dataclass(frozen=True)
class AnomalyRun:
    """Alerts of one run, its per-IP table and its one-row summary."""

    alerts: DataFrame
    judged: DataFrame
    summary: DataFrame


def behavioral_risk(features: DataFrame) -> DataFrame:
    """``ip, risk``: mean percentile rank over the attack-shaped metrics."""
    ranks = metric_ranks(features, RISK_METRICS)
    return ranks.groupBy("ip").agg(F.avg("pct").alias("risk"))


def _clip(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def low_n_hostile(config: AnomalyConfig) -> Column:
    """The rule for tables with too few IPs for a forest (M3)."""
    return (
        (F.col("requests_per_minute") >= config.low_n_requests_per_minute)
        | (F.col("error_rate") >= config.low_n_error_rate)
        | (F.col("path_scan_ratio") >= config.low_n_path_scan_ratio)
    )


def judge(table: DataFrame, config: AnomalyConfig, use_forest: bool) -> DataFrame:
    """Add ``outlier, hostile, confidence`` (M2).

    ``table`` holds features, ``risk``, and with a forest ``score`` and ``cutoff``.
    """
    risk = F.col("risk")
    severe = risk >= config.severe_risk
    plain = _clip(F.lit(0.45) + F.lit(0.5) * risk)
    if not use_forest:
        return table.withColumns(
            {
                "outlier": F.lit(False),
                "hostile": severe | low_n_hostile(config),
                "confidence": plain,
            }
        )
    score, cutoff = F.col("score"), F.col("cutoff")
    outlier = score < cutoff
    depth = (cutoff - score) / (F.abs(cutoff) + F.lit(1e-6))
    deep = _clip(
        F.lit(0.35) + F.lit(0.4) * F.least(F.lit(1.0), depth) + F.lit(0.25) * risk
    )
    return table.withColumns(
        {
            "outlier": outlier,
            "hostile": (outlier & (risk >= config.min_risk)) | severe,
            "confidence": F.when(outlier, deep).otherwise(plain),
        }
    )


def alerts_of(judged: DataFrame) -> DataFrame:
    return conform(
        judged.where("hostile").select(
            "ip", F.lit(KIND).alias("kind"), F.lit(1).alias("count"), "confidence"
        ),
        ALERT_SCHEMA,
    )


def run_anomaly(events: DataFrame, config: AnomalyConfig | None = None) -> AnomalyRun:
    """Features, forest, ranks and rules in one go.

    The features are written once, as several passes follow; scores likewise.
    """
    config = config or AnomalyConfig()
    features = stage(behavior_features(events), "features")
    return run_on_features(features, config)


def run_on_features(features: DataFrame, config: AnomalyConfig | None = None) -> AnomalyRun:
    """As ``run_anomaly``, for stored behaviour features."""
    config = config or AnomalyConfig()
    use_forest = features.count() >= config.min_ips_for_forest
    table = features.join(behavioral_risk(features), "ip")
    if use_forest:
        scores = stage(
            anomaly_scores(
                features, MODEL_FEATURES, config.trees, config.max_samples, config.seed
            ),
            "scores",
        )
        cutoff = mad_cutoff(scores, "score", config.mad_multiplier)
        table = table.join(scores, "ip").withColumn(
            "cutoff", cutoff.select("cutoff").scalar()
        )
    judged = stage(judge(table, config, use_forest), "judged")
    return AnomalyRun(alerts_of(judged), judged, summary_of(judged, config, use_forest))


def summary_of(judged: DataFrame, config: AnomalyConfig, use_forest: bool) -> DataFrame:
    """One row about the run (M4)."""
    return judged.agg(
        F.count("*").alias("unique_ips"),
        F.lit(use_forest).alias("use_forest"),
        F.lit(config.mad_multiplier).alias("mad_multiplier"),
        F.count_if("hostile").alias("flagged_ips"),
    )


def anomaly_detector(config: AnomalyConfig | None = None):
    """The detector form, for ``detect(extra=...)``."""
    return lambda events: run_anomaly(events, config).alerts
