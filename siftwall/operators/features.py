"""Per-IP and per-request features and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..schema import NORMAL

BASE_FEATURES = (
    "total_requests",
    "unique_paths",
    "error_rate",
    "fraction_2xx",
    "fraction_4xx",
    "fraction_5xx",
    "total_bytes",
    "avg_bytes",
    "unique_user_agents",
    "avg_interval",
)
BEHAVIOR_FEATURES = (
    "path_scan_ratio",
    "requests_per_minute",
    "burstiness",
    "post_fraction",
)
MODEL_FEATURES = BASE_FEATURES + BEHAVIOR_FEATURES

# Added to the time span in seconds, and the mean gap that stands in
# for "no gap".
SPAN_FLOOR_SECONDS = 1e-3
NO_INTERVAL_SECONDS = 1e6


def request_features(events: DataFrame) -> DataFrame:
    """One numeric row per event."""

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    return events.select(
        "status",
        "bytes_sent",
        F.log1p("bytes_sent").alias("bytes_log"),
        F.length("path").alias("path_length"),
        flag(F.col("method") == "POST").alias("is_post"),
        flag(F.col("status") >= 400).alias("is_error"),
        flag(F.col("status") >= 500).alias("is_5xx"),
        flag(F.rlike("path", F.lit(P.SQL_KEYWORDS))).alias("has_sql_keywords"),
        flag(F.rlike("path", F.lit(P.ADMIN_PATHS))).alias("has_admin_path"),
    )


def _per_ip(events: DataFrame) -> DataFrame:
    """Counts per IP.

    Rows are first folded per (ip, path, agent), map-side and with all three in the
    shuffle key. The two distinct counts, which multiply their input, then see the
    folded rows only, and no task ever holds all rows of a busy IP.
    """
    status = F.col("status")

    def times(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    folded = (
        events.where(F.col("ip").isNotNull())
        .groupBy("ip", "path", "agent")
        .agg(
            F.count("*").alias("n"),
            times(status >= 400).alias("n_error"),
            times(status.between(200, 299)).alias("n_2xx"),
            times(status.between(400, 499)).alias("n_4xx"),
            times(status >= 500).alias("n_5xx"),
            times(F.upper("method") == "POST").alias("n_post"),
            times(F.col("classification") != NORMAL).alias("n_threat"),
            F.sum("bytes_sent").alias("bytes"),
            F.count("bytes_sent").alias("n_bytes"),
            F.count("timestamp").alias("n_time"),
            F.min("timestamp").alias("first"),
            F.max("timestamp").alias("last"),
        )
    )
    sums = (
        "n",
        "n_error",
        "n_2xx",
        "n_4xx",
        "n_5xx",
        "n_post",
        "n_threat",
        "bytes",
        "n_bytes",
        "n_time",
    )
    return folded.groupBy("ip").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.count_distinct("path").alias("unique_paths"),
        F.count_distinct("agent").alias("unique_user_agents"),
    )


def _share(column: str) -> Column:
    return F.col(column) / F.col("n")


def _span_seconds() -> Column:
    return (F.unix_micros("last") - F.unix_micros("first")) / F.lit(1e6)


def _base_columns() -> list[Column]:
    # the mean of consecutive gaps is the whole span over their number
    interval = F.when(
        F.col("n_time") >= 2, _span_seconds() / (F.col("n_time") - 1)
    ).otherwise(F.lit(0.0))
    return [
        F.col("n").alias("total_requests"),
        F.col("unique_paths"),
        _share("n_error").alias("error_rate"),
        _share("n_2xx").alias("fraction_2xx"),
        _share("n_4xx").alias("fraction_4xx"),
        _share("n_5xx").alias("fraction_5xx"),
        F.coalesce("bytes", F.lit(0)).alias("total_bytes"),
        F.try_divide(F.col("bytes"), F.col("n_bytes")).alias("avg_bytes"),
        F.col("unique_user_agents"),
        interval.alias("avg_interval"),
    ]


def ip_features(events: DataFrame) -> DataFrame:
    """Base features, one row per IP (A1)."""
    return _per_ip(events).select("ip", *_base_columns())


def threat_features(events: DataFrame) -> DataFrame:
    """Base features and the threat label of each IP, from one pass."""
    return _per_ip(events).select(
        "ip", *_base_columns(), (F.col("n_threat") > 0).cast("int").alias("label")
    )


def behavior_features(events: DataFrame) -> DataFrame:
    """Base and behaviour features, one row per IP, from the same pass (A2)."""
    per_ip = _per_ip(events).select(
        "ip",
        *_base_columns(),
        F.coalesce(_span_seconds(), F.lit(0.0)).alias("span"),
        _share("n_post").alias("post_fraction"),
    )
    total = F.col("total_requests")
    interval = F.col("avg_interval")
    scan = F.col("unique_paths") / F.greatest(total, F.lit(1))
    rows = per_ip.select(
        "ip",
        *BASE_FEATURES,
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), scan)).alias("path_scan_ratio"),
        (total / ((F.col("span") + F.lit(SPAN_FLOOR_SECONDS)) / F.lit(60.0))).alias(
            "requests_per_minute"
        ),
        (
            F.lit(1.0)
            / (
                F.lit(1.0)
                + F.when(interval == 0.0, F.lit(NO_INTERVAL_SECONDS)).otherwise(interval)
            )
        ).alias("burstiness"),
        "post_fraction",
    )
    return rows.select(
        "ip", *[_finite_or_zero(rows, c).alias(c) for c in MODEL_FEATURES]
    )


def _finite_or_zero(rows: DataFrame, name: str) -> Column:
    if rows.schema[name].dataType.simpleString() != "double":
        return F.coalesce(F.col(name), F.lit(0))
    value = F.col(name)
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, value).otherwise(F.lit(0.0))


def modal_labels(events: DataFrame) -> DataFrame:
    """``ip, label``: the commonest class of an IP (A5).

    Ties go to the smallest word. Where that is ``normal``, an IP with more than half
    of its rows in error is taken for a brute forcer.
    """
    per_class = (
        events.where(F.col("ip").isNotNull())
        .groupBy("ip", "classification")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.coalesce(F.col("status") >= 400, F.lit(False))).alias("errors"),
        )
    )
    rank = F.struct((-F.col("n")).alias("order"), F.col("classification").alias("name"))
    per_ip = per_class.groupBy("ip").agg(
        F.min(F.when(F.col("classification").isNotNull(), rank)).alias("top"),
        F.sum("n").alias("n"),
        F.sum("errors").alias("errors"),
    )
    mode = F.col("top.name")
    return per_ip.select(
        "ip",
        F.when(mode.isNotNull() & (mode != NORMAL), mode)
        .when(F.col("errors") / F.col("n") > 0.5, F.lit("access_brute_force"))
        .otherwise(F.lit(NORMAL))
        .alias("label"),
    )


def threat_labels(events: DataFrame) -> DataFrame:
    """``ip, label``: 1 if the IP ever shows a class other than normal."""
    return (
        events.where(F.col("ip").isNotNull())
        .groupBy("ip")
        .agg(
            F.coalesce(
                F.max((F.col("classification") != NORMAL).cast("int")), F.lit(0)
            ).alias("label")
        )
    )


def labeled_features(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with the label of their IP, ``normal`` where there is none."""
    return features.join(labels.select("ip", "label"), "ip", "left").withColumn(
        "label", F.coalesce("label", F.lit(NORMAL))
    )


def class_distribution(labels: DataFrame) -> DataFrame:
    """``label, n``, most frequent first."""
    return labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def features_head(features: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows by IP (O2)."""
    return features.orderBy("ip").limit(rows)


def align_features(
    features: DataFrame, columns: list[str], keep: tuple[str, ...] = ()
) -> DataFrame:
    """The given columns in the given order; absent ones and nulls are 0.0.

    Columns of ``keep`` follow as they are.
    """

    def aligned(name: str) -> Column:
        if name not in features.columns:
            return F.lit(0.0)
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    return features.select("ip", *[aligned(c).alias(c) for c in columns], *keep)
