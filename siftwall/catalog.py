"""Every operator as a query over the test tables: ``name -> f(spark, sf_dir)``.

Times are returned as epoch microseconds and doubles are rounded, so that another
engine can be compared value by value (see ``oracle.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .config import AnomalyConfig, DetectorConfig
from .functions import predicates as P
from .operators import features as features_of
from .operators import ranks
from .operators.burst import BurstRule, burst_alerts, burst_sessions
from .operators.chain import privilege_escalation
from .operators.forest import anomaly_scores as forest_scores
from .operators.forest import grow_forest, sample_size
from .operators.gaps import interarrival_gaps as gaps_of
from .plans import anomaly, attack_types, reports, supervised
from .plans.detect import burst_rules, detect, register_detector, unregister_detector
from .session import fresh_path, stage
from .sources import merge, parsers, text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# The test rows are too thin for the flood thresholds of the rule set.
TEST_CONFIG = DetectorConfig(
    access_request_flood_min_rows=10, firewall_syn_flood_min_packets=500
)
MISSING_PATH = "file:///nonexistent/siftwall/auth.log"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _ts() -> object:
    return F.unix_micros("timestamp").alias("ts_us")


def _flat_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "ip", _ts(), "kind", "count", F.round("confidence", 6).alias("confidence")
    )


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name)
            if f.dataType.simpleString() == "double"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _as_files(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = fresh_path(spark, name)
    merge.archive_lines(lines, path)
    return path


# -- sources and sinks ------------------------------------------------------------


@query
def src_text_lines(spark, sf_dir):
    path = _as_files(spark, X.access_lines(X.access_events(spark, sf_dir)), "access")
    lines, _ = text.read_lines(spark, {"access": [path], "auth": [MISSING_PATH]})
    return lines.select("log_source", "value")


@query
def raw_line_view(spark, sf_dir):
    path = _as_files(spark, X.firewall_lines(X.firewall_events(spark, sf_dir)), "firewall")
    return text.raw_line_view(
        spark,
        {"access": [path], "firewall": [path], "auth": [MISSING_PATH]},
        enabled=["auth", "firewall"],
    )


EVENT_COLUMNS = (
    "ip",
    "method",
    "path",
    "status",
    "bytes_sent",
    "referer",
    "agent",
    "classification",
    "count",
    "log_source",
)


@query
def parse_access(spark, sf_dir):
    lines = X.access_lines(X.access_events(spark, sf_dir))
    return parsers.parse_access(lines).select(*EVENT_COLUMNS, _ts())


@query
def parse_auth(spark, sf_dir):
    lines = X.auth_lines(X.auth_events(spark, sf_dir, labeled=True))
    return parsers.parse_auth(lines, reference_year=X.YEAR).select(
        *EVENT_COLUMNS, _ts(), "service", "auth_user", "ssh_port"
    )


@query
def parse_firewall(spark, sf_dir):
    lines = X.firewall_lines(X.firewall_events(spark, sf_dir))
    return parsers.parse_firewall(lines).select(
        *[c for c in EVENT_COLUMNS if c != "referer"],
        _ts(),
        "firewall_host",
        "dst_ip",
        "src_port",
        "dst_port",
        "protocol",
        "packets",
        "action",
    )


@query
def syslog_timestamps(spark, sf_dir):
    t = F.col("timestamp")
    padded = F.concat(
        F.date_format(t, "MMM "),
        F.lpad(F.date_format(t, "d"), 2, " "),
        F.date_format(t, " HH:mm:ss"),
    )
    stamp = (
        F.when(F.col("k") % 3 == 0, padded)
        .when(F.col("k") % 3 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
    )
    return X._base(spark, sf_dir).select(
        "k", F.unix_micros(parsers.syslog_timestamp(stamp, X.YEAR)).alias("ts_us")
    )


@query
def sshd_events(spark, sf_dir):
    k = F.col("k")
    tail = F.format_string("u%d from 10.8.0.%d port %d ssh2", k % 7, k % 250, 1024 + k % 5000)
    body = X._case(
        (k % 6 == 0, F.concat(F.lit("Failed password for invalid user "), tail)),
        (k % 6 == 1, F.concat(F.lit("Failed password for "), tail)),
        (k % 6 == 2, F.concat(F.lit("Invalid user "), tail)),
        (k % 6 == 3, F.concat(F.lit("Accepted publickey for "), tail)),
        (k % 6 == 4, F.lit("Failed password for invalid from 10.8.0.1 port 22 ssh2")),
        otherwise=F.lit("Connection closed by 10.8.0.1 port 22"),
    )
    messages = X._base(spark, sf_dir).select("k", body.alias("body"))
    return parsers.sshd_events(messages).select(
        "k", "ip", "method", "path", "status", "auth_user", "ssh_port"
    )


@query
def sudo_events(spark, sf_dir):
    k = F.col("k")
    failure = "pam_unix(sudo:auth): authentication failure; ruser="
    body = X._case(
        (
            k % 4 == 0,
            F.format_string("  u%d : TTY=pts/0 ; PWD=/ ; USER=r%d ; COMMAND=/bin/ls", k % 7, k % 3),
        ),
        (
            k % 4 == 1,
            F.format_string(failure + "u%d from 10.8.0.%d port 22", k % 7, k % 250),
        ),
        (k % 4 == 2, F.lit(failure + " rhost= user=root")),
        otherwise=F.lit("pam_unix(sudo:session): session opened for user root"),
    )
    messages = X._base(spark, sf_dir).select("k", body.alias("body"))
    return parsers.sudo_events(messages).select(
        "k", "ip", "method", "path", "status", "referer", "auth_user"
    )


@query
def label_trailer(spark, sf_dir):
    k = F.col("k")
    line = X._case(
        (k % 3 == 0, F.format_string("message %d port ssh2 class_%d %d ", k, k % 5, k % 37)),
        (k % 3 == 1, F.format_string("  message %d without a label", k)),
        otherwise=F.format_string("message-%d ending in port %d", k, k % 100),
    )
    return parsers.label_trailer(X._base(spark, sf_dir).select(line.alias("value"))).select(
        "line", "classification", "count"
    )


@query
def parse_rejects(spark, sf_dir):
    lines = X.access_lines(X.access_events(spark, sf_dir))
    n = F.regexp_extract("value", r"(\d+)$", 1).cast("int") % 7
    broken = lines.select(
        X._case(
            (n == 0, F.regexp_replace("value", '"(GET|POST) ', '"PUT ')),
            (n == 1, F.regexp_replace("value", r"\[01/", "[32/")),
            (n == 2, F.concat("value", F.lit("00000000000000000000"))),
            otherwise=F.col("value"),
        ).alias("value")
    )
    return parsers.rejects(broken, "access")


@query
def finalize_events(spark, sf_dir):
    events = X.access_events(spark, sf_dir)
    stamp = F.when(F.col("count") % 9 == 0, F.lit("no time")).otherwise(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
    raw = events.withColumn("timestamp", stamp.try_cast("timestamp"))
    return merge.timeline(parsers.finalize(raw)).select("ip", _ts(), "path", "count")


@query
def source_selection(spark, sf_dir):
    access = _as_files(spark, X.access_lines(X.access_events(spark, sf_dir)), "access")
    firewall = _as_files(spark, X.firewall_lines(X.firewall_events(spark, sf_dir)), "firewall")
    sources = {
        "access": [access, MISSING_PATH],
        "auth": [MISSING_PATH],
        "firewall": [firewall],
    }
    events = merge.read_events(spark, sources, enabled=["access", "firewall"])
    return events.groupBy("log_source").agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("total_bytes")
    )


@query
def archive_events(spark, sf_dir):
    path = fresh_path(spark, "archive")
    merge.archive_events(X.all_events(spark, sf_dir), path)
    return (
        merge.read_archive(spark, path)
        .groupBy("log_source", F.date_format("timestamp", "yyyy-MM-dd").alias("event_date"))
        .agg(F.count("*").alias("n"), F.sum("bytes_sent").alias("total_bytes"))
    )


@query
def archive_source(spark, sf_dir):
    """The first configured source of a family, copied and read back."""
    paths = [
        _as_files(spark, X.access_lines(X.access_events(spark, sf_dir).where(part)), "access")
        for part in ("bytes_sent < 2500", "bytes_sent >= 2500")
    ]
    target = fresh_path(spark, "copied")
    merge.archive_source(spark, {"access": paths}, "access", target)
    return text.read_lines(spark, {"access": [target]})[0].select("log_source", "value")


# -- projections and filters --------------------------------------------------------


@query
def utc_normalize(spark, sf_dir):
    X.use_utc(spark)
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return merge.utc_normalize(raw, "ts").select("event_id", F.unix_micros("ts").alias("ts_us"))


@query
def request_features(spark, sf_dir):
    return _rounded(features_of.request_features(X.access_events(spark, sf_dir)))


@query
def sqli_requests(spark, sf_dir):
    return X.access_events(spark, sf_dir).where(P.SQL_INJECTION).select("ip", _ts(), "path")


@query
def cmdi_requests(spark, sf_dir):
    return X.access_events(spark, sf_dir).where(P.COMMAND_INJECTION).select("ip", _ts(), "path")


@query
def failed_logins(spark, sf_dir):
    return X.access_events(spark, sf_dir).where(P.FAILED_LOGIN).select("ip", _ts(), "path")


@query
def denied_connections(spark, sf_dir):
    rows = X.firewall_events(spark, sf_dir)
    # rows without an action are taken by their status
    rows = rows.withColumn("action", F.when(F.col("count") % 4 != 0, F.col("action")))
    return rows.where(P.DENIED_SSH).select("ip", _ts(), "path", "action")


@query
def auth_failures(spark, sf_dir):
    failure = " OR ".join([P.SSH_FAILED_PASSWORD, P.SSH_INVALID_USER, P.SUDO_FAILURE])
    return X.auth_events(spark, sf_dir).where(failure).select("ip", _ts(), "path", "auth_user")


@query
def detector_selection(spark, sf_dir):
    alerts = detect(X.all_events(spark, sf_dir), TEST_CONFIG, families=["auth"])
    return alerts.groupBy("kind").agg(F.count("*").alias("detected"))


@query
def align_features(spark, sf_dir):
    rows = features_of.ip_features(X.access_events(spark, sf_dir))
    return _rounded(
        features_of.align_features(rows, ["error_rate", "not_a_feature", "total_requests"])
    )


# -- burst detectors ------------------------------------------------------------------


@query
def burst_sessions_all(spark, sf_dir):
    rule = BurstRule("failed_login", P.FAILED_LOGIN, 1, 60, 0.5)
    return burst_sessions(X.access_events(spark, sf_dir), [rule])


QUERIES["burst_sessions"] = QUERIES.pop("burst_sessions_all")


def _burst_query(kind: str, table: Callable) -> Query:
    def run(spark, sf_dir):
        rule = burst_rules(TEST_CONFIG)[kind]
        return _flat_alerts(burst_alerts(table(spark, sf_dir), [rule]))

    return run


for _kind in burst_rules():
    _table = {
        "access": X.access_events,
        "auth": X.auth_events,
        "firewall": X.firewall_events,
    }[_kind.split("_", 1)[0]]
    QUERIES[_kind] = _burst_query(_kind, _table)


@query
def auth_privilege_escalation(spark, sf_dir):
    return _flat_alerts(privilege_escalation(X.auth_events(spark, sf_dir)))


@query
def auth_priv_esc_labeled(spark, sf_dir):
    return _flat_alerts(privilege_escalation(X.auth_events(spark, sf_dir, labeled=True)))


@query
def auth_priv_esc_heuristic(spark, sf_dir):
    labeled = X.auth_events(spark, sf_dir, labeled=True)
    return _flat_alerts(privilege_escalation(labeled, mode="heuristic"))


def _suite(spark, sf_dir) -> DataFrame:
    return detect(X.all_events(spark, sf_dir), TEST_CONFIG)


@query
def all_alerts(spark, sf_dir):
    return _flat_alerts(_suite(spark, sf_dir))


@query
def custom_detector(spark, sf_dir):
    def server_errors(events):
        return (
            events.where((F.col("log_source") == "access") & (F.col("status") >= 500))
            .groupBy("ip")
            .agg(F.max("timestamp").alias("timestamp"), F.count("*").alias("count"))
            .where(F.col("count") >= 5)
            .withColumn("kind", F.lit("access_server_errors"))
            .withColumn("confidence", F.lit(0.5))
        )

    register_detector("access_server_errors", server_errors)
    try:
        alerts = detect(
            X.all_events(spark, sf_dir),
            kinds=["access_server_errors", "firewall_port_scan"],
            families=["access"],
        )
    finally:
        unregister_detector("access_server_errors")
    return _flat_alerts(alerts)


# -- features, joins, aggregates, ranks -------------------------------------------------


@query
def ip_features(spark, sf_dir):
    return _rounded(features_of.ip_features(X.access_events(spark, sf_dir)))


@query
def ip_behavior_features(spark, sf_dir):
    return _rounded(features_of.behavior_features(X.access_events(spark, sf_dir)))


@query
def features_head(spark, sf_dir):
    return _rounded(
        features_of.features_head(features_of.ip_features(X.visitor_events(spark, sf_dir)))
    )


@query
def ip_modal_labels(spark, sf_dir):
    return features_of.modal_labels(X.all_events(spark, sf_dir))


@query
def labeled_features(spark, sf_dir):
    events = X.visitor_events(spark, sf_dir)
    labels = features_of.modal_labels(events).where(F.col("label") != "access_brute_force")
    rows = features_of.labeled_features(features_of.ip_features(events), labels)
    return rows.select("ip", "total_requests", "label")


@query
def ip_threat_labels(spark, sf_dir):
    return features_of.threat_labels(X.visitor_events(spark, sf_dir))


@query
def class_distribution(spark, sf_dir):
    labels = features_of.modal_labels(X.visitor_events(spark, sf_dir))
    return features_of.class_distribution(labels)


@query
def training_stats(spark, sf_dir):
    events = X.visitor_events(spark, sf_dir).unionByName(X.firewall_events(spark, sf_dir))
    return supervised.training_stats(events)


@query
def source_row_counts(spark, sf_dir):
    return reports.source_row_counts(X.all_events(spark, sf_dir))


def _visitor_features(spark, sf_dir) -> DataFrame:
    return stage(features_of.behavior_features(X.visitor_events(spark, sf_dir)), "features")


@query
def mad_cutoff(spark, sf_dir):
    rows = _visitor_features(spark, sf_dir)
    return _rounded(ranks.mad_cutoff(rows, "requests_per_minute", 2.5))


@query
def interarrival_gaps(spark, sf_dir):
    return gaps_of(X.access_events(spark, sf_dir)).select("ip", _ts(), "gap_us")


@query
def percent_ranks(spark, sf_dir):
    rows = ranks.metric_ranks(_visitor_features(spark, sf_dir), anomaly.RISK_METRICS)
    return _rounded(rows.select("ip", "metric", "pct"))


@query
def behavioral_risk(spark, sf_dir):
    return _rounded(anomaly.behavioral_risk(_visitor_features(spark, sf_dir)))


@query
def events_timeline(spark, sf_dir):
    return merge.timeline(X.all_events(spark, sf_dir)).select("ip", _ts(), "log_source", "path")


@query
def merged_events(spark, sf_dir):
    narrow = X.access_events(spark, sf_dir).drop("dst_port", "packets", "action")
    merged = merge.merge_events(narrow, X.firewall_events(spark, sf_dir))
    return merged.select("ip", _ts(), "log_source", "referer", "dst_port", "packets", "action")


@query
def scalar_functions(spark, sf_dir):
    return X.access_events(spark, sf_dir).select(
        "ip",
        _ts(),
        F.upper("path").alias("upper_path"),
        F.length("path").alias("path_length"),
        F.contains("path", F.lit("=")).alias("has_equals"),
        F.regexp_extract("agent", r"agent-(\d+)", 1).alias("agent_number"),
        reports.titled(F.col("classification")).alias("title"),
        F.format_string("%.2f", F.col("bytes_sent") / F.lit(7.0)).alias("two_decimals"),
        F.round(F.log1p("bytes_sent"), 6).alias("bytes_log"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.col("bytes_sent"))).alias("clipped"),
        F.col("status").between(400, 499).alias("is_4xx"),
        F.coalesce(F.col("service"), F.lit("none")).alias("service"),
        F.unix_micros(F.col("timestamp") + F.expr("INTERVAL 90 SECONDS")).alias("later_us"),
    )


@query
def rare_class_filter(spark, sf_dir):
    labels = X.access_events(spark, sf_dir).select(
        "ip", F.concat("path", F.lit("/"), F.col("bytes_sent")).alias("label")
    )
    return attack_types.rare_class_filter(labels, 3).groupBy("label").agg(
        F.count("*").alias("n")
    )


# -- model-based detection ----------------------------------------------------------------


def _four_addresses(spark, sf_dir) -> DataFrame:
    """Access rows folded onto four addresses, too few for a forest."""
    block = F.regexp_extract("ip", r"^(\d+\.\d+\.\d+)\.", 1)
    return X.access_events(spark, sf_dir).withColumn("ip", block)


@query
def isolation_trees(spark, sf_dir):
    """The nodes of all trees, from which scores can be computed again."""
    rows = _visitor_features(spark, sf_dir)
    sample = sample_size(rows, AnomalyConfig.max_samples)
    return _rounded(grow_forest(rows, features_of.MODEL_FEATURES, AnomalyConfig.trees, sample, AnomalyConfig.seed))


@query
def anomaly_scores(spark, sf_dir):
    rows = _visitor_features(spark, sf_dir)
    return _rounded(forest_scores(rows, features_of.MODEL_FEATURES))


@query
def ml_anomaly_alerts(spark, sf_dir):
    return _flat_alerts(anomaly.run_anomaly(X.visitor_events(spark, sf_dir)).alerts)


def _judged_by_rate(spark, sf_dir) -> DataFrame:
    """The alert rules with a plain score, the negative request rate."""
    config = AnomalyConfig(min_risk=0.5, severe_risk=0.7)
    rows = _visitor_features(spark, sf_dir)
    rows = rows.withColumn("score", -F.col("requests_per_minute"))
    cutoff = ranks.mad_cutoff(rows, "score", 0.5).select("cutoff").scalar()
    table = rows.join(anomaly.behavioral_risk(rows), "ip").withColumn("cutoff", cutoff)
    return anomaly.judge(table, config, use_forest=True)


@query
def ml_alert_rules(spark, sf_dir):
    rows = _judged_by_rate(spark, sf_dir).where("hostile")
    return _rounded(rows.select("ip", "outlier", "confidence"))


@query
def low_n_anomalies(spark, sf_dir):
    return _flat_alerts(anomaly.run_anomaly(_four_addresses(spark, sf_dir)).alerts)


@query
def ml_run_summary(spark, sf_dir):
    return anomaly.run_anomaly(_four_addresses(spark, sf_dir)).summary


@query
def ml_summary_report(spark, sf_dir):
    return reports.ml_summary_report(anomaly.run_anomaly(_four_addresses(spark, sf_dir)).summary)


@query
def train_ip_classifier(spark, sf_dir):
    return _rounded(supervised.train_ip_classifier(X.visitor_events(spark, sf_dir)).report)


@query
def stratified_split(spark, sf_dir):
    rows = features_of.threat_labels(X.visitor_events(spark, sf_dir))
    split = ranks.hash_split(rows, "label", "ip", 0.7, 42)
    return split.groupBy("label").agg(
        F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test")
    )


@query
def classifier_report(spark, sf_dir):
    rows = features_of.threat_features(X.visitor_events(spark, sf_dir))
    predicted = rows.select(
        "label", (F.col("unique_user_agents") > 11).cast("int").alias("prediction")
    )
    return _rounded(supervised.classifier_report(predicted))


@query
def model_bundle(spark, sf_dir):
    """A model stored and loaded again, held against the one that was fitted, IP by IP."""
    events = X.visitor_events(spark, sf_dir)
    fitted = supervised.train_ip_classifier(events).bundle
    path = fresh_path(spark, "bundle")
    supervised.save_bundle(spark, fitted, path)
    loaded = supervised.load_bundle(spark, path)
    features = stage(features_of.ip_features(events), "bundle-features")
    before, after = supervised.score_ips(features, fitted), supervised.score_ips(features, loaded)
    about = loaded.metadata
    return before.join(
        after.select("ip", F.col("probability").alias("again"), F.col("threat").alias("threat_again")), "ip"
    ).select(
        "ip",
        (F.col("probability") == F.col("again")).alias("same_probability"),
        F.col("threat_again").alias("threat"),
        F.lit(",".join(loaded.columns)).alias("columns"),
        F.lit(",".join(about["sources_seen"])).alias("sources"),
        F.lit(about["training_rows"]).cast("long").alias("training_rows"),
        F.lit(about["training_unique_ips"]).cast("long").alias("training_unique_ips"),
    )


@query
def ml_supervised_alerts(spark, sf_dir):
    """Alerts of the fitted forest; its confidences, as far as they are above the threshold."""
    events = X.visitor_events(spark, sf_dir)
    bundle = supervised.train_ip_classifier(events).bundle
    alerts = supervised.supervised_alerts(features_of.ip_features(events), bundle)
    return _flat_alerts(alerts).withColumn("confidence", F.col("confidence").between(0.5, 1.0))


@query
def ml_hard_prediction_alerts(spark, sf_dir):
    """Alerts of a linear model that predicts classes without probabilities."""
    events = X.visitor_events(spark, sf_dir)
    rows = stage(features_of.threat_features(events), "hard-features")
    columns = ["error_rate", "fraction_2xx"]
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=columns, outputCol="features"),
            LinearSVC(featuresCol="features", labelCol="label", maxIter=50),
        ]
    ).fit(features_of.align_features(rows, columns, keep=("label",)))
    bundle = supervised.ModelBundle(model, columns)
    return _flat_alerts(supervised.supervised_alerts(rows.drop("label"), bundle))


@query
def attack_type_classifier(spark, sf_dir):
    events = X.typed_events(spark, sf_dir)
    labeled = stage(
        features_of.labeled_features(
            features_of.ip_features(events), features_of.modal_labels(events)
        ),
        "labeled",
    )
    return _rounded(attack_types.train_attack_classifier(labeled).report)


# -- reports ----------------------------------------------------------------------------


@query
def true_attack_counts(spark, sf_dir):
    return reports.true_counts(X.all_events(spark, sf_dir)).select("kind", "true_count")


@query
def detected_counts(spark, sf_dir):
    return reports.detected_counts(_suite(spark, sf_dir)).select("kind", "detected")


@query
def true_count_report(spark, sf_dir):
    return reports.true_count_report(X.all_events(spark, sf_dir))


@query
def alert_listing(spark, sf_dir):
    alerts = stage(_suite(spark, sf_dir), "alerts")
    rows = reports.alert_listing(alerts, families=["auth", "firewall"])
    return rows.select("kind", "kind_total", "ip", _ts(), "count", "heading", "message")


@query
def detection_summary(spark, sf_dir):
    return reports.detection_summary(_suite(spark, sf_dir), families=["access", "auth"])


@query
def accuracy_report(spark, sf_dir):
    return _rounded(
        reports.accuracy_report(X.all_events(spark, sf_dir), _suite(spark, sf_dir))
    )


@query
def ml_accuracy_report(spark, sf_dir):
    alerts = anomaly.alerts_of(_judged_by_rate(spark, sf_dir))
    return reports.ml_accuracy_report(
        X.all_events(spark, sf_dir), alerts, X.actors(spark, sf_dir)
    )


@query
def hostile_actor_count(spark, sf_dir):
    return reports.hostile_actors(X.all_events(spark, sf_dir), X.actors(spark, sf_dir))


@query
def actor_distribution(spark, sf_dir):
    return reports.actor_distribution(X.actors(spark, sf_dir))


@query
def role_distribution(spark, sf_dir):
    events = X.access_events(spark, sf_dir).unionByName(
        X.auth_events(spark, sf_dir, labeled=True)
    )
    return reports.role_distribution(events, X.actors(spark, sf_dir))


@query
def counts_by_family(spark, sf_dir):
    return reports.counts_by_family(
        X.all_events(spark, sf_dir), _suite(spark, sf_dir), families=["access", "firewall"]
    )


@query
def family_totals(spark, sf_dir):
    return reports.family_totals(X.all_events(spark, sf_dir))
