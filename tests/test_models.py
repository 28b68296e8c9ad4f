"""Isolation forest, alert rules and the two classifiers."""

from __future__ import annotations

import pytest
from helpers import events
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from siftwall.config import AnomalyConfig, IpClassifierConfig
from siftwall.operators.features import BASE_FEATURES, align_features, ip_features, threat_features
from siftwall.operators.forest import anomaly_scores, expected_path, grow_forest
from siftwall.operators.ranks import class_sample
from siftwall.plans import anomaly, attack_types, supervised
from siftwall.plans.detect import detect, register_detector, unregister_detector
from siftwall.session import fresh_path


@pytest.fixture(scope="module")
def cloud(spark):
    """1,000 ordinary points and one far away."""
    rows = spark.range(1001).select(
        F.col("id").cast("string").alias("ip"),
        *[
            F.when(F.col("id") == 1000, 9.0)
            .otherwise((F.xxhash64("id", F.lit(i)) % 1000) / 1000)
            .alias(f"x{i}")
            for i in range(3)
        ],
    )
    return rows


COLUMNS = ["x0", "x1", "x2"]


def test_planted_outlier_is_lowest(cloud):
    scores = anomaly_scores(cloud, COLUMNS, trees=50)
    rows = sorted((r["score"], r["ip"]) for r in scores.collect())
    assert len(rows) == 1001
    assert rows[0][1] == "1000"
    assert all(-1 <= s <= 0 for s, _ in rows)


def test_scores_do_not_depend_on_partitioning(cloud):
    one = {r["ip"]: r["score"] for r in anomaly_scores(cloud, COLUMNS, trees=20).collect()}
    other = anomaly_scores(cloud.repartition(9), COLUMNS, trees=20).collect()
    assert {r["ip"]: r["score"] for r in other} == one


def judged(spark, use_forest, **row):
    table = spark.createDataFrame(
        [
            {
                "ip": "a",
                "risk": 0.5,
                "score": -0.5,
                "cutoff": -0.6,
                "requests_per_minute": 0.0,
                "error_rate": 0.0,
                "path_scan_ratio": 0.0,
                **row,
            }
        ]
    )
    return anomaly.judge(table, AnomalyConfig(), use_forest).first()


@pytest.mark.parametrize(
    "row, hostile, confidence",
    [
        ({}, False, 0.7),
        ({"score": -0.7}, False, None),
        ({"score": -0.7, "risk": 0.55}, True, 0.35 + 0.4 * (0.1 / 0.600001) + 0.25 * 0.55),
        ({"score": -0.6, "risk": 0.81}, False, None),
        ({"risk": 0.82}, True, 0.86),
    ],
)
def test_alert_rules(spark, row, hostile, confidence):
    found = judged(spark, True, **row)
    assert found["hostile"] is hostile
    if confidence is not None:
        assert found["confidence"] == pytest.approx(confidence)


@pytest.mark.parametrize(
    "row",
    [{"requests_per_minute": 30.0}, {"error_rate": 0.45}, {"path_scan_ratio": 0.65}],
)
def test_low_n_rules(spark, row):
    assert judged(spark, False, **row)["hostile"] is True
    assert judged(spark, False)["hostile"] is False


def test_few_ips_need_no_forest(spark):
    df = events(spark, [{"t": i, "ip": str(i % 3), "path": f"/{i}"} for i in range(30)])
    run = anomaly.run_anomaly(df)
    summary = run.summary.first()
    assert (summary["unique_ips"], summary["use_forest"]) == (3, False)
    assert summary["flagged_ips"] == run.alerts.count() == 3


def training_rows(threats=6, normals=10):
    rows = []
    for i in range(threats + normals):
        bad = i < threats
        for j in range(5):
            rows.append(
                {
                    "t": j,
                    "ip": f"ip{i}",
                    "path": f"/{j}" if bad else "/",
                    "status": 404 if bad else 200,
                    "classification": "access_directory_scan" if bad and j == 0 else "normal",
                }
            )
    return rows


SMALL = IpClassifierConfig(trees=10, max_depth=5)


def test_training_guards(spark):
    assert supervised.train_ip_classifier(events(spark, []), SMALL).bundle is None
    only_normal = supervised.train_ip_classifier(events(spark, training_rows(0)), SMALL)
    assert "0 attacking" in only_normal.problem
    one_threat = supervised.train_ip_classifier(events(spark, training_rows(1)), SMALL)
    assert "1 attacking" in one_threat.problem


def test_train_save_load_score(spark):
    df = events(spark, training_rows())
    trained = supervised.train_ip_classifier(df, SMALL)
    assert {r["label"]: r["support"] for r in trained.report.collect()} == {0: 3, 1: 2}
    path = fresh_path(spark, "bundle")
    supervised.save_bundle(spark, trained.bundle, path)
    bundle = supervised.load_bundle(spark, path)
    assert bundle.columns == list(BASE_FEATURES)
    assert bundle.metadata["training_unique_ips"] == 16
    features = ip_features(df)
    scores = {r["ip"]: r["probability"] for r in supervised.score_ips(features, bundle).collect()}
    assert all(0 <= p <= 1 for p in scores.values())
    alerts = {r["ip"] for r in supervised.supervised_alerts(features, bundle).collect()}
    assert alerts == {f"ip{i}" for i in range(6)}
    # missing and further columns
    shuffled = features.drop("avg_bytes").withColumn("more", F.lit(1))
    assert supervised.score_ips(shuffled, bundle).count() == 16


def test_no_model_and_one_class_model(spark):
    features = ip_features(events(spark, training_rows()))
    assert supervised.supervised_alerts(features, None).count() == 0
    for only, alerts in ((1, 16), (0, 0)):
        bundle = supervised.ModelBundle(None, list(BASE_FEATURES), {"classes": [only]})
        assert supervised.supervised_alerts(features, bundle).count() == alerts


def test_classifier_report(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2
    rows = supervised.classifier_report(
        spark.createDataFrame(pairs, "label int, prediction int")
    ).collect()
    assert [tuple(r) for r in rows] == [
        (0, 1.0, 0.75, pytest.approx(6 / 7), 4),
        (1, pytest.approx(2 / 3), 1.0, pytest.approx(0.8), 2),
    ]


def test_class_sample_whole_and_bounded(spark):
    df = spark.range(1300).select(
        F.col("id").cast("string").alias("ip"), (F.col("id") >= 1000).cast("int").alias("label")
    )
    whole = class_sample(df, "label", "ip", 10_000, 7)
    assert whole.count() == 1300
    assert {(r["label"], r["weight"]) for r in whole.collect()} == {(0, 0.65), (1, 1300 / 600)}
    some = class_sample(df, "label", "ip", 800, 7)
    rows = some.groupBy("label").agg(F.count("*").alias("n"), F.first("weight").alias("w")).collect()
    assert {(r["label"], r["n"], r["w"]) for r in rows} == {(0, 400, 1300 / 800), (1, 300, 1300 / 600)}
    assert some.exceptAll(class_sample(df.repartition(9), "label", "ip", 800, 7)).isEmpty()
    assert class_sample(df.where("false"), "label", "ip", 10, 7).count() == 0


def test_training_on_a_bounded_sample_scores_all(spark):
    df = events(spark, training_rows(60, 90))
    bounded = IpClassifierConfig(trees=10, max_depth=5, max_training_rows=20, max_bins=8)
    trained = supervised.train_ip_classifier(df, bounded)
    assert {r["label"]: (r["support"], r["f1"]) for r in trained.report.collect()} == {0: (27, 1.0), 1: (18, 1.0)}
    scores = supervised.score_ips(ip_features(df), trained.bundle)
    assert scores.count() == 150
    assert scores.where("threat").count() == scores.where("probability >= 0.5").count() == 60


def test_model_without_probabilities(spark):
    df = events(spark, training_rows())
    rows = align_features(threat_features(df), ["error_rate"], keep=("label",))
    stages = [
        VectorAssembler(inputCols=["error_rate"], outputCol="features"),
        LinearSVC(featuresCol="features", labelCol="label"),
    ]
    bundle = supervised.ModelBundle(Pipeline(stages=stages).fit(rows), ["error_rate"])
    path = fresh_path(spark, "hard-bundle")
    supervised.save_bundle(spark, bundle, path)
    for model in (bundle, supervised.load_bundle(spark, path)):
        alerts = supervised.supervised_alerts(ip_features(df), model).collect()
        assert {(r["ip"], r["confidence"]) for r in alerts} == {(f"ip{i}", 0.8) for i in range(6)}


def test_trees_can_be_grown_and_walked_again(spark, cloud):
    """Plain Python over the published nodes gives the scores."""
    nodes = grow_forest(cloud, COLUMNS, 7, 64, 3).collect()
    by = {(r["tree"], r["node"]): r for r in nodes}
    for r in nodes:
        if r["feature"] >= 0:
            assert r["size"] == by[r["tree"], 2 * r["node"]]["size"] + by[r["tree"], 2 * r["node"] + 1]["size"]
    assert all(by[t, 1]["size"] == 64 for t in range(7))
    rows = {r["ip"]: [r[c] for c in COLUMNS] for r in cloud.collect()}
    got = {r["ip"]: r["score"] for r in anomaly_scores(cloud, COLUMNS, 7, 64, 3).collect()}
    assert set(got) == set(rows)
    for ip in ["0", "17", "500", "1000"]:
        total = 0.0
        for t in range(7):
            node = 1
            while by[t, node]["feature"] >= 0:
                node = 2 * node + (rows[ip][by[t, node]["feature"]] > by[t, node]["cut"])
            total += node.bit_length() - 1 + expected_path(by[t, node]["size"])
        assert got[ip] == pytest.approx(-(2 ** (-total / 7 / expected_path(64))), abs=1e-12)


def test_attack_types(spark):
    df = events(spark, training_rows())
    labels = df.select("ip").distinct().withColumn(
        "label", F.when(F.substring("ip", 3, 2).cast("int") < 6, "scan").otherwise("normal")
    )
    features = ip_features(df)
    rare = features.where("ip = 'ip0'").withColumns(
        {"ip": F.lit("ip0x"), "label": F.lit("rare")}
    )
    labeled = features.join(labels, "ip").unionByName(rare)
    trained = attack_types.train_attack_classifier(labeled)
    assert trained.dropped_rows == 1
    assert trained.accuracy == 1.0


def test_custom_detector_contract(spark):
    register_detector("access_bad", lambda e: e.select("ip"))
    try:
        with pytest.raises(ValueError, match="lacks"):
            detect(events(spark, [{"t": 0}]), kinds=["access_bad"])
        with pytest.raises(ValueError, match="exists"):
            register_detector("access_bad", lambda e: e)
    finally:
        unregister_detector("access_bad")
    with pytest.raises(ValueError, match="exists"):
        register_detector("access_brute_force", lambda e: e)
