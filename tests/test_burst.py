"""Burst sessions: boundaries, hot keys, and a brute-force comparison."""

from __future__ import annotations

import random

import pytest
from helpers import events, seconds
from pyspark.sql import functions as F

from siftwall.config import DetectorConfig
from siftwall.operators.burst import BurstRule, burst_alerts, burst_sessions
from siftwall.plans.detect import burst_rules, detect, select_kinds

ALL = BurstRule("any", "true", 1, 10, 0.5)


def sessions(df, *rules):
    rows = burst_sessions(df, list(rules)).collect()
    return sorted((r["kind"], r["ip"], r["start_us"], r["end_us"], r["amount"]) for r in rows)


def brute(rows, rule):
    """Sessions by the plain definition; rows are (ip, micros, value)."""
    out = []
    for ip in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == ip), key=lambda r: r[1])
        parts, last = [], None
        for row in own:
            if last is None or row[1] - last > rule.gap_micros:
                parts.append([])
            parts[-1].append(row)
            last = row[1]
        for part in parts:
            amount = {
                "rows": len(part),
                "sum": sum(r[2] or 0 for r in part),
                "distinct": len({r[2] for r in part if r[2] is not None}),
            }[rule.measure]
            out.append((rule.kind, ip, part[0][1], part[-1][1], amount))
    return sorted(out)


def test_gap_is_strict(spark):
    df = events(spark, [{"t": 0}, {"t": 10}, {"t": 20.000001}])
    assert [s[4] for s in sessions(df, ALL)] == [2, 1]


def test_threshold_is_inclusive(spark):
    df = events(spark, [{"t": i} for i in range(3)])
    rule = lambda n: BurstRule("k", "true", n, 10, 0.5)
    assert burst_alerts(df, [rule(3)]).count() == 1
    assert burst_alerts(df, [rule(4)]).count() == 0


def test_equal_times_single_rows_and_nulls(spark):
    df = events(
        spark,
        [
            {"t": 5},
            {"t": 5},
            {"t": 5, "ip": "2.2.2.2"},
            {"t": 5, "ip": None},
            {"ip": "3.3.3.3"},
        ],
    )
    assert [(s[1], s[4]) for s in sessions(df, ALL)] == [("1.1.1.1", 2), ("2.2.2.2", 1)]


def test_zero_gap_keeps_equal_times_together(spark):
    df = events(spark, [{"t": 1}, {"t": 1}, {"t": 1.000001}])
    rule = BurstRule("k", "true", 1, 0, 0.5)
    assert [s[4] for s in sessions(df, rule)] == [2, 1]


def test_times_before_1970(spark):
    base = -60_000_000
    rows = [("a", base + d, 0) for d in (0, 9_000_000, 70_000_000)]
    df = spark.createDataFrame(rows, "ip string, us bigint, v bigint").select(
        "ip", F.timestamp_micros("us").alias("timestamp")
    )
    assert sessions(df, ALL) == brute(rows, ALL)


def test_empty_input(spark):
    assert sessions(events(spark, []), ALL) == []


@pytest.mark.parametrize("measure", ["rows", "sum", "distinct"])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, measure, seed):
    rng = random.Random(seed)
    rows = [
        (
            rng.choice(["hot"] * 5 + ["a", "b", "c"]),
            rng.randrange(0, 400_000_000),
            rng.choice([None, *range(6)]),
        )
        for _ in range(3000)
    ]
    rules = [
        BurstRule(f"{measure}_{g}", "true", 1, g, 0.5, measure, "v") for g in (0.05, 0.3, 2)
    ]
    df = spark.createDataFrame(rows, "ip string, us bigint, v bigint").select(
        "ip", F.timestamp_micros("us").alias("timestamp"), "v"
    )
    expected = sorted(sum((brute(rows, r) for r in rules), []))
    assert sessions(df.repartition(7), *rules) == expected
    assert sessions(df.orderBy(F.desc("us")).coalesce(1), *rules) == expected
    assert sorted(sum((sessions(df, r) for r in rules), [])) == expected


def test_same_as_session_window(spark):
    rng = random.Random(3)
    df = events(spark, [{"t": rng.random() * 500, "ip": rng.choice("abc")} for _ in range(400)])
    builtin = (
        df.groupBy("ip", F.session_window("timestamp", "10 seconds"))
        .agg(F.count("*").alias("n"))
        .select("ip", "n")
    )
    mine = burst_sessions(df, [ALL]).select("ip", F.col("amount").alias("n"))
    assert mine.exceptAll(builtin).count() == 0
    assert mine.count() == builtin.count()


def test_hot_ip_is_folded_before_the_window(spark):
    """The window sees at most span / gap cells of an IP, not its rows."""
    df = spark.range(200_000).select(
        F.expr("if(id % 3 = 0, 'hot', cast(id AS string)) AS ip"),
        F.timestamp_micros(F.col("id") * 100).alias("timestamp"),
    )
    found = {r["ip"]: r["amount"] for r in burst_sessions(df, [ALL]).where("amount > 1").collect()}
    assert found == {"hot": 66667}
    plan = burst_sessions(df, [ALL])._jdf.queryExecution().executedPlan().toString()
    before_window = plan[plan.index("Window") :]
    assert "partial_min" in before_window and "partial_sum" in before_window


def test_alert_columns(spark):
    rows = [{"t": i, "path": "/login", "status": 401, "method": "POST"} for i in range(10)]
    df = events(spark, rows)
    (alert,) = burst_alerts(df, [burst_rules()["access_brute_force"]]).collect()
    assert (alert["ip"], alert["kind"], alert["count"]) == ("1.1.1.1", "access_brute_force", 10)
    assert seconds(alert["timestamp"]) == 9
    assert alert["confidence"] == 0.95


def test_rows_of_another_source_do_not_alert(spark):
    login = {"path": "/login", "status": 401, "method": "POST", "log_source": "ml"}
    assert detect(events(spark, [{"t": i, **login} for i in range(10)])).count() == 0


def test_null_path_is_no_injection(spark):
    paths = [None, "/a;--", "/B' OR 1=1"]
    df = events(spark, [{"t": i, "path": p} for i, p in enumerate(paths)])
    rule = burst_rules()["access_sql_injection"]
    assert [a["count"] for a in burst_alerts(df, [rule]).collect()] == [2]


def test_suite_equals_single_detectors(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(1500):
        t = rng.random() * 300
        family = rng.choice(["access", "auth", "firewall"])
        row = {"t": t, "ip": rng.choice(["a", "b"]), "log_source": family}
        if family == "access":
            row.update(
                path=rng.choice(["/login", "/x;--", "/y", "/z"]),
                method="POST",
                status=rng.choice([200, 401, 404]),
                bytes_sent=rng.randrange(50_000),
            )
        elif family == "auth":
            path = rng.choice(["ssh/failed_password", "ssh/invalid_user", "ssh/accepted"])
            row.update(path=path, method="SSH", auth_user="u")
        else:
            row.update(
                action="DENY",
                protocol="tcp",
                dst_port=rng.choice([22, *range(15)]),
                packets=50,
                bytes_sent=rng.randrange(200_000),
            )
        rows.append(row)
    df = events(spark, rows)
    together = sorted(map(str, detect(df).collect()))
    single = []
    for rule in burst_rules().values():
        single += burst_alerts(df, [rule]).collect()
    assert together == sorted(map(str, single))
    assert len(together) > 5


def test_selection():
    kinds = ["access_x", "auth_y", "firewall_z", "ml_anomaly", "other"]
    assert select_kinds(kinds, [" Auth "]) == ["auth_y", "ml_anomaly", "other"]
    assert select_kinds(kinds, []) == ["ml_anomaly", "other"]


def test_config_changes_thresholds(spark):
    rows = [{"t": i, "path": "/login", "status": 401, "method": "POST"} for i in range(3)]
    config = DetectorConfig(access_brute_force_min_rows=3)
    kinds = [r["kind"] for r in detect(events(spark, rows), config).collect()]
    assert kinds == ["access_brute_force"]
