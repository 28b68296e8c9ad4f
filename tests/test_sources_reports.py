"""Files in and out, and the wording of the reports."""

from __future__ import annotations

import pytest
from helpers import at, events
from pyspark.errors import AnalysisException

from siftwall import schema
from siftwall.plans import reports
from siftwall.session import fresh_path
from siftwall.sources import merge, text

LINE = b'1.2.3.4 - - [23/Mar/2026:10:45:09 +0000] "GET / HTTP/1.1" 200 5 "-" "a\xffb" normal 0\r\n'


@pytest.fixture
def access_log(tmp_path):
    path = tmp_path / "access.log"
    path.write_bytes(LINE + b"rubbish\n")
    return str(path)


def test_bad_bytes_are_replaced(spark, access_log):
    (row,) = merge.read_events(spark, {"access": [access_log]}).collect()
    assert row["agent"] == "a�b"


def test_missing_path_is_reported(spark, access_log):
    lines, errors = text.read_lines(spark, {"access": [access_log, "/no/such.log"]})
    assert lines.count() == 2
    (error,) = errors.collect()
    assert (error["log_source"], error["file"]) == ("access", "/no/such.log")
    view = [r["value"] for r in text.raw_line_view(spark, {"auth": ["/no/such.log"]}).collect()]
    assert view == ["[error] Could not read /no/such.log: PATH_NOT_FOUND"]


def test_families_not_enabled_are_not_read(spark, access_log):
    sources = {"access": [access_log], "auth": ["/no/such.log"]}
    lines, errors = text.read_lines(spark, sources, enabled=["access"])
    assert (lines.count(), errors.count()) == (2, 0)
    assert merge.read_events(spark, sources, enabled=[]).count() == 0


def test_archive_refuses_to_overwrite(spark):
    df = events(spark, [{"t": 0}, {"t": 90_000, "log_source": "auth"}])
    path = fresh_path(spark, "archive")
    merge.archive_events(df, path)
    with pytest.raises(AnalysisException):
        merge.archive_events(df, path)
    merge.archive_events(df, path, overwrite=True)
    back = merge.read_archive(spark, path)
    assert back.schema == df.schema
    assert back.exceptAll(df).count() == 0 and back.count() == 2
    plan = back.where("log_source = 'auth'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_source" in plan


def test_archive_of_the_first_source(spark, access_log):
    path = fresh_path(spark, "copy")
    assert merge.archive_source(spark, {"access": [access_log]}, "access", path)
    assert spark.read.text(path).count() == 2
    assert not merge.archive_source(spark, {}, "auth", path)
    assert not merge.archive_source(spark, {"auth": ["/no/such"]}, "auth", path)


def test_utc_normalize(spark):
    df = spark.createDataFrame([("2026-03-01 02:00:00+02:00",)], "timestamp string")
    (row,) = merge.utc_normalize(df).collect()
    assert row["timestamp"] == at(0).replace(tzinfo=None)


def alerts(spark, *rows):
    return schema.conform(
        spark.createDataFrame(
            [(k, "1.1.1.1", at(t) if t is not None else None, n) for k, t, n in rows],
            "kind string, ip string, timestamp timestamp, count bigint",
        ),
        schema.ALERT_SCHEMA,
    )


def test_accuracy_wording(spark):
    def labeled(kind, episodes):
        return [{"t": 0, "classification": kind, "count": e} for e in range(episodes)]

    df = events(
        spark, labeled("access_brute_force", 3) + labeled("auth_ssh_user_enum", 32)
    )
    found = alerts(
        spark,
        *[("access_brute_force", 0, 1)] * 4,
        ("auth_ssh_user_enum", 0, 1),
    )
    message = {r["kind"]: r["message"] for r in reports.accuracy_report(df, found).collect()}
    assert list(message) == list(schema.ATTACK_KINDS)
    assert message["access_brute_force"] == (
        "Access Brute Force accuracy: 75.00%. Over-detected 4 attempts, but only 3 were generated."
    )
    assert message["auth_ssh_user_enum"] == (
        "Auth Ssh User Enum accuracy: 3.12%. Under-detected 1 attempts out of 32 generated attacks."
    )
    assert message["ml_anomaly"] == (
        "Ml Anomaly accuracy: 100%. Detected all 0 generated attempts."
    )


def test_listing_and_summary(spark):
    found = alerts(
        spark, ("auth_ssh_bruteforce", 1.5, 8), ("ml_anomaly", None, 1), ("access_x", 0, 2)
    )
    rows = reports.alert_listing(found, ["auth"]).collect()
    assert [r["message"] for r in rows] == [
        "ThreatAlert(auth_ssh_bruteforce, ip=1.1.1.1, "
        "time=2026-03-01 00:00:01.500000+00:00, count=8)",
        "ThreatAlert(ml_anomaly, ip=1.1.1.1, count=1)",
    ]
    assert rows[0]["heading"] == "AUTH_SSH_BRUTEFORCE (1 total):"
    summary = [r["message"] for r in reports.detection_summary(found, ["auth"]).collect()]
    assert summary == [
        "Auth Ssh Bruteforce attempts detected: 1",
        "ML isolation forest identified 1 anomalous/ hostile IPs",
    ]


def test_ml_summary_wording(spark):
    def lines(use_forest):
        row = spark.createDataFrame(
            [(9, use_forest, 2.5, 1)],
            "unique_ips bigint, use_forest boolean, mad_multiplier double, flagged_ips bigint",
        )
        return [r["message"] for r in reports.ml_summary_report(row).collect()]

    assert lines(True)[2] == "Outlier sensitivity: 2.5× "
    assert lines(False)[2].startswith(" Only 9 IPs here")
    assert lines(True)[3] == "Flagged as possible hostile IPs: 1 (out of 9 unique addresses)"


def test_supervised_line_needs_alerts(spark):
    df = events(spark, [{"t": 0, "classification": "access_brute_force"}])
    actors = spark.createDataFrame([("1.1.1.1", "attacker")], "ip string, profile string")
    no_ml = reports.ml_accuracy_report(df, alerts(spark, ("access_x", 0, 1)), actors)
    assert [r["kind"] for r in no_ml.collect()] == ["ml_anomaly"]
    both = reports.ml_accuracy_report(df, alerts(spark, ("ml_supervised", None, 1)), actors)
    assert {(r["kind"], r["detected"], r["hostile_ips"]) for r in both.collect()} == {
        ("ml_anomaly", 0, 1),
        ("ml_supervised", 1, 1),
    }
