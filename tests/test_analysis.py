"""A whole run from text files to reports."""

from __future__ import annotations

import pytest

from siftwall import fixtures as X
from siftwall.config import DetectorConfig
from siftwall.plans.analysis import analyze
from siftwall.plans.detect import detect
from siftwall.session import fresh_path
from siftwall.sources.merge import archive_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sources(spark):
    paths = {}
    for family, render, table in (
        ("access", X.access_lines, X.access_events(spark, SF)),
        ("auth", X.auth_lines, X.auth_events(spark, SF)),
        ("firewall", X.firewall_lines, X.firewall_events(spark, SF)),
    ):
        paths[family] = [fresh_path(spark, family)]
        archive_lines(render(table), paths[family][0])
    return paths


def test_run_over_files(spark, sources):
    config = DetectorConfig(access_brute_force_min_rows=2)
    run = analyze(spark, sources, reference_year=X.YEAR, config=config)
    assert run.events.count() == 3000
    expected = detect(X.all_events(spark, SF), config).groupBy("kind").count().collect()
    rules = run.alerts.where("kind NOT LIKE 'ml_%'").groupBy("kind").count().collect()
    # whole seconds in the files move some session borders, not the kinds
    assert {r["kind"] for r in rules} == {r["kind"] for r in expected}
    assert run.ml_summary.first()["unique_ips"] == 16
    assert run.accuracy().count() == 16
    assert run.alert_listing().count() == run.alerts.count()
    assert run.ml_report().count() == 4
    assert run.family_totals().where("kind IS NULL").count() == 3
    actors = X.actors(spark, SF)
    assert run.ml_accuracy(actors).count() >= 1
    assert run.role_distribution(actors).count() == 4
    assert run.detection_summary().count() == len(rules) + (
        1 if run.alerts.where("kind = 'ml_anomaly'").count() else 0
    )


def test_only_enabled_families_run(spark, sources):
    run = analyze(spark, sources, enabled=["auth"], reference_year=X.YEAR)
    assert run.families == ["auth"]
    kinds = {r["kind"] for r in run.alerts.select("kind").distinct().collect()}
    assert all(k.startswith(("auth_", "ml_")) for k in kinds)


def test_no_lines_at_all(spark):
    run = analyze(spark, {"access": ["/no/such.log"]})
    assert run.alerts.count() == 0
    assert run.detection_summary().count() == 0
    assert run.ml_report() is None
