"""Nothing is lost, invented or left out without a word."""

from __future__ import annotations

import pytest
from helpers import events

from siftwall.plans.analysis import analyze
from siftwall.plans.detect import detect
from siftwall.sources import merge, parsers, text


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def access(stamp: str) -> str:
    return f'1.2.3.4 - - [{stamp}] "GET /a HTTP/1.1" 200 5 "-" "x"'


@pytest.mark.parametrize(
    "stamp, hour",
    [
        ("1/Mar/2026:09:00:00 +0000", 9),
        ("01/Mar/2026:9:00:00 +0000", 9),
        ("01/Mar/2026:09:00:00 +00:00", 9),
        ("01/Mar/2026:09:00:00 Z", 9),
        ("01/Mar/2026:09:00:00 -02:00", 11),
    ],
)
def test_access_times(spark, stamp, hour):
    row = parsers.parse_access(lines(spark, access(stamp))).selectExpr("hour(timestamp) AS h").first()
    assert row.h == hour


@pytest.mark.parametrize("stamp", ["12:30:00", "T1", "2026", "2026-03-01", "now"])
def test_firewall_invents_no_time(spark, stamp):
    line = (
        f"{stamp} host=h FIREWALL action=DENY src=1.1.1.1 sport=1 dst=2.2.2.2 dport=2"
        " proto=TCP packets=1 bytes=1"
    )
    assert parsers.parse_firewall(lines(spark, line)).count() == 0
    assert [r.reason for r in parsers.rejects(lines(spark, line), "firewall").collect()] == ["time"]


def test_rejects_of_unlabelled_auth_lines(spark):
    line = lines(spark, "Mar  1 10:00:00 h sshd[1]: Failed password for bob from 1.1.1.1 port 22")
    assert parsers.parse_auth(line, reference_year=2026, labeled=False).count() == 1
    assert parsers.rejects(line, "auth", 2026, labeled=False).count() == 0
    assert parsers.rejects(line, "auth", 2026).count() == 1


def test_source_survives_its_archive(spark, tmp_path):
    source = tmp_path / "logs" / "a.log"
    source.parent.mkdir()
    source.write_text(access("01/Mar/2026:09:00:00 +0000") + "\n")
    for target in (source, source.parent, tmp_path / "logs" / ".." / "logs", source / "below"):
        with pytest.raises(ValueError):
            merge.archive_source(spark, {"access": [str(source)]}, "access", str(target), overwrite=True)
    assert source.read_text()
    copy = tmp_path / "copy"
    for _ in range(2):
        assert merge.archive_source(spark, {"access": [str(source)]}, "access", str(copy), overwrite=True)
    assert spark.read.text(str(copy)).count() == 1
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("copy")] == ["copy"]


def test_events_archive_replaces_safely(spark, tmp_path):
    path = str(tmp_path / "archive")
    merge.archive_events(events(spark, [{"t": 0}, {"t": 1}]), path)
    with pytest.raises(ValueError):
        merge.archive_events(merge.read_archive(spark, path), path, overwrite=True)
    assert merge.read_archive(spark, path).count() == 2
    merge.archive_events(events(spark, [{"t": 0}]), path, overwrite=True)
    assert merge.read_archive(spark, path).count() == 1


def test_unread_paths_are_named(spark, tmp_path):
    good = tmp_path / "good.log"
    good.write_text(access("01/Mar/2026:09:00:00 +0000") + "\nnonsense\n")
    sources = {"access": [str(good), "/no/such/path"]}
    with pytest.warns(UserWarning, match="/no/such/path"):
        assert merge.read_events(spark, sources).count() == 1
    found = analyze(spark, sources)
    assert [r.file for r in found.errors.collect()] == ["/no/such/path"]
    assert [(r.value, r.reason) for r in found.rejected.collect()] == [("nonsense", "pattern")]


def test_enabled_may_be_an_iterator(spark, tmp_path):
    a = tmp_path / "a.log"
    a.write_text("x\n")
    sources = {"access": [str(a)], "auth": [str(a)]}
    found, _ = text.read_lines(spark, sources, enabled=(f for f in ("auth", "access")))
    assert found.count() == 2


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError, match="acces"):
        merge.read_events(spark, {"access": []}, enabled=["acces"])
    with pytest.raises(ValueError, match="no_such_kind"):
        detect(events(spark, []), kinds=["no_such_kind"])
