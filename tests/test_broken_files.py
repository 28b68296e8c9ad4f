"""Files that cannot be read, and replacements of archives that break off."""

from __future__ import annotations

import gzip
import os

import pytest
from helpers import events

from siftwall.plans.analysis import analyze, analyze_events
from siftwall.plans.detect import detect
from siftwall.sources import merge, text

LINE = '10.0.0.%d - - [01/Mar/2026:10:00:00 +0000] "GET /a%d HTTP/1.1" 200 10 "-" "x" normal 0\n'


@pytest.fixture
def folder(tmp_path):
    good = "".join(LINE % (i % 9, i) for i in range(2000)).encode()
    (tmp_path / "good.log").write_bytes(good)
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "whole.log.gz").write_bytes(gzip.compress(good))
    (tmp_path / "cut.log.gz").write_bytes(gzip.compress(os.urandom(300_000).hex().encode() + b"\n" + good)[:-4000])
    (tmp_path / "noise.log.gz").write_bytes(b"this is not a compressed file")
    return tmp_path


def paths(folder, *names):
    return [f"file://{folder}/{n}" for n in names]


ALL = ("good.log", "empty.log", "whole.log.gz", "cut.log.gz", "noise.log.gz", "absent.log")


def test_broken_files_next_to_good_ones(spark, folder):
    lines, errors = text.read_lines(spark, {"access": paths(folder, *ALL)}, probe=True)
    assert lines.count() == 4000
    found = {r["file"].rsplit("/", 1)[1]: r["message"] for r in errors.collect()}
    assert set(found) == {"cut.log.gz", "noise.log.gz", "absent.log"}
    assert "breaks off" in found["cut.log.gz"] and "PATH_NOT_FOUND" in found["absent.log"]


def test_a_folder_with_a_broken_file(spark, folder):
    lines, errors = text.read_lines(spark, {"access": [f"file://{folder}"]}, probe=True)
    assert lines.count() == 4000 and errors.count() == 2


def test_without_a_probe_nothing_is_lost_unseen(spark, folder):
    lines, errors = text.read_lines(spark, {"access": paths(folder, "good.log", "noise.log.gz")})
    assert errors.count() == 0
    with pytest.raises(Exception, match="noise"):
        lines.count()


def test_all_good_and_all_absent(spark, folder):
    lines, errors = text.read_lines(spark, {"access": paths(folder, "good.log", "whole.log.gz")}, probe=True)
    assert (lines.count(), errors.count()) == (4000, 0)
    lines, errors = text.read_lines(spark, {"access": paths(folder, "a", "b", "c")}, probe=True)
    assert (lines.count(), errors.count()) == (0, 3)


def test_a_run_reports_broken_files(spark, folder):
    run = analyze(spark, {"access": paths(folder, *ALL)})
    assert run.events.count() == 4000 and run.errors.count() == 3


def lines_of(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


class Stubborn:
    """A file system that refuses some of its renames."""

    def __init__(self, system, refused):
        self.system, self.refused, self.seen = system, refused, 0

    def __getattr__(self, name):
        return getattr(self.system, name)

    def rename(self, a, b):
        self.seen += 1
        return False if self.seen in self.refused else self.system.rename(a, b)


@pytest.mark.parametrize("refused", [{1}, {2}])
def test_archive_survives_a_failed_rename(spark, tmp_path, monkeypatch, refused):
    target = f"file://{tmp_path}/archive"
    merge.archive_lines(lines_of(spark, "old"), target)
    system, full = merge._full(spark, target)
    stubborn = Stubborn(system, refused)
    monkeypatch.setattr(merge, "_full", lambda s, p: (stubborn, full))
    with pytest.raises(OSError):
        merge._write(spark, target, True, lambda to: lines_of(spark, "new").write.text(to))
    assert [r["value"] for r in spark.read.text(target).collect()] == ["old"]
    merge._write(spark, target, True, lambda to: lines_of(spark, "new").write.text(to))
    assert [r["value"] for r in spark.read.text(target).collect()] == ["new"]
    assert not (tmp_path / "archive.replaced").exists()


@pytest.mark.parametrize("both", [False, True])
def test_archive_comes_back_after_a_cut_off_replacement(spark, tmp_path, both):
    target = f"file://{tmp_path}/archive"
    merge.archive_events(events(spark, [{"t": 0, "path": "/kept"}]), target)
    os.rename(tmp_path / "archive", tmp_path / "archive.replaced")
    if both:
        merge._write(spark, f"{target}2", False, lambda to: None)
        events(spark, [{"t": 0, "path": "/new"}]).write.parquet(target)
    expected = ["/new"] if both else ["/kept"]
    assert [r["path"] for r in merge.read_archive(spark, target).collect()] == expected
    assert not (tmp_path / "archive.replaced").exists()


def test_unknown_families_are_an_error(spark):
    df = events(spark, [{"t": 0}])
    with pytest.raises(ValueError, match="unknown families"):
        detect(df, families=["acces"])
    with pytest.raises(ValueError, match="unknown families"):
        analyze_events(df, families=["acces"])
