"""Login / sudo-failure chains: boundaries, modes, and all pairs by brute force."""

from __future__ import annotations

import random

import pytest
from helpers import events, seconds

from siftwall.operators.chain import KIND, privilege_escalation


def login(t, user="u", ip="9.9.9.9", **more):
    return {"t": t, "path": "ssh/accepted", "method": "SSH", "auth_user": user, "ip": ip, **more}


def failure(t, user="u", **more):
    return {
        "t": t,
        "path": "sudo/auth_failure",
        "method": "SUDO",
        "auth_user": user,
        "ip": "127.0.0.1",
        **more,
    }


def alerts(df, **options):
    rows = privilege_escalation(df, **options).collect()
    return sorted((r["ip"], seconds(r["timestamp"]), r["count"], r["confidence"]) for r in rows)


def test_both_ends_of_the_window_count(spark):
    base = [failure(100), failure(101), failure(102), failure(103)]
    df = events(spark, [login(100), *base, failure(700)])
    assert alerts(df) == [("9.9.9.9", 600 + 100, 5, 0.75)]
    df = events(spark, [login(100), *base, failure(700.000001)])
    assert alerts(df) == []
    df = events(spark, [login(100.000001), *base, failure(200)])
    assert alerts(df) == []


@pytest.mark.parametrize("start", [0, 100, 359, 360, 361, 599.5])
@pytest.mark.parametrize("first, found", [(240, True), (240.000001, False)])
def test_first_failure_limit(spark, start, first, found):
    late = [failure(start + first + i / 10) for i in range(5)]
    assert bool(alerts(events(spark, [login(start), *late]))) is found


def test_identical_logins_alert_once_each(spark):
    df = events(spark, [login(0), login(0), *[failure(i) for i in range(5)]])
    assert len(alerts(df)) == 2


def test_users_do_not_mix_and_null_users_are_skipped(spark):
    rows = [login(0), login(0, user=None), *[failure(i, user="v") for i in range(9)]]
    rows += [failure(i, user=None) for i in range(9)]
    assert alerts(events(spark, rows)) == []


def test_labeled_mode(spark):
    marked = {"classification": KIND, "count": 4}
    rows = [login(0, **marked), login(1), *[failure(i + 2, count=4) for i in range(3)]]
    rows += [failure(i + 2, count=5) for i in range(9)]
    df = events(spark, rows)
    assert alerts(df) == [("9.9.9.9", 4, 3, 0.9)]
    assert alerts(df, mode="heuristic") == [("9.9.9.9", 10, 12, 0.75)] * 2


def test_any_label_switches_the_mode(spark):
    rows = [login(0), *[failure(i) for i in range(9)]]
    assert len(alerts(events(spark, rows))) == 1
    stray = {"t": 0, "path": "/x", "classification": KIND}
    assert alerts(events(spark, [*rows, stray])) == []


def test_empty_and_unknown_mode(spark):
    assert alerts(events(spark, [])) == []
    with pytest.raises(ValueError):
        privilege_escalation(events(spark, []), mode="both")


@pytest.mark.parametrize("labeled", [False, True])
def test_against_all_pairs(spark, labeled):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        t = rng.choice([rng.randrange(4000), rng.random() * 4000])
        user = rng.choice(["hot", "hot", "a", "b"])
        more = {"count": rng.randrange(3)}
        if rng.random() < 0.4:
            more["classification"] = rng.choice([KIND, "normal"]) if labeled else "normal"
            rows.append(login(t, user, ip=f"1.1.1.{rng.randrange(4)}", **more))
        else:
            rows.append(failure(t, user, **more))
    expected = []
    for a in (r for r in rows if r["path"] == "ssh/accepted"):
        if labeled and a["classification"] != KIND:
            continue
        hits = [
            f["t"]
            for f in rows
            if f["path"] == "sudo/auth_failure"
            and f["auth_user"] == a["auth_user"]
            and (not labeled or f["count"] == a["count"])
            and 0 <= round((f["t"] - a["t"]) * 1e6) <= 600_000_000
        ]
        if len(hits) >= (3 if labeled else 5) and round((min(hits) - a["t"]) * 1e6) <= 240_000_000:
            expected.append((a["ip"], len(hits), 0.9 if labeled else 0.75))
    found = [(ip, n, c) for ip, _, n, c in alerts(events(spark, rows).repartition(5))]
    assert sorted(found) == sorted(expected)
    assert len(expected) > 20
