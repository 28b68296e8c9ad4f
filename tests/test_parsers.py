"""Golden lines, one per rule of the line languages."""

from __future__ import annotations

from datetime import datetime

import pytest

from siftwall.sources import parsers

YEAR = 2026


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def access(spark, line):
    return [r.asDict() for r in parsers.parse_access(lines(spark, line)).collect()]


def auth(spark, line, **options):
    options.setdefault("reference_year", YEAR)
    return [r.asDict() for r in parsers.parse_auth(lines(spark, line), **options).collect()]


def firewall(spark, line):
    return [r.asDict() for r in parsers.parse_firewall(lines(spark, line)).collect()]


HEAD = '9.8.7.6 - - [23/Mar/2026:10:45:09 +0100] "POST /login HTTP/1.1" 401 659 "-" "curl/7"'


def test_access_full_line(spark):
    (row,) = access(spark, HEAD + " access_brute_force 4")
    assert row["ip"] == "9.8.7.6"
    assert row["timestamp"] == datetime(2026, 3, 23, 9, 45, 9)
    assert (row["method"], row["path"], row["status"]) == ("POST", "/login", 401)
    assert (row["bytes_sent"], row["referer"], row["agent"]) == (659, "-", "curl/7")
    assert (row["classification"], row["count"]) == ("access_brute_force", 4)
    assert row["log_source"] == "access"


@pytest.mark.parametrize(
    "tail, label",
    [
        (" some_class", ("some_class", 0)),
        ("", ("normal", 0)),
        (" 17", ("17", 0)),
        ("   normal   3  ", ("normal", 3)),
        (" trailing-dash 3", ("trailing", 0)),
    ],
)
def test_access_label(spark, tail, label):
    (row,) = access(spark, HEAD + tail)
    assert (row["classification"], row["count"]) == label


def test_access_match_may_start_inside_the_line(spark):
    (row,) = access(spark, "noise é " + HEAD)
    assert row["ip"] == "9.8.7.6"


@pytest.mark.parametrize(
    "line",
    [
        HEAD.replace("POST", "PUT"),
        HEAD.replace(" 659 ", " - "),
        HEAD.replace("/login", '/a"b'),
        HEAD.replace("23/Mar", "32/Mar"),
        HEAD.replace(" 659 ", " 99999999999999999999 "),
        "",
    ],
)
def test_access_rejected(spark, line):
    assert access(spark, line) == []


def test_rejects_say_why(spark):
    rows = lines(
        spark,
        HEAD,
        HEAD.replace("POST", "PUT"),
        HEAD.replace("23/Mar", "32/Mar"),
        HEAD.replace(" 659 ", " 99999999999999999999 "),
    )
    found = [r["reason"] for r in parsers.rejects(rows, "access").collect()]
    assert found == ["pattern", "time", "number"]
    unknown = lines(spark, "Mar 7 10:00:00 h cron[1]: x", "Mar 40 10:00:00 h sudo: x")
    assert {r["reason"] for r in parsers.rejects(unknown, "auth", YEAR).collect()} == {"pattern"}
    assert parsers.rejects(lines(spark, "x"), "firewall").count() == 1


def test_line_holding_the_internal_mark(spark):
    (row,) = access(spark, HEAD.replace("/login", "/a￿b") + " normal 5")
    assert (row["path"], row["count"]) == ("/a￿b", 5)


SSHD = "Mar  7 10:00:00 host sshd[12]: "
FROM = "bob from 5.6.7.8 port 2222 ssh2"


@pytest.mark.parametrize(
    "message, expected",
    [
        ("Failed password for invalid user " + FROM, ("ssh/failed_password", 401, "bob")),
        ("Failed password for " + FROM, ("ssh/failed_password", 401, "bob")),
        ("error: Invalid user " + FROM, ("ssh/invalid_user", 401, "bob")),
        ("Accepted publickey for " + FROM, ("ssh/accepted", 200, "bob")),
        ("Accepted keyboard-interactive for " + FROM, ("ssh/accepted", 200, "bob")),
    ],
)
def test_sshd(spark, message, expected):
    (row,) = auth(spark, SSHD + message)
    assert (row["path"], row["status"], row["auth_user"]) == expected
    assert (row["ip"], row["ssh_port"]) == ("5.6.7.8", 2222)
    assert (row["method"], row["agent"], row["service"]) == ("SSH", "sshd", "sshd")
    assert row["timestamp"] == datetime(2026, 3, 7, 10, 0, 0)


def test_sshd_rule_order_beats_position(spark):
    line = SSHD + "Invalid user a from 1.1.1.1 port 1 x Failed password for b from 2.2.2.2 port 2 x"
    (row,) = auth(spark, line)
    assert (row["path"], row["auth_user"]) == ("ssh/failed_password", "b")


def test_sshd_literal_user_invalid_is_dropped(spark):
    assert auth(spark, SSHD + "Failed password for invalid from 1.2.3.4 port 22 ssh2") == []


def test_label_split_is_greedy(spark):
    line = SSHD + "Invalid user bob from 5.6.7.8 port 22"
    assert auth(spark, line) == []
    (row,) = auth(spark, line, labeled=False)
    assert row["ssh_port"] == 22


def test_labels_on_auth_lines(spark):
    (row,) = auth(spark, SSHD + "Accepted password for " + FROM + " auth_privilege_escalation 9")
    assert (row["classification"], row["count"]) == ("auth_privilege_escalation", 9)


def test_sudo_command(spark):
    line = "Mar 7 10:00:00 h sudo:   bob : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls -l"
    (row,) = auth(spark, line)
    assert (row["path"], row["status"], row["ip"]) == ("sudo/command", 200, "127.0.0.1")
    assert (row["auth_user"], row["referer"]) == ("bob", "root")


FAILURE = "pam_unix(sudo:auth): authentication failure; logname=x uid=0 ruser="


@pytest.mark.parametrize(
    "body, user, ip",
    [
        (FAILURE + "bob rhost= user=root", "bob", "127.0.0.1"),
        (FAILURE + " rhost= user=root", None, "127.0.0.1"),
        (FAILURE + "bob from 4.4.4.4 port 22 x", "bob", "4.4.4.4"),
    ],
)
def test_sudo_failure(spark, body, user, ip):
    (row,) = auth(spark, "2026-03-07T10:00:00.5+02:00 h sudo: " + body)
    assert (row["path"], row["status"]) == ("sudo/auth_failure", 401)
    assert (row["auth_user"], row["ip"]) == (user, ip)
    assert row["timestamp"] == datetime(2026, 3, 7, 8, 0, 0, 500000)


@pytest.mark.parametrize(
    "line",
    [
        "Mar 7 10:00:00 h sudo[12]: " + FAILURE + "bob",
        "Mar 7 10:00:00 h cron[1]: job",
        "Mar 32 10:00:00 h sshd[1]: Accepted password for " + FROM,
        "no prefix sshd[1]: Accepted password for " + FROM,
        "   ",
    ],
)
def test_auth_dropped(spark, line):
    assert auth(spark, line) == []


WALL = (
    "2026-03-10T12:00:01Z host=fw-1 FIREWALL action=DENY src=1.2.3.4 sport=43210 "
    "dst=5.6.7.8 dport=443 proto=TCP packets=6 bytes=1234"
)


def test_firewall(spark):
    (row,) = firewall(spark, WALL + " firewall_port_scan 2")
    assert (row["status"], row["action"], row["protocol"]) == (403, "DENY", "tcp")
    assert row["path"] == "5.6.7.8:443/tcp"
    assert (row["src_port"], row["dst_port"], row["packets"]) == (43210, 443, 6)
    assert (row["classification"], row["count"]) == ("firewall_port_scan", 2)
    assert row["referer"] is None
    (row,) = firewall(spark, WALL.replace("DENY", "ALLOW"))
    assert row["status"] == 200


def test_firewall_label_needs_word_and_number(spark):
    (row,) = firewall(spark, WALL + " firewall_port_scan")
    assert (row["classification"], row["count"]) == ("normal", 0)


def test_firewall_lower_case_action_is_rejected(spark):
    assert firewall(spark, WALL.replace("DENY", "deny")) == []


def test_parse_plan_has_one_regex_pass_and_no_shuffle(spark):
    plan = parsers.parse_access(lines(spark, HEAD))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("regexp_replace") == 1
