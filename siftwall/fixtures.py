"""Log tables derived from the ``events`` test table by plain arithmetic.

Every row of ``events`` gives one row, so the tables grow with it. The same rules are
written as SQL in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EVENT_SCHEMA, conform
from .session import use_utc

# 30 days of events are pressed into 43 minutes, from 2026-01-01 on.
FROM_MICROS = 1_704_067_200_000_000
TO_MICROS = 1_767_225_600_000_000
YEAR = 2026


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.selectExpr(
        "event_id AS k",
        "user_id",
        "event_type AS what",
        "value",
        f"timestamp_micros({TO_MICROS} + (unix_micros(cast(ts AS timestamp)) - {FROM_MICROS})"
        " div 1000) AS timestamp",
        "concat('10.0.', user_id % 4, '.', user_id % 5) AS address",
    )


def _case(*pairs, otherwise=None) -> Column:
    chain = F
    for condition, result in pairs:
        chain = chain.when(condition, result if isinstance(result, Column) else F.lit(result))
    return chain if otherwise is None else chain.otherwise(otherwise)


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir).selectExpr(
        "address AS ip",
        "timestamp",
        "if(what = 'signup', 'POST', 'GET') AS method",
        """CASE WHEN k % 11 = 0 THEN "/search?q=' OR 1=1 --"
             WHEN k % 13 = 0 THEN '/status?check=value&&x'
             WHEN what = 'signup' THEN '/login'
             WHEN what = 'error' THEN concat('/p', k % 40)
             ELSE '/products' END AS path""",
        """CASE WHEN what = 'signup' THEN 401 WHEN what = 'error' AND k % 3 = 0 THEN 500
             WHEN what = 'error' THEN 404 ELSE 200 END AS status""",
        "if(what = 'purchase', floor(value * 10000), k % 5000) AS bytes_sent",
        "'-' AS referer",
        "concat('agent-', k % 12) AS agent",
        """CASE WHEN k % 11 = 0 THEN 'access_sql_injection'
             WHEN k % 13 = 0 THEN 'access_command_injection'
             WHEN what = 'signup' THEN 'access_brute_force' ELSE 'normal' END
           AS classification""",
        "k % 37 AS count",
        "'access' AS log_source",
    )
    return conform(rows, EVENT_SCHEMA)


def auth_events(spark: SparkSession, sf_dir: str, labeled: bool = False) -> DataFrame:
    episode = "what IN ('signup', 'view') AND k % 10 = 0" if labeled else "false"
    rows = (
        _base(spark, sf_dir)
        .selectExpr(
            "*",
            """CASE what WHEN 'signup' THEN 'ssh/accepted' WHEN 'error' THEN 'ssh/failed_password'
                 WHEN 'click' THEN 'ssh/invalid_user' WHEN 'view' THEN 'sudo/auth_failure'
                 ELSE 'sudo/command' END AS path""",
        )
        .selectExpr("*", "startswith(path, 'ssh/') AS ssh")
        .selectExpr(
            "if(ssh, address, '127.0.0.1') AS ip",
            "timestamp",
            "if(ssh, 'SSH', 'SUDO') AS method",
            "path",
            "if(path IN ('ssh/accepted', 'sudo/command'), 200, 401) AS status",
            "0 AS bytes_sent",
            "if(path = 'sudo/command', 'root', '') AS referer",
            "if(ssh, 'sshd', 'sudo') AS agent",
            f"if({episode}, 'auth_privilege_escalation', 'normal') AS classification",
            "k % 3 AS count",
            "'auth' AS log_source",
            "if(ssh, 'sshd', 'sudo') AS service",
            "concat('u', user_id % 6) AS auth_user",
            "if(ssh, 1024 + k % 5000, null) AS ssh_port",
        )
    )
    return conform(rows, EVENT_SCHEMA)


def firewall_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        _base(spark, sf_dir)
        .selectExpr(
            "*",
            "if(k % 3 = 0, 22L, 1000 + k % 50) AS dst_port",
            "if(k % 5 = 0, 'udp', 'tcp') AS protocol",
            "what IN ('error', 'click', 'signup') AS deny",
        )
        .selectExpr(
            "address AS ip",
            "timestamp",
            "'FIREWALL' AS method",
            "concat('10.9.0.1:', dst_port, '/', protocol) AS path",
            "if(deny, 403, 200) AS status",
            "floor(value * 10000) AS bytes_sent",
            "'firewall' AS agent",
            "if(deny AND k % 3 = 0, 'firewall_ssh_bruteforce', 'normal') AS classification",
            "k % 37 AS count",
            "'firewall' AS log_source",
            "'fw-1' AS firewall_host",
            "'10.9.0.1' AS dst_ip",
            "1024 + k % 6000 AS src_port",
            "dst_port",
            "protocol",
            "1 + k % 200 AS packets",
            "if(deny, 'DENY', 'ALLOW') AS action",
        )
    )
    return conform(rows, EVENT_SCHEMA)


def visitor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access rows with one address per user; every third user shows attack labels."""
    rows = (
        _base(spark, sf_dir)
        .selectExpr("*", "user_id % 3 = 0 AS attacker")
        .selectExpr("*", "attacker AND what <> 'view' AS attack")
        .selectExpr(
            "concat('10.1.', user_id div 250, '.', user_id % 250) AS ip",
            "timestamp",
            "if(what = 'signup', 'POST', 'GET') AS method",
            "concat('/p', if(attacker, k % 40, k % 4)) AS path",
            "if(attack, 404, 200) AS status",
            "k % 5000 AS bytes_sent",
            "'-' AS referer",
            "concat('agent-', k % 12) AS agent",
            """CASE WHEN attack AND user_id % 2 = 0 THEN 'access_directory_scan'
                 WHEN attack THEN 'access_brute_force' ELSE 'normal' END AS classification""",
            "k % 37 AS count",
            "'access' AS log_source",
        )
    )
    return conform(rows, EVENT_SCHEMA)


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access rows with one address per user, each of one of three behaviours.

    A third scans for paths, a third tries to log in, a third visits.
    """
    rows = (
        _base(spark, sf_dir)
        .selectExpr("*", "user_id % 3 AS sort")
        .selectExpr(
            "concat('10.2.', user_id div 250, '.', user_id % 250) AS ip",
            "timestamp",
            "if(sort = 1, 'POST', 'GET') AS method",
            "CASE sort WHEN 0 THEN concat('/p', k % 40) WHEN 1 THEN '/login' ELSE '/products' END AS path",
            "CASE sort WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS status",
            "k % 100 + sort * 1000 AS bytes_sent",
            "'-' AS referer",
            "concat('agent-', if(sort = 0, 1, k % 12)) AS agent",
            """CASE sort WHEN 0 THEN 'access_directory_scan' WHEN 1 THEN 'access_brute_force'
                 ELSE 'normal' END AS classification""",
            "k % 37 AS count",
            "'access' AS log_source",
        )
    )
    return conform(rows, EVENT_SCHEMA)


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        access_events(spark, sf_dir)
        .unionByName(auth_events(spark, sf_dir))
        .unionByName(firewall_events(spark, sf_dir))
    )


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ip, profile`` of every address seen; a profile per address block."""
    profile = """CASE user_id % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'scanner'
        WHEN 2 THEN 'attacker' ELSE 'compromised' END AS profile"""
    return _base(spark, sf_dir).selectExpr("address AS ip", profile).distinct()


# -- the same rows as text lines --------------------------------------------------


def access_lines(events: DataFrame) -> DataFrame:
    return events.select(
        F.format_string(
            '%s - - [%s +0000] "%s %s HTTP/1.1" %d %d "%s" "%s" %s %d',
            "ip",
            F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss"),
            "method",
            "path",
            "status",
            "bytes_sent",
            "referer",
            "agent",
            "classification",
            "count",
        ).alias("value")
    )


def auth_lines(events: DataFrame) -> DataFrame:
    remote = F.format_string(
        "%s from %s port %s ssh2", "auth_user", "ip", F.col("ssh_port").cast("string")
    )
    path = F.col("path")
    message = _case(
        (path == "ssh/accepted", F.concat(F.lit("sshd[77]: Accepted password for "), remote)),
        (
            path == "ssh/failed_password",
            F.concat(F.lit("sshd[77]: Failed password for "), remote),
        ),
        (path == "ssh/invalid_user", F.concat(F.lit("sshd[77]: Invalid user "), remote)),
        (
            path == "sudo/command",
            F.concat(
                F.lit("sudo:   "),
                F.col("auth_user"),
                F.lit(" : TTY=pts/0 ; PWD=/ ; USER="),
                F.col("referer"),
                F.lit(" ; COMMAND=/bin/ls"),
            ),
        ),
        otherwise=F.concat(
            F.lit(
                "sudo: pam_unix(sudo:auth): authentication failure; logname=x uid=0 ruser="
            ),
            F.col("auth_user"),
            F.lit(" rhost= user=root"),
        ),
    )
    return events.select(
        F.concat(
            F.date_format("timestamp", "MMM d HH:mm:ss"),
            F.lit(" host-1 "),
            message,
            F.lit(" "),
            F.col("classification"),
            F.lit(" "),
            F.col("count"),
        ).alias("value")
    )


def firewall_lines(events: DataFrame) -> DataFrame:
    return events.select(
        F.format_string(
            "%sZ host=%s FIREWALL action=%s src=%s sport=%d dst=%s dport=%d proto=%s "
            "packets=%d bytes=%d %s %d",
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"),
            "firewall_host",
            "action",
            "ip",
            "src_port",
            "dst_ip",
            "dst_port",
            F.upper("protocol"),
            "packets",
            "bytes_sent",
            "classification",
            "count",
        ).alias("value")
    )
