"""Text lines to common-schema events.

Each parser takes a DataFrame with a ``value`` column, so the same code serves files
and tables. A parser is a narrow projection without a shuffle that runs one regular
expression per line (three for auth lines).
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import bind, capture, matched, strip
from ..schema import EVENT_SCHEMA, NORMAL, conform

# The line languages. (?U) gives \w, \d and \s their Unicode meaning,
# (?d) lets "." stop at \n only.
ACCESS_LINE = (
    r"(?Ud)(\d+\.\d+\.\d+\.\d+) - - \[(.*?)\] "
    r'"(GET|POST) ([^"]*) HTTP/1.1" '
    r'(\d+) (\d+) "(.*?)" "(.*?)"(?:\s+(\w+))?(?:\s+(\d+))?'
)
FIREWALL_LINE = (
    r"(?Ud)(\S+)\s+host=(\S+)\s+FIREWALL\s+action=(ALLOW|DENY)\s+src=([\d.]+)\s+"
    r"sport=(\d+)\s+dst=([\d.]+)\s+dport=(\d+)\s+proto=(\w+)\s+packets=(\d+)\s+"
    r"bytes=(\d+)(?:\s+(\w+)\s+(\d+))?"
)
LABEL_TRAILER = r"(?Ud)\s+(\w+)\s+(\d+)\s*$"
ISO_STAMP = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}(?::?\d{2})?)?"
SYSLOG_STAMP = r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
AUTH_LINE = rf"(?Ud)^({ISO_STAMP}|{SYSLOG_STAMP})\s+\S+\s+(?:(sshd)\[\d+\]|sudo):\s*(.+)$"
# The first rule that hits anywhere in the message wins.
SSHD_MESSAGE = (
    r"(?Ud)^(?:"
    r".*?Failed password for invalid user (\S+) from (\S+) port (\d+)"
    r"|.*?Failed password for (\S+) from (\S+) port (\d+)"
    r"|.*?Invalid user (\S+) from (\S+) port (\d+)"
    r"|.*?Accepted (?:password|publickey|keyboard-interactive) for (\S+) from (\S+) port (\d+)"
    r")"
)
SUDO_MESSAGE = (
    r"(?Us)^(?:"
    r"\s*(\S+)\s*:\s+.*?\bUSER=(\S+)\s*;\s*COMMAND=.*\S"
    r"|.*?pam_unix\(sudo:auth\): authentication failure"
    r")"
)
REMOTE_PORT = r"(?Ud)\bfrom\s+(\S+)\s+port\s+(\d+)\b"
REMOTE_USER = r"(?Ud)\bruser=(\S+)"
LOCAL_ADDRESS = "127.0.0.1"
ACCESS_STAMP_FORMAT = "d/MMM/yyyy:H:m:s Z"
SYSLOG_STAMP_FORMAT = "yyyy MMM d HH:mm:ss"


def _or_default(text: Column, default: str) -> Column:
    return F.when(text != "", text).otherwise(F.lit(default))


def _number(text: Column) -> Column:
    return text.try_cast("bigint")


def _label_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0).cast("bigint")).otherwise(_number(text))


def _part(name: str):
    return lambda i: F.get(F.col(name), F.lit(i))


def finalize(parsed: DataFrame) -> DataFrame:
    """Keep rows with a readable time and whole numbers; fix the schema."""
    for name in ("timestamp", "status", "bytes_sent", "count"):
        parsed = parsed.where(F.col(name).isNotNull())
    return conform(parsed, EVENT_SCHEMA)


# -- access ---------------------------------------------------------------------


def _split_access(lines: DataFrame) -> DataFrame:
    fields = bind(lines, "f", capture(F.col("value"), ACCESS_LINE, 10))
    # the zone may be written Z or with a colon
    text = _part("f")(2)
    size = F.length(text)
    colon = (F.substring(text, -3, 1) == ":") & F.substring(text, -6, 1).isin("+", "-")
    text = (
        F.when(F.endswith(text, F.lit("Z")), F.concat(F.left(text, size - 1), F.lit("+0000")))
        .when(colon, F.concat(F.left(text, size - 3), F.right(text, F.lit(2))))
        .otherwise(text)
    )
    stamp = F.try_to_timestamp(text, F.lit(ACCESS_STAMP_FORMAT))
    return bind(fields, "timestamp", stamp)


def parse_access(lines: DataFrame, source: str = "access") -> DataFrame:
    """Web access lines; method GET or POST, two optional label words at the end."""
    f = _part("f")
    return finalize(
        _split_access(lines.select("value"))
        .where(matched(F.col("f")))
        .select(
            f(1).alias("ip"),
            "timestamp",
            f(3).alias("method"),
            f(4).alias("path"),
            _number(f(5)).alias("status"),
            _number(f(6)).alias("bytes_sent"),
            f(7).alias("referer"),
            f(8).alias("agent"),
            _or_default(f(9), NORMAL).alias("classification"),
            _label_count(f(10)).alias("count"),
            F.lit(source).alias("log_source"),
        )
    )


# -- firewall -------------------------------------------------------------------


def _split_firewall(lines: DataFrame) -> DataFrame:
    fields = bind(lines, "f", capture(F.col("value"), FIREWALL_LINE, 12))
    # a cast alone would read a bare time of day as today
    stamp = _part("f")(1)
    whole = F.rlike(stamp, F.lit(f"^{ISO_STAMP}$"))
    return bind(fields, "timestamp", F.when(whole, stamp.try_cast("timestamp")))


def parse_firewall(lines: DataFrame, source: str = "firewall") -> DataFrame:
    """Firewall lines; the label counts only with both its word and its number."""
    f = _part("f")
    protocol = F.lower(f(8))
    parsed = (
        _split_firewall(lines.select("value"))
        .where(matched(F.col("f")))
        .select(
            f(4).alias("ip"),
            "timestamp",
            F.lit("FIREWALL").alias("method"),
            F.concat(f(6), F.lit(":"), f(7), F.lit("/"), protocol).alias("path"),
            F.when(f(3) == "ALLOW", F.lit(200)).otherwise(F.lit(403)).alias("status"),
            _number(f(10)).alias("bytes_sent"),
            F.lit("firewall").alias("agent"),
            _or_default(f(11), NORMAL).alias("classification"),
            _label_count(f(12)).alias("count"),
            F.lit(source).alias("log_source"),
            f(2).alias("firewall_host"),
            f(6).alias("dst_ip"),
            _number(f(5)).alias("src_port"),
            _number(f(7)).alias("dst_port"),
            protocol.alias("protocol"),
            _number(f(9)).alias("packets"),
            F.upper(f(3)).alias("action"),
        )
    )
    for name in ("src_port", "dst_port", "packets"):
        parsed = parsed.where(F.col(name).isNotNull())
    return finalize(parsed)


# -- auth -----------------------------------------------------------------------


def label_trailer(lines: DataFrame) -> DataFrame:
    """Split ``<word> <number>`` off the line end (S8): ``line, classification, count``.

    The split is greedy on real logs: a message ending in ``port 22`` loses these
    words too. ``parse_auth(labeled=False)`` leaves the line whole.
    """
    cut = _part("cut")
    has_label = matched(F.col("cut"))
    split = bind(lines, "cut", capture(strip(F.col("value")), LABEL_TRAILER, 2))
    # without a label, the whole text is what comes before it
    return split.where((cut(0) != "") | has_label).select(
        *lines.columns,
        cut(0).alias("line"),
        F.when(has_label, cut(1)).otherwise(F.lit(NORMAL)).alias("classification"),
        F.when(has_label, _number(cut(2)))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("count"),
    )


def _unlabeled(lines: DataFrame) -> DataFrame:
    return lines.select(
        *lines.columns,
        strip(F.col("value")).alias("line"),
        F.lit(NORMAL).alias("classification"),
        F.lit(0).cast("bigint").alias("count"),
    ).where(F.col("line") != "")


def syslog_timestamp(stamp: Column, reference_year: int | None = None) -> Column:
    """ISO-8601 or ``Mon d HH:MM:SS``, the latter in ``reference_year``."""
    year = reference_year or datetime.now(timezone.utc).year
    text = strip(stamp)
    one_blank = F.regexp_replace(text, r"(?U)\s+", " ")
    is_iso = F.contains(text, F.lit("T")) & F.rlike(text, F.lit(r"^\d"))
    in_year = F.concat(F.lit(f"{year} "), one_blank)
    return F.when(is_iso, text.try_cast("timestamp")).otherwise(
        F.try_to_timestamp(in_year, F.lit(SYSLOG_STAMP_FORMAT))
    )


def _split_auth(cut: DataFrame, reference_year: int | None) -> DataFrame:
    """Add ``timestamp, daemon, body`` to trimmed lines, null where unknown."""
    f = _part("f")
    known = matched(F.col("f"))
    split = bind(cut, "f", capture(F.col("line"), AUTH_LINE, 3))
    stamp = F.when(known, syslog_timestamp(f(1), reference_year))
    return bind(split, "timestamp", stamp).select(
        *cut.columns,
        "timestamp",
        F.when(known, _or_default(f(2), "sudo")).alias("daemon"),
        F.when(known, f(3)).alias("body"),
    )


def _capture_sshd() -> Column:
    return capture(F.col("body"), SSHD_MESSAGE, 12)


def _capture_sudo() -> Column:
    return capture(F.col("body"), SUDO_MESSAGE, 2)


def _sshd_columns() -> dict[str, Column]:
    """Event columns out of ``_capture_sshd`` bound as ``m``.

    The groups come in threes (user, address, port), one triple per rule; only the
    triple of the rule that hit is not empty.
    """
    m = _part("m")
    ok = F.lit(200).cast("bigint")
    failed = F.lit(401).cast("bigint")
    return {
        "ip": F.concat(m(2), m(5), m(8), m(11)),
        "method": F.lit("SSH"),
        "path": F.when(m(10) != "", F.lit("ssh/accepted"))
        .when(m(7) != "", F.lit("ssh/invalid_user"))
        .otherwise(F.lit("ssh/failed_password")),
        "status": F.when(m(10) != "", ok).otherwise(failed),
        "referer": F.lit(""),
        "agent": F.lit("sshd"),
        "auth_user": F.concat(m(1), m(4), m(7), m(10)),
        "ssh_port": _number(F.concat(m(3), m(6), m(9), m(12))),
    }


def _sshd_is_event() -> Column:
    # a failed login of a user literally called "invalid" is dropped
    return matched(F.col("m")) & (_part("m")(4) != "invalid")


def _sudo_columns() -> dict[str, Column]:
    """Event columns out of ``_capture_sudo`` bound as ``m``."""
    m = _part("m")
    command = m(1) != ""
    remote = F.get(capture(F.col("body"), REMOTE_PORT, 2), F.lit(1))
    user = F.get(capture(F.col("body"), REMOTE_USER, 1), F.lit(1))
    return {
        "ip": F.when(command, F.lit(LOCAL_ADDRESS)).otherwise(
            F.coalesce(remote, F.lit(LOCAL_ADDRESS))
        ),
        "method": F.lit("SUDO"),
        "path": F.when(command, F.lit("sudo/command")).otherwise(F.lit("sudo/auth_failure")),
        "status": F.when(command, F.lit(200)).otherwise(F.lit(401)).cast("bigint"),
        "referer": m(2),
        "agent": F.lit("sudo"),
        "auth_user": F.when(command, m(1)).otherwise(user),
        "ssh_port": F.lit(None).cast("bigint"),
    }


def sshd_events(messages: DataFrame) -> DataFrame:
    """Event columns for sshd message bodies; other bodies are dropped."""
    return (
        bind(messages, "m", _capture_sshd())
        .where(_sshd_is_event())
        .select(*messages.columns, *[c.alias(n) for n, c in _sshd_columns().items()])
    )


def sudo_events(messages: DataFrame) -> DataFrame:
    """Event columns for sudo message bodies; other bodies are dropped."""
    return (
        bind(messages, "m", _capture_sudo())
        .where(matched(F.col("m")))
        .select(*messages.columns, *[c.alias(n) for n, c in _sudo_columns().items()])
    )


def _split_message(messages: DataFrame) -> DataFrame:
    by_daemon = F.when(F.col("daemon") == "sshd", _capture_sshd()).when(
        F.col("daemon") == "sudo", _capture_sudo()
    )
    return bind(messages, "m", by_daemon)


def _is_auth_event() -> Column:
    return F.when(F.col("daemon") == "sshd", _sshd_is_event()).otherwise(matched(F.col("m")))


def parse_auth(
    lines: DataFrame,
    source: str = "auth",
    reference_year: int | None = None,
    labeled: bool = True,
) -> DataFrame:
    """Auth lines, in one pass: each body goes to the rules of its daemon."""
    values = lines.select("value")
    cut = (label_trailer(values) if labeled else _unlabeled(values)).drop("value")
    messages = _split_auth(cut, reference_year)
    sshd, sudo = _sshd_columns(), _sudo_columns()
    is_sshd = F.col("daemon") == "sshd"
    return finalize(
        _split_message(messages)
        .where(_is_auth_event())
        .select(
            "timestamp",
            "classification",
            "count",
            *[F.when(is_sshd, sshd[n]).otherwise(sudo[n]).alias(n) for n in sshd],
            F.lit(0).alias("bytes_sent"),
            F.lit(source).alias("log_source"),
            F.col("daemon").alias("service"),
        )
    )


# -- all families ---------------------------------------------------------------

PARSERS = {"access": parse_access, "auth": parse_auth, "firewall": parse_firewall}


def rejects(
    lines: DataFrame, family: str, reference_year: int | None = None, labeled: bool = True
) -> DataFrame:
    """Lines that give no event, with the reason (S9): ``log_source, value, reason``.

    ``labeled`` is for auth lines and must be as it was for ``parse_auth``.

    ``pattern`` - the line is not of the family's language (for auth also: another
    daemon or message); ``time`` - unreadable time; ``number`` - a number too large.
    """
    f = _part("f")
    values = lines.select("value")
    if family == "access":
        checked = _split_access(values)
        known = matched(F.col("f"))
        numbers = [_number(f(5)), _number(f(6)), _label_count(f(10))]
    elif family == "firewall":
        checked = _split_firewall(values)
        known = matched(F.col("f"))
        numbers = [*[_number(f(i)) for i in (5, 7, 9, 10)], _label_count(f(12))]
    elif family == "auth":
        cut = label_trailer(values) if labeled else _unlabeled(values)
        checked = _split_message(_split_auth(cut, reference_year))
        known = _is_auth_event()
        numbers = [F.col("count")]
    else:
        raise ValueError(f"unknown family {family!r}")
    reason = F.when(~known, F.lit("pattern")).when(
        F.col("timestamp").isNull(), F.lit("time")
    )
    for number in numbers:
        reason = reason.when(number.isNull(), F.lit("number"))
    return bind(checked, "reason", reason).where(F.col("reason").isNotNull()).select(
        F.lit(family).alias("log_source"), "value", "reason"
    )
