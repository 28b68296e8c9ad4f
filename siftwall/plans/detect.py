"""Detectors, their selection, and the detection suite."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame

from ..config import DetectorConfig
from ..functions import predicates as P
from ..operators.burst import BurstRule, burst_alerts
from ..operators.chain import KIND as CHAIN_KIND
from ..operators.chain import privilege_escalation
from ..schema import ALERT_SCHEMA, FAMILIES, chosen_families, conform
from ..session import stage

Detector = Callable[[DataFrame], DataFrame]

_custom: dict[str, Detector] = {}


def burst_rules(config: DetectorConfig | None = None) -> dict[str, BurstRule]:
    """The burst detectors; a detector is a filter, a measure and a few numbers."""
    c = config or DetectorConfig()
    rules = [
        BurstRule(
            "access_brute_force",
            f"{P.ACCESS} AND {P.FAILED_LOGIN}",
            c.access_brute_force_min_rows,
            c.access_brute_force_gap_seconds,
            0.95,
        ),
        BurstRule(
            "access_directory_scan",
            f"{P.ACCESS} AND {P.NOT_FOUND}",
            c.access_directory_scan_min_paths,
            c.access_directory_scan_gap_seconds,
            0.85,
            "distinct",
            "path",
        ),
        BurstRule(
            "access_request_flood",
            P.ACCESS,
            c.access_request_flood_min_rows,
            c.access_request_flood_gap_seconds,
            0.90,
        ),
        BurstRule(
            "access_sql_injection",
            f"{P.ACCESS} AND {P.SQL_INJECTION}",
            c.access_sql_injection_min_rows,
            c.access_sql_injection_gap_seconds,
            0.9,
        ),
        BurstRule(
            "access_data_exfiltration",
            P.ACCESS,
            c.access_data_exfiltration_min_bytes,
            c.access_data_exfiltration_gap_seconds,
            0.85,
            "sum",
            "bytes_sent",
        ),
        BurstRule(
            "access_command_injection",
            f"{P.ACCESS} AND {P.COMMAND_INJECTION}",
            c.access_command_injection_min_rows,
            c.access_command_injection_gap_seconds,
            0.9,
        ),
        # the auth detectors go by event, whatever the name of the source
        BurstRule(
            "auth_ssh_bruteforce",
            P.SSH_FAILED_PASSWORD,
            c.auth_ssh_bruteforce_min_rows,
            c.auth_ssh_bruteforce_gap_seconds,
            0.92,
        ),
        BurstRule(
            "auth_ssh_user_enum",
            P.SSH_INVALID_USER,
            c.auth_ssh_user_enum_min_rows,
            c.auth_ssh_user_enum_gap_seconds,
            0.92,
        ),
        BurstRule(
            "auth_sudo_bruteforce",
            P.SUDO_FAILURE,
            c.auth_sudo_bruteforce_min_rows,
            c.auth_sudo_bruteforce_gap_seconds,
            0.92,
        ),
        BurstRule(
            "firewall_port_scan",
            f"{P.FIREWALL} AND {P.DENIED_TCP}",
            c.firewall_port_scan_min_ports,
            c.firewall_port_scan_gap_seconds,
            0.9,
            "distinct",
            "dst_port",
        ),
        BurstRule(
            "firewall_ssh_bruteforce",
            f"{P.FIREWALL} AND {P.DENIED_SSH}",
            c.firewall_ssh_bruteforce_min_rows,
            c.firewall_ssh_bruteforce_gap_seconds,
            0.8,
        ),
        BurstRule(
            "firewall_syn_flood",
            f"{P.FIREWALL} AND {P.DENIED_TCP}",
            c.firewall_syn_flood_min_packets,
            c.firewall_syn_flood_gap_seconds,
            0.85,
            "sum",
            "packets",
        ),
        BurstRule(
            "firewall_egress_exfiltration",
            f"{P.FIREWALL} AND {P.DENIED}",
            c.firewall_egress_exfiltration_min_bytes,
            c.firewall_egress_exfiltration_gap_seconds,
            0.88,
            "sum",
            "bytes_sent",
        ),
    ]
    return {rule.kind: rule for rule in rules}


def detector(kind: str, config: DetectorConfig | None = None) -> Detector:
    """One detector by kind, as a function from events to alerts."""
    rules = burst_rules(config)
    if kind in rules:
        return lambda events: burst_alerts(events, [rules[kind]])
    if kind == CHAIN_KIND:
        return lambda events: privilege_escalation(events, config)
    if kind in _custom:
        return _checked(kind, _custom[kind])
    raise KeyError(f"no detector of kind {kind!r}")


def register_detector(kind: str, detect: Detector) -> None:
    """Add a detector of one's own: a function from events to alerts."""
    if kind in _custom or kind in burst_rules() or kind == CHAIN_KIND:
        raise ValueError(f"detector {kind!r} exists already")
    _custom[kind] = detect


def unregister_detector(kind: str) -> None:
    _custom.pop(kind, None)


def _checked(kind: str, detect: Detector) -> Detector:
    def run(events: DataFrame) -> DataFrame:
        alerts = detect(events)
        missing = [f.name for f in ALERT_SCHEMA.fields if f.name not in alerts.columns]
        if missing:
            raise ValueError(f"detector {kind!r} lacks the columns {missing}")
        return conform(alerts, ALERT_SCHEMA)

    return run


def select_kinds(kinds: Iterable[str], families: Iterable[str]) -> list[str]:
    """Keep the kinds whose family is enabled (P10).

    Kinds with another prefix, such as ``ml_``, stay.
    """
    enabled = {f.strip().lower() for f in families if f}
    return [k for k in kinds if not _family(k) or _family(k) in enabled]


def _family(kind: str) -> str | None:
    prefix = kind.split("_", 1)[0] if "_" in kind else ""
    return prefix if prefix in FAMILIES else None


def detect(
    events: DataFrame,
    config: DetectorConfig | None = None,
    families: Iterable[str] = FAMILIES,
    kinds: Iterable[str] | None = None,
    extra: Mapping[str, Detector] | None = None,
    chain_mode: str = "auto",
    stage_events: bool = False,
) -> DataFrame:
    """Run the selected detectors over one event table and append their alerts.

    All burst detectors run together: one scan for the additive ones, one for those that
    count distinct values. An unknown kind or family is an error. ``extra`` holds further detectors, for
    example the model-based ones. With ``stage_events`` the events are written once
    to the shared folder; use it when they come straight from parsing text.
    """
    if stage_events:
        events = stage(events, "events")
    rules = burst_rules(config)
    further = {**_custom, **(extra or {})}
    known = [*rules, CHAIN_KIND, *further]
    offered = known if kinds is None else list(kinds)
    if set(offered) - set(known):
        raise ValueError(f"unknown kinds {sorted(set(offered) - set(known))}")
    families = [f.strip().lower() for f in families if f]
    chosen_families(families)
    chosen = select_kinds(offered, families)
    parts = []
    bursts = [rules[k] for k in chosen if k in rules]
    if bursts:
        parts.append(burst_alerts(events, bursts))
    if CHAIN_KIND in chosen:
        parts.append(privilege_escalation(events, config, chain_mode))
    parts += [_checked(k, further[k])(events) for k in chosen if k in further]
    if not parts:
        return events.sparkSession.createDataFrame([], ALERT_SCHEMA)
    return reduce(DataFrame.unionByName, parts)
