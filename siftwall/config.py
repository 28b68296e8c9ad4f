"""Thresholds, windows and gaps as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectorConfig:
    """Detector settings; the defaults are fixed values of the rule set."""

    access_brute_force_min_rows: int = 10
    access_brute_force_gap_seconds: int = 60
    access_directory_scan_min_paths: int = 4
    access_directory_scan_gap_seconds: int = 10
    access_request_flood_min_rows: int = 100
    access_request_flood_gap_seconds: int = 5
    access_sql_injection_min_rows: int = 2
    access_sql_injection_gap_seconds: int = 60
    access_data_exfiltration_min_bytes: int = 2_000_000
    access_data_exfiltration_gap_seconds: int = 300
    access_command_injection_min_rows: int = 2
    access_command_injection_gap_seconds: int = 60

    auth_ssh_bruteforce_min_rows: int = 8
    auth_ssh_bruteforce_gap_seconds: int = 90
    auth_ssh_user_enum_min_rows: int = 12
    auth_ssh_user_enum_gap_seconds: int = 90
    auth_sudo_bruteforce_min_rows: int = 5
    auth_sudo_bruteforce_gap_seconds: int = 180

    priv_esc_labeled_min_failures: int = 3
    priv_esc_heuristic_min_failures: int = 5
    priv_esc_window_seconds: int = 600
    priv_esc_first_failure_seconds: int = 240

    firewall_port_scan_min_ports: int = 10
    firewall_port_scan_gap_seconds: int = 60
    firewall_ssh_bruteforce_min_rows: int = 25
    firewall_ssh_bruteforce_gap_seconds: int = 60
    firewall_syn_flood_min_packets: int = 2000
    firewall_syn_flood_gap_seconds: int = 2
    firewall_egress_exfiltration_min_bytes: int = 5_000_000
    firewall_egress_exfiltration_gap_seconds: int = 60


@dataclass(frozen=True)
class AnomalyConfig:
    """Settings of the isolation forest and of the rules around its scores."""

    trees: int = 200
    max_samples: int = 256
    seed: int = 42
    mad_multiplier: float = 2.5
    min_risk: float = 0.55
    severe_risk: float = 0.82
    min_ips_for_forest: int = 6
    low_n_requests_per_minute: float = 30.0
    low_n_error_rate: float = 0.45
    low_n_path_scan_ratio: float = 0.65


@dataclass(frozen=True)
class IpClassifierConfig:
    """Settings of the threat / normal classifier over per-IP features.

    At most ``max_training_rows`` rows are fitted, equally many of each class at most; of a
    larger class a repeatable sample is taken. Split, report and scores cover all rows.
    """

    trees: int = 200
    max_depth: int = 30
    train_fraction: float = 0.7
    seed: int = 42
    threshold: float = 0.5
    max_training_rows: int = 200_000
    max_bins: int = 32


@dataclass(frozen=True)
class AttackTypeConfig:
    """Settings of the multiclass attack-type classifier; bounds as in IpClassifierConfig."""

    trees: int = 10
    max_depth: int = 30
    train_fraction: float = 0.8
    seed: int = 42
    min_class_rows: int = 2
    max_training_rows: int = 200_000
    max_bins: int = 32
