"""siftwall: security-log analytics on Spark DataFrames."""

from .config import AnomalyConfig, AttackTypeConfig, DetectorConfig, IpClassifierConfig
from .plans.analysis import Analysis, analyze, analyze_events
from .plans.detect import detect, detector, register_detector
from .session import build_session
from .sources.merge import archive_events, merge_events, read_archive, read_events
from .sources.parsers import parse_access, parse_auth, parse_firewall, rejects
from .sources.text import raw_line_view, read_lines

__all__ = [
    "Analysis",
    "AnomalyConfig",
    "AttackTypeConfig",
    "DetectorConfig",
    "IpClassifierConfig",
    "analyze",
    "analyze_events",
    "archive_events",
    "build_session",
    "detect",
    "detector",
    "merge_events",
    "parse_access",
    "parse_auth",
    "parse_firewall",
    "raw_line_view",
    "read_archive",
    "read_events",
    "read_lines",
    "register_detector",
    "rejects",
]
