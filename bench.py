"""Timings of the headline queries, as one JSON line.

Reads ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``. Every query runs once untimed, so
that class loading and code generation are not measured, and then once timed; the
result is computed in full but not collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "parse_access",
    "parse_auth",
    "parse_firewall",
    "request_features",
    "access_brute_force",
    "access_directory_scan",
    "access_request_flood",
    "access_data_exfiltration",
    "firewall_port_scan",
    "firewall_syn_flood",
    "auth_ssh_bruteforce",
    "auth_privilege_escalation",
    "all_alerts",
    "interarrival_gaps",
    "ip_behavior_features",
    "ip_modal_labels",
    "behavioral_risk",
    "mad_cutoff",
    "anomaly_scores",
    "true_attack_counts",
    "accuracy_report",
    "role_distribution",
)


def main() -> None:
    from siftwall.catalog import QUERIES
    from siftwall.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
