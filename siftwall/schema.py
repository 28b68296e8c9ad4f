"""Column layouts shared by every source, operator and report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FAMILIES = ("access", "auth", "firewall")

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status", T.LongType()),
        T.StructField("bytes_sent", T.LongType()),
        T.StructField("referer", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("classification", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("log_source", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("auth_user", T.StringType()),
        T.StructField("ssh_port", T.LongType()),
        T.StructField("firewall_host", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.LongType()),
        T.StructField("dst_port", T.LongType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("packets", T.LongType()),
        T.StructField("action", T.StringType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

# The attack kinds in report order.
ATTACK_KINDS = (
    "access_brute_force",
    "access_directory_scan",
    "access_request_flood",
    "access_sql_injection",
    "access_data_exfiltration",
    "access_command_injection",
    "auth_ssh_bruteforce",
    "auth_ssh_user_enum",
    "auth_sudo_bruteforce",
    "auth_privilege_escalation",
    "firewall_port_scan",
    "firewall_syn_flood",
    "firewall_ssh_bruteforce",
    "firewall_egress_exfiltration",
    "ml_anomaly",
    "ml_supervised",
)

ML_KINDS = ("ml_anomaly", "ml_supervised")

NORMAL = "normal"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: by name, cast, absent columns null."""
    present = set(df.columns)
    return df.selectExpr(
        *[
            f"cast({f'`{f.name}`' if f.name in present else 'null'} "
            f"as {f.dataType.simpleString()}) as `{f.name}`"
            for f in schema.fields
        ]
    )


def kinds_table(spark) -> DataFrame:
    """The fixed 16-row kind dimension: ``position, kind, family``.

    A literal of the plan, so joins with it broadcast it and folds see its values.
    """
    rows = ", ".join(
        f"(bigint({i}), '{k}', '{k.split('_', 1)[0]}')" for i, k in enumerate(ATTACK_KINDS)
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS kinds(position, kind, family)")


def chosen_families(enabled) -> set[str]:
    """The enabled families, all if None; an unknown name is an error."""
    if enabled is None:
        return set(FAMILIES)
    wanted = set(enabled)
    if wanted - set(FAMILIES):
        raise ValueError(f"unknown families {sorted(wanted - set(FAMILIES))}")
    return wanted
