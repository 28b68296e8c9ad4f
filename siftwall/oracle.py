"""The catalog's queries as plain SQL over the same tables.

Written the straightforward way (windows over whole groups, joins of pairs), on
purpose unlike the engine's plans.
"""

from __future__ import annotations

from .operators.features import BASE_FEATURES, BEHAVIOR_FEATURES
from .schema import ATTACK_KINDS

BASE = """base AS (
  SELECT event_id AS k, user_id, event_type AS what, value,
         1767225600000000 + ((epoch_us(ts) - 1704067200000000) // 1000) AS ts_us,
         '10.0.' || (user_id % 4) || '.' || (user_id % 5) AS addr
  FROM events)"""

ACCESS = """access_events AS (
  SELECT k, addr AS ip, ts_us,
    CASE WHEN what = 'signup' THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN k % 11 = 0 THEN '/search?q='' OR 1=1 --'
         WHEN k % 13 = 0 THEN '/status?check=value&&x'
         WHEN what = 'signup' THEN '/login'
         WHEN what = 'error' THEN '/p' || (k % 40)
         ELSE '/products' END AS path,
    CAST(CASE WHEN what = 'signup' THEN 401
         WHEN what = 'error' AND k % 3 = 0 THEN 500
         WHEN what = 'error' THEN 404 ELSE 200 END AS BIGINT) AS status,
    CAST(CASE WHEN what = 'purchase' THEN floor(value * 10000) ELSE k % 5000 END AS BIGINT)
      AS bytes_sent,
    '-' AS referer, 'agent-' || (k % 12) AS agent,
    CASE WHEN k % 11 = 0 THEN 'access_sql_injection'
         WHEN k % 13 = 0 THEN 'access_command_injection'
         WHEN what = 'signup' THEN 'access_brute_force'
         ELSE 'normal' END AS classification,
    k % 37 AS "count", 'access' AS log_source
  FROM base)"""


def _auth(labeled: bool) -> str:
    episode = "what IN ('signup','view') AND k % 10 = 0" if labeled else "false"
    return f"""auth_events AS (
  SELECT k, CASE WHEN path LIKE 'ssh/%' THEN addr ELSE '127.0.0.1' END AS ip, ts_us,
    CASE WHEN path LIKE 'ssh/%' THEN 'SSH' ELSE 'SUDO' END AS method, path,
    CAST(CASE WHEN path IN ('ssh/accepted','sudo/command') THEN 200 ELSE 401 END AS BIGINT)
      AS status,
    CAST(0 AS BIGINT) AS bytes_sent,
    CASE WHEN path = 'sudo/command' THEN 'root' ELSE '' END AS referer,
    CASE WHEN path LIKE 'ssh/%' THEN 'sshd' ELSE 'sudo' END AS agent,
    CASE WHEN {episode} THEN 'auth_privilege_escalation' ELSE 'normal' END AS classification,
    k % 3 AS "count", 'auth' AS log_source,
    CASE WHEN path LIKE 'ssh/%' THEN 'sshd' ELSE 'sudo' END AS service,
    'u' || (user_id % 6) AS auth_user,
    CASE WHEN path LIKE 'ssh/%' THEN 1024 + k % 5000 END AS ssh_port
  FROM (SELECT *, CASE what WHEN 'signup' THEN 'ssh/accepted'
                            WHEN 'error' THEN 'ssh/failed_password'
                            WHEN 'click' THEN 'ssh/invalid_user'
                            WHEN 'view' THEN 'sudo/auth_failure'
                            ELSE 'sudo/command' END AS path FROM base))"""


AUTH, AUTH_LABELED = _auth(False), _auth(True)

FIREWALL = """firewall_events AS (
  SELECT k, addr AS ip, ts_us, 'FIREWALL' AS method,
    '10.9.0.1:' || dst_port || '/' || protocol AS path,
    CAST(CASE WHEN deny THEN 403 ELSE 200 END AS BIGINT) AS status,
    CAST(floor(value * 10000) AS BIGINT) AS bytes_sent, 'firewall' AS agent,
    CASE WHEN deny AND k % 3 = 0 THEN 'firewall_ssh_bruteforce' ELSE 'normal' END
      AS classification,
    k % 37 AS "count", 'firewall' AS log_source, 'fw-1' AS firewall_host,
    '10.9.0.1' AS dst_ip, 1024 + k % 6000 AS src_port, dst_port, protocol,
    1 + k % 200 AS packets, CASE WHEN deny THEN 'DENY' ELSE 'ALLOW' END AS action
  FROM (SELECT *, CASE WHEN k % 3 = 0 THEN CAST(22 AS BIGINT) ELSE 1000 + k % 50 END AS dst_port,
               CASE WHEN k % 5 = 0 THEN 'udp' ELSE 'tcp' END AS protocol,
               what IN ('error','click','signup') AS deny FROM base))"""

VISITORS = """visitor_events AS (
  SELECT '10.1.' || (user_id // 250) || '.' || (user_id % 250) AS ip, ts_us,
    CASE WHEN what = 'signup' THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN user_id % 3 = 0 THEN '/p' || (k % 40) ELSE '/p' || (k % 4) END AS path,
    CAST(CASE WHEN user_id % 3 = 0 AND what <> 'view' THEN 404 ELSE 200 END AS BIGINT) AS status,
    k % 5000 AS bytes_sent, 'agent-' || (k % 12) AS agent,
    CASE WHEN user_id % 3 = 0 AND user_id % 2 = 0 AND what <> 'view'
           THEN 'access_directory_scan'
         WHEN user_id % 3 = 0 AND what <> 'view' THEN 'access_brute_force'
         ELSE 'normal' END AS classification,
    'access' AS log_source
  FROM base)"""

ACTORS = """actors AS (
  SELECT DISTINCT addr AS ip,
    CASE user_id % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'scanner' WHEN 2 THEN 'attacker'
      ELSE 'compromised' END AS profile
  FROM base)"""

SHARED = "ip, ts_us, method, path, status, bytes_sent, agent, classification, \"count\", log_source"


FAMILY_EVENTS = ",\n".join(
    [
        ACCESS,
        AUTH,
        FIREWALL,
        f"""all_events AS (
  SELECT {SHARED} FROM access_events UNION ALL SELECT {SHARED} FROM auth_events
  UNION ALL SELECT {SHARED} FROM firewall_events)""",
    ]
)


def _all() -> str:
    return BASE + ",\n" + FAMILY_EVENTS


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# -- text ------------------------------------------------------------------------------

_TIME = "make_timestamp(ts_us)"
_SECOND = "ts_us // 1000000 * 1000000"
ACCESS_LINE = (
    f"""ip || ' - - [' || strftime({_TIME}, '%d/%b/%Y:%H:%M:%S') || ' +0000] "' || method || ' '
    || path || ' HTTP/1.1" ' || status || ' ' || bytes_sent || ' "' || referer || '" "' || agent
    || '" ' || classification || ' ' || "count" """
)
FIREWALL_LINE = (
    f"""strftime({_TIME}, '%Y-%m-%dT%H:%M:%S') || 'Z host=' || firewall_host
    || ' FIREWALL action=' || action || ' src=' || ip || ' sport=' || src_port || ' dst='
    || dst_ip || ' dport=' || dst_port || ' proto=' || upper(protocol) || ' packets=' || packets
    || ' bytes=' || bytes_sent || ' ' || classification || ' ' || "count" """
)
EVENT_COLUMNS = (
    "ip, method, path, status, bytes_sent, referer, agent, classification, \"count\", log_source"
)

SQL: dict[str, str] = {}

SQL["src_text_lines"] = (
    _with(BASE, ACCESS) + f"SELECT log_source, {ACCESS_LINE} AS value FROM access_events"
)
SQL["raw_line_view"] = _with(BASE, FIREWALL) + (
    f"SELECT log_source, {FIREWALL_LINE} AS value FROM firewall_events UNION ALL "
    "SELECT 'auth', '[error] Could not read file:///nonexistent/siftwall/auth.log: "
    "PATH_NOT_FOUND'"
)
SQL["parse_access"] = (
    _with(BASE, ACCESS) + f"SELECT {EVENT_COLUMNS}, {_SECOND} AS ts_us FROM access_events"
)
SQL["parse_auth"] = _with(BASE, AUTH_LABELED) + (
    f"SELECT {EVENT_COLUMNS}, {_SECOND} AS ts_us, service, auth_user, ssh_port FROM auth_events"
)
SQL["parse_firewall"] = _with(BASE, FIREWALL) + (
    f"SELECT {EVENT_COLUMNS.replace('referer, ', '')}, {_SECOND} AS ts_us, firewall_host, dst_ip, "
    "src_port, dst_port, protocol, packets, action FROM firewall_events"
)
SQL["syslog_timestamps"] = _with(BASE) + (
    f"SELECT k, CASE k % 3 WHEN 0 THEN {_SECOND} WHEN 1 THEN ts_us "
    f"ELSE {_SECOND} - 7200000000 END AS ts_us FROM base"
)
SQL["sshd_events"] = _with(BASE) + """
SELECT k, '10.8.0.' || (k % 250) AS ip, 'SSH' AS method,
  CASE k % 6 WHEN 3 THEN 'ssh/accepted' WHEN 2 THEN 'ssh/invalid_user'
    ELSE 'ssh/failed_password' END AS path,
  CAST(CASE k % 6 WHEN 3 THEN 200 ELSE 401 END AS BIGINT) AS status,
  'u' || (k % 7) AS auth_user, 1024 + k % 5000 AS ssh_port
FROM base WHERE k % 6 < 4"""
SQL["sudo_events"] = _with(BASE) + """
SELECT k, CASE k % 4 WHEN 1 THEN '10.8.0.' || (k % 250) ELSE '127.0.0.1' END AS ip,
  'SUDO' AS method,
  CASE k % 4 WHEN 0 THEN 'sudo/command' ELSE 'sudo/auth_failure' END AS path,
  CAST(CASE k % 4 WHEN 0 THEN 200 ELSE 401 END AS BIGINT) AS status,
  CASE k % 4 WHEN 0 THEN 'r' || (k % 3) ELSE '' END AS referer,
  CASE WHEN k % 4 < 2 THEN 'u' || (k % 7) END AS auth_user
FROM base WHERE k % 4 < 3"""
SQL["label_trailer"] = _with(BASE) + """
SELECT CASE k % 3 WHEN 0 THEN 'message ' || k || ' port ssh2'
    WHEN 1 THEN 'message ' || k || ' without a label'
    ELSE 'message-' || k || ' ending in' END AS line,
  CASE k % 3 WHEN 0 THEN 'class_' || (k % 5) WHEN 1 THEN 'normal' ELSE 'port' END
    AS classification,
  CASE k % 3 WHEN 0 THEN k % 37 WHEN 1 THEN 0 ELSE k % 100 END AS "count"
FROM base"""
SQL["parse_rejects"] = _with(BASE, ACCESS) + f"""
SELECT 'access' AS log_source,
  CASE "count" % 7
    WHEN 0 THEN replace(replace(line, '"GET ', '"PUT '), '"POST ', '"PUT ')
    WHEN 1 THEN replace(line, '[01/', '[32/')
    ELSE line || '00000000000000000000' END AS value,
  CASE "count" % 7 WHEN 0 THEN 'pattern' WHEN 1 THEN 'time' ELSE 'number' END AS reason
FROM (SELECT *, {ACCESS_LINE} AS line FROM access_events) WHERE "count" % 7 < 3"""
SQL["finalize_events"] = _with(BASE, ACCESS) + (
    'SELECT ip, ts_us, path, "count" FROM access_events WHERE "count" % 9 <> 0'
)
SQL["source_selection"] = _with(_all()) + (
    "SELECT log_source, count(*) AS n, CAST(sum(bytes_sent) AS BIGINT) AS total_bytes "
    "FROM all_events WHERE log_source <> 'auth' GROUP BY log_source"
)
SQL["archive_events"] = _with(_all()) + (
    f"SELECT log_source, strftime({_TIME}, '%Y-%m-%d') AS event_date, count(*) AS n, "
    "CAST(sum(bytes_sent) AS BIGINT) AS total_bytes FROM all_events GROUP BY 1, 2"
)

SQL["archive_source"] = _with(BASE, ACCESS) + (
    f"SELECT log_source, {ACCESS_LINE} AS value FROM access_events WHERE bytes_sent < 2500"
)

# -- projections and filters -------------------------------------------------------------

SQL["utc_normalize"] = "SELECT event_id, epoch_us(ts) AS ts_us FROM events"
SQL["request_features"] = _with(BASE, ACCESS) + """
SELECT status, bytes_sent, round(ln(1 + bytes_sent), 6) AS bytes_log,
  CAST(length(path) AS INTEGER) AS path_length,
  CAST(method = 'POST' AS INTEGER) AS is_post,
  CAST(status >= 400 AS INTEGER) AS is_error, CAST(status >= 500 AS INTEGER) AS is_5xx,
  CAST(regexp_matches(path, '(?i)''|union|select|drop|insert|update') AS INTEGER)
    AS has_sql_keywords,
  CAST(regexp_matches(path, '(?i)/admin|wp-admin|\\.env|\\.git|phpmyadmin') AS INTEGER)
    AS has_admin_path
FROM access_events"""

_SQLI = " OR ".join(
    f"contains(lower(path), '{t}')"
    for t in (
        " or 1=1",
        ' or "1"="1',
        "''--",
        " union select ",
        " drop table ",
        "../",
        "%2e%2e%2f",
        ";--",
    )
)
_CMDI = " OR ".join(
    f"contains(lower(path), '{t}')"
    for t in (
        ";",
        "&&",
        "||",
        "|",
        "$(",
        "`",
        "%60",
        "echo+test",
        "probe_test",
        "exec_test",
        "test_exec",
        "cmd",
        "<cmd>",
        "<test>",
    )
)
_LOGIN = "path = '/login' AND status = 401 AND method = 'POST'"
_DENIED_TCP = "action = 'DENY' AND protocol = 'tcp'"


def _rows(where: str) -> str:
    return _with(BASE, ACCESS) + f"SELECT ip, ts_us, path FROM access_events WHERE {where}"


SQL["sqli_requests"] = _rows(_SQLI)
SQL["cmdi_requests"] = _rows(_CMDI)
SQL["failed_logins"] = _rows(_LOGIN)
SQL["denied_connections"] = _with(BASE, FIREWALL) + """
SELECT ip, ts_us, path, CASE WHEN "count" % 4 <> 0 THEN action END AS action
FROM firewall_events
WHERE status = 403 AND protocol = 'tcp' AND dst_port = 22"""
SQL["auth_failures"] = _with(BASE, AUTH) + (
    "SELECT ip, ts_us, path, auth_user FROM auth_events WHERE path IN "
    "('ssh/failed_password', 'ssh/invalid_user', 'sudo/auth_failure')"
)

# -- bursts --------------------------------------------------------------------------------

# kind: table, filter, measure, threshold, gap in seconds, confidence
BURSTS = {
    "access_brute_force": ("access", _LOGIN, "count(*)", 10, 60, 0.95),
    "access_directory_scan": ("access", "status = 404", "count(DISTINCT path)", 4, 10, 0.85),
    "access_request_flood": ("access", "true", "count(*)", 10, 5, 0.90),
    "access_sql_injection": ("access", _SQLI, "count(*)", 2, 60, 0.9),
    "access_data_exfiltration": ("access", "true", "sum(bytes_sent)", 2000000, 300, 0.85),
    "access_command_injection": ("access", _CMDI, "count(*)", 2, 60, 0.9),
    "auth_ssh_bruteforce": ("auth", "path = 'ssh/failed_password'", "count(*)", 8, 90, 0.92),
    "auth_ssh_user_enum": ("auth", "path = 'ssh/invalid_user'", "count(*)", 12, 90, 0.92),
    "auth_sudo_bruteforce": ("auth", "path = 'sudo/auth_failure'", "count(*)", 5, 180, 0.92),
    "firewall_port_scan": ("firewall", _DENIED_TCP, "count(DISTINCT dst_port)", 10, 60, 0.9),
    "firewall_ssh_bruteforce": (
        "firewall",
        _DENIED_TCP + " AND dst_port = 22",
        "count(*)",
        25,
        60,
        0.8,
    ),
    "firewall_syn_flood": ("firewall", _DENIED_TCP, "sum(packets)", 500, 2, 0.85),
    "firewall_egress_exfiltration": (
        "firewall",
        "action = 'DENY'",
        "sum(bytes_sent)",
        5000000,
        60,
        0.88,
    ),
}
TABLES = {"access": ACCESS, "auth": AUTH, "firewall": FIREWALL}


def _sessions(table: str, where: str, gap: int) -> str:
    return f"""(SELECT *, sum(brk) OVER (PARTITION BY ip ORDER BY ts_us
        ROWS UNBOUNDED PRECEDING) AS sid
    FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY ip ORDER BY ts_us)
                 <= {gap * 1_000_000} THEN 0 ELSE 1 END AS brk
          FROM {table}_events WHERE {where}))"""


def _burst(kind: str) -> str:
    table, where, measure, threshold, gap, confidence = BURSTS[kind]
    return f"""SELECT ip, max(ts_us) AS ts_us, '{kind}' AS kind,
    CAST({measure} AS BIGINT) AS "count", CAST({confidence} AS DOUBLE) AS confidence
  FROM {_sessions(table, where, gap)}
  GROUP BY ip, sid HAVING {measure} >= {threshold}"""


for _kind, _spec in BURSTS.items():
    SQL[_kind] = _with(BASE, TABLES[_spec[0]]) + _burst(_kind)

SQL["burst_sessions"] = _with(BASE, ACCESS) + f"""
SELECT 'failed_login' AS kind, ip, min(ts_us) AS start_us, max(ts_us) AS end_us,
  count(*) AS amount
FROM {_sessions("access", _LOGIN, 60)} GROUP BY ip, sid"""


def _chain(labeled: bool) -> str:
    only = "a.classification = 'auth_privilege_escalation' AND" if labeled else ""
    same = "AND f.\"count\" = a.\"count\"" if labeled else ""
    wanted, confidence = (3, 0.9) if labeled else (5, 0.75)
    return f"""SELECT any_value(a.ip) AS ip, max(f.ts_us) AS ts_us,
    'auth_privilege_escalation' AS kind, count(*) AS "count",
    CAST({confidence} AS DOUBLE) AS confidence
  FROM auth_events a JOIN auth_events f ON {only} a.path = 'ssh/accepted'
    AND f.path = 'sudo/auth_failure' AND f.auth_user = a.auth_user {same}
    AND f.ts_us BETWEEN a.ts_us AND a.ts_us + 600000000
  GROUP BY a.k
  HAVING count(*) >= {wanted} AND min(f.ts_us) <= any_value(a.ts_us) + 240000000"""


SQL["auth_privilege_escalation"] = _with(BASE, AUTH) + _chain(False)
SQL["auth_priv_esc_labeled"] = _with(BASE, AUTH_LABELED) + _chain(True)
SQL["auth_priv_esc_heuristic"] = _with(BASE, AUTH_LABELED) + _chain(False)

ALERTS = (
    "alerts AS ("
    + " UNION ALL ".join([*[f"({_burst(k)})" for k in BURSTS], f"({_chain(False)})"])
    + ")"
)
SUITE = _all() + ",\n" + ALERTS
SQL["all_alerts"] = _with(SUITE) + "SELECT * FROM alerts"
SQL["detector_selection"] = _with(SUITE) + (
    "SELECT kind, count(*) AS detected FROM alerts WHERE kind LIKE 'auth_%' GROUP BY kind"
)
SQL["custom_detector"] = _with(BASE, ACCESS) + """
SELECT ip, max(ts_us) AS ts_us, 'access_server_errors' AS kind, count(*) AS "count",
  CAST(0.5 AS DOUBLE) AS confidence
FROM access_events WHERE status >= 500 GROUP BY ip HAVING count(*) >= 5"""

# -- features -----------------------------------------------------------------------------------


def _features(table: str) -> str:
    return f"""features AS (
  SELECT *, least(1.0, greatest(0.0, unique_paths / greatest(total_requests, 1)))
      AS path_scan_ratio,
    total_requests / ((span + 1e-3) / 60.0) AS requests_per_minute,
    1.0 / (1.0 + CASE WHEN avg_interval = 0 THEN 1e6 ELSE avg_interval END) AS burstiness
  FROM (SELECT *, CASE WHEN total_requests >= 2 THEN span / (total_requests - 1) ELSE 0.0 END
          AS avg_interval
    FROM (SELECT ip, count(*) AS total_requests, count(DISTINCT path) AS unique_paths,
        count(*) FILTER (status >= 400) / count(*) AS error_rate,
        count(*) FILTER (status BETWEEN 200 AND 299) / count(*) AS fraction_2xx,
        count(*) FILTER (status BETWEEN 400 AND 499) / count(*) AS fraction_4xx,
        count(*) FILTER (status >= 500) / count(*) AS fraction_5xx,
        CAST(sum(bytes_sent) AS BIGINT) AS total_bytes,
        CAST(sum(bytes_sent) AS BIGINT) / count(*) AS avg_bytes,
        count(DISTINCT agent) AS unique_user_agents,
        count(*) FILTER (upper(method) = 'POST') / count(*) AS post_fraction,
        (max(ts_us) - min(ts_us)) / 1e6 AS span
      FROM {table} GROUP BY ip)))"""


_INTEGERS = ("total_requests", "unique_paths", "total_bytes", "unique_user_agents")


def _feature_list(names) -> str:
    return ", ".join(n if n in _INTEGERS else f"round({n}, 6) AS {n}" for n in names)


SQL["ip_features"] = _with(BASE, ACCESS, _features("access_events")) + (
    f"SELECT ip, {_feature_list(BASE_FEATURES)} FROM features"
)
SQL["ip_behavior_features"] = _with(BASE, ACCESS, _features("access_events")) + (
    f"SELECT ip, {_feature_list(BASE_FEATURES + BEHAVIOR_FEATURES)} FROM features"
)
SQL["features_head"] = _with(BASE, VISITORS, _features("visitor_events")) + (
    f"SELECT ip, {_feature_list(BASE_FEATURES)} FROM features ORDER BY ip LIMIT 5"
)
SQL["align_features"] = _with(BASE, ACCESS, _features("access_events")) + (
    "SELECT ip, round(error_rate, 6) AS error_rate, CAST(0 AS DOUBLE) AS not_a_feature, "
    "CAST(total_requests AS DOUBLE) AS total_requests FROM features"
)


def _modal(table: str) -> str:
    return f"""labels AS (
  SELECT t.ip, CASE WHEN any_value(m.classification) <> 'normal' THEN any_value(m.classification)
      WHEN count(*) FILTER (t.status >= 400) / count(*) > 0.5 THEN 'access_brute_force'
      ELSE 'normal' END AS label
  FROM {table} t JOIN (
    SELECT ip, classification FROM (
      SELECT ip, classification,
        row_number() OVER (PARTITION BY ip ORDER BY count(*) DESC, classification) AS r
      FROM {table} GROUP BY ip, classification) WHERE r = 1) m ON m.ip = t.ip
  GROUP BY t.ip)"""


SQL["ip_modal_labels"] = _with(_all(), _modal("all_events")) + "SELECT ip, label FROM labels"
SQL["labeled_features"] = _with(BASE, VISITORS, _modal("visitor_events")) + """
SELECT v.ip, count(*) AS total_requests,
  coalesce(any_value(CASE WHEN l.label <> 'access_brute_force' THEN l.label END), 'normal') AS label
FROM visitor_events v LEFT JOIN labels l ON l.ip = v.ip GROUP BY v.ip"""
SQL["ip_threat_labels"] = _with(BASE, VISITORS) + (
    "SELECT ip, max(CAST(classification <> 'normal' AS INTEGER)) AS label "
    "FROM visitor_events GROUP BY ip"
)
SQL["class_distribution"] = _with(BASE, VISITORS, _modal("visitor_events")) + (
    "SELECT label, count(*) AS n FROM labels GROUP BY label"
)
SQL["training_stats"] = _with(
    BASE,
    VISITORS,
    FIREWALL,
    """t AS (SELECT ip, classification, log_source FROM visitor_events
      UNION ALL SELECT ip, classification, log_source FROM firewall_events)""",
    "p AS (SELECT ip, count(*) AS n, bool_or(classification <> 'normal') AS bad FROM t GROUP BY ip)",
) + """
SELECT count(*) FILTER (bad) AS positives, count(*) FILTER (NOT bad) AS negatives,
  CAST(sum(n) AS BIGINT) AS training_rows, count(*) AS unique_ips,
  (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT log_source AS s FROM t)) AS sources
FROM p"""
SQL["source_row_counts"] = _with(_all()) + (
    "SELECT log_source, count(*) AS n FROM all_events GROUP BY log_source"
)
SQL["interarrival_gaps"] = _with(BASE, ACCESS) + (
    "SELECT ip, ts_us, ts_us - lag(ts_us) OVER (PARTITION BY ip ORDER BY ts_us) AS gap_us "
    "FROM access_events"
)


def _mad(table: str, column: str, multiplier: float) -> str:
    return f"""mad AS (
  SELECT med AS median, mad, sigma,
    CASE WHEN sigma < 1e-12 THEN med ELSE med - {multiplier} * sigma END AS cutoff
  FROM (SELECT med, mad, CASE WHEN mad > 1e-12 THEN 1.4826 * mad ELSE dev END AS sigma
    FROM (SELECT any_value(m.med) AS med, median(abs({column} - m.med)) AS mad,
            stddev_pop({column}) AS dev
      FROM {table}, (SELECT median({column}) AS med FROM {table}) m)))"""


SQL["mad_cutoff"] = _with(
    BASE, VISITORS, _features("visitor_events"), _mad("features", "requests_per_minute", 2.5)
) + (
    "SELECT round(median, 6) AS median, round(mad, 6) AS mad, round(sigma, 6) AS sigma, "
    "round(cutoff, 6) AS cutoff FROM mad"
)

_RISK = (
    "path_scan_ratio",
    "error_rate",
    "fraction_4xx",
    "requests_per_minute",
    "burstiness",
    "post_fraction",
)
RANKS = (
    "ranked AS ("
    + " UNION ALL ".join(
        f"""SELECT ip, '{m}' AS metric,
    CASE WHEN (SELECT count(DISTINCT {m}) FROM features) <= 1 THEN 0.5
      ELSE (rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0)
        / count(*) OVER () END AS pct FROM features"""
        for m in _RISK
    )
    + "),\nrisks AS (SELECT ip, avg(pct) AS risk FROM ranked GROUP BY ip)"
)
_RANKED = _with(BASE, VISITORS, _features("visitor_events"), RANKS)
SQL["percent_ranks"] = _RANKED + "SELECT ip, metric, round(pct, 6) AS pct FROM ranked"
SQL["behavioral_risk"] = _RANKED + "SELECT ip, round(risk, 6) AS risk FROM risks"

SQL["events_timeline"] = _with(_all()) + (
    "SELECT ip, ts_us, log_source, path FROM all_events ORDER BY ts_us"
)
SQL["merged_events"] = _with(BASE, ACCESS, FIREWALL) + """
SELECT ip, ts_us, log_source, referer, CAST(NULL AS BIGINT) AS dst_port,
  CAST(NULL AS BIGINT) AS packets, CAST(NULL AS VARCHAR) AS action FROM access_events
UNION ALL
SELECT ip, ts_us, log_source, NULL, dst_port, packets, action FROM firewall_events"""
SQL["scalar_functions"] = _with(BASE, ACCESS) + """
SELECT ip, ts_us, upper(path) AS upper_path, CAST(length(path) AS INTEGER) AS path_length,
  contains(path, '=') AS has_equals, regexp_extract(agent, 'agent-(\\d+)', 1) AS agent_number,
  array_to_string(list_transform(string_split(classification, '_'),
    lambda w: upper(w[1]) || w[2:]), ' ') AS title,
  printf('%.2f', bytes_sent / 7.0) AS two_decimals,
  round(ln(1 + bytes_sent), 6) AS bytes_log, greatest(0, least(100, bytes_sent)) AS clipped,
  status BETWEEN 400 AND 499 AS is_4xx, 'none' AS service, ts_us + 90000000 AS later_us
FROM access_events"""
_TREES, _SAMPLE, _SEED, _LEVELS = 200, 256, 42, 8
MODEL = BASE_FEATURES + BEHAVIOR_FEATURES


def _bits(text: str, at: int) -> str:
    return f"('0x' || substr(md5({text}), {at}, 8))::BIGINT"


def _path_rest(size: str) -> str:
    return f"""CASE WHEN {size} <= 1 THEN 0.0 WHEN {size} = 2 THEN 1.0
    ELSE 2.0 * (ln({size} - 1.0) + 0.5772156649015329) - 2.0 * ({size} - 1.0) / {size} END"""


def _forest() -> str:
    """Trees grown level by level over samples, and scores of all IPs, as ``nodes`` and ``scored``."""
    count = len(MODEL)
    parts = [
        f"""points AS MATERIALIZED (SELECT ip, [{", ".join(f"{f}::DOUBLE" for f in MODEL)}] AS v FROM features)""",
        f"""setting AS MATERIALIZED (SELECT psi, greatest(1, ceil(log2(psi))) AS depth
  FROM (SELECT least({_SAMPLE}, greatest(2, count(*))) AS psi FROM points))""",
        f"""seeds AS MATERIALIZED (SELECT t, 1 + {_bits(f"'{_SEED}:' || t", 1)} % 2147483646 AS factor
  FROM (SELECT unnest(range({_TREES})) AS t))""",
        f"""level_0 AS MATERIALIZED (SELECT t, ip, v, 1 AS node FROM (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY draw, ip) AS place FROM (
    SELECT t, ip, v, ({_bits("ip", 1)} % 2147483647 * factor + {_bits("ip", 9)}) % 2147483647 AS draw
    FROM points, seeds)) WHERE place <= (SELECT psi FROM setting))""",
    ]
    lows = ", ".join(f"min(v[{i + 1}])" for i in range(count))
    highs = ", ".join(f"max(v[{i + 1}])" for i in range(count))
    for level in range(_LEVELS + 1):
        key = f"'{_SEED}:' || t || ':' || node"
        parts.append(
            f"""nodes_{level} AS MATERIALIZED (
  SELECT t, node, n, f - 1 AS feature,
    CASE WHEN f = 0 THEN 0.0 ELSE lo[f] + {_bits(key, 9)} / 4294967296.0 * (hi[f] - lo[f]) END AS cut
  FROM (SELECT *, CASE WHEN {level} < (SELECT depth FROM setting) AND n > 1 AND len(usable) > 0
      THEN usable[1 + floor({_bits(key, 1)} / 4294967296.0 * len(usable))::BIGINT] ELSE 0 END AS f
    FROM (SELECT *, list_filter(range(1, {count + 1}), lambda i: hi[i] > lo[i]) AS usable
      FROM (SELECT t, node, count(*) AS n, [{lows}] AS lo, [{highs}] AS hi
        FROM level_{level} GROUP BY t, node))))"""
        )
        if level < _LEVELS:
            parts.append(
                f"""level_{level + 1} AS MATERIALIZED (
  SELECT t, ip, v, 2 * node + (v[feature + 1] > cut)::INTEGER AS node
  FROM level_{level} JOIN nodes_{level} USING (t, node) WHERE feature >= 0)"""
            )
    every = " UNION ALL ".join(f"SELECT * FROM nodes_{k}" for k in range(_LEVELS + 1))
    parts.append(f"nodes AS MATERIALIZED ({every})")
    parts.append(
        f"""walk_0 AS (SELECT ip, v, t, 1 AS node FROM points, (SELECT unnest(range({_TREES})) AS t))"""
    )
    for level in range(_LEVELS):
        parts.append(
            f"""walk_{level + 1} AS (
  SELECT ip, v, t, CASE WHEN feature < 0 THEN node ELSE 2 * node + (v[feature + 1] > cut)::INTEGER END AS node
  FROM walk_{level} JOIN nodes USING (t, node))"""
        )
    parts.append(
        f"""scored AS (SELECT ip, -pow(2.0, -avg(floor(log2(node)) + {_path_rest("n")})
      / (SELECT {_path_rest("psi")} FROM setting)) AS score
  FROM walk_{_LEVELS} JOIN nodes USING (t, node) GROUP BY ip)"""
    )
    return ",\n".join(parts)


_FOREST = _with(BASE, VISITORS, _features("visitor_events"), _forest())
SQL["isolation_trees"] = _FOREST + (
    "SELECT t::INTEGER AS tree, node::INTEGER AS node, feature::INTEGER AS feature, "
    "round(cut, 6) AS cut, n::INTEGER AS size FROM nodes"
)
SQL["anomaly_scores"] = _FOREST + "SELECT ip, round(score, 6) AS score FROM scored"
SQL["ml_anomaly_alerts"] = (
    _with(
        BASE,
        VISITORS,
        _features("visitor_events"),
        _forest(),
        RANKS,
        _mad("scored", "score", 2.5),
    )
    + """
SELECT ip, CAST(NULL AS BIGINT) AS ts_us, 'ml_anomaly' AS kind, CAST(1 AS BIGINT) AS "count",
  round(least(1.0, greatest(0.0, CASE WHEN score < cutoff
    THEN 0.35 + 0.4 * least(1.0, (cutoff - score) / (abs(cutoff) + 1e-6)) + 0.25 * risk
    ELSE 0.45 + 0.5 * risk END)), 6) AS confidence
FROM scored JOIN risks USING (ip), mad
WHERE (score < cutoff AND risk >= 0.55) OR risk >= 0.82"""
)
SQL["rare_class_filter"] = _with(BASE, ACCESS) + """
SELECT path || '/' || bytes_sent AS label, count(*) AS n FROM access_events
GROUP BY 1 HAVING count(*) >= 3"""

# -- model-based detection ------------------------------------------------------------------

FOUR = """four_events AS (
  SELECT ip[:6] AS ip, ts_us, method, path, status, bytes_sent, agent FROM access_events)"""
_LOW_N = _with(BASE, ACCESS, FOUR, _features("four_events"), RANKS)
_LOW_N_RULE = (
    "risk >= 0.82 OR requests_per_minute >= 30 OR error_rate >= 0.45 OR path_scan_ratio >= 0.65"
)
SQL["low_n_anomalies"] = _LOW_N + f"""
SELECT ip, CAST(NULL AS BIGINT) AS ts_us, 'ml_anomaly' AS kind, CAST(1 AS BIGINT) AS "count",
  round(least(1.0, greatest(0.0, 0.45 + 0.5 * risk)), 6) AS confidence
FROM features JOIN risks USING (ip) WHERE {_LOW_N_RULE}"""
SQL["ml_run_summary"] = _LOW_N + f"""
SELECT count(*) AS unique_ips, false AS use_forest, CAST(2.5 AS DOUBLE) AS mad_multiplier,
  count(*) FILTER ({_LOW_N_RULE}) AS flagged_ips
FROM features JOIN risks USING (ip)"""
SQL["ml_summary_report"] = _LOW_N + f""", s AS (
SELECT count(*) AS n, count(*) FILTER ({_LOW_N_RULE}) AS f FROM features JOIN risks USING (ip))
SELECT CAST(0 AS INTEGER) AS line,
  '-------------- Machine Learning Behaviour Anomaly Detector --------------' AS message
UNION ALL SELECT 1, 'Unique IPs in this log: ' || n FROM s
UNION ALL SELECT 2, ' Only ' || n || ' IPs here — not enough for the full model. '
  || 'Only IPs with very extreme attack-like behaviour were considered.' FROM s
UNION ALL SELECT 3, 'Flagged as possible hostile IPs: ' || f || ' (out of ' || n
  || ' unique addresses)' FROM s""".replace("\n, s AS", ", s AS")

_JUDGED = _with(
    BASE,
    VISITORS,
    _features("visitor_events"),
    RANKS,
    "scored AS (SELECT *, -requests_per_minute AS score FROM features JOIN risks USING (ip))",
    _mad("scored", "score", 0.5),
    """judged AS (
  SELECT ip, score < cutoff AS outlier,
    (score < cutoff AND risk >= 0.5) OR risk >= 0.7 AS hostile,
    least(1.0, greatest(0.0, CASE WHEN score < cutoff
      THEN 0.35 + 0.4 * least(1.0, (cutoff - score) / (abs(cutoff) + 1e-6)) + 0.25 * risk
      ELSE 0.45 + 0.5 * risk END)) AS confidence
  FROM scored, mad)""",
)
SQL["ml_alert_rules"] = _JUDGED + (
    "SELECT ip, outlier, round(confidence, 6) AS confidence FROM judged WHERE hostile"
)
SQL["stratified_split"] = _with(BASE, VISITORS) + """
SELECT label, least(n - 1, greatest(1, CAST(floor(n * 0.7 + 0.5) AS BIGINT))) AS train,
  n - least(n - 1, greatest(1, CAST(floor(n * 0.7 + 0.5) AS BIGINT))) AS test
FROM (SELECT label, count(*) AS n FROM (
  SELECT ip, max(CAST(classification <> 'normal' AS INTEGER)) AS label
  FROM visitor_events GROUP BY ip) GROUP BY label)"""
SQL["classifier_report"] = _with(
    BASE,
    VISITORS,
    """p AS (SELECT ip, max(CAST(classification <> 'normal' AS INTEGER)) AS label,
      CAST(count(DISTINCT agent) > 11 AS INTEGER) AS prediction
      FROM visitor_events GROUP BY ip)""",
    """c AS (SELECT x.label, count(*) FILTER (p.label = x.label AND p.prediction = x.label) AS hit,
      count(*) FILTER (p.prediction = x.label) AS claimed,
      count(*) FILTER (p.label = x.label) AS actual
      FROM p, (SELECT label FROM p UNION SELECT prediction FROM p) x GROUP BY x.label)""",
) + """
SELECT label, round(coalesce(hit / nullif(claimed, 0), 0.0), 6) AS precision,
  round(coalesce(hit / nullif(actual, 0), 0.0), 6) AS recall,
  round(coalesce(2 * hit / nullif(claimed + actual, 0), 0.0), 6) AS f1, actual AS support
FROM c"""
# labels follow from the features without exception, so a fitted model has to be right
_THREATS = """threats AS (SELECT ip, bool_or(classification <> 'normal') AS bad, count(*) AS n
  FROM visitor_events GROUP BY ip)"""
SQL["train_ip_classifier"] = _with(BASE, VISITORS, _THREATS) + """
SELECT bad::INTEGER AS label, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1,
  count(*) - least(count(*) - 1, greatest(1, CAST(floor(count(*) * 0.7 + 0.5) AS BIGINT))) AS support
FROM threats GROUP BY bad"""
SQL["model_bundle"] = _with(BASE, VISITORS, _THREATS) + f"""
SELECT ip, true AS same_probability, bad AS threat, '{",".join(BASE_FEATURES)}' AS columns,
  'access' AS sources, (SELECT count(*) FROM visitor_events) AS training_rows,
  (SELECT count(*) FROM threats) AS training_unique_ips
FROM threats"""
_SUPERVISED = """
SELECT ip, CAST(NULL AS BIGINT) AS ts_us, 'ml_supervised' AS kind, CAST(1 AS BIGINT) AS "count",
  {} AS confidence FROM threats WHERE bad"""
SQL["ml_supervised_alerts"] = _with(BASE, VISITORS, _THREATS) + _SUPERVISED.format("true")
SQL["ml_hard_prediction_alerts"] = _with(BASE, VISITORS, _THREATS) + _SUPERVISED.format(
    "0.8::DOUBLE"
)
SQL["attack_type_classifier"] = _with(BASE) + """
SELECT label, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1,
  n - least(n - 1, greatest(1, CAST(floor(n * 0.8 + 0.5) AS BIGINT))) AS support
FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'access_directory_scan' WHEN 1 THEN 'access_brute_force'
    ELSE 'normal' END AS label, count(DISTINCT user_id) AS n FROM base GROUP BY label)"""

# -- reports -------------------------------------------------------------------------------------

KINDS = (
    "kinds AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{k}')" for i, k in enumerate(ATTACK_KINDS))
    + ") AS v(position, kind))"
)
TRUE = """true_counts AS (
  SELECT kind, split_part(kind, '_', 1) AS family,
    (SELECT count(DISTINCT e."count") FROM all_events e WHERE e.classification = kind)
      AS true_count
  FROM kinds)"""
DETECTED = """detected AS (
  SELECT k.kind, count(a.kind) AS detected FROM kinds k LEFT JOIN alerts a ON a.kind = k.kind
  GROUP BY k.kind)"""
_TITLE = (
    "array_to_string(list_transform(string_split(kind, '_'), "
    "lambda w: upper(w[1]) || w[2:]), ' ')"
)
SQL["true_attack_counts"] = _with(_all(), KINDS, TRUE) + (
    "SELECT kind, true_count FROM true_counts"
)
SQL["detected_counts"] = _with(SUITE, KINDS, DETECTED) + "SELECT kind, detected FROM detected"
SQL["true_count_report"] = _with(_all(), KINDS, TRUE) + (
    f"SELECT kind, true_count, {_TITLE} || ' attempts generated: ' || true_count AS message "
    "FROM true_counts"
)
SQL["alert_listing"] = _with(SUITE) + """
SELECT kind, kind_total, ip, ts_us, "count", upper(kind) || ' (' || kind_total || ' total):' AS heading,
  'ThreatAlert(' || kind || ', ip=' || ip || ', time='
    || strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S')
    || CASE WHEN ts_us % 1000000 <> 0 THEN strftime(make_timestamp(ts_us), '.%f') ELSE '' END
    || '+00:00, count=' || "count" || ')' AS message
FROM (SELECT *, count(*) OVER (PARTITION BY kind) AS kind_total FROM alerts)
WHERE kind LIKE 'auth_%' OR kind LIKE 'firewall_%'"""
SQL["detection_summary"] = _with(SUITE) + f"""
SELECT kind, detected, {_TITLE} || ' attempts detected: ' || detected AS message
FROM (SELECT kind, count(*) AS detected FROM alerts
  WHERE kind LIKE 'access_%' OR kind LIKE 'auth_%' GROUP BY kind)"""
SQL["accuracy_report"] = _with(SUITE, KINDS, TRUE, DETECTED) + f"""
SELECT kind, detected, true_count, round(accuracy, 6) AS accuracy, verdict,
  {_TITLE} || ' accuracy: ' || CASE verdict
    WHEN 'over' THEN printf('%.2f', accuracy) || '%. Over-detected ' || detected
      || ' attempts, but only ' || true_count || ' were generated.'
    WHEN 'under' THEN printf('%.2f', accuracy) || '%. Under-detected ' || detected
      || ' attempts out of ' || true_count || ' generated attacks.'
    ELSE '100%. Detected all ' || true_count || ' generated attempts.' END AS message
FROM (SELECT kind, detected, true_count,
    CASE WHEN detected > true_count THEN true_count / detected * 100
      WHEN detected < true_count THEN detected / true_count * 100 ELSE 100.0 END AS accuracy,
    CASE WHEN detected > true_count THEN 'over' WHEN detected < true_count THEN 'under'
      ELSE 'equal' END AS verdict
  FROM detected JOIN true_counts USING (kind))"""
_HOSTILE = """(SELECT count(DISTINCT e.ip) FROM all_events e JOIN actors a ON a.ip = e.ip
    WHERE e.classification <> 'normal' AND a.profile <> 'normal')"""
SQL["hostile_actor_count"] = _with(_all(), ACTORS) + f"SELECT {_HOSTILE} AS hostile_ips"
SQL["ml_accuracy_report"] = (
    _JUDGED.rstrip()
    + ",\n"
    + FAMILY_EVENTS
    + ",\n"
    + ACTORS
    + f"""
SELECT kind, detected, hostile_ips, 'ML Isolation Forest detected ' || detected
  || ' anomalous/ hostile IPs out of ' || hostile_ips
  || ' total unique attacking IPs (non-normal profiles in generation metadata).' AS message
FROM (SELECT 'ml_anomaly' AS kind, (SELECT count(*) FROM judged WHERE hostile) AS detected,
  {_HOSTILE} AS hostile_ips)"""
)
SQL["actor_distribution"] = _with(BASE, ACTORS) + (
    "SELECT profile, count(*) AS users, '- ' || profile || ': ' || count(*) || ' users' AS message "
    "FROM actors GROUP BY profile"
)
SQL["role_distribution"] = _with(BASE, ACCESS, AUTH_LABELED, ACTORS) + """
SELECT role, access_lines, auth_lines, '- ' || role || ': ' || access_lines
  || ' access log lines, ' || auth_lines || ' auth log lines' AS message
FROM (SELECT role, count(*) FILTER (f = 'access') AS access_lines,
    count(*) FILTER (f = 'auth') AS auth_lines
  FROM (SELECT 'access' AS f, coalesce(a.profile, 'normal') AS role
        FROM access_events e LEFT JOIN actors a ON a.ip = e.ip
        UNION ALL
        SELECT 'auth', CASE WHEN classification IN
            ('auth_sudo_bruteforce', 'auth_privilege_escalation') THEN 'compromised'
          WHEN classification <> 'normal' THEN 'attacker' ELSE 'normal' END
        FROM auth_events) GROUP BY role)"""
SQL["counts_by_family"] = _with(SUITE, KINDS, TRUE, DETECTED) + """
SELECT family, kind, detected, true_count FROM true_counts JOIN detected USING (kind)
WHERE family IN ('access', 'firewall') OR kind = 'ml_anomaly'"""
SQL["family_totals"] = _with(_all(), KINDS, TRUE) + """
SELECT family, kind, CAST(sum(true_count) AS BIGINT) AS episodes,
  CASE WHEN kind IS NULL THEN (SELECT count(*) FROM all_events e WHERE e.log_source = family) END
    AS lines
FROM true_counts WHERE family <> 'ml' GROUP BY GROUPING SETS ((family, kind), (family))"""
