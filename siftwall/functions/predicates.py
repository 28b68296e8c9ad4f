"""Row predicates over the common event schema, as SQL text."""

from __future__ import annotations

# Request-path tokens that mark SQL injection.
SQL_INJECTION_TOKENS = (
    " or 1=1",
    ' or "1"="1',
    "'--",
    " union select ",
    " drop table ",
    "../",
    "%2e%2e%2f",
    ";--",
)

# Request-path tokens that mark command injection. Upper-case hex
# escapes are left out: they cannot occur in a lower-cased path.
COMMAND_INJECTION_TOKENS = (
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

# Patterns of the per-request features.
SQL_KEYWORDS = r"(?iu)'|union|select|drop|insert|update"
ADMIN_PATHS = r"(?iu)/admin|wp-admin|\.env|\.git|phpmyadmin"



def quoted(text: str) -> str:
    """``text`` as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _path_contains_any(tokens) -> str:
    """False, not null, for a null path."""
    tests = " OR ".join(f"contains(lower(path), {quoted(t)})" for t in tokens)
    return f"coalesce({tests}, false)"


SQL_INJECTION = _path_contains_any(SQL_INJECTION_TOKENS)
COMMAND_INJECTION = _path_contains_any(COMMAND_INJECTION_TOKENS)

ACCESS = "log_source = 'access'"
FIREWALL = "log_source = 'firewall'"

FAILED_LOGIN = "(path = '/login' AND status = 401 AND method = 'POST')"
NOT_FOUND = "status = 404"

SSH_FAILED_PASSWORD = "(method = 'SSH' AND path = 'ssh/failed_password')"
SSH_INVALID_USER = "(method = 'SSH' AND path = 'ssh/invalid_user')"
SSH_ACCEPTED = "(method = 'SSH' AND path = 'ssh/accepted')"
SUDO_FAILURE = "(method = 'SUDO' AND path = 'sudo/auth_failure')"

DENIED = "upper(action) = 'DENY'"
DENIED_TCP = f"({DENIED} AND lower(protocol) = 'tcp')"
# where a row has no action, its status stands in
DENIED_SSH = (
    f"(coalesce({DENIED}, status = 403) AND lower(protocol) = 'tcp' AND dst_port = 22)"
)
