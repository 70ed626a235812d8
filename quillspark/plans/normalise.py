"""Tolerant reading of untyped sheet rows: aliases of columns, numbers with units, flags, states, times, labels."""

from __future__ import annotations

from quillspark.plans.shared import both

#: Spellings of health states, incident states and severities.
HEALTH = {
    "UP": "HEALTHY", "HEALTHY": "HEALTHY", "OK": "HEALTHY", "PASS": "HEALTHY", "PASSED": "HEALTHY",
    "DEGRADED": "SLOW", "SLOW": "SLOW", "WARN": "SLOW", "WARNING": "SLOW",
    "DOWN": "DOWN", "FAILED": "DOWN", "FAILURE": "DOWN", "ERROR": "DOWN",
    "FUNCTIONAL_FAILURE": "FUNCTIONAL_FAILURE", "FUNCTIONALFAILURE": "FUNCTIONAL_FAILURE",
    "RETRYING": "RETRYING", "UNKNOWN": "UNKNOWN",
}
INCIDENT = {
    "OPEN": "Open", "ACTIVE": "Open", "INVESTIGATING": "Investigating", "RECOVERED": "Recovered",
    "RECOVERY": "Recovered", "RESOLVED": "Resolved", "CLOSED": "Resolved",
}
SEVERITY = {
    "SEV-1": "Critical", "SEV1": "Critical", "CRITICAL": "Critical", "SEV-2": "High", "SEV2": "High", "HIGH": "High",
    "SEV-3": "Medium", "SEV3": "Medium", "MEDIUM": "Medium", "SEV-4": "Low", "SEV4": "Low", "LOW": "Low",
}

#: The events as a sheet has them: strings with blanks, units, aliases, holes, and two columns of which one is filled.
SHEET = """sheet AS (SELECT event_id, CASE WHEN k % 3 = 0 THEN '' ELSE ' Svc ' || cast(user_id % 5 AS varchar(20)) || ' / Main!' END AS service_name, CASE WHEN k % 3 = 0 THEN 'fallback ' || event_type END AS service,
    CASE k % 11 WHEN 0 THEN ' up ' WHEN 1 THEN 'Degraded' WHEN 2 THEN 'DOWN' WHEN 3 THEN 'passed' WHEN 4 THEN 'warning' WHEN 5 THEN 'Failure' WHEN 6 THEN 'functionalFailure' WHEN 7 THEN 'retrying' WHEN 8 THEN 'odd' WHEN 9 THEN '' END AS status,
    CASE k % 4 WHEN 0 THEN cast(cast(floor(value * 25) AS bigint) AS varchar(20)) || ' ms' WHEN 1 THEN ' ' || cast(cast(floor(value * 25) AS bigint) AS varchar(20)) WHEN 2 THEN 'n/a' ELSE '' END AS response,
    CASE k % 5 WHEN 0 THEN '500' WHEN 1 THEN '200 OK' WHEN 2 THEN '404' ELSE ' ' END AS http, CASE k % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' TRUE ' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN '' ELSE 'y' END AS critical,
    CASE k % 4 WHEN 0 THEN 'staging' WHEN 1 THEN ' PRODUCTION' WHEN 2 THEN 'dev' ELSE '' END AS env, CASE k % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'Functional ' WHEN 2 THEN 'ping' ELSE '' END AS check_type,
    CASE k % 5 WHEN 0 THEN 'post' WHEN 1 THEN 'HEAD' WHEN 2 THEN 'patch' ELSE '' END AS http_method, CASE k % 8 WHEN 0 THEN 'active' WHEN 1 THEN 'Recovery' WHEN 2 THEN 'closed' WHEN 3 THEN 'investigating' ELSE 'new' END AS incident,
    CASE k % 7 WHEN 0 THEN 'sev-1' WHEN 1 THEN 'Sev2' WHEN 2 THEN 'low' WHEN 3 THEN 'p1' ELSE 'SEV-3' END AS sev,
    CASE k % 8 WHEN 0 THEN 'INCIDENT_START' WHEN 1 THEN 'check_failed' WHEN 2 THEN 'RETRY_SCHEDULED' WHEN 3 THEN 'scheduled' WHEN 4 THEN 'recovered' WHEN 5 THEN 'resolved' WHEN 6 THEN 'incident' ELSE 'note' END AS kind,
    CASE k % 6 WHEN 0 THEN 'HTTP 402: quota' WHEN 1 THEN '401 unauthorized' WHEN 2 THEN 'Too Many Requests' WHEN 3 THEN 'model x not found, expected dim: 768, got 384' ELSE 'socket closed' END AS error
    FROM (SELECT *, cast(regexp_extract(props, '[0-9]+', 0) AS bigint) AS k FROM {events}) e)"""


def pick(*columns: str) -> str:
    """The first column that is not blank (H-01, H-02)."""
    return "coalesce(" + ", ".join(f"nullif(trim({c}), '')" for c in columns) + ")"


def number(column: str) -> str:
    """A number out of text with units; null if there is none (H-03)."""
    return f"try_cast(nullif(regexp_replace({column}, '[^0-9.+-]', ''{{g}}), '') AS double)"


def flag(column: str) -> str:
    return f"coalesce(lower(trim({column})), '') IN ('true', '1', 'yes', 'y')"


def aliased(column: str, names: dict[str, str], default: str) -> str:
    """A CASE over spellings, whatever the case of letters (H-07, H-08)."""
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE upper(trim(coalesce({column}, ''))) {arms} ELSE '{default}' END"


def clamped(column: str, values: tuple[str, ...], default: str) -> str:
    """One of the values, whatever the case of letters, else the default (H-09)."""
    return aliased(column, {v.upper(): v for v in values}, default)


def slug(column: str) -> str:
    """Lower case, runs of other characters as one dash, none at the ends (H-06)."""
    return f"'svc-' || trim(BOTH '-' FROM regexp_replace(lower({column}), '[^a-z0-9]+', '-'{{g}}))"


_DERIVED = "CASE WHEN stated <> 'UNKNOWN' OR http_status IS NULL THEN stated WHEN http_status >= 400 THEN 'DOWN' WHEN response_ms > 3000 THEN 'SLOW' ELSE 'HEALTHY' END"
#: The needles of kinds and of error classes, in the order in which they are tried.
_KIND = "CASE WHEN position('START' IN u) > 0 OR position('FAIL' IN u) > 0 THEN 'failure' WHEN position('RETRY' IN u) > 0 THEN 'retry' WHEN position('SCHEDULE' IN u) > 0 THEN 'schedule' WHEN position('RECOVER' IN u) > 0 OR position('RESOLV' IN u) > 0 THEN 'recovery' WHEN position('INCIDENT' IN u) > 0 THEN 'incident' ELSE 'info' END"
_ERROR = """CASE WHEN position('402' IN error) > 0 OR position('payment' IN l) > 0 OR position('billing' IN l) > 0 OR position('quota' IN l) > 0 THEN 'billing' WHEN position('403' IN error) > 0 OR position('forbidden' IN l) > 0 OR position('unauthorized' IN l) > 0 OR position('401' IN error) > 0 THEN 'access'
    WHEN position('429' IN error) > 0 OR position('rate limit' IN l) > 0 OR position('too many requests' IN l) > 0 THEN 'rate' WHEN position('not found' IN l) > 0 AND position('model' IN l) > 0 THEN 'model' ELSE 'other' END"""

_W = f"WITH {SHEET}"
_SECONDS = "(SELECT DISTINCT event_id % 9000 AS s FROM {events}) x"
SQLS = {
    # H-01..H-10, H-15: one row of the sheet, typed
    "s4_sheet_checks": f"{_W}, t AS (SELECT event_id, {pick('service_name', 'service')} AS name, {aliased('status', HEALTH, 'UNKNOWN')} AS stated, {number('response')} AS response_ms, cast({number('http')} AS int) AS http_status, {flag('critical')} AS critical, {clamped('env', ('QA', 'Staging', 'Production'), 'QA')} AS environment, {clamped('check_type', ('HTTP', 'API', 'FUNCTIONAL'), 'HTTP')} AS check_type, {clamped('http_method', ('GET', 'POST', 'HEAD'), 'GET')} AS http_method FROM sheet) SELECT event_id, name, {slug('name')} AS id, stated, {_DERIVED} AS health, response_ms, http_status, critical, environment, check_type, http_method FROM t",
    "s4_sheet_incidents": f"{_W} SELECT event_id, {aliased('incident', INCIDENT, 'Open')} AS status, {aliased('sev', SEVERITY, 'Medium')} AS severity FROM sheet",
    "s4_timeline_kinds": f"{_W} SELECT kind, {_KIND} AS class, count(*) AS n FROM (SELECT kind, upper(kind) AS u FROM sheet) x GROUP BY kind, {_KIND}",  # H-14
    "s4_errors": f"{_W} SELECT {_ERROR} AS class, try_cast(nullif(regexp_extract(error, 'dim: ([0-9]+), got ([0-9]+)', 2), '') AS int) AS dims, count(*) AS n FROM (SELECT error, lower(error) AS l FROM sheet) x GROUP BY {_ERROR}, try_cast(nullif(regexp_extract(error, 'dim: ([0-9]+), got ([0-9]+)', 2), '') AS int)",  # H-22, H-23
    # H-16: labels of durations; H-41: the generator's next three numbers
    "s4_durations": f"SELECT s, CASE WHEN s <= 0 THEN '—' WHEN s >= 3600 THEN cast(cast(floor(s / 3600.0) AS int) AS varchar(20)) || 'h ' || cast(cast(floor((s % 3600) / 60.0) AS int) AS varchar(20)) || 'm' WHEN s >= 60 THEN cast(cast(floor(s / 60.0) AS int) AS varchar(20)) || 'm ' || cast(s % 60 AS varchar(20)) || 's' ELSE cast(s AS varchar(20)) || 's' END AS label FROM {_SECONDS}",
    "s4_lcg": f"SELECT s, a, b, (b * 1664525 + 1013904223) % 4294967296 AS c FROM (SELECT s, a, (a * 1664525 + 1013904223) % 4294967296 AS b FROM (SELECT s, (s * 1664525 + 1013904223) % 4294967296 AS a FROM {_SECONDS}) y) z",
    # G-10: every service of the list, with zeros where it has no sample
    "s4_fan_in": "SELECT v.service, coalesce(count(e.event_id), 0) AS samples, coalesce(max(cast(floor(e.value) AS bigint)), 0) AS most FROM (VALUES ('svc-0'), ('svc-1'), ('svc-9')) AS v(service) LEFT JOIN {events} e ON 'svc-' || cast(e.user_id % 5 AS varchar(20)) = v.service GROUP BY v.service",
    # G-19: how many rows each source of the snapshot gave
    "s4_sources": "SELECT 'checks' AS source, count(*) AS n, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS state FROM {events} UNION ALL SELECT 'jobs', count(*), CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END FROM {orders} UNION ALL SELECT 'pages', count(*), CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END FROM {pages}",
}
QUERIES = both({k: v.replace("{g}", "") for k, v in SQLS.items()})[0]
ORACLES = both({k: v.replace("{g}", ", 'g'") for k, v in SQLS.items()})[1]
