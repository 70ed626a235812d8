"""Job-board, scalar and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators.ranking import sorted_ranks
from quillspark.plans.shared import both
from quillspark.sources.adapters import JOBS, on_duckdb, on_spark

W = f"WITH {JOBS}"
STATUSES = "(VALUES (1, 'wishlist'), (2, 'applied'), (3, 'followup'), (4, 'interview'), (5, 'offer'), (6, 'rejected')) AS v(pos, status)"
NUMBERS = "(SELECT l_linenumber + 7 * (l_orderkey % 29) AS n FROM {lineitem} GROUP BY l_linenumber + 7 * (l_orderkey % 29)) x"

SQLS = {
    "s5_filter": f"{W} SELECT id, company, role FROM jobs WHERE status = 'offer' AND (lower(company) LIKE '%00012%' OR lower(role) LIKE '%urgent%')",  # B-15
    "s5_counts": f"{W}, n AS (SELECT status, count(*) AS n FROM jobs GROUP BY status) SELECT v.status, v.pos, coalesce(n.n, 0) AS n FROM (SELECT * FROM {STATUSES}) v LEFT JOIN n ON v.status = n.status UNION ALL SELECT 'all', 0, count(*) FROM jobs",  # D-22
    "s5_required": f"{W} SELECT id, CASE WHEN trim(company) <> '' AND trim(role) <> '' THEN 'ok' ELSE 'quarantine' END AS verdict FROM jobs",  # B-19
    "s5_roles_union": f"{W} SELECT role, min(pos) AS pos FROM (SELECT role, pos FROM (VALUES ('1-URGENT', 0), ('QA', 1)) AS p(role, pos) UNION ALL SELECT DISTINCT role, 100 FROM jobs) u GROUP BY role",  # G-11
    # A-10, A-11: keyed upsert: the newest row of a key wins
    "s5_upsert": f"{W}, u AS (SELECT id, company, status, 0 AS ver FROM jobs UNION ALL SELECT id, upper(company), 'offer', 1 FROM jobs WHERE id % 7 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ver DESC) AS rn FROM u) SELECT id, company, status FROM r WHERE rn = 1",
    "s5_days_since": f"{W}, m AS (SELECT max(date_applied) AS today FROM jobs) SELECT id, datediff({{q}}today, date_applied) AS days FROM jobs, m",  # H-17
    # H-29..H-31, H-35, H-37..H-39
    "s8_fizzbuzz": f"SELECT n, CASE WHEN n % 15 = 0 THEN 'FizzBuzz' WHEN n % 3 = 0 THEN 'Fizz' WHEN n % 5 = 0 THEN 'Buzz' ELSE cast(n AS varchar(20)) END AS word, CASE WHEN n % 2 = 0 THEN 'Even' ELSE 'Odd' END AS parity FROM {NUMBERS}",
    "s8_grades": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 2 >= 90 THEN 'A' WHEN l_quantity * 2 >= 80 THEN 'B' WHEN l_quantity * 2 >= 70 THEN 'C' END AS grade FROM {lineitem}",
    "s8_leap": "SELECT DISTINCT year(o_orderdate) AS y, year(o_orderdate) % 400 = 0 OR (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) AS leap FROM {orders}",
    "s8_triangle": "SELECT p_partkey, CASE WHEN p_size % 4 = p_size % 3 AND p_size % 3 = p_size % 5 THEN 'Equilateral' WHEN p_size % 4 = p_size % 3 THEN 'Isosceles' ELSE 'Scalene' END AS kind FROM {part}",
    "s8_eligibility": "SELECT p_partkey, (m >= 65 AND p >= 55 AND c >= 50 AND m + p + c >= 180) OR m + p >= 140 AS eligible FROM (SELECT p_partkey, p_partkey % 101 AS m, (p_partkey * 7) % 101 AS p, (p_partkey * 13) % 101 AS c FROM {part}) x",
    "s8_primes": f"SELECT a.n FROM {NUMBERS.replace(' x', ' a')} WHERE a.n > 1 AND NOT EXISTS (SELECT 1 FROM {NUMBERS.replace(' x', ' b')} WHERE b.n > 1 AND b.n < a.n AND a.n % b.n = 0)",
    "s8_vowels": "SELECT c_custkey, length(c_name) - length(translate(lower(c_name), 'aeiou', '')) AS vowels, length(regexp_replace(lower(c_name), '[^a-z]', ''{g})) - (length(c_name) - length(translate(lower(c_name), 'aeiou', ''))) AS consonants FROM {customer}",
    "s8_palindrome": "SELECT doc_id, lower(text) = reverse(lower(text)) AS palindrome FROM {documents}",
    "s8_table": f"SELECT n, i, n * i AS product FROM {NUMBERS} CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) AS v(i)",
    "s8_stars": f"SELECT n, repeat('*', cast(n AS int)) AS triangle, lpad(repeat('*', cast(2 * n - 1 AS int)), cast(60 + n AS int), ' ') AS pyramid FROM {NUMBERS} WHERE n BETWEEN 1 AND 20",
    # F-06: the last four turns of each conversation
    "s1_memory_window": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM {conversations}) x WHERE rn <= 4",
    # H-18, H-27: scheme prefix and host
    "s5_urls": "SELECT page_id, CASE WHEN lower(url) LIKE 'http://%' OR lower(url) LIKE 'https://%' THEN url ELSE 'https://' || url END AS full_url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS base FROM {pages}",
    "s6_ticket_keys": "SELECT doc_id, nullif(regexp_extract(source || ' ' || upper(lang) || '-' || cast(doc_id AS varchar(20)), '[A-Z]+-[0-9]+', 0), '') AS ticket FROM {documents}",  # C-29
}
_spark = {k: v.replace("{g}", "").replace("{q}", "") for k, v in SQLS.items()}
_duck = {k: v.replace("{g}", ", 'g'").replace("datediff({q}today, date_applied)", "cast(today - date_applied AS int)") for k, v in SQLS.items()}
QUERIES, ORACLES = both(_spark)[0], both(_duck)[1]

# F-10: the columns of the board, newest first; a missing date counts as the epoch
_CARDS = f"{W} SELECT id, company, role, status, coalesce(date_applied, date '1970-01-01') AS day FROM jobs"


def _board(spark, sf_dir):
    cards = on_spark(spark, sf_dir, _CARDS)
    return sorted_ranks(cards, [F.desc("day"), F.asc("id")], group="status", name="pos").drop("day")


QUERIES["s5_board"] = _board
ORACLES["s5_board"] = f"SELECT id, company, role, status, row_number() OVER (PARTITION BY status ORDER BY day DESC, id) AS pos FROM ({on_duckdb(_CARDS)})"
