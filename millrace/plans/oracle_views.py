"""SQL text of the fixture views, for the DuckDB oracle.

The driver registers only the raw parquet tables, so every oracle query is
sent with the views it needs as CTEs. These definitions are the SQL twin of
``millrace.sources.fixtures`` (written independently, so the oracle check is
a real cross-check of the DataFrame mapping).
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "production": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       concat('PLANT_', lpad(CAST(s_nationkey AS VARCHAR), 2, '0')) AS tenant_id,
       CAST(l_shipdate AS DATE) AS production_date,
       concat('M', lpad(CAST(l_suppkey AS VARCHAR), 4, '0')) AS machine_id,
       l_quantity * 10 AS units_produced,
       CAST(floor(l_quantity * 10 * l_discount) AS DOUBLE) AS defective_units,
       CAST(round(l_tax * 1000) AS DOUBLE) AS downtime_min,
       CASE l_returnflag WHEN 'A' THEN 'Morning' WHEN 'N' THEN 'Evening' ELSE 'Night' END AS shift
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "production_dirty": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, tenant_id, production_date, machine_id,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE units_produced END AS units_produced,
       CASE WHEN shift = 'Night' THEN defective_units * 15 ELSE defective_units END AS defective_units,
       downtime_min - 20 AS downtime_min, shift
FROM production""",
    "tenants": """
SELECT concat('PLANT_', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS tenant_id,
       n_name AS tenant_name, r_name AS plant_location, 'UTC' AS timezone,
       n_nationkey % 5 <> 0 AS is_active, '{}' AS config
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "machines": """
SELECT concat('PLANT_', lpad(CAST(s_nationkey AS VARCHAR), 2, '0')) AS tenant_id,
       concat('M', lpad(CAST(s_suppkey AS VARCHAR), 4, '0')) AS machine_id,
       s_name AS machine_name,
       CASE s_suppkey % 3 WHEN 0 THEN 'Assembly' WHEN 1 THEN 'Press' ELSE 'Paint' END AS machine_type,
       s_acctbal AS capacity_units_per_hour, s_acctbal >= 0 AS is_active
FROM supplier""",
    "user_grants": """
SELECT c_custkey AS seq, concat('U', lpad(CAST(c_custkey % 50 AS VARCHAR), 4, '0')) AS user_id,
       concat('PLANT_', lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS tenant_id,
       c_name AS user_name, concat(c_name, '@example.com') AS user_email,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'manager' ELSE 'viewer' END AS role,
       c_acctbal >= 0 AS is_active
FROM customer""",
    "live_records": """
SELECT event_id, ts, CAST(ts AS DATE) AS production_date,
       concat('OPC-UA-M', CAST(user_id % 3 + 1 AS VARCHAR)) AS machine_id,
       CAST(round(value * 10) AS DOUBLE) AS units_produced,
       CAST(event_id % 15 AS DOUBLE) AS defective_units,
       CAST(event_id % 46 AS DOUBLE) AS downtime_min,
       'Live-Stream' AS shift
FROM events""",
    "analysis_texts": """
SELECT doc_id, concat('Intro ', lang, chr(10), '1. Executive Summary', chr(10), text, chr(10),
       '2. Empty', chr(10), '3. Actions', chr(10), 'first', chr(10), '4. Actions', chr(10), 'last ', source) AS text
FROM documents""",
    "unicode_texts": """
SELECT doc_id, concat('•–—‘’“”…°你😀 ', text) AS text FROM documents""",
}

# Views that read other views.
DEPENDS = {"production_dirty": ["production"]}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (dependencies first)."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    body = body.strip()
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in ordered)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        # merge the body's own CTEs after the fixture views
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# Fixture convention: "as of" is the last production day in the data.
AS_OF = "(SELECT max(production_date) FROM production)"
