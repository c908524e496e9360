"""Register queries with the SQL that must give the same rows on the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bindings import Tables
from ..sources.rules import TABLES, values_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Canonical tables in SQL, independent of the DataFrame bindings.
VIEWS = {
    "x_act": """SELECT o_orderkey AS activity_id, o_custkey AS budget_activity_id,
        CAST(year(o_orderdate) AS INT) AS fiscal_year, CAST(o_orderdate AS DATE) AS start_date,
        CASE o_orderkey % 3 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'INDIRECT' ELSE 'MIXED' END
          AS execution_mode,
        CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'IN_EXECUTION'
          ELSE 'IN_PREPARATION' END AS status,
        o_orderpriority AS priority, CAST(o_totalprice AS DECIMAL(18,2)) AS allocation
        FROM orders""",
    "x_line": """SELECT l_orderkey AS activity_id, l_linenumber AS seq, l_partkey AS resource_id,
        l_suppkey AS supplier_id, CAST(l_quantity AS BIGINT) AS quantity,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS total,
        (2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
          // (2 * CAST(l_quantity AS BIGINT)) AS unit_cents,
        CAST(l_discount AS DECIMAL(4,2)) AS discount, CAST(l_tax AS DECIMAL(4,2)) AS tax,
        l_returnflag AS return_flag, l_linestatus AS line_status,
        CAST(l_shipdate AS DATE) AS work_date FROM lineitem""",
    "x_price": """SELECT p_partkey AS resource_id, p_name AS label, p_brand AS brand,
        p_type AS resource_type, p_size AS size, CAST(p_retailprice AS DECIMAL(18,2)) AS ref_price,
        CAST(round(p_retailprice * 100) AS BIGINT) AS ref_cents FROM part""",
    "x_unit": """SELECT c_custkey AS unit_id, c_name AS unit_name, c_mktsegment AS program,
        n_nationkey AS ministry_id, n_name AS ministry, r_regionkey AS institution_id,
        r_name AS institution, CAST(c_acctbal AS DECIMAL(18,2)) AS score
        FROM customer, nation, region
        WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey""",
    "x_contract": """SELECT activity_id, supplier_id, activity_id || ':' || supplier_id
        AS contract_number, CAST(sum(total) AS DECIMAL(18,2)) AS award_amount,
        min(work_date) AS signature_date, max(work_date) AS end_date, count(*) AS n_lines
        FROM x_line GROUP BY activity_id, supplier_id""",
    "x_pay": """SELECT activity_id, supplier_id, resource_id, seq, work_date AS pay_date,
        CAST(round(total * (1 - discount), 2) AS DECIMAL(18,2)) AS amount,
        return_flag = 'R' AS rejected FROM x_line WHERE line_status = 'F'""",
    "x_ev": """SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id AS actor, event_type AS kind,
        CAST(value AS DECIMAL(18,2)) AS value, CAST(props->>'$.k' AS INT) AS k, props
        FROM events""",
    "x_au": """SELECT a.*, u.* EXCLUDE (unit_id) FROM x_act a JOIN x_unit u
        ON a.budget_activity_id = u.unit_id""",
    "x_la": "SELECT l.*, a.* EXCLUDE (activity_id) FROM x_line l JOIN x_act a USING (activity_id)",
    "x_lu": "SELECT l.*, a.* EXCLUDE (activity_id) FROM x_line l JOIN x_au a USING (activity_id)",
    "x_need": """SELECT l.*, p.resource_type, p.label, c.category, f.funding_source, f.regime,
        t.authority_type FROM x_lu l JOIN x_price p ON p.resource_id = l.resource_id
        JOIN x_category_map c ON c.resource_type = p.resource_type
        JOIN x_funding_map f ON f.priority = l.priority
        JOIN x_authority_map t ON t.institution_id = l.institution_id
        WHERE l.execution_mode <> 'DIRECT'""",
    "x_env": """SELECT program, fiscal_year, initial_ceiling, current_ceiling,
        coalesce(allocated, 0) AS allocated, coalesce(reserved, 0) AS reserved,
        coalesce(need, 0) AS need,
        current_ceiling - coalesce(allocated, 0) - coalesce(reserved, 0) AS available
        FROM (SELECT program, fiscal_year, CAST(sum(allocation) AS DECIMAL(18,2)) AS initial_ceiling,
              CAST(round(sum(allocation) * min(factor), 2) AS DECIMAL(18,2)) AS current_ceiling
              FROM x_au JOIN x_program_factor USING (program) GROUP BY 1, 2)
        LEFT JOIN (SELECT program, fiscal_year,
              CAST(sum(total) FILTER (status = 'CLOSED') AS DECIMAL(18,2)) AS allocated,
              CAST(round(sum(total) FILTER (status = 'IN_EXECUTION') * CAST(0.1 AS DECIMAL(2,1)), 2)
                AS DECIMAL(18,2)) AS reserved,
              CAST(sum(total) FILTER (status = 'IN_PREPARATION') AS DECIMAL(18,2)) AS need
              FROM x_lu GROUP BY 1, 2) USING (program, fiscal_year)""",
}
VIEWS.update({f"x_{name}": values_sql(name) for name in TABLES})


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the CTEs it mentions, in dependency order."""
    views = {**VIEWS, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bx_\w+", text)):
            if name in views and name not in needed:
                visit(views[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    head = ", ".join(f"{n} AS ({views[n]})" for n in needed)
    stripped = body.strip()
    if stripped.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {stripped[14:]}"
    if stripped.upper().startswith("WITH"):
        return f"WITH {head}, {stripped[4:]}"
    return f"WITH {head} {stripped}"


def resolved() -> dict[str, str]:
    """The SQL of every query that has one, with its CTEs."""
    return {name: with_views(sql) for name, sql in ORACLE.items()}


def query(name: str, sql: str | None = None):
    """Decorator: ``fn(tables) -> DataFrame`` becomes the query ``name``."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap
