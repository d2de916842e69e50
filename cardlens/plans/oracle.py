"""Equivalent DuckDB SQL for every registered query.

The driver registers the test tables as views and runs these strings next to
the Spark jobs. Stand-in tables are CTEs here with the same definitions as
``cardlens.sources.standins``.
"""

from __future__ import annotations

from cardlens.params import Params


def _ts(day: str) -> str:
    return f"TIMESTAMP '{day} 00:00:00'"


def _ilike(col: str, word: str) -> str:
    return f"{col} ILIKE '%{word}%'"


def billing_cte(p: Params, name: str = "billing", *, start: str | None = None,
                end_exclusive: str | None = None, use_merchant: bool = True,
                use_range: bool = True) -> str:
    start = start or p.start
    end_exclusive = end_exclusive or p.end_exclusive
    conds = []
    if use_range:
        conds.append(f"l_shipdate >= {_ts(start)} AND l_shipdate < {_ts(end_exclusive)}")
    if use_merchant and p.merchant:
        conds.append(_ilike("p_name", p.merchant))
    if p.account is not None:
        conds.append(f"o_custkey = {int(p.account)}")
    where = ("WHERE " + " AND ".join(conds)) if conds else ""
    return f"""{name} AS (
  SELECT o_custkey AS acct, l_orderkey * 8 + l_linenumber AS line_id,
         CAST(l_shipdate AS DATE) AS sl_date,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         p_name AS merchant, p_brand AS card, p_type AS service,
         NULLIF(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)), 0) AS discount,
         CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS billed
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  {where})"""


def services_cte(p: Params, name: str = "services") -> str:
    codes = ", ".join(f"'{c}'" for c in p.known_services)
    return f"""{name} AS (
  SELECT p_type AS sv_code, CAST(MAX(p_retailprice) * 100 AS DECIMAL(18,2)) AS monthly_limit
  FROM part WHERE p_type IN ({codes}) GROUP BY p_type)"""


def month_use_cte(p: Params, name: str = "month_use", *, service: str | None = "asked",
                  at_merchant: bool = False) -> str:
    """Current-month discount use per account: of the asked service, or with
    ``service=None`` of all listed ones; at all merchants or at the asked one."""
    cond = f"service = '{p.service}'" if service else "service IN (SELECT sv_code FROM services)"
    return f"""{billing_cte(p, name + "_lines", start=p.month_start, end_exclusive=p.month_end_exclusive, use_merchant=at_merchant)},
{name} AS (
  SELECT acct, SUM(discount) AS used FROM {name}_lines WHERE {cond} GROUP BY acct)"""


def limit_scalar(p: Params) -> str:
    return f"(SELECT MAX(monthly_limit) FROM services WHERE sv_code = '{p.service}')"


PROMOTIONS_CTE = """promotions AS (
  SELECT p_partkey AS promo_id, p_name AS title,
         concat_ws(' ', p_brand, p_type, p_name) AS body, start_date, end_date
  FROM (SELECT l_partkey, CAST(MIN(l_shipdate) AS DATE) AS start_date,
               CAST(MAX(l_shipdate) AS DATE) AS end_date
        FROM lineitem GROUP BY l_partkey) s
  JOIN part ON s.l_partkey = p_partkey)"""


def sales_cte() -> str:
    return """sales AS (
  SELECT o_custkey AS pss_cno, o_orderdate AS st_ts,
         CAST(o_totalprice AS DECIMAL(18,2)) AS sl_am,
         o_orderstatus AS sl_pd_dc, substr(o_orderpriority, 1, 1) AS apl_phc
  FROM orders)"""


APPS_CTE = """apps AS (
  SELECT user_id AS cno, CAST(json_extract_string(props, '$.k') AS BIGINT) AS cmp_id
  FROM events WHERE event_type = 'signup')"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
