"""Discounts and monthly limits.

Membership in the service table (``BLL_SV_DC IN (SELECT SV_C ...)``) is a left
semi join: it never adds rows and, with a service table that is small at
runtime, AQE plans it as a broadcast hash semi join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardlens.functions.dates import month_text
from cardlens.functions.jsonfmt import to_json
from cardlens.params import Params
from cardlens.plans.broadcast import bounded_broadcast
from cardlens.sources.cards import CardTables
from cardlens.operators.lines import ASKED, ASKED_AT_MERCHANT, range_and_month


def discounted_lines(cards: CardTables, p: Params, **kw) -> DataFrame:
    """Billing lines whose service grants a discount."""
    b = cards.billing(p, **kw)
    sv = cards.services(p).select(F.col("sv_code").alias("service"))
    return b.join(bounded_broadcast(sv, cards.services_row_bound(p)), "service", "left_semi")


def discount_total(cards: CardTables, p: Params) -> DataFrame:
    """Total discount received per account at the merchant in the range."""
    d = discounted_lines(cards, p)
    return d.groupBy("acct").agg(
        F.sum("discount").cast("double").alias("total_discount"),
        F.count("discount").alias("n_discounted"))


def discount_by_month(cards: CardTables, p: Params) -> DataFrame:
    """Discount per account and month."""
    d = discounted_lines(cards, p)
    return (d.groupBy("acct", month_text(F.col("sl_date")).alias("month"))
             .agg(F.sum("discount").cast("double").alias("monthly_discount")))


def _remaining(cards: CardTables, p: Params, use: DataFrame) -> DataFrame:
    """limit − COALESCE(used, 0) of the asked service: one row per account, also
    for accounts without use; ``use`` has (acct, used)."""
    used = F.coalesce(F.col("used"), F.lit(0).cast("decimal(18,2)"))
    return (cards.accounts(p).join(use, "acct", "left")
            .withColumn("limit_value", service_limit(cards, p))
            .select("acct", F.col("limit_value").cast("double").alias("monthly_limit"),
                    used.cast("double").alias("used"),
                    (F.col("limit_value") - used).cast("double").alias("remaining")))


def limit_remaining(cards: CardTables, p: Params) -> DataFrame:
    """Q2 + A10: the asked service's limit − COALESCE(used this month, 0).

    Used: the discounts of all listed services at the merchant in the month of
    ``as_of``. One row per account; an idle account has its full limit.
    """
    use = discounted_lines(cards, p, start=p.month_start, end_exclusive=p.month_end_exclusive)
    r = _remaining(cards, p, use.groupBy("acct").agg(F.sum("discount").alias("used")))
    return r.select("acct", F.lit(p.service).alias("service"), "monthly_limit", "used", "remaining")


def limit_for_month(cards: CardTables, p: Params) -> DataFrame:
    """the month asked as a ``yyyyMM`` prefix, as a day range on a date.

    Remaining limit of the asked service per account; used: that service's
    discounts of the month at all merchants.
    """
    use = cards.billing(p, start=p.limit_month_start, end_exclusive=p.limit_month_end_exclusive,
                        use_merchant=False).where(F.col("service") == p.service)
    r = _remaining(cards, p, use.groupBy("acct").agg(F.sum("discount").alias("used")))
    return r.select("acct", F.lit(p.limit_month).alias("month"), "monthly_limit", "used", "remaining")


def service_limit(cards: CardTables, p: Params):
    """The asked service's monthly limit as a scalar subquery, evaluated once.

    Aggregated, so it is one row even when a service table repeats a code
    (SQLite would take an arbitrary row; the largest is taken here) and NULL
    when the code is missing."""
    return (cards.services(p).where(F.col("sv_code") == p.service)
            .agg(F.max("monthly_limit")).scalar())


def discount_by_month_limit(cards: CardTables, p: Params) -> DataFrame:
    """Q6: each month's discount with the account's remaining limit repeated.

    Monthly rows of the asked service at the merchant; the remaining limit is
    limit − this month's use of the service at the merchant. One scan; the
    account's use is summed over its (few) month rows with a window.
    """
    lines = range_and_month(cards, p, ASKED_AT_MERCHANT)
    sel = F.col("r") & (F.col("service") == p.service)
    g = (lines.groupBy("acct", month_text(F.col("sl_date")).alias("month"))
              .agg(F.sum(F.when(sel, F.col("discount"))).alias("monthly_discount"),
                   F.count(F.when(sel, F.lit(1))).alias("n"),
                   F.sum(F.when(F.col("m"), F.col("discount"))).alias("month_used")))
    # bounded: one row per month of the scanned range per account
    used = F.coalesce(F.sum("month_used").over(Window.partitionBy("acct")), F.lit(0).cast("decimal(18,2)"))
    return (g.withColumn("used", used).where(F.col("n") > 0)
             .withColumn("limit_value", service_limit(cards, p))
             .select("acct", "month",
                     F.col("monthly_discount").cast("double").alias("monthly_discount"),
                     (F.col("limit_value") - F.col("used")).cast("double").alias("remaining_limit")))


def discount_info(cards: CardTables, p: Params) -> DataFrame:
    """A14 + Q4: one JSON object per account with total, limit and remaining.

    Accounts with a line at the merchant in the range; total = the discounts of
    those lines, whatever their service (null if there is none), remaining =
    limit − this month's use of the asked service at all merchants. One scan of
    the range and the current month.
    """
    lines = range_and_month(cards, p, ASKED)
    sel = F.col("r")
    g = (lines.groupBy("acct")
              .agg(F.sum(F.when(sel, F.col("discount"))).alias("total_discount"),
                   F.count(F.when(sel, F.lit(1))).alias("n"),
                   F.sum(F.when(F.col("m"), F.col("discount"))).alias("used"))
              .where(F.col("n") > 0)
              .withColumn("discount_limit", service_limit(cards, p)))
    used = F.coalesce(F.col("used"), F.lit(0).cast("decimal(18,2)"))
    obj = F.struct(F.col("total_discount"), F.col("discount_limit"),
                   (F.col("discount_limit") - used).alias("remaining_limit"))
    return g.select("acct", to_json(obj).alias("discount_info"))
