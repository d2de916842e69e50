"""Spending reports for all accounts.

Each is one scan of the billing lines and one hash aggregate; the partial
aggregate runs map-side, so a hot account costs one row per map task before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlens.functions.dates import month_text, ymd_text
from cardlens.params import Params
from cardlens.sources.cards import CardTables


def _total(c="amount"):
    return F.sum(c).cast("double").alias("total_spent")


def spend_total(cards: CardTables, p: Params) -> DataFrame:
    """Total spent per account at the merchant in the range (demo question b)."""
    b = cards.billing(p)
    return b.groupBy("acct").agg(_total(), F.count("*").alias("n_payments"))


def spend_by_card(cards: CardTables, p: Params) -> DataFrame:
    """Amount per account and card over the range, all merchants (question a)."""
    b = cards.billing(p, use_merchant=False)
    return b.groupBy("acct", F.col("card").alias("card_name")).agg(
        F.sum("amount").cast("double").alias("total_amount"))


def spend_by_month(cards: CardTables, p: Params) -> DataFrame:
    """Amount per account and month at the merchant (question b), ordered by
    the group key (Q7; a range-partitioned sort of the aggregated rows)."""
    b = cards.billing(p)
    return (b.groupBy("acct", month_text(F.col("sl_date")).alias("month"))
             .agg(_total(), F.count("*").alias("n_payments"))
             .orderBy("acct", "month"))


def spend_by_day(cards: CardTables, p: Params) -> DataFrame:
    """Amount per account and payment day (question e, 'by payment date')."""
    b = cards.billing(p)
    return (b.groupBy("acct", ymd_text(F.col("sl_date")).alias("payment_date"))
             .agg(_total(), F.count("*").alias("n_payments")))


def billed_by_month(cards: CardTables, p: Params) -> DataFrame:
    """Sum of COALESCE(billed principal, amount) per account and month."""
    b = cards.billing(p)
    return (b.groupBy("acct", month_text(F.col("sl_date")).alias("month"))
             .agg(F.sum(F.coalesce("billed", "amount")).cast("double").alias("billed_total")))


def spend_total_and_month(cards: CardTables, p: Params) -> DataFrame:
    """The range total and the monthly breakdown together, as asked.

    ``rollup(acct, month)``: level 0 = account-month, 1 = account total,
    3 = grand total. One aggregate, no self-join.
    """
    b = cards.billing(p).select(
        "acct", month_text(F.col("sl_date")).alias("month"), "amount")
    return (b.rollup("acct", "month")
             .agg(F.grouping_id().cast("int").alias("level"), _total(),
                  F.count("*").alias("n_payments")))


def month_from_text(cards: CardTables, p: Params) -> DataFrame:
    """Month of a ``yyyyMMdd`` text date, by substr chain and by parsing.

    The text of every payment day in the range; only days are scanned.
    """
    from cardlens.functions.dates import month_by_substr, parse_ymd
    days = cards.days(p).select(F.col("sl_ymd").alias("sl_dt")).distinct()
    return days.select(
        "sl_dt",
        month_by_substr(F.col("sl_dt")).alias("month_substr"),
        month_text(parse_ymd(F.col("sl_dt"))).alias("month_parsed"))


def month_bounds(cards: CardTables, p: Params) -> DataFrame:
    """First and last day of the month of every payment day."""
    from cardlens.functions.dates import month_end, month_start
    days = cards.days(p).select("sl_date").distinct()
    return days.select(
        ymd_text(F.col("sl_date")).alias("sl_dt"),
        ymd_text(month_start(F.col("sl_date"))).alias("month_first"),
        ymd_text(month_end(F.col("sl_date"))).alias("month_last"))


def top_customers(cards: CardTables, p: Params) -> DataFrame:
    """Q8, Q9: the k accounts that spent most at the merchant, ties by account.

    ``orderBy + limit`` plans as TakeOrderedAndProject: each task keeps its
    top k and only k rows per task reach the final merge.
    """
    exact = cards.billing(p).groupBy("acct").agg(F.sum("amount").alias("exact"), F.count("*").alias("n_payments"))
    top = exact.orderBy(F.col("exact").desc(), F.col("acct").asc()).limit(p.top_k)
    return top.select("acct", F.col("exact").cast("double").alias("total_spent"), "n_payments")
