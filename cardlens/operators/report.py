"""One combined report per account (Q1 Q3; demo question e).

The reference answers one account with five scalar subqueries over the same
table. For all accounts this is one scan of the lines of the asked range and
of the current month, aggregated to (account, day) with conditional sums
(spend, discounts, this month's use: listed services at the merchant), then to
one row per account. The global parts
(service limit, number of matching promotions and messages) are scalar
subqueries evaluated once; the lists themselves are ``promos_active`` and
``messages_match`` and are not copied into every account row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlens.functions.dates import ymd_text
from cardlens.functions.jsonfmt import sorted_json_list
from cardlens.operators.discounts import service_limit
from cardlens.operators.lines import LISTED_AT_MERCHANT, range_and_month
from cardlens.operators.promos import active_promotions, matching_messages
from cardlens.params import Params
from cardlens.sources.cards import CardTables


def account_report(cards: CardTables, p: Params) -> DataFrame:
    b = range_and_month(cards, p, LISTED_AT_MERCHANT).select("acct", "sl_date", "amount", "discount", "r", "m", "known")
    known = F.col("known")
    by_day = (b.groupBy("acct", "sl_date")
               .agg(F.sum(F.when(F.col("r"), F.col("amount"))).alias("day_amount"),
                    F.count(F.when(F.col("r"), F.lit(1))).alias("n"),
                    F.sum(F.when(F.col("r") & known, F.col("discount"))).alias("day_discount"),
                    F.sum(F.when(F.col("m"), F.col("discount"))).alias("day_used")))
    # bounded: at most one entry per day of the asked range
    item = F.when(F.col("n") > 0, F.struct(ymd_text(F.col("sl_date")).alias("date"),
                                           F.col("day_amount").alias("amount")))
    per_acct = (by_day.groupBy("acct")
                .agg(F.sum("day_amount").alias("total_spent"),
                     F.sum("n").alias("n_payments"),
                     F.sum("day_discount").alias("total_discount"),
                     F.sum("day_used").alias("used"),
                     F.collect_list(item).alias("days"))
                .where(F.col("n_payments") > 0))

    limit_value = service_limit(cards, p)
    n_events = active_promotions(cards, p).agg(F.count("*")).scalar()
    n_messages = matching_messages(cards, p, word=p.merchant).agg(F.count("*")).scalar()
    used = F.coalesce(F.col("used"), F.lit(0).cast("decimal(18,2)"))

    per_acct = per_acct.withColumn("limit_value", limit_value)  # evaluated once
    limit_value = F.col("limit_value")
    return per_acct.select(
        "acct",
        F.col("total_spent").cast("double").alias("total_spent"),
        "n_payments",
        sorted_json_list(F.col("days"), ["date", "amount"]).alias("daily_spending"),
        F.col("total_discount").cast("double").alias("total_discount_received"),
        limit_value.cast("double").alias("discount_limit"),
        used.cast("double").alias("used_this_month"),
        (limit_value - used).cast("double").alias("remaining_discount_limit"),
        n_events.alias("n_related_events"),
        n_messages.alias("n_related_messages"))
