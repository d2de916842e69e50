"""Shared line selections for reports that need more than one slice.

A report that needs the asked range (at the merchant) and the current month
reads both in one scan: the union of the two day ranges is pushed to the scan,
and each line carries flags ``r`` (in the asked range at the merchant) and
``m`` (counts as use of this month's limit). Catalyst splits the OR of the two
conditions into a date filter on the lines and a filter on the merchant side of
the join. What counts as use differs between the reports:

ASKED               the asked service, at all merchants
ASKED_AT_MERCHANT   the asked service, at the asked merchant
LISTED_AT_MERCHANT  every service of the service table, at the asked merchant
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.functions.text import contains_ci
from cardlens.params import Params
from cardlens.plans.broadcast import bounded_broadcast
from cardlens.sources.cards import CardTables


ASKED, ASKED_AT_MERCHANT, LISTED_AT_MERCHANT = "asked", "asked_at_merchant", "listed_at_merchant"


def with_known_service(cards: CardTables, p: Params, lines: DataFrame) -> DataFrame:
    """Add ``known``: the line's service is in the service table (the
    membership test of F11 as a flag, for conditional sums)."""
    sv = (cards.services(p).select(F.col("sv_code").alias("service")).distinct()
          .withColumn("known", F.lit(True)))
    j = lines.join(bounded_broadcast(sv, cards.services_row_bound(p)), "service", "left")
    return j.withColumn("known", F.coalesce(F.col("known"), F.lit(False)))


def month_use(p: Params, scope: str) -> Column:
    """Whether a line (of the month) counts as use of the limit in ``scope``;
    LISTED_AT_MERCHANT needs the flag ``known``."""
    cond = F.col("known") if scope == LISTED_AT_MERCHANT else F.col("service") == p.service
    if scope != ASKED and p.merchant:
        cond = cond & contains_ci(F.col("merchant"), p.merchant)
    return F.coalesce(cond, F.lit(False))


def range_and_month(cards: CardTables, p: Params, scope: str) -> DataFrame:
    lo = min(p.start, p.month_start)
    hi = max(p.end_exclusive, p.month_end_exclusive)
    b = cards.billing(p, start=lo, end_exclusive=hi, use_merchant=False)
    d = F.col("sl_date")

    def between(first: str, last: str) -> Column:
        # a day's text that is no date is compared as text
        text = F.col("sl_ymd")
        return (((d >= F.to_date(F.lit(first))) & (d < F.to_date(F.lit(last))))
                | (d.isNull() & (text >= first.replace("-", "")) & (text < last.replace("-", ""))))

    at = contains_ci(F.col("merchant"), p.merchant) if p.merchant else F.lit(True)
    in_range = between(p.start, p.end_exclusive) & at
    in_month = between(p.month_start, p.month_end_exclusive)
    in_month = in_month & ((F.col("service") == p.service) if scope == ASKED else at)
    b = b.where(in_range | in_month).withColumn("r", F.coalesce(in_range, F.lit(False)))
    b = b.withColumn("in_month", F.coalesce(in_month, F.lit(False)))
    return with_known_service(cards, p, b).withColumn("m", F.col("in_month") & month_use(p, scope)).drop("in_month")
