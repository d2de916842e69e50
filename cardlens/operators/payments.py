"""JSON lists of payments and monthly totals.

An account has one list of single payments, in the order of the days, unless it
holds more than ``payment_chunk_lines``: then it has several, and consumers
concatenate them in ``chunk`` order. One account, day or payment may hold a
large share of all lines, so no list is cut in one task: equal payments are
counted first (map-side) and stand as one row with their number, lines are
counted per (account, day), days are numbered by running counts over the day
rows, and only a day that is longer than a list is split further, into hash
buckets with running counts of their own. The rule is the same for all sources.

Monthly lists are bounded by the number of months in the asked range and are
built after the monthly aggregate, one row per account.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardlens.functions.dates import month_text
from cardlens.functions.jsonfmt import sorted_json_list
from cardlens.params import Params
from cardlens.operators.lines import with_known_service
from cardlens.sources.cards import CardTables


def payment_chunks(b: DataFrame, width: int) -> DataFrame:
    """(acct, date, amount, discount, copies, chunk): the payments of ``b``, equal ones
    together, at most about ``width`` copies a row and twice as many a chunk.

    ``chunk``: the running count of the days before, in widths, shifted by 40 bits;
    on a day longer than a width, also a hash bucket and the place inside it.
    """
    kinds = (b.groupBy("acct", F.col("sl_ymd").alias("date"), "amount", "discount")
              .agg(F.count("*").alias("n")))
    days = kinds.groupBy("acct", "date").agg(F.sum("n").alias("day_n"))
    # bounded: one row per day of an account
    before = Window.partitionBy("acct").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("before", F.coalesce(F.sum("day_n").over(before), F.lit(0)))
    j = (kinds.alias("k").join(days.alias("d"), (F.col("k.acct") == F.col("d.acct")) & F.col("k.date").eqNullSafe(F.col("d.date")))
         .select("k.acct", "k.date", "amount", "discount", "n", "day_n", "before"))
    base = F.shiftleft(F.floor(F.col("before") / width).cast("bigint"), 40)
    short = j.where(F.col("day_n") <= width).select("acct", "date", "amount", "discount", F.col("n").alias("copies"),
                                                    base.alias("chunk"))
    # days longer than a list: rows of at most ``width`` copies, dealt out by a hash of the payment
    long = j.where(F.col("day_n") > width)
    long = long.withColumn("bucket", F.pmod(F.xxhash64("amount", "discount"), F.ceil(F.col("day_n") / width)))
    long = long.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / width))))
    long = long.withColumn("copies", F.least(F.lit(width).cast("bigint"), F.col("n") - F.col("piece") * width))
    inside = (Window.partitionBy("acct", "date", "bucket").orderBy("amount", "discount", "piece")
              .rowsBetween(Window.unboundedPreceding, -1))
    place = F.floor(F.coalesce(F.sum("copies").over(inside), F.lit(0)) / width).cast("bigint")
    long = long.select("acct", "date", "amount", "discount", "copies",
                       (base + F.shiftleft(F.col("bucket") + 1, 20) + place).alias("chunk"))
    return short.unionByName(long)


def payments_json(cards: CardTables, p: Params) -> DataFrame:
    """Each payment as ``{"date","amount","discount"}``, sorted by day, amount and discount."""
    b = payment_chunks(cards.billing(p), p.payment_chunk_lines)
    item = F.struct("date", "amount", "discount", "copies")
    g = (b.groupBy("acct", "chunk")
          .agg(F.sum("copies").alias("n_payments"),
               F.sum(F.col("amount") * F.col("copies")).cast("double").alias("chunk_amount"),
               F.collect_list(item).alias("items")))
    # equal payments stand side by side again
    whole = F.flatten(F.transform("items", lambda x: F.array_repeat(
        F.struct(x["date"].alias("date"), x["amount"].alias("amount"), x["discount"].alias("discount")),
        x["copies"].cast("int"))))
    return g.select("acct", "chunk", "n_payments", "chunk_amount",
                    sorted_json_list(whole, ["date", "amount", "discount"]).alias("payments"))


def monthly_json(cards: CardTables, p: Params) -> DataFrame:
    """Q5: monthly spending (COALESCE(billed, amount)) and monthly discounts
    of listed services as JSON lists per account (the monthly few-shot of the
    reference). One scan; one aggregate to (account, month) with conditional
    sums, then one row per account (lists bounded by the months of the range)."""
    b = with_known_service(cards, p, cards.billing(p))
    g = (b.groupBy("acct", month_text(F.col("sl_date")).alias("month"))
          .agg(F.sum(F.coalesce("billed", "amount")).alias("total_spent"),
               F.sum(F.when(F.col("known"), F.col("discount"))).alias("total_discount"),
               F.count(F.when(F.col("known"), F.lit(1))).alias("n_known")))
    spend_item = F.struct(F.col("month"), F.col("total_spent"))
    disc_item = F.when(F.col("n_known") > 0, F.struct(F.col("month"), F.col("total_discount")))
    per = g.groupBy("acct").agg(F.collect_list(spend_item).alias("s"), F.collect_list(disc_item).alias("d"))
    return per.select(
        "acct",
        sorted_json_list(F.col("s"), ["month", "total_spent"]).alias("monthly_spending"),
        sorted_json_list(F.col("d"), ["month", "total_discount"]).alias("monthly_discounts"))
