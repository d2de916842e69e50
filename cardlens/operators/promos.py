"""Promotions and messages matching a word.

The matched set is global (not per account) and grows with the tables, so
titles and texts are listed per chunk of ids; each chunk is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlens.functions.jsonfmt import to_json
from cardlens.functions.text import contains_ci
from cardlens.params import Params
from cardlens.sources.cards import CardTables


def _listed(df: DataFrame, id_col: str, text_col: str, width: int, out: str, n_name: str) -> DataFrame:
    """Lists per chunk: ceil(n / width) hash buckets of the ids, n from a scalar
    count; the same rule for dense and hashed ids."""
    n = df.agg(F.count("*")).scalar()
    bucket = F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    chunk = F.pmod(bucket, F.greatest(F.ceil(n / F.lit(width)), F.lit(1)).cast("bigint"))
    g = (df.groupBy(chunk.alias("chunk"))
           .agg(F.count("*").alias(n_name),
                F.collect_list(F.struct(F.col(id_col), F.col(text_col))).alias("items")))
    return g.select("chunk", n_name,
                    to_json(F.transform(F.array_sort("items"), lambda x: x[text_col])).alias(out))


def active_promotions(cards: CardTables, p: Params, word: str | None = None) -> DataFrame:
    """title contains the word and the promotion runs on ``as_of``."""
    pr = cards.promotions(word or p.merchant)
    day = F.to_date(F.lit(p.as_of))
    return pr.where(contains_ci(F.col("title"), word or p.merchant)
                    & (F.col("start_date") <= day) & (F.col("end_date") >= day))


def promos_active(cards: CardTables, p: Params) -> DataFrame:
    """JSON lists of matching active promotion titles."""
    return _listed(active_promotions(cards, p), "promo_id", "title",
                   p.promo_chunk_parts, "events_json", "n_events")


def promos_overlap(cards: CardTables, p: Params) -> DataFrame:
    """F8: promotions running at any time in [promo_start, promo_end]."""
    pr = cards.promotions(p.promo_word)
    cond = (contains_ci(F.col("title"), p.promo_word)
            & (F.col("start_date") <= F.to_date(F.lit(p.promo_end)))
            & (F.col("end_date") >= F.to_date(F.lit(p.promo_start))))
    return _listed(pr.where(cond), "promo_id", "title", p.promo_chunk_parts, "events_json", "n_events")


def promos_body_match(cards: CardTables, p: Params) -> DataFrame:
    """F9 on the body column, active on ``as_of``."""
    pr = cards.promotions(body_word=p.merchant)
    day = F.to_date(F.lit(p.as_of))
    cond = (contains_ci(F.col("body"), p.merchant)
            & (F.col("start_date") <= day) & (F.col("end_date") >= day))
    return _listed(pr.where(cond), "promo_id", "title", p.promo_chunk_parts, "events_json", "n_events")


def matching_messages(cards: CardTables, p: Params, word: str | None = None) -> DataFrame:
    return cards.messages().where(contains_ci(F.col("msg_text"), word or p.message_word))


def messages_match(cards: CardTables, p: Params) -> DataFrame:
    """A11 + F9: JSON lists of whole message texts containing the word."""
    return _listed(matching_messages(cards, p), "msg_id", "msg_text",
                   p.message_chunk_docs, "messages_json", "n_messages")
