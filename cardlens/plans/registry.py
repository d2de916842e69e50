"""Named queries: the Spark job and its DuckDB oracle, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardlens.params import DEFAULT, Params
from cardlens.sources.cards import CardTables, TpchCards
from cardlens.plans import oracle_billing as ob
from cardlens.plans import oracle_logs as ol
from cardlens.operators import (attempts, campaign, catalog, discounts, ledger, payments, prompts, promos,
                                report, spans, spend)

SparkFn = Callable[[SparkSession, str, Params], DataFrame]


def on_tpch(fn: Callable[[CardTables, Params], DataFrame]) -> SparkFn:
    """Run a card report over the test tables' stand-ins."""
    def run(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
        return fn(TpchCards(spark, sf_dir), p)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def on_tpch_campaigns(fn) -> SparkFn:
    def run(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
        return fn(campaign.TpchCampaigns(spark, sf_dir), p)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run
OracleFn = Callable[[Params], str]

# name -> (spark job, oracle SQL builder or None for a rows-only check)
REGISTRY: dict[str, tuple[SparkFn, OracleFn | None]] = {
    "spend_total": (on_tpch(spend.spend_total), ob.spend_total),
    "spend_by_card": (on_tpch(spend.spend_by_card), ob.spend_by_card),
    "spend_by_month": (on_tpch(spend.spend_by_month), ob.spend_by_month),
    "spend_by_day": (on_tpch(spend.spend_by_day), ob.spend_by_day),
    "billed_by_month": (on_tpch(spend.billed_by_month), ob.billed_by_month),
    "spend_total_and_month": (on_tpch(spend.spend_total_and_month), ob.spend_total_and_month),
    "month_from_text": (on_tpch(spend.month_from_text), ob.month_from_text),
    "month_bounds": (on_tpch(spend.month_bounds), ob.month_bounds),
    "top_customers": (on_tpch(spend.top_customers), ob.top_customers),
    "discount_total": (on_tpch(discounts.discount_total), ob.discount_total),
    "discount_by_month": (on_tpch(discounts.discount_by_month), ob.discount_by_month),
    "discount_by_month_limit": (on_tpch(discounts.discount_by_month_limit), ob.discount_by_month_limit),
    "limit_remaining": (on_tpch(discounts.limit_remaining), ob.limit_remaining),
    "limit_for_month": (on_tpch(discounts.limit_for_month), ob.limit_for_month),
    "discount_info": (on_tpch(discounts.discount_info), ob.discount_info),
    "payments_json": (on_tpch(payments.payments_json), ob.payments_json),
    "monthly_json": (on_tpch(payments.monthly_json), ob.monthly_json),
    "promos_active": (on_tpch(promos.promos_active), ob.promos_active),
    "promos_overlap": (on_tpch(promos.promos_overlap), ob.promos_overlap),
    "promos_body_match": (on_tpch(promos.promos_body_match), ob.promos_body_match),
    "messages_match": (on_tpch(promos.messages_match), ob.messages_match),
    "campaign_customers": (on_tpch_campaigns(campaign.campaign_customers), ob.campaign_customers),
    "campaign_offer": (on_tpch_campaigns(campaign.campaign_offer), ob.campaign_offer),
    "campaign_offer_list": (on_tpch_campaigns(campaign.campaign_offer_list), ob.campaign_offer_list),
    "account_report": (on_tpch(report.account_report), ob.account_report),
    "table_profile": (catalog.table_profile, ol.table_profile),
    "largest_table": (catalog.largest_table, ol.largest_table),
    "schema_card": (catalog.whole_card, ol.schema_card),
    "schema_samples": (catalog.schema_samples, ol.schema_samples),
    "synonym_card": (catalog.synonym_card, ol.synonym_card),
    "table_copy": (catalog.table_copy, ol.table_copy),
    "run_named_sql": (catalog.run_named_sql, ol.run_named_sql),
    "question_ledger": (ledger.question_ledger, ol.question_ledger),
    "prompt_table": (prompts.prompt_table, ol.prompt_table),
    "prompt_budget": (prompts.prompt_budget, ol.prompt_budget),
    "prompt_tokens": (prompts.prompt_tokens, None),
    "repair_prompts": (prompts.repair_prompts, ol.repair_prompts),
    "answer_prompts": (prompts.answer_prompts, ol.answer_prompts),
    "response_clean": (attempts.response_clean, ol.response_clean),
    "sql_extract": (attempts.sql_extract, ol.sql_extract),
    "attempt_status": (attempts.attempt_status, ol.attempt_status),
    "attempt_outcome": (attempts.attempt_outcome, ol.attempt_outcome),
    "error_mix": (attempts.error_mix, ol.error_mix),
    "chunk_join": (attempts.chunk_join, ol.chunk_join),
    "display_truncate": (attempts.display_truncate, ol.display_truncate),
    "span_flatten": (spans.span_flatten, ol.span_flatten),
    "span_latency": (spans.span_latency, ol.span_latency),
    "token_usage": (spans.token_usage, ol.token_usage),
    "episodes": (spans.episodes, ol.episodes),
    "span_tree": (spans.span_tree, ol.span_tree),
}


def queries(p: Params = DEFAULT) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: SparkFn):
        return lambda spark, sf_dir: fn(spark, sf_dir, p)
    return {name: bind(fn) for name, (fn, _) in REGISTRY.items()}


def oracle_sql(p: Params = DEFAULT) -> dict[str, str]:
    return {name: ofn(p) for name, (_, ofn) in REGISTRY.items() if ofn is not None}
