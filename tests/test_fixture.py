"""Reports on the hand fixture, expected values written by hand."""

import json

import pytest
from pyspark.sql import functions as F

import fixtures as FX
from cardlens.operators import discounts, payments, promos, report, spend


@pytest.fixture(scope="module")
def cards(spark):
    return FX.cards(spark)


P = FX.params()


def rows(df, *cols):
    return sorted(tuple("" if r[c] is None else r[c] for c in cols) for r in df.collect())


def test_spend_by_month(cards):
    got = rows(spend.spend_by_month(cards, P), "acct", "month", "total_spent")
    assert got == [("0042", "", 1111.0), ("0042", "2023-03", 2500.0), ("0042", "2023-04", 8800.0),
                   ("0042", "2023-05", 5900.0)]


def test_spend_total_and_rollup_agree(cards):
    total = rows(spend.spend_total(cards, P), "acct", "total_spent", "n_payments")
    assert total == [("0042", 18311.0, 9)]
    r = spend.spend_total_and_month(cards, P)
    levels = {(x["acct"], x["month"], x["level"]): x["total_spent"] for x in r.collect()}
    assert levels[("0042", None, 1)] == 18311.0
    assert levels[(None, None, 3)] == 18311.0
    assert sum(v for (a, m, lv), v in levels.items() if lv == 0) == 18311.0


def test_spend_by_day_two_lines_one_day(cards):
    got = dict(rows(spend.spend_by_day(cards, P), "payment_date", "total_spent"))
    assert got["20230403"] == 5500.0
    assert len(got) == 8


def test_spend_by_card_all_merchants(cards):
    got = rows(spend.spend_by_card(cards, P), "acct", "card_name", "total_amount")
    # the invalid date is inside the text range and counts, as in SQLite
    assert ("0042", "Card A", 2500.0 + 4000 + 3300 + 2200 + 900 + 1111 + 5000) in got
    assert ("77", "Card C", 9500.0) in got


def test_billed_by_month_falls_back_to_amount(cards):
    got = dict(rows(spend.billed_by_month(cards, P), "month", "billed_total"))
    assert got["2023-04"] == 4000 + 1500 + 3000


def test_discounts(cards):
    assert rows(discounts.discount_total(cards, P), "acct", "total_discount", "n_discounted") == \
        [("0042", 860.0, 4)]
    assert rows(discounts.discount_by_month(cards, P), "month", "monthly_discount") == \
        [("2023-04", 550.0), ("2023-05", 310.0)]


def test_limit_remaining(cards):
    got = rows(discounts.limit_remaining(cards, P), "acct", "service", "monthly_limit", "used", "remaining")
    # listed services at the merchant; idle accounts show the whole limit
    assert got == [("0042", "S1", 10000.0, 310.0, 9690.0), ("77", "S1", 10000.0, 0.0, 10000.0),
                   ("900", "S1", 10000.0, 0.0, 10000.0)]
    # the asked service at all merchants
    got = rows(discounts.limit_for_month(cards, P), "acct", "remaining")
    assert got == [("0042", 9280.0), ("77", 9800.0), ("900", 10000.0)]


def test_limit_of_one_account_that_is_idle(cards, spark):
    from cardlens.sources.cards import RecordCards
    bare = RecordCards(cards.billing_df, cards.services_df)  # no account table
    for account in ("900", "12345"):
        got = rows(discounts.limit_remaining(bare, FX.params(account=account)), "acct", "remaining")
        assert got == [(account, 10000.0)]
    assert rows(discounts.limit_for_month(bare, FX.params(account="0042")), "acct", "remaining") == [("0042", 9280.0)]


def test_discount_by_month_limit_repeats_remaining(cards):
    got = rows(discounts.discount_by_month_limit(cards, P), "month", "monthly_discount", "remaining_limit")
    assert got == [("2023-04", 550.0, 9780.0), ("2023-05", 220.0, 9780.0)]


def test_discount_info_keeps_nulls_and_numbers(cards):
    got = {r["acct"]: json.loads(r["discount_info"]) for r in discounts.discount_info(cards, P).collect()}
    assert got == {"0042": {"total_discount": 930.0, "discount_limit": 10000.0, "remaining_limit": 9280.0}}


def test_payments_json_is_whole_and_sorted(cards):
    df = payments.payments_json(cards, P).where(F.col("acct") == "0042")
    chunks = df.collect()
    items = [x for c in chunks for x in json.loads(c["payments"])]
    assert len(items) == 9
    assert sum(x["amount"] for x in items) == 18311
    assert any(x["discount"] is None for x in items)  # NULL kept
    for c in chunks:
        dates = [x["date"] for x in json.loads(c["payments"])]
        assert dates == sorted(dates)
        assert c["n_payments"] <= 2 * P.payment_chunk_lines


def test_monthly_json(cards):
    r = {x["acct"]: x for x in payments.monthly_json(cards, P).collect()}["0042"]
    assert [m["month"] for m in json.loads(r["monthly_spending"])] == [None, "2023-03", "2023-04", "2023-05"]
    assert [m["total_discount"] for m in json.loads(r["monthly_discounts"])] == [550, 310]


def test_promotions_active_and_overlap(cards):
    act = promos.promos_active(cards, P).collect()
    assert [json.loads(r["events_json"]) for r in act] == [["Tea House spring card"]]
    ov = [t for r in promos.promos_overlap(cards, P).collect() for t in json.loads(r["events_json"])]
    assert sorted(ov) == ["Tea House opening week", "Tea House spring card"]


def test_messages_whole_text(cards):
    got = [t for r in promos.messages_match(cards, P).collect() for t in json.loads(r["messages_json"])]
    assert got == ["Tea House: a free refill on Friday"]


def test_account_report(cards):
    r = {x["acct"]: x for x in report.account_report(cards, P).collect()}
    a = r["0042"]
    assert a["total_spent"] == 18311.0 and a["n_payments"] == 9
    assert a["total_discount_received"] == 860.0
    assert a["discount_limit"] == 10000.0 and a["used_this_month"] == 310.0
    assert a["remaining_discount_limit"] == 9690.0
    assert a["n_related_events"] == 1 and a["n_related_messages"] == 1
    days = json.loads(a["daily_spending"])
    assert len(days) == 8 and sum(d["amount"] for d in days) == 18311
    assert "77" not in r  # no lines at the merchant


def test_account_filter(cards):
    one = spend.spend_total(cards, FX.params(account="77", merchant="bakery"))
    assert rows(one, "acct", "total_spent") == [("77", 9500.0)]


def test_top_customers_tie_key(spark):
    from cardlens.sources.cards import RecordCards
    b = spark.createDataFrame([
        ("2", "20230401", 100, "Tea", None, None, None, None),
        ("1", "20230401", 100, "Tea", None, None, None, None),
        ("3", "20230401", 50, "Tea", None, None, None, None)], FX.BILLING_SCHEMA)
    got = spend.top_customers(RecordCards(b), FX.params(top_k=2))
    assert [r["acct"] for r in got.collect()] == ["1", "2"]


def test_hashed_ids_share_lists(spark):
    from cardlens.sources.cards import RecordCards
    msgs = spark.createDataFrame([(f"tea note {i}",) for i in range(10)], "UMS_MSG_CN string")
    c = FX.cards(spark)
    cards = RecordCards(c.billing_df, c.services_df, c.promotions_df, msgs)
    out = promos.messages_match(cards, FX.params(message_chunk_docs=4)).collect()
    assert sum(r["n_messages"] for r in out) == 10
    assert len(out) <= 3
    assert sorted(t for r in out for t in json.loads(r["messages_json"])) == sorted(f"tea note {i}" for i in range(10))


def test_body_match_finds_words_outside_the_title(cards):
    got = [t for r in promos.promos_body_match(cards, P).collect() for t in json.loads(r["events_json"])]
    assert got == ["Book fair"]


def test_equal_payments_are_split_and_whole(spark):
    from cardlens.sources.cards import RecordCards
    b = spark.createDataFrame([("9", "20230401", 10, "Tea", None, None, None, None)] * 500, FX.BILLING_SCHEMA)
    out = payments.payments_json(RecordCards(b), FX.params(payment_chunk_lines=50)).collect()
    assert len(out) >= 10 and sum(r["n_payments"] for r in out) == 500
    assert all(len(json.loads(r["payments"])) == r["n_payments"] <= 100 for r in out)


def test_an_account_within_the_width_has_one_list(spark):
    from cardlens.params import DEFAULT
    from cardlens.sources.cards import TpchCards
    from conftest import SMALL
    cards = TpchCards(spark, SMALL)
    p = DEFAULT.with_(start="1990-01-01", end="2010-12-31", merchant="")
    out = payments.payments_json(cards, p)
    assert out.count() == out.select("acct").distinct().count()
    assert out.agg(F.sum("n_payments")).first()[0] == 6000
