"""Reports over the materialised billing table equal the direct reports."""

import tempfile

from cardlens.operators import batch, discounts, payments, promos, report, spend
from cardlens.params import DEFAULT
from cardlens.plans.compare import norm
from cardlens.sources.cards import TpchCards
from conftest import SMALL

REPORTS = {
    "spend_by_month": spend.spend_by_month,
    "spend_by_card": spend.spend_by_card,
    "limit_for_month": discounts.limit_for_month,
    "discount_info": discounts.discount_info,
    "payments_json": payments.payments_json,
    "account_report": report.account_report,
    "promos_active": promos.promos_active,
    "promos_overlap": promos.promos_overlap,
}


def _rows(df):
    return sorted((tuple(norm(x) for x in r) for r in df.collect()), key=str)


def test_materialized_reports_match(spark):
    cards = TpchCards(spark, SMALL)
    out = batch.run_reports(cards, DEFAULT, REPORTS, tempfile.mkdtemp(prefix="cardlens-bl-"))
    for name, fn in REPORTS.items():
        assert _rows(out[name]) == _rows(fn(cards, DEFAULT)), name


def test_invalid_days_and_missing_promotions(spark):
    """A line whose day is no date stays in the batch; a source may lack promotions."""
    import fixtures as FX
    from cardlens.sources.cards import RecordCards
    full = FX.cards(spark)
    cards = RecordCards(full.billing_df, full.services_df, None, full.messages_df, full.accounts_df)
    reports = {"spend_total": spend.spend_total, "spend_by_month": spend.spend_by_month,
               "limit_remaining": discounts.limit_remaining, "discount_info": discounts.discount_info,
               "payments_json": payments.payments_json}
    p = FX.params()
    out, again = batch.run_reports(cards, p, reports), batch.run_reports(cards, p, reports)
    for name, fn in reports.items():
        assert _rows(out[name]) == _rows(fn(cards, p)) == _rows(again[name]), name
    assert out["spend_total"].first()["n_payments"] == 9


def test_files_per_month_are_that_many(spark):
    import glob
    from cardlens.sources.cards import MaterializedCards
    path = tempfile.mkdtemp(prefix="cardlens-bl-")
    MaterializedCards.build(TpchCards(spark, SMALL), DEFAULT, path, "1997-07-01", "1997-08-01", files_per_month=8)
    assert len(glob.glob(path + "/sl_month=199707/*.parquet")) == 8


def test_month_partitions_are_pruned(spark):
    import contextlib
    import io
    cards = TpchCards(spark, SMALL)
    out = batch.run_reports(cards, DEFAULT, {"m": spend.spend_by_month}, tempfile.mkdtemp(prefix="cardlens-bl-"))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out["m"].explain("formatted")
    assert "PartitionFilters: [isnotnull(sl_month" in buf.getvalue()


def test_promotions_are_read_from_the_written_table(spark):
    import contextlib
    import io
    cards = TpchCards(spark, SMALL)
    path = tempfile.mkdtemp(prefix="cardlens-bl-")
    out = batch.run_reports(cards, DEFAULT, {"p": promos.promos_active}, path)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out["p"].explain("formatted")
    plan = buf.getvalue()
    assert path + "_promotions" in plan and "lineitem" not in plan
