"""Physical-plan checks: pushdown, pruning, semi joins, no Python in hot paths."""

import contextlib
import io

import __spark_entry__ as E
from conftest import SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_account_report_has_no_python(spark):
    text = plan(E.queries()["account_report"](spark, SMALL))
    assert "Python" not in text and "ArrowEval" not in text


def test_discount_total_plans_left_semi(spark):
    text = plan(E.queries()["discount_total"](spark, SMALL))
    assert "LeftSemi" in text


def test_billing_scan_pushdown_and_pruning(spark):
    text = plan(E.queries()["spend_by_month"](spark, SMALL))
    scan = [b for b in text.split("\n\n") if "lineitem.parquet" in b][0]
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThan(l_shipdate" in scan
    read = [ln for ln in scan.splitlines() if ln.startswith("ReadSchema")][0]
    assert "l_tax" not in read and "l_quantity" not in read


def test_campaign_has_no_fan_out_join(spark):
    text = plan(E.queries()["campaign_customers"](spark, SMALL))
    assert text.count("LeftSemi") >= 2
    assert "Inner" not in text


def test_day_queries_scan_days_only(spark):
    for name in ("month_from_text", "month_bounds"):
        text = plan(E.queries()[name](spark, SMALL))
        assert "Join" not in text and "part.parquet" not in text


def test_body_match_reduces_lines_before_they_are_aggregated(spark):
    text = plan(E.queries()["promos_body_match"](spark, SMALL))
    assert "LeftSemi" in text


def test_services_broadcast_is_hinted(spark):
    text = plan(E.queries()["limit_remaining"](spark, SMALL))
    assert "BroadcastHashJoin" in text


def test_plan_text_keeps_main_plan_around_subquery_blocks():
    import importlib.util
    import os
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts", "plans.py")
    spec = importlib.util.spec_from_file_location("plans_script", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    text = "\n".join([
        "AdaptiveSparkPlan isFinalPlan=true",
        "+- == Final Plan ==",
        "   Project [a, Subquery subquery AS s]",
        "      :  +- Subquery subquery",
        "      :     +- AdaptiveSparkPlan isFinalPlan=true",
        "            +- == Final Plan ==",
        "               SubFinal",
        "            +- == Initial Plan ==",
        "               SubInitial",
        "      +- MainChild",
        "         +- MainScan",
        "+- == Initial Plan ==",
        "   TopInitial",
    ])
    out = mod.drop_initial_plans(text)
    assert "SubFinal" in out and "MainChild" in out and "MainScan" in out
    assert "Initial" not in out
