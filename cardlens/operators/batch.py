"""Run a fixed list of reports one after another (S7) over one billing join.

The reference runs five questions in sequence, each re-reading the billing
table. Here the covering billing lines are joined once, written partitioned
by month to the shared folder, the promotions are written beside them, and
every report reads those tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cardlens.params import Params
from cardlens.session import shared_dir
from cardlens.sources.cards import CardTables, MaterializedCards


def covering_range(p: Params) -> tuple[str, str]:
    starts = [p.start, p.month_start, p.limit_month_start]
    ends = [p.end_exclusive, p.month_end_exclusive, p.limit_month_end_exclusive]
    return min(starts), max(ends)


def run_reports(cards: CardTables, p: Params,
                reports: dict[str, Callable[[CardTables, Params], DataFrame]],
                path: str | None = None) -> dict[str, DataFrame]:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    start, end = covering_range(p)
    path = path or shared_dir(spark, "billing_lines")  # a new folder for each batch
    promotions = path.rstrip("/") + "_promotions" if cards.has_promotions() else None
    mat = MaterializedCards.build(cards, p, path, start, end, promotions_path=promotions)
    return {name: fn(mat, p) for name, fn in reports.items()}
