"""Campaign responders and offer cost.

The reference joins applications ⋈ messages ⋈ sales and then takes DISTINCT
customers, which multiplies rows by messages × sales per customer first. Here
each side is reduced to distinct keys and applied as a left semi join, which
gives the same customer set without the fan-out.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.functions.dates import day_range
from cardlens.functions.text import contains_ci
from cardlens.params import Params
from cardlens.sources import standins


def _end_exclusive(day: str) -> str:
    return (_dt.date.fromisoformat(day) + _dt.timedelta(days=1)).isoformat()


class CampaignTables:
    """applications (cno, cmp_id); messages (cmp_id, msg_text);
    sales in a day range (pss_cno, sl_am, sl_pd_dc, apl_phc)."""

    def applications(self) -> DataFrame:
        raise NotImplementedError

    def messages(self) -> DataFrame:
        raise NotImplementedError

    def sales_between(self, start: str, end_exclusive: str) -> DataFrame:
        raise NotImplementedError


@dataclass
class TpchCampaigns(CampaignTables):
    spark: SparkSession
    sf_dir: str

    def applications(self):
        return standins.campaign_applications(self.spark, self.sf_dir)

    def messages(self):
        return standins.campaign_messages(self.spark, self.sf_dir)

    def sales_between(self, start, end_exclusive):
        return standins.sales(self.spark, self.sf_dir).where(day_range("st_ts", start, end_exclusive))


@dataclass
class RecordCampaigns(CampaignTables):
    """Tables in the reference's layout: WMK_T_CMP_APL_OJP (CNO, CMP_ID),
    WSC_V_UMS_FW_HIST (CMP_ID, UMS_MSG_DTL_CN), WMG_T_D_SL_OUT (PSS_CNO,
    STDT yyyyMMdd, SL_AM, SL_PD_DC, APL_PHC)."""
    applications_df: DataFrame
    messages_df: DataFrame
    sales_df: DataFrame

    def applications(self):
        return self.applications_df.select(F.col("CNO").alias("cno"), F.col("CMP_ID").alias("cmp_id"))

    def messages(self):
        return self.messages_df.select(F.col("CMP_ID").alias("cmp_id"), F.col("UMS_MSG_DTL_CN").alias("msg_text"))

    def sales_between(self, start, end_exclusive):
        s = self.sales_df.where((F.col("STDT") >= start.replace("-", ""))
                                & (F.col("STDT") < end_exclusive.replace("-", "")))
        return s.select(F.col("PSS_CNO").alias("pss_cno"), F.col("SL_AM").cast("decimal(18,2)").alias("sl_am"),
                        F.col("SL_PD_DC").cast("string").alias("sl_pd_dc"), F.col("APL_PHC").alias("apl_phc"))


def responders(ct: CampaignTables, p: Params, *, benefit_phrase: bool = False) -> DataFrame:
    """Distinct customers who applied to a matching campaign and bought."""
    cond = contains_ci(F.col("msg_text"), p.campaign_word)
    if benefit_phrase:
        cond = cond & contains_ci(F.col("msg_text"), p.campaign_benefit_word)
    campaigns = ct.messages().where(cond).select("cmp_id").distinct()

    s = ct.sales_between(p.campaign_start, _end_exclusive(p.campaign_end))
    amount = F.col("sl_am")
    floor = F.lit(p.campaign_min_amount).cast("decimal(18,2)")
    scond = ((amount >= floor) if p.campaign_inclusive else (amount > floor)) \
        & (F.col("sl_pd_dc") == F.lit(str(p.campaign_product)))
    if p.campaign_channel is not None:
        scond = scond & (F.col("apl_phc") == p.campaign_channel)
    buyers = s.where(scond).select(F.col("pss_cno").alias("cno")).distinct()

    return (ct.applications().join(campaigns, "cmp_id", "left_semi")
              .join(buyers, "cno", "left_semi")
              .select("cno").distinct())


def campaign_customers(ct: CampaignTables, p: Params) -> DataFrame:
    """A3: the customer list."""
    return responders(ct, p)


def campaign_offer(ct: CampaignTables, p: Params) -> DataFrame:
    """A4 + F10: COUNT(DISTINCT customer) × benefit, one row."""
    r = responders(ct, p, benefit_phrase=True)
    return r.agg(F.count("*").alias("n_customers"),
                 (F.count("*") * F.lit(p.benefit).cast("bigint")).alias("total_offer"))


def campaign_offer_list(ct: CampaignTables, p: Params) -> DataFrame:
    """A5: the customer list and the total offer together.

    SQLite accepts a bare column beside the aggregate and returns one arbitrary
    row; here every customer is listed with its benefit and the total, taken
    from a scalar subquery computed once. List and total share the exchange of
    the distinct responders; building the frame runs no job.
    """
    r = responders(ct, p, benefit_phrase=True)
    total = r.agg((F.count("*") * F.lit(p.benefit).cast("bigint")).alias("t")).scalar()
    return r.select("cno", F.lit(p.benefit).cast("bigint").alias("benefit"),
                    total.alias("total_offer"))
