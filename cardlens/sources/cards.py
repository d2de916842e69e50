"""Card tables behind one interface.

Reports take a ``CardTables`` and read canonical frames from it:

billing    acct, line_id, sl_date, sl_ymd, amount, merchant, card, service, discount, billed
           (sl_ymd: the day as yyyyMMdd text; sl_date is NULL where that is no date)
accounts   acct, one row per account
days       sl_date, sl_ymd of the payment days, distinct
services   sv_code, monthly_limit
promotions promo_id, title, body, start_date, end_date
messages   msg_id, msg_text

``TpchCards`` builds them from the test tables (see ``standins``);
``RecordCards`` reads tables in the reference's own layout (``ACCTNO``,
``SL_DT`` as ``yyyyMMdd`` text, ...). In both, range, merchant and account
filters are applied to raw source columns so they reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.functions.dates import parse_ymd
from cardlens.functions.text import contains_ci
from cardlens.params import Params
from cardlens.sources import standins

MONEY = "decimal(18,2)"


class CardTables:
    def billing(self, p: Params, *, start: str | None = None, end_exclusive: str | None = None,
                use_range: bool = True, use_merchant: bool = True) -> DataFrame:
        raise NotImplementedError

    def accounts(self, p: Params) -> DataFrame:
        """One row per account, whether or not it has billing lines."""
        raise NotImplementedError

    def days(self, p: Params) -> DataFrame:
        """The distinct payment days in the asked range."""
        return self.billing(p, use_merchant=False).select("sl_date", "sl_ymd").distinct()

    def services(self, p: Params) -> DataFrame:
        raise NotImplementedError

    def services_row_bound(self, p: Params) -> int | None:
        """A proven upper bound on the service table's rows, if there is one."""
        return None

    def promotions(self, title_word: str | None = None, body_word: str | None = None) -> DataFrame:
        """All promotions; the words let a source prune early (callers still
        filter titles and bodies themselves)."""
        raise NotImplementedError

    def has_promotions(self) -> bool:
        return True

    def messages(self) -> DataFrame:
        raise NotImplementedError


@dataclass
class TpchCards(CardTables):
    spark: SparkSession
    sf_dir: str

    def billing(self, p, *, start=None, end_exclusive=None, use_range=True, use_merchant=True):
        return standins.billing_lines(self.spark, self.sf_dir, p, start=start, end_exclusive=end_exclusive,
                                      use_range=use_range, use_merchant=use_merchant)

    def accounts(self, p):
        return standins.accounts(self.spark, self.sf_dir, p)

    def days(self, p):
        if p.account is not None:
            return super().days(p)
        return standins.payment_days(self.spark, self.sf_dir, p.start, p.end_exclusive)

    def services(self, p):
        return standins.services(self.spark, self.sf_dir, p)

    def services_row_bound(self, p):
        # grouped by p_type and filtered to the listed codes: one row per code
        return len(p.known_services)

    def promotions(self, title_word=None, body_word=None):
        return standins.promotions(self.spark, self.sf_dir, title_word, body_word)

    def messages(self):
        return standins.messages(self.spark, self.sf_dir)


def _ymd(day: str) -> str:
    return day.replace("-", "")


@dataclass
class RecordCards(CardTables):
    """Tables in the reference's layout.

    billing    ACCTNO, SL_DT (yyyyMMdd), SL_AM, BLL_MC_NM, UNIT_CD_NM, BIL_PRN, BLL_SV_AM, BLL_SV_DC
    services   SV_C, MLIM_AM
    promotions EVN_BULT_TIT_NM, EVN_BULT_CN, EVN_SDT, EVN_EDT (yyyyMMdd)
    messages   UMS_MSG_CN
    """
    billing_df: DataFrame
    services_df: DataFrame | None = None
    promotions_df: DataFrame | None = None
    messages_df: DataFrame | None = None
    accounts_df: DataFrame | None = None  # ACCTNO; else the accounts of the billing lines

    def has_promotions(self):
        return self.promotions_df is not None

    def accounts(self, p):
        if p.account is not None:  # asked by number: it has a row even without a line
            kind = self.billing_df.schema["ACCTNO"].dataType
            return self.billing_df.sparkSession.range(1).select(F.lit(str(p.account)).cast(kind).alias("acct"))
        src = self.billing_df if self.accounts_df is None else self.accounts_df
        return src.select(F.col("ACCTNO").alias("acct")).where("acct is not null").distinct()

    def billing(self, p, *, start=None, end_exclusive=None, use_range=True, use_merchant=True):
        b = self.billing_df
        start = start or p.start
        end_exclusive = end_exclusive or p.end_exclusive
        if use_range:  # text comparison on the raw column: pushed to the scan
            b = b.where((F.col("SL_DT") >= _ymd(start)) & (F.col("SL_DT") < _ymd(end_exclusive)))
        if use_merchant and p.merchant:
            b = b.where(contains_ci(F.col("BLL_MC_NM"), p.merchant))
        if p.account is not None:
            b = b.where(F.col("ACCTNO") == F.lit(str(p.account)).cast(b.schema["ACCTNO"].dataType))
        cols = b.columns
        # equal rows share this id; nothing may take it for a key of a line
        line_id = F.xxhash64(*[F.col(c) for c in cols])
        billed = F.col("BIL_PRN").cast(MONEY) if "BIL_PRN" in cols else F.lit(None).cast(MONEY)
        card = F.col("UNIT_CD_NM") if "UNIT_CD_NM" in cols else F.lit(None).cast("string")
        return b.select(
            F.col("ACCTNO").alias("acct"),
            line_id.alias("line_id"),
            parse_ymd(F.col("SL_DT")).alias("sl_date"),
            F.col("SL_DT").alias("sl_ymd"),
            F.col("SL_AM").cast(MONEY).alias("amount"),
            F.col("BLL_MC_NM").alias("merchant"),
            card.alias("card"),
            F.col("BLL_SV_DC").alias("service"),
            F.col("BLL_SV_AM").cast(MONEY).alias("discount"),
            billed.alias("billed"),
        )

    def services(self, p):
        """One row per code (a repeated code keeps its largest limit)."""
        s = self.services_df
        return s.groupBy(F.col("SV_C").alias("sv_code")).agg(
            F.max(F.col("MLIM_AM").cast(MONEY)).alias("monthly_limit"))

    def promotions(self, title_word=None, body_word=None):
        e = self.promotions_df
        return e.select(
            F.xxhash64("EVN_BULT_TIT_NM", "EVN_SDT", "EVN_EDT").alias("promo_id"),
            F.col("EVN_BULT_TIT_NM").alias("title"),
            F.col("EVN_BULT_CN").alias("body"),
            parse_ymd(F.col("EVN_SDT")).alias("start_date"),
            parse_ymd(F.col("EVN_EDT")).alias("end_date"))

    def messages(self):
        m = self.messages_df
        return m.select(F.xxhash64("UMS_MSG_CN").alias("msg_id"), F.col("UMS_MSG_CN").alias("msg_text"))


@dataclass
class MaterializedCards(CardTables):
    """Billing lines of a covering day range joined once and written to the
    shared checkpoint folder, partitioned by the month of the day's text, so
    that lines whose text is no date stay in the table.

    Every later report reads the written table: the month filter prunes
    partitions, the day filter is pushed into the files, and the lineage back
    to the source joins is cut (a lost executor recomputes from the written
    files, not from the joins). With ``promotions_path`` the promotions (on the
    test tables a per-part aggregate over every line) are written once as well,
    so reports of the batch read them instead of re-aggregating all lines.
    Services and messages are delegated to the source.
    """
    source: CardTables
    path: str
    promotions_path: str | None = None

    @classmethod
    def build(cls, source: CardTables, p: Params, path: str, start: str, end_exclusive: str,
              files_per_month: int | None = None,
              promotions_path: str | None = None) -> "MaterializedCards":
        b = source.billing(p.with_(account=None), start=start, end_exclusive=end_exclusive,
                           use_merchant=False)
        b = b.withColumn("sl_month", F.substring("sl_ymd", 1, 6))
        if files_per_month:
            b = b.repartition(files_per_month)  # every task holds a share of each month
        b.write.mode("overwrite").partitionBy("sl_month").parquet(path)
        if promotions_path:
            source.promotions().write.mode("overwrite").parquet(promotions_path)
        return cls(source, path, promotions_path)

    def _spark(self):
        from pyspark.sql import SparkSession
        return SparkSession.getActiveSession()

    def billing(self, p, *, start=None, end_exclusive=None, use_range=True, use_merchant=True):
        spark = self._spark()
        b = spark.read.schema(self.source.billing(p).withColumn("sl_month", F.lit("")).schema).parquet(self.path)
        start = start or p.start
        end_exclusive = end_exclusive or p.end_exclusive
        if use_range:
            first, last = _ymd(start), _ymd(end_exclusive)
            b = b.where((F.col("sl_month") >= first[:6]) & (F.col("sl_month") <= last[:6])
                        & (F.col("sl_ymd") >= first) & (F.col("sl_ymd") < last))
        if use_merchant and p.merchant:
            b = b.where(contains_ci(F.col("merchant"), p.merchant))
        if p.account is not None:
            b = b.where(F.col("acct") == F.lit(str(p.account)).cast(b.schema["acct"].dataType))
        return b.drop("sl_month")

    def accounts(self, p):
        return self.source.accounts(p)

    def services(self, p):
        return self.source.services(p)

    def services_row_bound(self, p):
        return self.source.services_row_bound(p)

    def promotions(self, title_word=None, body_word=None):
        if self.promotions_path:  # callers filter titles and bodies themselves
            return self._spark().read.parquet(self.promotions_path)
        return self.source.promotions(title_word, body_word)

    def messages(self):
        return self.source.messages()
