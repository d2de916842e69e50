"""The reference's card tables, built as DataFrames over the test tables.

Mapping (one place, used by every report):

billing lines  = lineitem ⋈ part ⋈ orders; account o_custkey, date l_shipdate,
                 amount l_extendedprice, merchant p_name, card p_brand,
                 service p_type, discount amount*l_discount (NULL when 0),
                 billed principal = amount for returned lines ('R'), else NULL
services       = part grouped by p_type, limit = max(p_retailprice) * 100,
                 restricted to the discount-granting service list
promotions     = one per part: title p_name, body brand/type/name,
                 active from the part's first to its last ship day
messages       = documents (doc_id, text)
campaign msgs  = benchmark (item_id, text)
applications   = signup events: customer user_id, campaign props.$.k
sales          = orders: customer, order date, total price, status as product
                 code, first priority character as channel
META tables    = nation and region with a code, a name and synonyms
questions      = the first user turn of every four turns of a conversation;
                 replies = assistant turns, attempts 1 and 2 of their question
spans          = events: name event_type, duration value, key user_id

Filters are applied to the raw scan columns so they reach parquet as pushed
filters; derived columns are computed after the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.functions.dates import day_range
from cardlens.functions.text import contains_ci
from cardlens.params import Params
from cardlens.sources.tables import read_table

MONEY = "decimal(18,2)"


def money(c):
    return F.col(c).cast(MONEY) if isinstance(c, str) else c.cast(MONEY)


def billing_lines(spark: SparkSession, sf_dir: str, p: Params, *,
                  start: str | None = None, end_exclusive: str | None = None,
                  merchant: str | None = None, account: int | str | None = None,
                  use_range: bool = True, use_merchant: bool = True) -> DataFrame:
    """Billing lines (WBM_T_BLL_SPEC_IZ) for all accounts, or one.

    Join order: lines ⋈ (filtered) part on the part key, then ⋈ orders on the
    order key. Both are shuffle joins at scale; AQE turns a side that is small
    at runtime into a broadcast and splits a skewed key's partition.
    """
    start = start or p.start
    end_exclusive = end_exclusive or p.end_exclusive
    merchant = p.merchant if merchant is None else merchant
    account = p.account if account is None else account

    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice",
        "l_discount", "l_returnflag", "l_shipdate")
    if use_range:
        li = li.where(day_range("l_shipdate", start, end_exclusive))
    pt = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    if use_merchant and merchant:
        pt = pt.where(contains_ci(F.col("p_name"), merchant))
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if account is not None:
        od = od.where(F.col("o_custkey") == F.lit(account).cast("bigint"))

    lines = (li.join(pt, li.l_partkey == pt.p_partkey, "inner")
               .join(od, li.l_orderkey == od.o_orderkey, "inner"))
    amount = money("l_extendedprice")
    discount = F.nullif((amount * F.col("l_discount").cast("decimal(4,2)")).cast(MONEY),
                        F.lit(0).cast(MONEY))
    return lines.select(
        F.col("o_custkey").alias("acct"),
        # unique line id: order key and line number (TPC-H line numbers are 1-7)
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"),
        F.col("l_shipdate").cast("date").alias("sl_date"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("sl_ymd"),
        amount.alias("amount"),
        F.col("p_name").alias("merchant"),
        F.col("p_brand").alias("card"),
        F.col("p_type").alias("service"),
        discount.alias("discount"),
        F.when(F.col("l_returnflag") == "R", amount).alias("billed"),
    )


def services(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Service table (WPD_T_SV_SNGL_PRP_INF): code and monthly discount limit."""
    pt = read_table(spark, sf_dir, "part").select("p_type", "p_retailprice")
    pt = pt.where(F.col("p_type").isin(list(p.known_services)))
    return (pt.groupBy(F.col("p_type").alias("sv_code"))
              .agg((F.max("p_retailprice") * 100).cast(MONEY).alias("monthly_limit")))


def accounts(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """All accounts, or the asked one: one row each."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("acct"))
    return c if p.account is None else c.where(F.col("acct") == F.lit(p.account).cast("bigint"))


def payment_days(spark: SparkSession, sf_dir: str, start: str, end_exclusive: str) -> DataFrame:
    """The distinct payment days of a range; only the date column is scanned."""
    li = read_table(spark, sf_dir, "lineitem").select("l_shipdate").where(
        day_range("l_shipdate", start, end_exclusive))
    return li.select(F.col("l_shipdate").cast("date").alias("sl_date")).distinct().select(
        "sl_date", F.date_format("sl_date", "yyyyMMdd").alias("sl_ymd"))


def promotions(spark: SparkSession, sf_dir: str, title_word: str | None = None,
               body_word: str | None = None) -> DataFrame:
    """Promotions (WLP_T_EVN_INF): one per part, active over its ship days.

    Lines are reduced to one row per part (partial aggregation map-side) before
    the join with part, so a hot part costs one row per map task. When the
    caller filters titles or bodies by a word, only lines of matching parts are
    aggregated (a semi join ahead of the aggregate).
    """
    body = F.concat_ws(" ", "p_brand", "p_type", "p_name")
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate")
    pt = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    if title_word:
        pt = pt.where(contains_ci(F.col("p_name"), title_word))
    if body_word:
        pt = pt.where(contains_ci(body, body_word))
    if title_word or body_word:
        li = li.join(pt.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    span = (li.groupBy("l_partkey")
            .agg(F.min("l_shipdate").cast("date").alias("start_date"),
                 F.max("l_shipdate").cast("date").alias("end_date")))
    return (span.join(pt, span.l_partkey == pt.p_partkey, "inner")
                .select(F.col("p_partkey").alias("promo_id"),
                        F.col("p_name").alias("title"),
                        body.alias("body"),
                        "start_date", "end_date"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sent messages (WSC_T_UMS_FW_HIST)."""
    return read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("msg_id"), F.col("text").alias("msg_text"))


def campaign_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign messages (WSC_V_UMS_FW_HIST): campaign id and message text."""
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("cmp_id"), F.col("text").alias("msg_text"))


def campaign_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign applications (WMK_T_CMP_APL_OJP): customer and campaign."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_type", "props")
    return (ev.where(F.col("event_type") == "signup")
              .select(F.col("user_id").alias("cno"),
                      F.get_json_object("props", "$.k").cast("bigint").alias("cmp_id")))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales (WMG_T_D_SL_OUT): customer, day, amount, product code, channel."""
    od = read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return od.select(
        F.col("o_custkey").alias("pss_cno"),
        F.col("o_orderdate").alias("st_ts"),
        money("o_totalprice").alias("sl_am"),
        F.col("o_orderstatus").alias("sl_pd_dc"),
        F.substring("o_orderpriority", 1, 1).alias("apl_phc"),
    )


def meta_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Code/name/synonym dictionaries (tables whose name contains META)."""
    na = read_table(spark, sf_dir, "nation")
    rg = read_table(spark, sf_dir, "region")
    meta_nation = (na.join(rg, na.n_regionkey == rg.r_regionkey, "left")
                     .select(F.col("n_nationkey").cast("string").alias("code"),
                             F.col("n_name").alias("name"),
                             F.when(F.col("r_name") != "AFRICA", F.col("r_name")).alias("synonyms")))
    meta_region = rg.select(
        F.col("r_regionkey").cast("string").alias("code"),
        F.col("r_name").alias("name"),
        F.when(F.col("r_regionkey") == 0, F.lit("")).otherwise(F.lower("r_name")).alias("synonyms"))
    return {"meta_nation": meta_nation, "meta_region": meta_region}


def _question_id():
    """A conversation is cut in groups of four turns: a question, its first reply, a
    request to repair it, and a second reply. The group is the question."""
    return F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.expr("turn div 4").cast("string"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions (q_id, question): the first user turn of each group."""
    cv = read_table(spark, sf_dir, "conversations")
    return cv.where((F.col("role") == "user") & (F.col("turn") % 4 == 0)).select(
        _question_id().alias("q_id"), F.col("text").alias("question"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies: assistant turns (conv_id, turn, text)."""
    cv = read_table(spark, sf_dir, "conversations")
    return cv.where(F.col("role") == "assistant").select("conv_id", "turn", "text")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored SQL attempts, one per assistant turn, numbered within their question.

    Each reply is one of the four shapes on record (bare statement, prose then
    ``SQLQuery:``, code fence, statement naming a missing column), and the
    stored result text is what the database returned for the reply sent raw. The
    statements hold semicolons that do not end them, in literals, quoted names and
    comments, and some fenced ones have none of their own.
    """
    r = replies(spark, sf_dir)
    shape = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    first_word = F.regexp_extract("text", r"^([^ \n]+)", 1)
    first_line = F.regexp_extract("text", r"^([^\n]*)", 1)
    cid = F.col("conv_id").cast("string")
    literal, name = F.lit(" AND l_comment <> 'it''s; --'"), F.lit('SELECT sum(l_quantity) AS "q;1"')
    note = F.lit(" /* by; account */ FROM orders -- all; of them\n")
    last = F.when(F.col("conv_id") % 4 == 0, F.lit("")).otherwise(F.lit(";"))
    reply = (F.when(shape == 0, F.concat(F.lit("SELECT count(*) AS n FROM lineitem WHERE l_orderkey = "), cid, literal, F.lit(";")))
              .when(shape == 1, F.concat(first_line, F.lit("\n\nSQLQuery: SELECT count(*) AS n"), note, F.lit("WHERE o_custkey = "), cid, F.lit("; That is it.")))
              .when(shape == 2, F.concat(F.lit("Here is the query:\n```sql\n"), name, F.lit(" FROM lineitem WHERE l_partkey = "), cid, last, F.lit("\n```")))
              .otherwise(F.concat(F.lit("SELECT l_missing FROM lineitem WHERE l_orderkey = "), cid, F.lit(";"))))
    result = (F.when(shape == 0, F.lit("[(1,)]"))
               .when(shape == 1, F.concat(F.lit('Error: (sqlite3.OperationalError) near "'), first_word, F.lit('": syntax error')))
               .when(shape == 2, F.lit('Error: (sqlite3.OperationalError) near "Here": syntax error'))
               .otherwise(F.lit("Error: (sqlite3.OperationalError) no such column: l_missing")))
    return r.select(_question_id().alias("q_id"), F.expr("turn % 4 div 2 + 1").alias("attempt_no"),
                    reply.alias("reply"), result.alias("result_text"))


def reply_chunks(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Replies as stored chunks of ``size`` characters (conv_id, turn, chunk_no, chunk)."""
    r = replies(spark, sf_dir)
    n = F.ceil(F.length("text") / size).cast("int")
    r = r.where(F.length("text") > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return r.select("conv_id", "turn", "chunk_no",
                    F.substring("text", F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span records: one per event."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("span_id"),
        F.col("user_id").alias("trace_key"),
        F.col("event_type").alias("name"),
        F.col("ts").alias("start_ts"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("OK")).alias("status"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"),
        (F.col("event_id") % 50).alias("output_tokens"),
        # views and clicks are calls of a model, a third of them without its name
        F.when(F.col("event_type").isin("view", "click") & (F.col("event_id") % 3 != 0),
               F.concat(F.lit("model-"), (F.col("event_id") % 2).cast("string"))).alias("model"),
        # traces of 64 spans, each a binary tree below its first
        F.when(F.col("event_id") % 64 != 0,
               F.expr("event_id - event_id % 64 + (event_id % 64 - 1) div 2")).alias("parent_id"),
    )
