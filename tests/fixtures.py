"""Hand fixture in the reference's table layout; every value is made up.

Account 0042 at merchants named like 'tea': March 2,500, April 8,800, May 5,900 and
1,111 on a day that is no date, together 18,311 over nine lines. May's discounts
tell the three meanings of use apart: 310 of listed services at the merchant, 220 of
S1 at the merchant, 720 of S1 anywhere.
"""

from pyspark.sql import types as T

BILLING_SCHEMA = T.StructType([
    T.StructField("ACCTNO", T.StringType()),
    T.StructField("SL_DT", T.StringType()),
    T.StructField("SL_AM", T.LongType()),
    T.StructField("BLL_MC_NM", T.StringType()),
    T.StructField("UNIT_CD_NM", T.StringType()),
    T.StructField("BIL_PRN", T.LongType()),
    T.StructField("BLL_SV_AM", T.LongType()),
    T.StructField("BLL_SV_DC", T.StringType()),
])

BILLING = [
    ("0042", "20230310", 2500, "Tea House North", "Card A", 2500, None, None),
    ("0042", "20230403", 4000, "tea house", "Card A", 4000, 400, "S1"),
    ("0042", "20230403", 1500, "TEA HOUSE", "Card B", None, 150, "S1"),     # same day; NULL billed principal
    ("0042", "20230418", 3300, "Tea House", "Card A", 3000, None, None),    # billed below amount
    ("0042", "20230502", 2200, "Tea House", "Card A", 2200, 220, "S1"),
    ("0042", "20230511", 1800, "Tea House", "Card B", 1800, 90, "S2"),
    ("0042", "20230515", 1000, "Tea House", "Card B", 1000, 70, "S3"),      # service not listed
    ("0042", "20230522", 900, "Tea House", "Card A", 900, None, "S1"),      # NULL discount
    ("0042", "20230532", 1111, "Tea House", "Card A", 1111, None, None),    # no date
    ("0042", "20230505", 5000, "Book Store", "Card A", 5000, 500, "S1"),    # other merchant
    ("0042", "20230605", 700, "Tea House", "Card A", 700, 30, "S1"),        # after the range
    ("77", "20230408", 3000, "Bakery", "Card C", 3000, None, None),
    ("77", "20230412", 4500, "Bakery", "Card C", None, 450, "S1"),
    ("77", "20230509", 2000, "Bakery", "Card C", 2000, 200, "S1"),
]

ACCOUNTS = [("0042",), ("77",), ("900",)]  # 900 has no line

SERVICES = [("S1", 10000), ("S2", 3000)]

PROMOTIONS = [
    ("Tea House spring card", "a stamp for every pot", "20230501", "20230531"),
    ("Tea House opening week", "first week", "20230401", "20230519"),  # ended the day before
    ("Book fair", "tea among the shelves", "20230501", "20230531"),
]

MESSAGES = [("Tea House: a free refill on Friday",), ("Bakery news",)]


def cards(spark):
    from cardlens.sources.cards import RecordCards
    return RecordCards(
        billing_df=spark.createDataFrame(BILLING, BILLING_SCHEMA),
        services_df=spark.createDataFrame(SERVICES, "SV_C string, MLIM_AM long"),
        promotions_df=spark.createDataFrame(
            PROMOTIONS, "EVN_BULT_TIT_NM string, EVN_BULT_CN string, EVN_SDT string, EVN_EDT string"),
        messages_df=spark.createDataFrame(MESSAGES, "UMS_MSG_CN string"),
        accounts_df=spark.createDataFrame(ACCOUNTS, "ACCTNO string"),
    )


def params(**kw):
    from cardlens.params import Params
    base = dict(start="2023-02-01", end="2023-05-31", merchant="tea", as_of="2023-05-20",
                service="S1", known_services=("S1", "S2"), limit_month="202305",
                promo_start="2023-03-01", promo_end="2023-05-31", promo_word="tea",
                message_word="tea", payment_chunk_lines=4)
    base.update(kw)
    return Params(**base)


# questions and their attempts: every kind of reply and of result, with retries
QUESTIONS = [(q, f"request {q}") for q in "abcde"]
ATTEMPTS = [
    ("a", 1, "Sure thing. SQLQuery: SELECT 1;", 'Error: (sqlite3.OperationalError) near "Sure": syntax error'),
    ("a", 2, "SELECT shop, SUM(x) FROM t GROUP BY shop;", "[('s', 1)]"),
    ("b", 1, "Try this one:\n```sql\nSELECT 2;\n```", 'Error: (sqlite3.OperationalError) near "Try": syntax error'),
    ("b", 2, "SELECT month, SUM(x) FROM t GROUP BY month;", "[('2023-04', 8800)]"),
    ("c", 1, "Well then.\nSQLQuery: \nSELECT lim FROM t;", 'Error: (sqlite3.OperationalError) near "Well": syntax error'),
    ("c", 2, "SELECT lim FROM t;", "Error: (sqlite3.OperationalError) no such column: lim"),
    ("c", 3, "SELECT 3;", "[(3,)]"),
    ("d", 1, "One moment: SQLQuery: SELECT 4;", 'Error: (sqlite3.OperationalError) near "One": syntax error'),
    ("d", 2, "SELECT 4;", "[('x',)]"),
    ("e", 1, "SELECT lim FROM t;", "Error: (sqlite3.OperationalError) no such column: lim"),
    ("e", 2, "SELECT v FROM t;", "Error: (sqlite3.OperationalError) no such column: v"),
    ("e", 3, "SELECT 5;", "[(5,)]"),
]
