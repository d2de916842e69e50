"""Oracle SQL for the catalogue, prompt, attempt and span families."""

from __future__ import annotations

from cardlens.functions.text import TOKEN_PATTERN
from cardlens.operators.attempts import CHUNK_CHARS
from cardlens.operators.catalog import NAMED_SQL, SAMPLE_CHARS, SAMPLE_ROWS
from cardlens.operators.prompts import (ANSWER_TEMPLATE, DIALECT, EXAMPLE_ROWS, REPAIR_TEMPLATE,
                                        SQL_TEMPLATE, _SLOT)
from cardlens.params import Params
from cardlens.sources.tables import TABLES
from cardlens.plans.oracle import with_

TRIM = "' ' || chr(9) || chr(10) || chr(13)"
TS = "'%Y-%m-%d %H:%M:%S.%f'"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(names) -> str:
    return ", ".join(lit(n) for n in names)


def table_profile(p: Params) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in TABLES)


def largest_table(p: Params) -> str:
    return f"""SELECT table_name, n_rows FROM (
  SELECT table_name, n_rows, 0 AS fallback FROM ({table_profile(p)}) t WHERE n_rows > 0
  UNION ALL SELECT NULL, 0, 1) x
ORDER BY fallback, n_rows DESC, table_name LIMIT 1"""


# Columns and types of the test tables.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _value_text(c: str, kind: str) -> str:
    if kind == "double":
        c = f"CAST(CAST({c} AS DECIMAL(38,6)) AS VARCHAR)"
    elif kind == "timestamp_ntz":
        c = f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
    elif kind == "array<float>":
        c = f"array_to_string([CAST(CAST(x AS DECIMAL(38,6)) AS VARCHAR) FOR x IN {c}[1:4]], ',')"
    else:
        c = f"CAST({c} AS VARCHAR)"
    return f"COALESCE(substr({c}, 1, {SAMPLE_CHARS}), 'NULL')"


def _card_cte(whole: bool = False) -> str:
    """The card of the least rows by all columns (``whole``) or of the first rows by place."""
    parts = []
    for t, text in COLUMNS.items():
        cols = [c.split(" ") for c in text.split(", ")]
        order = ", ".join(f"{c} NULLS FIRST" for c, _ in cols) if whole else "nth"
        values = ", ".join(
            f"{{'ordinal': {i}, 'column_name': '{c}', 'data_type': '{k}', 'samples': list({_value_text(c, k)} ORDER BY {order})}}"
            for i, (c, k) in enumerate(cols, start=1))
        # a scan keeps the order of the file
        rows = f"SELECT * FROM {t} ORDER BY {order} LIMIT {SAMPLE_ROWS}" if whole else \
            f"SELECT *, row_number() OVER () AS nth FROM (SELECT * FROM {t} LIMIT {SAMPLE_ROWS}) y"
        parts.append(f"SELECT '{t}' AS table_name, unnest([{values}]) AS u FROM ({rows}) x")
    return "card AS (SELECT table_name, CAST(u.ordinal AS INTEGER) AS ordinal, u.column_name, u.data_type, u.samples FROM (\n" \
        + "\nUNION ALL\n".join(parts) + ") c)"


def schema_card(p: Params) -> str:
    return with_(_card_cte(whole=True)) + "SELECT * FROM card"


def schema_samples(p: Params) -> str:
    return with_(_card_cte(whole=True)) + """SELECT table_name, column_name, CAST(i AS INTEGER) AS place, samples[i + 1] AS value
FROM (SELECT *, unnest(range(len(samples))) AS i FROM card) c"""


META_CTES = """meta_nation AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name,
         CASE WHEN r_name <> 'AFRICA' THEN r_name END AS synonyms
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey),
meta_region AS (
  SELECT CAST(r_regionkey AS VARCHAR) AS code, r_name AS name,
         CASE WHEN r_regionkey = 0 THEN '' ELSE lower(r_name) END AS synonyms FROM region),
syn_lines AS (
  SELECT table_name, code, name, synonyms,
         table_name || ' ' || COALESCE(name, '') || ' (Code: ' || COALESCE(code, '') || '), Synonyms: ' || synonyms AS line
  FROM (SELECT 'meta_nation' AS table_name, * FROM meta_nation
        UNION ALL SELECT 'meta_region' AS table_name, * FROM meta_region) u
  WHERE synonyms IS NOT NULL AND length(synonyms) > 0)"""


def synonym_card(p: Params) -> str:
    return with_(META_CTES) + "SELECT table_name, code, name, synonyms, line FROM syn_lines"


def table_copy(p: Params) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows, {len(text.split(', '))} AS n_columns, TRUE AS equal FROM {t}"
        for t, text in COLUMNS.items())


def run_named_sql(p: Params) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {lit(name)} AS query_name, CAST(to_json(t) AS VARCHAR) AS row_json FROM ({sql}) t"
        for name, sql in NAMED_SQL.items())


def question_ledger(p: Params) -> str:
    ran = "\nUNION ALL\n".join(
        f"SELECT {lit(name)} AS query_name, 'done' AS status, COUNT(*) AS n_rows, NULL AS error_class FROM ({sql}) t"
        for name, sql in NAMED_SQL.items())
    failed = [("missing_column", "missing_column"), ("missing_table", "missing_table"), ("prose", "syntax")]
    return ran + "".join(f"\nUNION ALL SELECT {lit(n)}, 'failed', NULL, {lit(c)}" for n, c in failed)


def fill(template: str, values: dict[str, str]) -> str:
    """SQL concat of template pieces; values are SQL expressions."""
    parts, pos = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(lit(template[pos:m.start()]))
        parts.append(f"COALESCE({values[m.group(1)]}, '')")
        pos = m.end()
    if pos < len(template):
        parts.append(lit(template[pos:]))
    return " || ".join(parts)


TABLE_INFO = """(SELECT string_agg(line, chr(10) ORDER BY table_name) FROM (
  SELECT table_name, table_name || '(' || string_agg(column_name || ' ' || data_type || ': ' || array_to_string(samples, ' | '),
    ', ' ORDER BY ordinal) || ')' AS line FROM card GROUP BY table_name) ti)"""

QUESTIONS_CTE = """questions AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn // 4 AS VARCHAR) AS q_id, text AS question
  FROM conversations WHERE role = 'user' AND turn % 4 = 0)"""


def _prompts_sql(whole: bool = False) -> str:
    syn = "(SELECT string_agg(line, chr(10) ORDER BY table_name, code) FROM syn_lines)"
    examples = "\n\n".join(f"Request: {r}\nQuery: {q}" for r, q in EXAMPLE_ROWS)
    prompt = fill(SQL_TEMPLATE, {"dialect": lit(DIALECT), "max_rows": "'1'", "schema": TABLE_INFO,
                                 "words": syn, "examples": lit(examples), "ask": "question"})
    return with_(META_CTES, _card_cte(whole), QUESTIONS_CTE) + f"SELECT q_id, {prompt} AS prompt FROM questions"


def prompt_table(p: Params) -> str:
    return _prompts_sql()


def prompt_budget(p: Params) -> str:
    return f"""SELECT q_id, n_tokens, {int(p.context_window)} - n_tokens AS room,
  {int(p.context_window)} - n_tokens >= 0 AS fits
FROM (SELECT q_id, CAST(len(regexp_extract_all(prompt, {lit(TOKEN_PATTERN)})) AS BIGINT) AS n_tokens
      FROM ({_prompts_sql(whole=True)}) pr) x"""


ATTEMPTS_CTE = r"""attempts AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn // 4 AS VARCHAR) AS q_id, turn % 4 // 2 + 1 AS attempt_no,
    CASE (conv_id + turn) % 4
      WHEN 0 THEN 'SELECT count(*) AS n FROM lineitem WHERE l_orderkey = ' || CAST(conv_id AS VARCHAR) || ' AND l_comment <> ''it''''s; --'';'
      WHEN 1 THEN regexp_extract(text, '^([^\n]*)', 1) || chr(10) || chr(10) || 'SQLQuery: SELECT count(*) AS n /* by; account */ FROM orders -- all; of them'
        || chr(10) || 'WHERE o_custkey = ' || CAST(conv_id AS VARCHAR) || '; That is it.'
      WHEN 2 THEN 'Here is the query:' || chr(10) || '```sql' || chr(10) || 'SELECT sum(l_quantity) AS "q;1" FROM lineitem WHERE l_partkey = ' || CAST(conv_id AS VARCHAR)
        || CASE WHEN conv_id % 4 = 0 THEN '' ELSE ';' END || chr(10) || '```'
      ELSE 'SELECT l_missing FROM lineitem WHERE l_orderkey = ' || CAST(conv_id AS VARCHAR) || ';'
    END AS reply,
    CASE (conv_id + turn) % 4
      WHEN 0 THEN '[(1,)]'
      WHEN 1 THEN 'Error: (sqlite3.OperationalError) near "' || regexp_extract(text, '^([^ \n]+)', 1) || '": syntax error'
      WHEN 2 THEN 'Error: (sqlite3.OperationalError) near "Here": syntax error'
      ELSE 'Error: (sqlite3.OperationalError) no such column: l_missing'
    END AS result_text
  FROM conversations WHERE role = 'assistant')"""


# R3 by its rules: the statement starts where the reply does, after SQLQuery: or in a
# fence; its characters are walked one by one with a state (code, inside a quote of one of
# three kinds, line or block comment) until a semicolon or a fence is met as code.
SCAN_CTES = f"""begun AS (
  SELECT q_id, attempt_no, CASE WHEN starts_with(reply, 'SELECT') THEN reply
      WHEN contains(reply, 'SQLQuery: ') THEN split_part(reply, 'SQLQuery: ', 2)
      WHEN contains(reply, '```sql' || chr(10)) THEN split_part(reply, '```sql' || chr(10), 2) ELSE '' END AS t FROM attempts),
walk AS (
  SELECT q_id, attempt_no, t, 1 AS i, 'code' AS state FROM begun
  UNION ALL
  SELECT q_id, attempt_no, t, CASE WHEN state = 'block' AND t[i:i + 1] = '*/' THEN i + 2 ELSE i + 1 END,
    CASE WHEN state = 'code' AND (t[i] = ';' OR t[i:i + 2] = '```') THEN 'end'
         WHEN state = 'code' AND t[i:i + 1] = '--' THEN 'line' WHEN state = 'code' AND t[i:i + 1] = '/*' THEN 'block'
         WHEN state = 'code' AND t[i] IN (chr(39), '"', '`') THEN t[i]
         WHEN state = t[i] OR (state = 'line' AND t[i] = chr(10)) OR (state = 'block' AND t[i:i + 1] = '*/') THEN 'code'
         ELSE state END
  FROM walk WHERE state <> 'end' AND i <= length(t)),
found AS (
  SELECT q_id, attempt_no, trim(CASE WHEN state <> 'end' THEN t WHEN t[i - 1] = ';' THEN t[:i - 1] ELSE t[:i - 2] END, {TRIM}) AS sql
  FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY q_id, attempt_no ORDER BY i DESC) = 1) w)"""

STATUS_CTE = SCAN_CTES + """,
status AS (
  SELECT a.q_id, a.attempt_no, reply, result_text, sql,
    CASE WHEN NOT (starts_with(result_text, 'Error:') OR contains(result_text, 'OperationalError')) THEN 'ok'
         WHEN regexp_matches(lower(result_text), 'syntax error') THEN 'syntax'
         WHEN regexp_matches(lower(result_text), 'no such column') THEN 'missing_column'
         WHEN regexp_matches(lower(result_text), 'no such table') THEN 'missing_table'
         ELSE 'other' END AS status,
    contains(result_text, 'OperationalError') AS has_error_marker
  FROM attempts a JOIN found f ON f.q_id = a.q_id AND f.attempt_no = a.attempt_no)"""


def sql_extract(p: Params) -> str:
    return with_(ATTEMPTS_CTE, SCAN_CTES) + f"""SELECT a.q_id, a.attempt_no, sql, sql <> trim(reply, {TRIM}) AS had_wrapping
FROM attempts a JOIN found f ON f.q_id = a.q_id AND f.attempt_no = a.attempt_no"""


def attempt_status(p: Params) -> str:
    return with_(ATTEMPTS_CTE, STATUS_CTE) + "SELECT * FROM status"


def attempt_outcome(p: Params) -> str:
    b = int(p.retry_budget)
    return with_(ATTEMPTS_CTE, STATUS_CTE) + f"""SELECT q_id, n_attempts, first_ok_attempt,
  CAST(COALESCE(first_ok_attempt, least(n_attempts, {b})) AS BIGINT) AS attempts_used,
  CASE WHEN first_ok_attempt IS NOT NULL THEN 'ok' ELSE 'no result' END AS final_status
FROM (SELECT q_id, COUNT(*) AS n_attempts,
        MIN(CASE WHEN rnk <= {b} AND status = 'ok' THEN rnk END) AS first_ok_attempt
      FROM (SELECT q_id, status, row_number() OVER (PARTITION BY q_id ORDER BY attempt_no) AS rnk
            FROM status) r GROUP BY q_id) g"""


def error_mix(p: Params) -> str:
    return with_(ATTEMPTS_CTE, STATUS_CTE) + """SELECT attempt_no, status, COUNT(*) AS n_attempts
FROM status GROUP BY attempt_no, status"""


def _join_q(where: str) -> str:
    return f"""FROM status s JOIN questions q ON s.q_id = q.q_id
WHERE {where}"""


def repair_prompts(p: Params) -> str:
    prompt = fill(REPAIR_TEMPLATE, {"statement": "CASE WHEN s.sql <> '' THEN s.sql ELSE s.reply END",
                                    "failure": "s.result_text", "schema": TABLE_INFO, "ask": "q.question"})
    return with_(ATTEMPTS_CTE, STATUS_CTE, QUESTIONS_CTE, _card_cte()) + \
        f"SELECT s.q_id, s.attempt_no, {prompt} AS prompt " + _join_q("s.status <> 'ok'")


def answer_prompts(p: Params) -> str:
    prompt = fill(ANSWER_TEMPLATE, {"ask": "q.question", "statement": "s.sql", "rows": "s.result_text"})
    return with_(ATTEMPTS_CTE, STATUS_CTE, QUESTIONS_CTE) + \
        f"SELECT s.q_id, s.attempt_no, {prompt} AS prompt " + _join_q("s.status = 'ok'")


def response_clean(p: Params) -> str:
    return f"""SELECT conv_id, turn, trim(text, {TRIM}) AS clean_text, length(trim(text, {TRIM})) AS n_chars,
  trim(text, {TRIM}) <> text AS changed
FROM conversations WHERE role = 'assistant'"""


def chunk_join(p: Params) -> str:
    n = CHUNK_CHARS
    return f"""SELECT conv_id, turn, CAST(len(kept) AS BIGINT) AS n_chunks, trim(array_to_string(kept, ''), {TRIM}) AS answer
FROM (SELECT conv_id, turn, [c FOR c IN [substr(text, {n} * i + 1, {n}) FOR i IN range(CAST(ceil(length(text) / {n}.0) AS BIGINT))]
        IF trim(c, {TRIM}) <> ''] AS kept FROM conversations WHERE role = 'assistant') x
WHERE len(kept) > 0"""


def display_truncate(p: Params) -> str:
    n = int(p.display_chars)
    return f"""SELECT doc_id, length(text) AS n_chars,
  CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '...' ELSE text END AS display
FROM documents"""


SPANS_CTE = """spans AS (
  SELECT event_id AS span_id, user_id AS trace_key, event_type AS name, ts AS start_ts,
         value AS duration_ms, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens, event_id % 50 AS output_tokens,
         CASE WHEN event_type IN ('view', 'click') AND event_id % 3 <> 0 THEN 'model-' || (event_id % 2) END AS model,
         CASE WHEN event_id % 64 <> 0 THEN event_id - event_id % 64 + (event_id % 64 - 1) // 2 END AS parent_id
  FROM events)"""


def span_flatten(p: Params) -> str:
    return with_(SPANS_CTE) + f"""SELECT span_id, trace_key, name, strftime(start_ts, {TS}) AS start_time,
  duration_ms, status, input_tokens, output_tokens FROM spans"""


def span_latency(p: Params) -> str:
    return with_(SPANS_CTE) + """, r AS (
  SELECT name, v, row_number() OVER (PARTITION BY name ORDER BY v) AS rn,
         COUNT(*) OVER (PARTITION BY name) AS n
  FROM (SELECT name, CAST(duration_ms AS DECIMAL(38,6)) AS v FROM spans WHERE duration_ms IS NOT NULL) s)
SELECT name, COUNT(*) AS n_spans, CAST(MIN(v) AS DOUBLE) AS min_ms,
  (CAST(MIN(CASE WHEN rn = (n - 1) // 2 + 1 THEN v END) AS DOUBLE)
   + CAST(MIN(CASE WHEN rn = n // 2 + 1 THEN v END) AS DOUBLE)) / 2.0 AS median_ms,
  CAST(SUM(v) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS mean_ms,
  CAST(MAX(v) AS DOUBLE) AS max_ms, CAST(SUM(v) AS DOUBLE) AS sum_ms
FROM r GROUP BY name"""


def token_usage(p: Params) -> str:
    return with_(SPANS_CTE) + """SELECT COALESCE(model, name) AS model, COUNT(*) AS n_calls, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens,
  CAST(SUM(output_tokens) AS BIGINT) AS output_tokens, CAST(SUM(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
  MAX(input_tokens + output_tokens) AS max_tokens, CAST(SUM(CASE WHEN status = 'ERROR' THEN 1 ELSE 0 END) AS BIGINT) AS n_errors
FROM spans GROUP BY COALESCE(model, name)"""


def episodes(p: Params) -> str:
    # a marker counts by the marker before it; a span is inside if the last marker at or
    # before it opens, or if it closes what was open
    return with_(SPANS_CTE) + f""", m AS (
  SELECT *, CASE name WHEN 'signup' THEN 1 WHEN 'purchase' THEN 0 END AS mark FROM spans),
b AS (SELECT *, COALESCE(last_value(mark IGNORE NULLS) OVER (
      PARTITION BY trace_key ORDER BY start_ts, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM m),
e AS (
  SELECT *, CAST(SUM(CASE WHEN mark = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (
      PARTITION BY trace_key ORDER BY start_ts, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS episode_no
  FROM b)
SELECT trace_key, episode_no, COUNT(*) AS n_spans,
  strftime(MIN(start_ts), {TS}) AS first_time, strftime(MAX(start_ts), {TS}) AS last_time,
  CAST(SUM(CAST(duration_ms AS DECIMAL(38,6))) AS DOUBLE) AS total_ms,
  CAST(SUM(CASE WHEN status = 'ERROR' THEN 1 ELSE 0 END) AS BIGINT) AS n_errors, bool_or(name = 'purchase') AS answered
FROM e WHERE was = 1 OR mark = 1 GROUP BY trace_key, episode_no"""


def span_tree(p: Params) -> str:
    return with_(SPANS_CTE) + """, t AS (
  SELECT span_id // 64 AS request_id, span_id, span_id AS root_id, 0 AS depth FROM spans s
  WHERE parent_id IS NULL OR parent_id NOT IN (SELECT span_id FROM spans)
  UNION ALL SELECT t.request_id, s.span_id, t.root_id, t.depth + 1 FROM t JOIN spans s ON s.parent_id = t.span_id),
k AS (SELECT parent_id, SUM(CAST(duration_ms AS DECIMAL(38,6))) AS c FROM spans GROUP BY parent_id)
SELECT t.request_id, t.span_id, t.root_id, CAST(t.depth AS BIGINT) AS depth,
  CAST(CAST(s.duration_ms AS DECIMAL(38,6)) - COALESCE(k.c, 0) AS DOUBLE) AS own_ms, CAST(CAST(s.duration_ms AS DECIMAL(38,6)) AS DOUBLE) AS total_ms
FROM t JOIN spans s ON s.span_id = t.span_id LEFT JOIN k ON k.parent_id = t.span_id"""
