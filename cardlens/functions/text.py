"""Text predicates and log-text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Characters trimmed from replies and the whitespace class used
# for token counts (kept ASCII so Java regex and RE2 agree).
TRIM_CHARS = " \t\n\r"
TOKEN_PATTERN = r"[^ \t\n\r\f]+"

# A statement starts with SELECT, or with WITH and a name defined AS (...), at the very
# start, after a line break, after a code fence or after "SQLQuery:". Prose that begins
# with "With" is none.
STATEMENT_START = (
    r"(?is)(?:^|\n|```sql|SQLQuery:)[ \t\r\n]*"
    r"((?:select[ \t\r\n(*'\"`]|with[ \t\r\n]+(?:recursive[ \t\r\n]+)?(?:\w+|\"[^\"]*\"|`[^`]*`)[ \t\r\n]*"
    r"(?:\([^()]*\)[ \t\r\n]*)?as[ \t\r\n]*(?:(?:not[ \t\r\n]+)?materialized[ \t\r\n]*)?\().*)")

# The pieces of a statement: a fence, a semicolon, literals, quoted names and comments
# (one without an end runs to the end of the text), runs of other characters, single
# ones. A quote doubled inside a literal is two literals side by side.
PIECE = (r"(?s)(```|;|'[^']*(?:'|\z)|\"[^\"]*(?:\"|\z)|`[^`]*(?:`|\z)|--[^\n]*"
         r"|/\*.*?(?:\*/|\z)|[^;'\"`/-]+|.)")

# Fixed values. Error classes from the database's error text.
ERROR_CLASSES = (
    ("syntax", r"syntax error"),
    ("missing_column", r"no such column"),
    ("missing_table", r"no such table"),
)
ERROR_MARKER = "OperationalError"


def like_escape(word: str) -> str:
    return word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(c: Column, word: str) -> Column:
    """SQLite ``LIKE '%word%'`` (case-insensitive) as ``ilike``."""
    return c.ilike(f"%{like_escape(word)}%")


def trim_text(c: Column) -> Column:
    """Strip spaces, tabs and line breaks at both ends."""
    return F.trim(c, F.lit(TRIM_CHARS))


def truncate_display(c: Column, n: int) -> Column:
    """Cut to ``n`` characters and mark the cut with '...'. Display only."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def token_count(c: Column) -> Column:
    """Whitespace token count (R2 default tokenizer)."""
    return F.regexp_count(c, F.lit(TOKEN_PATTERN))


def extract_sql(c: Column) -> Column:
    """The statement inside a chatty reply; '' when there is none.

    The reply is cut into pieces in one pass from the statement's start; the statement
    runs through the first ``;`` that is a piece of its own, or up to a closing code
    fence, or to the end of the text. A ``;`` inside a literal, a quoted name or a
    comment is part of its piece.
    """
    pieces = F.regexp_extract_all(F.regexp_extract(c, STATEMENT_START, 1), F.lit(PIECE), F.lit(1))
    return F.trim(F.transform(F.array(pieces), _through_end)[0], F.lit(TRIM_CHARS))


def _through_end(pieces: Column) -> Column:
    """The pieces up to a fence, or through the first ``;``, as one text."""
    whole = F.size(pieces)
    fence, end = F.array_position(pieces, "```").cast("int"), F.array_position(pieces, ";").cast("int")
    # array_position is 0 where there is none
    stop = F.least(F.when(fence > 0, fence - 1).otherwise(whole), F.when(end > 0, end).otherwise(whole))
    return F.array_join(F.slice(pieces, F.lit(1), stop), "")


def error_class(result: Column) -> Column:
    """Ok / syntax / missing_column / missing_table / other."""
    is_error = result.startswith("Error:") | result.contains(ERROR_MARKER)
    expr = F.when(~is_error, F.lit("ok"))
    for name, pattern in ERROR_CLASSES:
        expr = expr.when(F.lower(result).rlike(pattern), F.lit(name))
    return expr.otherwise(F.lit("other"))


def has_error_marker(result: Column) -> Column:
    """C11: the reference's own test, ``"OperationalError" in result``."""
    return result.contains(ERROR_MARKER)
