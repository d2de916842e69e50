"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "is_finite") and not isinstance(v, (int, float)):  # Decimal
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def duckdb_views(con, sf_dir: str) -> None:
    from cardlens.sources.tables import TABLES, table_path
    for t in TABLES:
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")


def compare(df, con, sql: str) -> tuple[bool, str]:
    """(equal, message) for a Spark DataFrame against DuckDB SQL."""
    cols = df.columns
    srows = [tuple(norm(x) for x in r) for r in df.collect()]
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    orows = [tuple(norm(x) for x in r) for r in cur.fetchall()]
    if sorted(cols) != sorted(ocols):
        return False, f"columns {cols} vs {ocols}"
    idx = [ocols.index(c) for c in cols]
    orows = [tuple(r[i] for i in idx) for r in orows]
    a, b = sorted(srows, key=_key), sorted(orows, key=_key)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return False, f"{len(a)} vs {len(b)} rows; first diffs {str(diff)[:1000]}"
    return True, f"{len(a)} rows"
