"""Write PLANS.md: the final (post-AQE) physical plans of five queries.

usage: python scripts/plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cardlens.plans import registry  # noqa: E402
from cardlens.session import get_session  # noqa: E402

# one of each kind: the flagship, a chain of joins, chunked lists, a scan by slices, cards by place
DETAIL = ("account_report", "campaign_customers", "payments_json", "episodes", "schema_card")


def drop_initial_plans(text: str) -> str:
    """Remove every ``== Initial Plan ==`` block (the top one and those of
    subqueries), keeping the final plans and the main plan around them."""
    out, skip_from = [], None
    for line in text.splitlines():
        col = len(line) - len(line.lstrip())
        if skip_from is not None:
            if line.strip() and col >= skip_from + 3:
                continue
            skip_from = None
        if line.strip().startswith("+- == Initial Plan =="):
            skip_from = col
            continue
        out.append(line)
    return "\n".join(out)


def final_tree(df) -> str:
    df.write.format("noop").mode("overwrite").save()  # a separate execution
    df.collect()
    text = drop_initial_plans(df._jdf.queryExecution().executedPlan().toString())
    text = re.sub(r"#\d+L?", "", text)
    text = re.sub(r"\[plan_id=\d+\]", "", text)
    return text.rstrip()


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return re.sub(r"#\d+L?", "", buf.getvalue()).rstrip()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 16)
    spark.sparkContext.setLogLevel("ERROR")
    out = ["# Physical plans", "",
           f"Final adaptive plans of five queries of `cardlens.plans.registry` on `{sf_dir}` (local[8]),",
           "written by `scripts/plans.py`. Expression ids are removed.", ""]
    for name in DETAIL:
        fn = registry.queries()[name]
        df = fn(spark, sf_dir)
        out += [f"## {name}", "", "```", final_tree(df), "```", ""]
        out += ["<details><summary>formatted (scan details)</summary>", "", "```",
                formatted(fn(spark, sf_dir)), "```", "", "</details>", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")


if __name__ == "__main__":
    main()
