"""JSON rendering at the edge.

Inside jobs nested values are arrays of structs; text is produced last with
``to_json``. NULL fields are kept, as ``json_object`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def to_json(c: Column) -> Column:
    return F.to_json(c, KEEP_NULLS)


def sorted_json_list(items: Column, keep_fields: list[str]) -> Column:
    """Render an array of structs as JSON text, sorted.

    Structs compare field by field, so the leading fields of each struct are
    the sort key; the rendered objects carry ``keep_fields``.
    """
    ordered = F.array_sort(items)
    shown = F.transform(ordered, lambda x: F.struct(*[x[f].alias(f) for f in keep_fields]))
    return to_json(shown)
