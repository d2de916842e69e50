"""Plain Python versions of what the operators share."""

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

# names that the operators use inside
CLASHING = ["key", "hash", "a", "b", "rid", "label", "score", "kept", "row", "size", "place", "part", "component", "node"]


def docs_of(spark, rows, extra=False):
    """A documents frame of (doc_id, text[, lang]) rows."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        for i, c in enumerate(CLASHING):
            df = df.withColumn(c, F.lit(i))
    return df


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is not None, x))
