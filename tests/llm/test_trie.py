import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlens.llm import trie

CONVS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def brute(seqs):
    """Nodes by every prefix of every sequence; seqs: conv_id -> list of turns."""
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = set()
    for p, m in members.items():
        under = [q for q in members if q[:len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids),
                 sum(not any(len(r) == len(q) + 1 and r[:-1] == q for r in under) for q in under),
                 sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def ordered(rows):
    key = lambda t: hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).hexdigest()[:32]
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "", text or "")))
    return {c: [x[2] for x in sorted(t, key=lambda x: (x[0], x[1], key(x[2])))] for c, t in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + turns[h:]
    return out


def nodes(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * 7 if c % 3 else c * 100 - 300
        copy = rng.random() < 0.3
        for t in range(rng.choice([1, 2, 5, 8, 12])):
            word = "same" * (t % 3) if copy else rng.choice(["a", "bb", "ü", ""])
            rows.append((c, t, rng.choice(["user", None]) if not copy else "user", word))
    return rows


AWKWARD = [(1, None, "user", "x"), (1, 3, "user", "y"), (1, 3, "user", "y"), (1, 2, None, None), (None, 1, "user", "lost"),
           (100, 1, "user", "base"), (101, None, None, None), (203, 1, "user", "alone"), (-50, 1, "a", "ä"), (-100, 1, "b", "n")]


@pytest.mark.parametrize("limit", [0, 30, 20000])
def test_trie_equals_brute_force_at_every_container_size(spark, limit):
    rows = random_rows(1) + AWKWARD
    df = spark.createDataFrame(rows, CONVS)
    for i, c in enumerate(["depth", "box", "top", "rep", "n", "size", "token"]):
        df = df.withColumn(c, F.lit(i))
    turns, convs = trie.rebuild(trie.number_turns(df))
    assert nodes(trie.prefix_trie(turns, convs, container_rows=limit)) == brute(rebuilt(ordered(rows)))


def test_query_with_copies_and_one_long_conversation(spark, tmp_path):
    rng = random.Random(3)
    rows = random_rows(2, 20) + [(c, t, "user", f"copy {t}") for c in range(300, 400) for t in range(9)]
    rows += [(9999, t, "user", rng.choice("ab")) for t in range(400)] + [(9998, t, "user", "a") for t in range(300)]
    spark.createDataFrame(rows, CONVS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = nodes(trie.op12_prefix_trie(spark, str(tmp_path)))
    small = {c: s for c, s in rebuilt(ordered(rows)).items()}
    want = brute_fast(small)
    assert got == want


def brute_fast(seqs):
    """As ``brute``, for long sequences: sums climb from the members' ends."""
    members, kids = {}, {}
    digest = {}
    for c, s in seqs.items():
        key = b""
        path = [key]
        for t in s:
            nxt = hashlib.md5(key + repr(t).encode()).digest()
            kids.setdefault(key, set()).add(nxt)
            digest[nxt] = (key, t)
            path.append(key := nxt)
        for d, k in enumerate(path):
            members.setdefault(k, [d, [], []])[1].append(c)
        members[key][2].append(c)
    leaves, saved = {}, {}
    for k, (_, m, _) in sorted(members.items(), key=lambda x: -x[1][0]):
        leaves[k] = sum(leaves[x] for x in kids.get(k, ())) or 1
        saved[k] = sum(saved[x] for x in kids.get(k, ())) + (len(m) - 1) * (len(digest[k][1][1]) if k else 0)
    return {(min(m), d, min(members[digest[k][0]][1]) if k else None, len(m), len(kids.get(k, ())), leaves[k], saved[k],
             hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()) for k, (d, m, e) in members.items()}


def test_numbering_spreads_one_conversation_over_parts(spark):
    rows = [(5, t, "u", "x" * (t % 3)) for t in range(500)] + [(6, 0, "u", "y")]
    got = sorted(tuple(r) for r in trie.number_turns(spark.createDataFrame(rows, CONVS).repartition(5)).select("conv_id", "depth", "through").collect())
    total, want = 0, []
    for t in range(500):
        total += t % 3
        want.append((5, t + 1, total))
    assert got == [*want, (6, 1, 1)]


def test_empty_table_has_no_nodes(spark, tmp_path):
    spark.createDataFrame([(None, 1, "user", "x")], CONVS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert trie.op12_prefix_trie(spark, str(tmp_path)).collect() == []


def test_long_lists_of_ends_are_hashed_over_pieces(spark, monkeypatch):
    n = 10000
    df = spark.range(n).select(F.lit(0).cast("long").alias("rep"), F.col("id").alias("conv_id"))
    got = trie._ends(df).collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()]
