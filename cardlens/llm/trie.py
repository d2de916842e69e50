"""Prefix trie of conversations as a burst trie.

A turn's id is a digest of its role and text; a conversation is a sequence of turn ids,
kept one row a turn, so a conversation of any length is dealt over many tasks. Equal
sequences count as one with a number of copies. All sequences start in one container
under the root. A container whose rest is longer than ``container_rows`` turns bursts:
its common path down to the first turn at which its sequences part becomes a chain of
trie heads, and the sequences go on into one container for each next turn id. What
remains is small: a container of one sequence is a chain written straight from its
rows; each other one is sorted within its shard and swept once with a stack of open
nodes. Totals of a container's top node then climb from head to head.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardlens.llm._util import batch_rows, drop, materialize, prepare, shuffle_partitions, table

CONTAINER_ROWS = 20000  # turns of a container that is sorted and swept in one piece
SHARED = 100  # ids of one hundred start with turns of its first
ENDS_BLOCK = 4096  # ids of one written piece of a list of ends
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends long")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each turn and code points so far, within one partition's part of a conversation."""
    conv, nth, through = None, 0, 0
    for batch in batches:
        nths, throughs = [], []
        for c, size in zip(batch.column("conv_id").to_pylist(), batch.column("size").to_pylist(), strict=True):
            if c != conv:
                conv, nth, through = c, 0, 0
            nth += 1
            through += size
            nths.append(nth)
            throughs.append(through)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nths, pa.int64()), pa.array(throughs, pa.int64())],
                                         [*batch.schema.names, "nth", "through"])


def number_turns(convs: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), token, size, through of every turn of ``convs``.

    Turns are ordered by ``turn`` (null first), ties by their id; a null role or text is
    empty; rows without ``conv_id`` belong to no conversation and are left out. ``size``
    counts the text's code points, ``through`` those of the conversation so far. Turns
    are dealt out by ranges of (conversation, turn) and numbered from each part's
    counts, so that one conversation may hold any share of the rows.
    """
    spark = convs.sparkSession
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = convs.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)).alias("token"),
        F.length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("place"))
    order = ["conv_id", "turn", "token", "place"]
    dealt = (turns.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
             .select("conv_id", "token", "size", F.spark_partition_id().alias("part")))
    with batch_rows(spark, 10000):
        dealt = materialize(dealt.mapInArrow(_number, "conv_id long, token binary, size long, part int, nth long, through long"), "turns")
    parts = dealt.groupBy("conv_id", "part").agg(F.max("nth").alias("n"), F.max("through").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one conversation reaches into a partition from the one before: a row a partition
    carried = parts.select("conv_id", "part", F.sum("n").over(earlier).alias("n0"), F.sum("size").over(earlier).alias("s0")).where("n0 > 0")
    return dealt.join(F.broadcast(carried), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("nth") + F.coalesce("n0", F.lit(0))).alias("depth"), "token", "size",
        (F.col("through") + F.coalesce("s0", F.lit(0))).alias("through"))


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations, all conversation ids).

    Conversation c starts with the first crc32(c) % 6 turns of conversation c - c % 100
    (all it has, none where it is missing) and goes on with its own after as many.
    """
    head = F.crc32(F.col("conv_id").cast("string")) % 6
    convs = materialize(turns.groupBy("conv_id").agg(
        F.coalesce(F.sum(F.when(F.col("depth") <= head, F.col("size"))), F.lit(0)).alias("cut_size")), "convs")
    first = turns.where((F.col("conv_id") % SHARED == 0) & (F.col("depth") <= 5)).withColumnRenamed("conv_id", "base")
    heads = (convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"), head.alias("h")).where("h > 0")
             .join(first, "base").where("depth <= h").select("conv_id", "depth", "token", "size", "through"))
    heads = materialize(heads, "heads")
    info = convs.join(heads.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("through").alias("head_size")), "conv_id", "left")
    tail = (turns.where(F.col("depth") > head).join(info, "conv_id").select(
        "conv_id", (F.col("depth") - head + F.coalesce("n", F.lit(0))).alias("depth"), "token", "size",
        (F.col("through") - F.col("cut_size") + F.coalesce("head_size", F.lit(0))).alias("through")))
    return heads.unionByName(tail), convs.select("conv_id")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each container; rows come by container, sequence and depth."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "box"]
    kinds = [pa.int64()] * 8 + [pa.binary()]
    out: list[tuple] = []

    def close(members: list, box: bytes, top: int, parent) -> None:
        members.sort(key=lambda m: m[2])
        nodes, stack = [], []  # node: conv, depth, place of the parent, convs, children, leaves, saved, ends, size

        def pop() -> None:
            node = nodes[stack.pop()]
            if not node[4]:
                node[5] = 1
            node[6] += (node[3] - 1) * node[8]
            if stack:
                up = nodes[stack[-1]]
                up[0] = min(up[0], node[0])
                up[3] += node[3]
                up[4] += 1
                up[5] += node[5]
                up[6] += node[6]

        before: list[bytes] = []
        for conv, copies, tokens, sizes in members:
            if top == 0:
                tokens, sizes = [b"", *tokens], [0, *sizes]
            same, most = 0, min(len(before), len(tokens))
            while same < most and before[same] == tokens[same]:
                same += 1
            while len(stack) > same:
                pop()
            for k in range(same, len(tokens)):
                nodes.append([conv, top + k, stack[-1] if stack else None, 0, 0, 0, 0, None, sizes[k]])
                stack.append(len(nodes) - 1)
            node = nodes[stack[-1]]
            node[0] = min(node[0], conv)
            node[3] += copies
            node[7] = conv
            before = tokens
        while stack:
            pop()
        out.extend((n[0], n[1], parent if n[2] is None else nodes[n[2]][0], *n[3:8], box) for n in nodes)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out.clear()
        return batch

    box, members, top, parent = None, [], 0, None
    for batch in batches:
        for b, t, up, conv, copies, token, size in zip(*(batch.column(c).to_pylist() for c in (
                "box", "top", "parent_rep", "rep", "copies", "token", "size")), strict=True):
            if b != box:
                if members:
                    close(members, box, top, parent)
                    if len(out) >= 5000:
                        yield flush()
                box, members, top, parent = b, [], t, up
            if not members or members[-1][0] != conv:
                members.append((conv, copies, [], []))
            if token is not None:
                members[-1][2].append(token)
                members[-1][3].append(size)
    if members:
        close(members, box, top, parent)
    if out:
        yield flush()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ENDS_BLOCK ids of one list, in order."""
    rep, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"rep": pa.array([rep], pa.int64()), "first": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

    for batch in batches:
        for r, c in zip(batch.column("rep").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (r != rep or len(ids) == ENDS_BLOCK):
                yield piece()
                ids = []
            rep = r
            ids.append(c)
    if ids:
        yield piece()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rep, sha = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"ends": pa.array([rep], pa.int64()), "ends_sha256": [sha.hexdigest()]})

    for batch in batches:
        for r, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if sha is not None and r == rep:
                sha.update(b",")
            else:
                if sha is not None:
                    yield row()
                rep, sha = r, hashlib.sha256()
            sha.update(ids.encode())
    if sha is not None:
        yield row()


def _ends(members: DataFrame) -> DataFrame:
    """ends (least id of equal sequences), ends_sha256 of their ids in numeric order.

    A list is cut into pieces over range partitions. SHA-256 is sequential, so a list's
    pieces pass through one task, but as a stream that is never held.
    """
    n = shuffle_partitions(members.sparkSession)
    pieces = (members.repartitionByRange(n, "rep", "conv_id").sortWithinPartitions("rep", "conv_id")
              .mapInArrow(_blocks, "rep long, first long, ids string"))
    return pieces.repartition(n, "rep").sortWithinPartitions("rep", "first").mapInArrow(_digest, "ends long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, container_rows: int = CONTAINER_ROWS) -> DataFrame:
    """The nodes of the trie of sequences: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, depth (1, 2, ... without gaps), token, size, through;
    ``convs`` the distinct conv_id of all members, those without turns included. No
    members, no nodes (not even the root). A node is named by its least member and its
    depth. Tables written on the way stay in the shared folder, since the result is lazy.
    """
    spark = turns.sparkSession
    turns = materialize(turns.select("conv_id", "depth", "token", "size", "through"), "rebuilt")
    salted = [F.xxhash64("depth", "token"), F.xxhash64("token", "depth", F.lit(1))]
    prints = turns.groupBy("conv_id").agg(
        F.count("*").alias("n"), *(F.sum(s.cast("decimal(20,0)")).alias(f"f{k}") for k, s in enumerate(salted)))
    prints = materialize(convs.join(prints, "conv_id", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "f0", "f1"))), "prints")
    classes = materialize(prints.groupBy("n", "f0", "f1").agg(F.min("conv_id").alias("rep"), F.count("*").alias("copies")), "classes")
    ends = materialize(_ends(prints.join(classes, ["n", "f0", "f1"]).select("rep", "conv_id")), "ends")

    open_ = classes.select("rep", "copies", "n", F.lit(b"").alias("box"), F.lit(0).cast("long").alias("top"),
                           F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("parent_rep"))
    heads: list[DataFrame] = []
    closed: list[DataFrame] = []
    while True:
        sizes = open_.groupBy("box").agg(F.count("*").alias("members"), F.sum(F.col("n") - F.col("top")).alias("rows"),
                                         F.sum("copies").alias("n_convs"), F.min("rep").alias("head_rep"))
        sizes = materialize(sizes, "sizes")
        large = sizes.where((F.col("members") > 1) & (F.col("rows") > container_rows))
        closed.append(materialize(open_.join(sizes.select("box", "members", "rows"), "box").where(
            (F.col("members") == 1) | (F.col("rows") <= container_rows)).drop("rows"), "closed"))
        if large.isEmpty():
            break
        over = materialize(open_.join(large.drop("rows"), "box"), "over")
        rest = turns.join(over.select(F.col("rep").alias("conv_id"), "box", "top", "members"), "conv_id").where("depth > top")
        # the first depth at which a container's sequences part or one of them has ended
        part = (rest.groupBy("box", "depth", "members").agg(F.count("*").alias("c"), F.min("token").alias("lo"), F.max("token").alias("hi"))
                .where("c < members or lo != hi").groupBy("box").agg((F.min("depth") - 1).alias("stop")))
        part = materialize(part, "part")
        at = over.join(part, "box")
        heads.append(materialize(at.groupBy("box", "top", "parent", "parent_rep", "stop", "n_convs", "head_rep").agg(
            F.max(F.when(F.col("n") == F.col("stop"), F.col("rep"))).alias("ends")), "head"))
        nexts = turns.join(at.where("n > stop").withColumn("conv_id", F.col("rep")), "conv_id").where(F.col("depth") == F.col("stop") + 1)
        open_ = materialize(nexts.select(
            "rep", "copies", "n", F.unhex(F.md5(F.concat("box", F.col("depth").cast("string").cast("binary"), "token"))).alias("box"),
            F.col("depth").alias("top"), F.col("box").alias("parent"), F.col("head_rep").alias("parent_rep")), "open")
        drop(over)

    left = closed[0]
    for more in closed[1:]:
        left = left.unionByName(more)
    first = F.col("top") == 0
    # one sequence: a chain, row by row; the root has no row of its own
    one = left.where("members = 1").withColumn("conv_id", F.col("rep"))
    last = turns.groupBy("conv_id").agg(F.max("through").alias("total"))
    chain = one.join(turns, "conv_id").where("depth >= top").unionByName(
        one.where(first).select("*", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("token"),
                                F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("through")))
    chain = chain.join(last.join(one.where("copies > 1"), "conv_id", "left_semi"), "conv_id", "left").select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent_rep")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("copies").alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("copies") - 1) * (F.coalesce("total", F.lit(0)) - F.col("through") + F.col("size"))).alias("saved_tokens"),
        F.when(F.col("depth") == F.col("n"), F.col("rep")).alias("ends"), "box")
    many = left.where("members > 1")
    rows = many.join(turns.select(F.col("conv_id").alias("rep"), "depth", "token", "size"), "rep", "left").where(
        "depth is null or depth >= top")
    shards = rows.select("box", "top", "parent_rep", "rep", "copies", "depth", "token", "size").repartition(
        shuffle_partitions(spark), "box").sortWithinPartitions("box", "rep", "depth")
    with batch_rows(spark, 10000):
        nodes = materialize(chain.unionByName(shards.mapInArrow(_sweep, NODE + ", box binary")), "nodes")

    # totals of the containers' top nodes climb from the last heads to the root
    tops = left.select("box", "parent", "top").where("parent is not null").distinct().join(
        nodes.select("box", F.col("depth").alias("top"), "n_leaves", "saved_tokens"), ["box", "top"]).select(
        "parent", "n_leaves", "saved_tokens")
    paths, climbed = [], tops
    for head in reversed(heads):
        below = climbed.groupBy(F.col("parent").alias("box")).agg(
            F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        end = turns.select(F.col("conv_id").alias("head_rep"), F.col("depth").alias("stop"), F.col("through").alias("total"))
        full = head.join(below, "box").join(end, ["head_rep", "stop"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
        path = full.join(turns.withColumnRenamed("conv_id", "head_rep"), "head_rep").where("depth between top and stop")
        path = path.unionByName(full.where(first).select("*", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("token"),
                                                         F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("through")))
        at_stop = F.col("depth") == F.col("stop")
        path = materialize(path.select(
            F.col("head_rep").alias("conv_id"), "depth",
            F.when(F.col("depth") == F.col("top"), F.col("parent_rep")).otherwise(F.col("head_rep")).alias("parent_conv_id"), "n_convs",
            F.when(at_stop, F.col("n_children")).otherwise(F.lit(1)).alias("n_children"), "n_leaves",
            (F.col("below") + (F.col("n_convs") - 1) * (F.col("total") - F.col("through") + F.col("size"))).alias("saved_tokens"),
            F.when(at_stop, F.col("ends")).alias("ends"), "box", "parent", "top"), "path")
        paths.append(path)
        climbed = climbed.unionByName(path.where((F.col("depth") == F.col("top")) & F.col("parent").isNotNull())
                                      .select("parent", "n_leaves", "saved_tokens"))
    out = nodes.drop("box")
    for path in paths:
        out = out.unionByName(path.drop("box", "parent", "top"))
    return out.join(ends, "ends", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of the whole ``conversations`` table, rebuilt so that neighbours share turns.

    Nulls, ties and repeated turns: see ``number_turns``. An empty table has no nodes.
    """
    prepare(spark)
    turns, convs = rebuild(materialize(number_turns(table(spark, sf_dir, "conversations")), "numbered"))
    return prefix_trie(turns, convs)


# Every prefix by its list of turns; what lies below a node by the members' own nodes.
ORACLE = """
WITH RECURSIVE step AS (
  SELECT range AS k, range::BIGINT AS c, 0 AS n FROM range(256)
  UNION ALL SELECT k, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM step WHERE n < 8),
tab AS (SELECT list(c ORDER BY k) AS l FROM step WHERE n = 8),
turns AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS i,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY i) AS l FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, own.l, xor(list_reduce(list_prepend(4294967295::BIGINT,
             [ord(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT FOR i IN range(length(conv_id::VARCHAR))]),
             lambda a, b: xor(a >> 8, tab.l[xor(a & 255, b) + 1])), 4294967295)::BIGINT % 6 AS h FROM own, tab),
rebuilt AS MATERIALIZED (
  SELECT a.conv_id, list_concat(coalesce(b.l, [])[1:a.h], a.l[a.h + 1:]) AS l
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
pre AS MATERIALIZED (
  SELECT conv_id, d, len(l) AS n, sha256(to_json(l[1:d])::VARCHAR) AS k, sha256(to_json(l[1:d - 1])::VARCHAR) AS up,
         CASE WHEN d > 0 THEN length(l[d].text) ELSE 0 END AS size
  FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM rebuilt)),
node AS MATERIALIZED (
  SELECT k, min(conv_id) AS conv_id, d, CASE WHEN d > 0 THEN min(up) END AS up, count(*) AS n_convs,
         (count(*) - 1) * min(size) AS own_saved, max(n) = d AS leaf,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends
  FROM pre GROUP BY k, d),
below AS (
  SELECT p.k, p.d, sum(u.own_saved) AS saved, count(*) FILTER (u.leaf) AS leaves
  FROM node u JOIN pre p ON p.conv_id = u.conv_id AND p.d <= u.d GROUP BY p.k, p.d),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS c FROM node WHERE d > 0 GROUP BY up, d)
SELECT node.conv_id, node.d::BIGINT AS depth, above.conv_id AS parent_conv_id, node.n_convs::BIGINT AS n_convs,
       coalesce(kids.c, 0)::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens,
       sha256(node.ends) AS ends_sha256
FROM node JOIN below ON below.k = node.k AND below.d = node.d
LEFT JOIN kids ON kids.k = node.k AND kids.d = node.d
LEFT JOIN node above ON above.k = node.up AND above.d = node.d - 1
"""
