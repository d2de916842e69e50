"""Span analytics (S8 T1-T3, span trees).

Latency statistics are exact. The median is found from value counts ranked
in three levels (value buckets, slices of the middle bucket, then the values of
a slice), so a span name with a third of all spans is never ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardlens.params import Params
from cardlens.session import shared_dir
from cardlens.sources.standins import spans
from cardlens.sources.traces import nested_records, read_span_lines

TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DUR = "decimal(38,6)"  # milliseconds to the nanosecond
SLICES = 4096


def stored_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans read back from nested records in the shared folder."""
    path = shared_dir(spark, "traces")
    nested_records(spans(spark, sf_dir)).write.json(path)
    return read_span_lines(spark, path)


def span_flatten(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """One flat row per span of the stored nested records."""
    s = stored_spans(spark, sf_dir)
    start = F.timestamp_micros(F.expr("start_ns div 1000"))
    return s.select(F.col("span_id").cast("bigint").alias("span_id"), F.col("trace_id").cast("bigint").alias("trace_key"),
                    "name", F.date_format(start, TS_TEXT).alias("start_time"),
                    "duration_ms", F.col("status_code").alias("status"), "input_tokens", "output_tokens")


def _log_bucket(v):
    """Monotone bucket of a value, about 4.4% wide (16 per doubling)."""
    x = v.cast("double")
    pos = F.floor(F.log2(F.lit(1.0) + x) * 16)
    neg = -F.floor(F.log2(F.lit(1.0) - x) * 16) - 1
    return F.when(x < 0, neg).otherwise(pos).cast("int")


def _with_key(left: DataFrame, right: DataFrame, key: str, others: list[str]) -> DataFrame:
    """Inner join on a key that may be null and on columns that may not."""
    right = right.select(*[F.col(c).alias(f"r_{c}") if c in (key, *others) else F.col(c) for c in right.columns])
    same = F.col(key).eqNullSafe(F.col(f"r_{key}"))
    for c in others:
        same = same & (F.col(c) == F.col(f"r_{c}"))
    return left.join(right, same, "inner").drop(f"r_{key}", *[f"r_{c}" for c in others])


def latency_stats(s: DataFrame, key: str = "name", value: str = "duration_ms") -> DataFrame:
    """n, min, median, mean, max, sum of ``value`` per ``key`` (T1), exact to a
    nanosecond (six decimals of a millisecond, as spans are stored).

    1. values are counted per (key, value) map-side;
    2. counts are summed per (key, bucket) and ranked over the few hundred
       buckets of a key, which locates the bucket of each middle rank;
    3. those (at most two) buckets are cut in ``SLICES`` equal slices each, which
       are ranked in the same way;
    4. only the values of the slices that hold a middle rank are ranked.
    No task sees all values of a key: a slice is 4.4 % / ``SLICES`` of a value wide.
    """
    d = s.select(key, F.col(value).cast(DUR).alias("v")).where(F.col("v").isNotNull())
    counts = d.groupBy(key, "v").agg(F.count("*").alias("c")).withColumn("b", _log_bucket(F.col("v")))
    buckets = counts.groupBy(key, "b").agg(
        F.sum("c").alias("bc"), F.min("v").alias("bmin"), F.max("v").alias("bmax"),
        F.sum(F.col("v") * F.col("c")).alias("bsum"))
    w_prev = Window.partitionBy(key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranked = buckets.select(key, "b", "bc", "bmin", "bmax", "bsum",
                            F.coalesce(F.sum("bc").over(w_prev), F.lit(0)).alias("before"),
                            F.sum("bc").over(Window.partitionBy(key)).alias("n"))
    lo = F.floor((F.col("n") - 1) / 2) + 1
    hi = F.floor(F.col("n") / 2) + 1

    def holds(r, c):
        return (F.col("before") < r) & (r <= F.col("before") + F.col(c))

    targets = ranked.where(holds(lo, "bc") | holds(hi, "bc")).select(key, "b", "before", "n", "bmin", "bmax")
    wide = F.greatest((F.col("bmax") - F.col("bmin")).cast("double"), F.lit(1e-9))
    inside = _with_key(counts, targets, key, ["b"]).withColumn(
        "slice", F.floor((F.col("v") - F.col("bmin")).cast("double") / wide * SLICES).cast("int"))
    slices = inside.groupBy(key, "b", "slice").agg(
        F.sum("c").alias("sc"), F.max("n").alias("n"), F.max("before").alias("first"))
    w_slice = Window.partitionBy(key, "b").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.col("first") + F.coalesce(F.sum("sc").over(w_slice), F.lit(0)))
    slices = slices.where(holds(lo, "sc") | holds(hi, "sc")).select(
        key, "b", "slice", F.col("before").alias("slice_before"))
    w_in = Window.partitionBy(key, "b", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = _with_key(inside, slices, key, ["b", "slice"]).withColumn(
        "cum", F.col("slice_before") + F.sum("c").over(w_in))
    # a value holds the ranks after the count before it, up to the count through it
    mid = inside.groupBy(key).agg(
        F.min(F.when(F.col("cum") >= lo, F.col("v"))).alias("vlo"),
        F.min(F.when(F.col("cum") >= hi, F.col("v"))).alias("vhi"))
    tot = ranked.groupBy(key).agg(
        F.max("n").alias("n"), F.min("bmin").alias("vmin"), F.max("bmax").alias("vmax"),
        F.sum("bsum").alias("vsum"))
    g = tot.join(mid, tot[key].eqNullSafe(mid[key]), "inner").drop(mid[key])
    return g.select(
        key, F.col("n").alias("n_spans"),
        F.col("vmin").cast("double").alias("min_ms"),
        ((F.col("vlo").cast("double") + F.col("vhi").cast("double")) / 2.0).alias("median_ms"),
        (F.col("vsum").cast("double") / F.col("n").cast("double")).alias("mean_ms"),
        F.col("vmax").cast("double").alias("max_ms"),
        F.col("vsum").cast("double").alias("sum_ms"))


def span_latency(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    return latency_stats(spans(spark, sf_dir))


def usage_of(s: DataFrame) -> DataFrame:
    """T2 over flat spans: calls, input and output tokens per model, as the span's
    outputs name it; a span that names none counts under its own name."""
    total = F.col("input_tokens") + F.col("output_tokens")
    return s.groupBy(F.coalesce("model", "name").alias("model")).agg(
        F.count("*").alias("n_calls"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(total).alias("total_tokens"), F.max(total).alias("max_tokens"),
        F.sum(F.when(F.col("status_code") == "ERROR", 1).otherwise(0)).alias("n_errors"))


def token_usage(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    return usage_of(stored_spans(spark, sf_dir))


OPEN_SPAN = "signup"
CLOSE_SPAN = "purchase"


SLICE_SPANS = 100_000  # spans of a window, about
_MICROS = {"minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def episode_numbers(s: DataFrame, bucket: str = "hour", opener: str | None = OPEN_SPAN,
                    closer: str | None = None, reopen: bool = False) -> DataFrame:
    """Number each span with its episode on its key, in the order of start and id.

    - ``opener`` alone: the count of opening spans at or before the span (0 before the
      first opening).
    - ``closer`` alone: the count of closing spans strictly before it (an answer ends
      its question's episode).
    - both: an opening span starts an episode if none is open, a closing span ends the
      open one and belongs to it; a span outside, a stray closing one too, has no
      episode (null). An opening span inside an open episode belongs to it, as a repair
      chain does that bears the first chain's name; with ``reopen`` it starts the next
      one instead, and the one before has no answer.

    A key's timeline is cut into time buckets, and a bucket of more than
    ``SLICE_SPANS`` spans into as many equal slices as it takes. With both markers a
    slice is a change of state: (open or not) at its end and episodes begun, for either
    state at its start. The state after a marker does not depend on the state before it,
    so a slice's changes compose from its first marker, its last marker and the episodes
    it begins when it starts closed: a scan over the slices of a key gives each one's
    starting state and number, and a window inside the slice does the rest. No window
    spans a whole key, so a key with a third of all spans, or a busy hour of it, is
    spread over its slices.
    """
    if opener is None and closer is None:
        raise ValueError("name an opening span, a closing span or both")
    single = opener is None or closer is None
    if opener is not None and opener == closer:
        raise ValueError("an opening span cannot close")
    name = F.col("name")
    s = s.withColumn("mark", F.when(name == F.lit(opener), 1).when(name == F.lit(closer), 0)).withColumn(
        "bucket", F.date_trunc(bucket, "start_ts"))
    load = s.groupBy("trace_key", "bucket").agg(F.ceil(F.count("*") / SLICE_SPANS).alias("parts"))
    into = F.unix_micros(F.col("start_ts").cast("timestamp")) - F.unix_micros(F.col("bucket").cast("timestamp"))
    same = (F.col("trace_key").eqNullSafe(F.col("l_key"))) & (F.col("bucket").eqNullSafe(F.col("l_bucket")))
    load = load.select(F.col("trace_key").alias("l_key"), F.col("bucket").alias("l_bucket"), "parts")
    s = s.join(load, same, "inner").drop("l_key", "l_bucket").withColumn(
        "slice", F.floor(into / _MICROS[bucket] * F.col("parts")).cast("bigint")).drop("parts")

    inside = Window.partitionBy("trace_key", "bucket", "slice").orderBy("start_ts", "span_id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    through = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the state before a span, as far as its own slice tells
    s = s.withColumn("own_state", F.last("mark", ignorenulls=True).over(before))
    if single:
        begins = F.when(F.col("mark").isNotNull(), 1).otherwise(0)
    elif reopen:
        begins = F.when(F.col("mark") == 1, 1).otherwise(0)
    else:
        begins = F.when((F.col("mark") == 1) & (F.coalesce("own_state", F.lit(0)) == 0), 1).otherwise(0)
    s = s.withColumn("begins", begins).withColumn("begun", F.sum("begins").over(through))

    order = F.struct("start_ts", "span_id")
    marked = F.when(F.col("mark").isNotNull(), order)
    per_slice = s.groupBy("trace_key", "bucket", "slice").agg(
        F.min_by("mark", marked).alias("first_mark"), F.max_by("mark", marked).alias("last_mark"), F.sum("begins").alias("n_begins"))
    w_prev = Window.partitionBy("trace_key").orderBy("bucket", "slice").rowsBetween(Window.unboundedPreceding, -1)
    scan = per_slice.withColumn("state", F.coalesce(F.last("last_mark", ignorenulls=True).over(w_prev), F.lit(0)))
    # an opening at the head of a slice begins nothing if the slice starts open
    again = F.when((F.col("state") == 1) & (F.col("first_mark") == 1), 1).otherwise(0)
    scan = scan.withColumn("again", F.lit(0) if single or reopen else again)
    prior = scan.select(F.col("trace_key").alias("l_key"), F.col("bucket").alias("l_bucket"), F.col("slice").alias("l_slice"), "state", "again",
                        F.coalesce(F.sum(F.col("n_begins") - F.col("again")).over(w_prev), F.lit(0)).alias("prior"))
    s = s.join(prior, same & F.col("slice").eqNullSafe(F.col("l_slice")), "inner")
    if single:
        number = F.col("prior") + F.col("begun") - (F.col("begins") if closer is not None else F.lit(0))
    else:
        # within a slice that starts open, its first opening was counted once too often
        late = F.when(F.coalesce(F.col("own_state"), F.col("mark")).isNotNull(), F.col("again")).otherwise(0)
        is_open = (F.coalesce("own_state", "state") == 1) | F.coalesce(F.col("mark") == 1, F.lit(False))
        number = F.when(is_open, F.col("prior") + F.col("begun") - late)
    return s.withColumn("episode_no", number.cast("bigint")).drop(
        "bucket", "slice", "mark", "own_state", "begins", "begun", "state", "again", "prior", "l_key", "l_bucket", "l_slice")


def episodes(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """One row per (key, episode) between an opening and a closing span: spans, first
    and last start, time, and whether its answer came. Spans outside belong to none."""
    e = episode_numbers(spans(spark, sf_dir), p.episode_bucket, OPEN_SPAN, CLOSE_SPAN).where("episode_no is not null")
    g = e.groupBy("trace_key", "episode_no").agg(
        F.count("*").alias("n_spans"),
        F.min("start_ts").alias("first_ts"), F.max("start_ts").alias("last_ts"),
        F.sum(F.col("duration_ms").cast(DUR)).cast("double").alias("total_ms"),
        F.sum(F.when(F.col("status") == "ERROR", 1).otherwise(0)).alias("n_errors"),
        F.max(F.coalesce(F.col("name") == CLOSE_SPAN, F.lit(False))).alias("answered"))
    return g.select("trace_key", "episode_no", "n_spans",
                    F.date_format("first_ts", TS_TEXT).alias("first_time"),
                    F.date_format("last_ts", TS_TEXT).alias("last_time"),
                    "total_ms", "n_errors", "answered")


def span_tree_of(s: DataFrame) -> DataFrame:
    """request_id, span_id, root_id, depth, own_ms and total_ms of flat spans.

    Input: request_id, span_id, parent_id, duration_ms. Spans of one request with a
    parent form trees; a span without a parent, or whose parent is not among the spans,
    is a root at depth 0. ``own_ms`` is the span's time less that of its children, so
    the own times of a tree add up to its root's time (all in exact decimals). Parents are resolved by
    pointer doubling: in each round every span takes over the pointer of the span it
    points at, so a chain of n spans takes log2(n) rounds, each one join of plain
    tables written to the shared folder. Spans on a cycle, or below one, have no root:
    root_id and depth stay null. A null request id is a request of its own; rows
    without a span id cannot be pointed at and are roots. Of rows that repeat a span id
    within a request each gets its own row; their children count once for each.
    """
    spark = s.sparkSession
    s = s.select("request_id", "span_id", "parent_id", F.col("duration_ms").cast(DUR).alias("total"))
    ids = s.where("span_id is not null").select("request_id", "span_id").distinct()
    at = lambda a, b, x, y: F.col(a).eqNullSafe(F.col(b)) & (F.col(x) == F.col(y))
    known = ids.select(F.col("request_id").alias("p_req"), F.col("span_id").alias("p_id"))
    up = (s.where("span_id is not null and parent_id is not null").groupBy("request_id", "span_id").agg(F.min("parent_id").alias("parent_id"))
          .join(known, at("request_id", "p_req", "parent_id", "p_id"), "left_semi"))
    # to: the span pointed at, hops: how far it is; roots point at nothing
    links = _written(ids.select(F.col("request_id").alias("i_req"), F.col("span_id").alias("i_id")).join(
        up, F.col("i_req").eqNullSafe(F.col("request_id")) & (F.col("i_id") == F.col("span_id")), "left").select(
        F.col("i_req").alias("request_id"), F.col("i_id").alias("span_id"), F.col("i_id").alias("root_id"),
        F.col("parent_id").alias("to"), F.lit(0).cast("long").alias("depth"), F.when(F.col("parent_id").isNotNull(), F.lit(1)).cast("long").alias("hops")), "links")
    # a pointer that has passed more spans than there are runs on a cycle
    left = links.count()
    rounds = 0
    while left >> rounds and not links.where("to is not null").isEmpty():
        rounds += 1
        nxt = links.select(F.col("request_id").alias("n_req"), F.col("span_id").alias("n_id"), F.col("root_id").alias("n_root"),
                           F.col("to").alias("n_to"), F.col("depth").alias("n_depth"), F.col("hops").alias("n_hops"))
        j = links.join(nxt, at("request_id", "n_req", "to", "n_id"), "left")
        done = F.col("to").isNotNull() & F.col("n_to").isNull()  # the span pointed at is settled
        links = _written(j.select(
            "request_id", "span_id", F.when(done, F.col("n_root")).otherwise(F.col("root_id")).alias("root_id"),
            F.col("n_to").alias("to"), F.when(done, F.col("hops") + F.col("n_depth")).otherwise(F.col("depth")).alias("depth"),
            F.when(F.col("n_to").isNotNull(), F.col("hops") + F.col("n_hops")).alias("hops")), "links")
    settled = links.select(F.col("request_id").alias("t_req"), F.col("span_id").alias("t_id"), F.col("to").isNull().alias("ok"), "root_id", "depth")
    kids = (s.join(up.select(F.col("request_id").alias("u_req"), F.col("span_id").alias("u_id")),
                   at("request_id", "u_req", "span_id", "u_id"), "left_semi")
            .groupBy(F.col("request_id").alias("k_req"), F.col("parent_id").alias("k_id")).agg(F.sum("total").alias("children")))
    out = s.join(settled, at("request_id", "t_req", "span_id", "t_id"), "left").join(kids, at("request_id", "k_req", "span_id", "k_id"), "left")
    alone = F.col("span_id").isNull()
    return out.select(
        "request_id", "span_id", F.when(alone, F.col("span_id")).when(F.col("ok"), F.col("root_id")).alias("root_id"),
        F.when(alone, F.lit(0)).when(F.col("ok"), F.col("depth")).cast("long").alias("depth"),
        (F.col("total") - F.coalesce("children", F.lit(0).cast(DUR))).cast("double").alias("own_ms"), F.col("total").cast("double").alias("total_ms"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def span_tree(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Depth, root and own time of every stored span; a trace is 64 events."""
    s = spans(spark, sf_dir).select(
        F.expr("span_id div 64").alias("request_id"), "span_id", "parent_id", "duration_ms")
    return span_tree_of(s)
