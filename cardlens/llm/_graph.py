"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlens.llm._util import drop, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the edges.

    Every round each node points to the neighbour (or itself) with the least hash,
    so a constant share of the nodes vanishes whatever the shape of the graph; the
    edges are relabelled and made distinct again. Minima combine map-side and the
    relabelling joins are plain sort-merge joins, which AQE splits when one node
    has very many edges. Nothing but an emptiness test reaches the driver. Rounds
    are tables in the shared folder. Null ends and loops are ignored.
    """
    x, y = F.col(a), F.col(b)
    edges = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(
        F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    edges = materialize(edges, "edges")
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                         .withColumn("label", F.col("node")), "labels")
    rounds = 0
    while not edges.isEmpty():
        rounds += 1
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(rounds)).alias("h"), F.col(c).alias("to"))
        ends = edges.select(F.explode(F.array(
            F.struct(F.col("a").alias("at"), F.least(rank("a"), rank("b")).alias("r")),
            F.struct(F.col("b").alias("at"), F.least(rank("a"), rank("b")).alias("r")))).alias("e"))
        to = ends.groupBy(F.col("e.at").alias("at")).agg(F.min("e.r").alias("r")).select(
            "at", F.col("r.to").alias("to"))
        to = materialize(to, "parents")
        left = (edges.join(to.select(F.col("at").alias("a"), F.col("to").alias("ta")), "a")
                .join(to.select(F.col("at").alias("b"), F.col("to").alias("tb")), "b")
                .where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
                .distinct())
        left = materialize(left, "edges")
        relabelled = materialize(labels.join(to.withColumnRenamed("at", "label"), "label", "left").select(
            "node", F.coalesce("to", "label").alias("label")), "labels")
        for done in (edges, labels, to):
            drop(done)
        edges, labels = left, relabelled
    # written, so that the join reads plain shuffles and AQE can split a large component
    least = materialize(labels.groupBy("label").agg(F.min("node").alias("component")), "least")
    return labels.join(least, "label").select("node", "component")
