"""Connected components over tables of links, by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import materialize, release


def _large(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Every node hands its larger neighbours to the least of itself and its neighbours.

    The least neighbour is found by a partial aggregation, so a node with very many links costs its task
    no more than one row a partition. Written out, it joins back between two plain exchanges, so that
    Spark can split a hot node's links, or broadcast it while it is under the size threshold.
    """
    both = edges.unionByName(edges.select(F.col("root").alias("k"), F.col("k").alias("root")))
    least = materialize(both.groupBy("k").agg(F.least(F.col("k"), F.min("root")).alias("m")), made)
    hung = both.join(least, "k").where(F.col("root") > F.col("k"))
    return hung.select(F.col("root").alias("k"), F.col("m").alias("root")).distinct()


def _small(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Every node joins its smaller neighbours, and itself, to the least of them. Edges run from larger to smaller."""
    least = materialize(edges.groupBy("k").agg(F.min("root").alias("m")), made)
    moved = edges.join(least, "k").where(F.col("root") > F.col("m")).select(F.col("root").alias("k"), F.col("m").alias("root"))
    return moved.unionByName(least.select("k", F.col("m").alias("root"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (k, root) -> (k, g): every linked node and the least node of its component.

    Large and small stars alternate until every node hangs on one root that hangs on nothing; the number
    of rounds grows with the logarithm of the longest chain, and no round makes more links than it was given.
    """
    now = materialize(edges.select(F.least("k", "root").alias("root"), F.greatest("k", "root").alias("k")).select("k", "root").where("k <> root").distinct())
    while True:
        single = now.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        if single and now.join(now.select(F.col("k").alias("x")).distinct(), F.col("root") == F.col("x"), "left_semi").isEmpty():
            break
        made = [now]
        now = materialize(_small(materialize(_large(now, made), made), made))
        release(made)
    tops = now.select(F.col("root").alias("k"), F.col("root").alias("g"))
    out = materialize(now.select("k", F.col("root").alias("g")).unionByName(tops).distinct())
    release([now])
    return out
