"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every node of ``edges`` (a, b): comp is the smallest id reachable.

    Each round every node points to its smallest neighbour, pointers are followed once more, and edges
    are relabelled; nodes that are left at least halve in two rounds. Rounds are written tables.
    """
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = written(e.select(F.col("a").alias("id")).union(e.select("b")).distinct().withColumn("comp", F.col("id")), "labels")
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        low = written(low, "pointers")
        to = written(low.alias("p").join(low.alias("q"), F.col("p.low") == F.col("q.a")).select(F.col("p.a").alias("node"), F.least("p.low", "q.low").alias("to")), "pointers")
        old, labels = labels, written(labels.join(to, labels["comp"] == to["node"], "left").select("id", F.coalesce("to", "comp").alias("comp")), "labels")
        left, right = to.select(F.col("node").alias("a"), F.col("to").alias("ta")), to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        rest = e.join(left, "a").join(right, "b").where("ta <> tb")
        done, e = e, written(rest.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        forget(low, to, old, done)
    forget(e)
    return labels
