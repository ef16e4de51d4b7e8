"""Connected components of an edge table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected ``edges``; root is one
    node of the component, the same for all its nodes.

    Each round hooks every node to its smallest neighbour when that is
    smaller, follows these links to the end by doubling, replaces both ends
    of every edge by what they lead to and drops loops; the edge table shrinks
    until it is empty, in a logarithmic number of rounds for chains as well.
    A round is a few shuffles of the remaining edges; its tables are written
    to the shared scratch folder, so lineage stays short and a lost executor
    costs one round at most. Self-loops keep their node; null ends are ignored; an
    empty table gives an empty result.
    """
    spark = edges.sparkSession
    s = Scratch(spark)
    e = s.keep(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null"), "edges")
    labels = None
    while True:
        ends = e.select("a", "b").union(e.select("b", "a"))
        parent = s.keep(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                        .select("node", F.least("node", "low").alias("up")), "parent")
        while True:  # each pass doubles the length of the links that have been followed
            up = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            far = s.keep(parent.join(up, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("more")), "parent")
            s.drop(parent)
            parent = far
            if parent.where("more").isEmpty():
                break
        if labels is None:
            new = s.keep(parent.select("node", F.col("up").alias("root")), "labels")
        else:
            up = parent.select(F.col("node").alias("root"), "up")
            new = s.keep(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
            s.drop(labels)
        labels = new
        pa, pb = (parent.select(F.col("node").alias(c), F.col("up").alias(u)) for c, u in (("a", "ua"), ("b", "ub")))
        nxt = s.keep(e.join(pa, "a").join(pb, "b").where("ua <> ub")
                     .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
        s.drop(e, parent)
        e = nxt
        if e.isEmpty():
            s.drop(e)
            return labels
