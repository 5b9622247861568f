"""Connected components by alternating large-star and small-star steps (no collection of links or labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._common import materialise, spread_join


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that each node with a link can reach.

    ``edges`` has long columns ``a`` and ``b``. Self links and repeated links don't matter; no rows give no rows. Each
    step is two hash aggregations and a join over the links, written to the shared folder. Hubs, which stars make, are
    joined by broadcast: ``spread_join`` bounds how many there are.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialise(links, "links")
    seen = None
    for _ in range(max_rounds):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = links.union(links.select("b", "a").toDF("a", "b"))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "least")
        large = spread_join(both.where("b > a"), least.select("a", "m"), "a", least.select("a", "n"))
        large = materialise(large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-stars")
        # a node's larger neighbours now hang on its least one, so links lead down only and no node has many upwards
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialise(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
