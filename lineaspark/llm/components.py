"""Connected components over an edge table, by alternating star contraction.

Only DataFrame operations; every round is written to the shared folder.  Links
and labels never leave the cluster: the driver sees one row of counters a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``a``, ``b``); root is the least node reachable.

    Large-star and small-star steps alternate until a round changes nothing.
    Self loops and repeated edges are allowed.  Nodes are of any orderable type.
    """
    now = scratch.table(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges-0"
    )
    state, k = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(now.join(low, "a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        name = f"large-{k + 1}"
        star = scratch.table(large, name)
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = scratch.table(small, f"edges-{k + 1}")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"edges-{k}")
        scratch.drop(name)
        now, k = after, k + 1
        if state == tuple(seen):
            break
        state = tuple(seen)
        if k >= max_rounds:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
