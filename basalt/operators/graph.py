"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.core.lineage import checkpoint


def components(links: DataFrame, most: int = 100) -> DataFrame:
    """(node, root) of every node of links (a, b); root is the least node reachable.

    Each round a node takes the least label around it, and the label of that label, so rounds grow with the logarithm
    of the longest path; it stops when no label changes.
    """
    both = checkpoint(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    now = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(most):
        around = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        joined = now.join(around, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        hop = joined.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = checkpoint(joined.join(hop, "root", "left").select("node", F.least("root", "next").alias("root"), "was"))
        if not after.where("root <> was").limit(1).count():
            return after.select("node", "root")
        now = after.select("node", "root")
    raise RuntimeError("components did not settle")
