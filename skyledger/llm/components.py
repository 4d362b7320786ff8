"""Connected components of links by alternating large-star and small-star steps, all on Spark.

Each step joins the links with the least neighbour of each node. A node with a
third of all links is one row of the aggregate after the map-side combine, and
Spark splits its side of the join. Links are written after each two steps, so the
lineage stays short; only whether steps are left to do reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.storage import stored

# Links that a task writes: more tasks would be spent on the files of a few links each.
ROWS_EACH = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b", known: DataFrame | None = None) -> DataFrame:
    """`node`, `root` for every node that is not the least of its component; the root is.

    `known` is what this returned for earlier links, which then count as well.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
    edges = stored((edges if known is None else edges.union(known)).distinct(), "links")
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // ROWS_EACH))
    while True:
        both = edges.union(edges.select("root", "node"))
        least = stored(both.groupBy("node").agg(F.min("root").alias("least"), F.count("*").alias("n")).coalesce(parts), "links")
        # Links keep what is connected and point to the lesser node, so once all are stars, their centres are the roots.
        if not least.agg(F.bool_or((F.col("least") < F.col("node")) & (F.col("n") > 1))).first()[0]:
            return edges
        least = least.select("node", F.least("least", "node").alias("least"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("least").alias("root"))
        least = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(least, "node").where("root != least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        edges = stored(small.union(least).distinct().coalesce(parts), "links")
