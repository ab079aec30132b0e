"""Connected components of a distributed edge list."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges: equal only when a round changed nothing."""
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r["n"], r["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect each node's larger (or smaller) neighbours to the smallest node in reach."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    linked = both.join(low, "a")
    if large:
        linked = linked.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        linked = linked.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b: long); a component is named by its smallest node.

    Large-star and small-star rounds (Kiveris et al. 2014) until nothing
    changes; each round is written to the shared folder.  At the end every
    node but the smallest of its component has exactly one edge, to that one.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = stored(_star(_star(now, True), False), "edges")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
