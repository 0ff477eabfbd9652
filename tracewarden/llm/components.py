"""Connected components of a graph given as an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or not larger) neighbours to the least of its neighbourhood. edges: distinct (u, v), u > v."""
    if large:
        pairs = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if large:
        new = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return new.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another; root: the least node of the component.

    Each round halves paths, so rounds grow with the logarithm of the longest one; each is written to the shared folder. Nulls, loops
    and repeated edges are passed over. The hot node of a star is handled by partial aggregation and by skew splitting of the join.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` <> `{b}`").distinct()
    e = write_shared(e, "edges")
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = now
        e = write_shared(_star(_star(e, True), False), "edges")
