"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a keyed minimum (combined before its shuffle) and a join, so a node with
very many links is split by the skew-join handling and never gathered in one task.  The
links are written to the shared checkpoint folder after each round, which also cuts the
lineage.  Ids may be of any orderable type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node that has a link to another one; the component is
    its smallest node.  Null ends, loops and repeated links are ignored."""
    e = (links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
         .filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") != F.col("v"))).distinct()
         .checkpoint())
    before = None
    while True:
        # both directions by explode: a union would have twice the tasks in every stage that reads it
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("l")).select("l.u", "l.v")
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = (both.join(low, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter(F.col("u") != F.col("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = (large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
             .filter(F.col("u") != F.col("v")).distinct().checkpoint())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", "v").distinct())
