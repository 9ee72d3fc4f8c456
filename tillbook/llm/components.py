"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a min-aggregation and a join by node; both pre-aggregate before the shuffle, and the join of a hot
node is an inner equi-join that AQE can split.  No group is ever gathered in one task, and every iteration's
edges go to the shared folder.  Tasks are as many as the edges need (``gathered``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import gathered, materialize


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return gathered(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), n)


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    each = F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), F.col("m")))
    out = gathered(joined, n).select(F.explode(each).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return gathered(out.filter("u <> v").distinct(), n)


def _are_stars(edges: DataFrame, n: int) -> bool:
    """Whether each child has one parent and no parent is a child."""
    ends = F.array(F.struct(F.col("u").alias("x"), F.lit(True).alias("child"), F.col("v").alias("parent")),
                   F.struct(F.col("v").alias("x"), F.lit(False).alias("child"), F.lit(None).cast("long").alias("parent")))
    nodes = (edges.select(F.explode(ends).alias("e")).groupBy("e.x")
             .agg(F.max("e.child").alias("child"), F.min("e.child").alias("only_child"), F.min("e.parent").alias("a"), F.max("e.parent").alias("b")))
    return not gathered(nodes, n).filter("(child and not only_child) or a <> b").limit(1).count()


def connected_components(links: DataFrame) -> DataFrame:
    """``links(u long, v long)`` -> ``(id, root)`` for every linked node but the roots themselves, root being its
    component's smallest id.  Null ends and self links are ignored; no links give an empty table."""
    down = links.filter("u is not null and v is not null and u <> v")
    edges = materialize(down.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    n = edges.count()
    while n and not _are_stars(edges, n):
        edges = materialize(_small_star(_large_star(edges, n), n), "stars")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
