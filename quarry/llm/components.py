"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is two aggregations with a map-side minimum and two joins; the links of a hub are
never gathered in one task. Each round's table is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. edges: distinct (u, v) with u > v."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = (edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(least.select("u", F.col("m").alias("v"))))
    return out.filter("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component: its smallest reachable node.
    Nulls are no nodes; an empty table has no components."""
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                        .filter("u > v").distinct(), "links")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(edges)
    while True:
        old, edges = edges, materialize(_star(_star(edges, True), False), "links")
        release(old)
        now = print_of(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(roots.select(F.col("component").alias("node"), "component").distinct())
