"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch


def components(links: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60, dense: bool = False) -> DataFrame:
    """(node, root): the least node of each linked node's component, for all nodes with a link.

    Alternating large-star and small-star rounds: each node's greater neighbours, then its
    lesser ones, are linked to the least of its neighbourhood, until all that is left are stars around
    lesser nodes. Each is a join with one aggregated row a node, so no neighbourhood is ever collected. The
    aggregated rows of a large star are written first, so that the join is one of two plain tables, in which Spark
    deals a node of very many links to several tasks. The driver sees two numbers of each round.

    ``dense`` is for graphs of many links a node: before the rounds each node moves onto its least neighbour, after which few pairs are left; links, read twice, are a written
    table then and need not be distinct.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    edges = _contracted(edges, scratch) if dense else scratch.keep(edges.distinct(), "edges-0")
    for i in range(1, max_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"least-{i}")
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = scratch.keep(small.where("u <> v").distinct(), f"edges-{i}")
        scratch.drop(f"edges-{i - 1}")
        scratch.drop(f"least-{i}")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("down"))
        if not ends.where("up > 1 or (up = 1 and down = 0)").agg(F.count("*")).first()[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _contracted(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Links with the same components: of each node to the least of its neighbourhood, and between these for each edge."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-0")
    moved = edges.join(least.withColumnRenamed("m", "mu"), "u").join(least.select(F.col("u").alias("v"), F.col("m").alias("mv")), "v")
    moved = moved.select(F.greatest("mu", "mv").alias("u"), F.least("mu", "mv").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    moved = scratch.keep(moved.where("u <> v").distinct(), "edges-0")
    scratch.drop("least-0")
    return moved


def joined(found: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of the components of more links, given those of the links so far (or None): only roots are searched."""
    if found is None:
        return scratch.keep(components(links, scratch), name)
    for end in ("a", "b"):
        links = links.join(found.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    links = scratch.keep(links.where("a <> b").distinct(), f"{name}-links")
    if links.isEmpty():
        return found
    new = scratch.keep(components(links, scratch), f"{name}-new")
    old = found.join(new.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return scratch.keep(old.unionByName(new.join(found.select("node"), "node", "left_anti")), name)
