"""Undirected graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch
from .components import components


def canonical_edges(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "weight", how: str = "max") -> DataFrame:
    """One row a pair, the lesser node first; blanks and self loops go; repeated pairs by max, mean or sum."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    agg = {"max": F.max, "mean": F.avg, "sum": F.sum}[how]
    return e.groupBy(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(agg(weight).alias("weight"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight")
    return both.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def induced(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges with both ends in the node set (of each group)."""
    src, dst = nodes.select(*by, F.col("node").alias("src")), nodes.select(*by, F.col("node").alias("dst"))
    return edges.join(src, "src").join(dst, ["dst", *by])


def laplacian(edges: DataFrame, kind: str = "unnormalized") -> DataFrame:
    """(i, j, v) of D - A, I - D^-1/2 A D^-1/2 or I - D^-1 A."""
    d = degrees(edges).select("node", F.col("strength").alias("d"))
    s = symmetric(edges).join(d.withColumnsRenamed({"node": "src", "d": "di"}), "src").join(d.withColumnsRenamed({"node": "dst", "d": "dj"}), "dst")
    off = {"unnormalized": -F.col("weight"), "normalized": -F.col("weight") / F.sqrt(F.col("di") * F.col("dj")), "random_walk": -F.col("weight") / F.col("di")}[kind]
    diag = d.select(F.col("node").alias("i"), F.col("node").alias("j"), (F.col("d") if kind == "unnormalized" else F.lit(1.0)).cast("double").alias("v"))
    return s.select(F.col("src").alias("i"), F.col("dst").alias("j"), off.cast("double").alias("v")).unionByName(diag)


def smoothness(edges: DataFrame, signal: DataFrame) -> DataFrame:
    """x' L x = sum of w (x_i - x_j)^2 over edges, and x' x, of the centred signal."""
    x = signal.select("node", "x")
    mean = x.agg(F.avg("x").alias("m"))
    e = edges.join(x.withColumnsRenamed({"node": "src", "x": "xi"}), "src").join(x.withColumnsRenamed({"node": "dst", "x": "xj"}), "dst")
    top = e.agg(F.sum(F.col("weight") * (F.col("xi") - F.col("xj")) ** 2).alias("smoothness"))
    return top.crossJoin(x.crossJoin(mean).agg(F.sum((F.col("x") - F.col("m")) ** 2).alias("energy")))


def component_table(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component_id, n_nodes, n_edges, is_largest): components numbered by size, then least node; isolates are components."""
    edges = Scratch(edges.sparkSession, "component-table").keep(edges.select("src", "dst"), "edges")
    roots = nodes.select("node").join(components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), dense=True), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n_nodes"))
    links = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).join(roots, "node").groupBy("root").agg(F.sum("n").alias("n_edges"))
    order = Window.orderBy(F.desc("n_nodes"), "root")
    numbered = sizes.join(links, "root", "left").select("root", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.row_number().over(order).alias("component_id"))
    return roots.join(numbered, "root").select("node", "component_id", "n_nodes", "n_edges", (F.col("component_id") == 1).alias("is_largest"))


def edge_density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.agg(F.countDistinct("node").alias("n"))
    e = induced(edges, nodes.select("node").distinct()).agg(F.count("*").alias("e"))
    return n.crossJoin(e).select("n", "e", F.when(F.col("n") > 1, 2 * F.col("e") / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))).otherwise(0.0).alias("density"))


def protein_genes(info: DataFrame, protein: str = "string_protein_id", gene: str = "preferred_name") -> DataFrame:
    """(protein, gene): one name a protein, the least of several; rows without either go."""
    held = info.where(F.col(protein).isNotNull() & F.col(gene).isNotNull())
    return held.groupBy(F.col(protein).alias("protein")).agg(F.min(gene).alias("gene"))


def gene_links(links: DataFrame, genes: DataFrame, how: str = "max") -> DataFrame:
    """Canonical edges between genes of links between proteins; links with an unnamed protein go."""
    a, b = genes.select(F.col("protein").alias("protein1"), F.col("gene").alias("a")), genes.select(F.col("protein").alias("protein2"), F.col("gene").alias("b"))
    named = links.join(a, "protein1").join(b, "protein2")
    return canonical_edges(named.select("a", "b", F.col("combined_score").cast("double").alias("weight")), how=how)


def descendants(terms: DataFrame, scratch: Scratch | None = None, known: bool = True) -> DataFrame:
    """(term, descendant) over the is_a links of (term, parents), a term itself only within a cycle. With ``known``, parents that the table lacks are no terms of it.

    Paths double in length each round and end when no pair is new, so rounds grow with the logarithm of the depth.
    """
    scratch = scratch or Scratch(terms.sparkSession, "descendants")
    pairs = scratch.keep(terms.select(F.explode("parents").alias("term"), F.col("term").alias("descendant")).distinct(), "pairs-0")
    n, i = pairs.count(), 0
    while True:
        i += 1
        longer = pairs.join(pairs.select(F.col("term").alias("descendant"), F.col("descendant").alias("further")), "descendant").select("term", F.col("further").alias("descendant"))
        pairs = scratch.keep(pairs.unionByName(longer).distinct(), f"pairs-{i}")
        scratch.drop(f"pairs-{i - 1}")
        before, n = n, pairs.count()
        if n == before:
            return pairs if not known else pairs.join(terms.select("term").distinct(), "term", "left_semi")
