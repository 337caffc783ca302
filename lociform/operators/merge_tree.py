"""Components of every top share of a ranking, for any number of replicates, from one merge tree.

An edge joins the selection when the worse ranked of its ends does. Boruvka rounds over all replicates at once (each component
takes its least outgoing edge) give a tree of components in which the greatest weight on the way from a node up to a common ancestor is
the share at which two nodes come together; a node's component at any share is the highest ancestor that it reaches over edges within that share. So
sizes, sums and links at all shares are sums over nodes under a label that is read off, and no share has a component search of its own.

Rounds grow with the logarithm of the nodes, each round a few joins; ranks of a replicate are one task over its nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch
from .relational import empirical, hash_permute


def _roots(links: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Of links (replicate, a, b, e) each component's least edge, and the component that they lead to: (replicate, node, w), (replicate, node, root)."""
    both = links.select("replicate", "a", "b", "e").unionByName(links.select("replicate", F.col("b").alias("a"), F.col("a").alias("b"), "e"))
    best = both.groupBy("replicate", "a").agg(F.min(F.struct("e", "b")).alias("x")).select("replicate", F.col("a").alias("node"), F.col("x.b").alias("up"), F.col("x.e.w").alias("w"))
    best = scratch.keep(best, f"best-{name}")
    # least edges lead to a pair that chose the same one; its lesser node is the root
    back = best.select("replicate", F.col("node").alias("up"), F.col("up").alias("back"))
    found = best.join(back, ["replicate", "up"]).select("replicate", "node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("root"))
    found, i = scratch.keep(found, f"roots-{name}-0"), 0
    while True:
        i += 1
        further = found.select("replicate", F.col("node").alias("root"), F.col("root").alias("top"))
        found = scratch.keep(found.join(further, ["replicate", "root"]).select("replicate", "node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), f"roots-{name}-{i}")
        scratch.drop(f"roots-{name}-{i - 1}")
        if not found.where("moved").limit(1).count():
            return best.select("replicate", "node", "w"), found.select("replicate", "node", "root")


def merge_tree(weighted: DataFrame, nodes: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """nodes (replicate, node, ...) with ``ups`` and ``weights``: each node's ancestors from round to round, and the weights of the edges that led there.

    weighted: (replicate, src, dst, w), one row a pair; ties of w are broken by src and dst.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "merge-tree")
    links = weighted.select("replicate", F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("w", "src", "dst").alias("e"))
    links = scratch.keep(links.where("a <> b"), "links-0")
    held = nodes.withColumns({"__at": F.col("node"), "ups": F.array().cast(f"array<{dict(nodes.dtypes)['node']}>"), "weights": F.array().cast(f"array<{dict(weighted.dtypes)['w']}>")})
    held = scratch.keep(held, "held-0")
    i = 0
    while links.limit(1).count():
        i += 1
        best, roots = _roots(links, scratch, str(i))
        step = best.join(roots, ["replicate", "node"]).select("replicate", F.col("node").alias("__at"), "root", "w")
        grown = lambda c, x: F.when(F.col("root").isNull(), F.col(c)).otherwise(F.concat(c, F.array(x)))
        held = held.join(step, ["replicate", "__at"], "left").withColumns({"ups": grown("ups", "root"), "weights": grown("weights", "w")})
        held = scratch.keep(held.withColumn("__at", F.coalesce("root", "__at")).drop("root", "w"), f"held-{i}")
        scratch.drop(f"held-{i - 1}")
        to = lambda c: roots.select("replicate", F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        moved = links.join(to("a"), ["replicate", "a"]).join(to("b"), ["replicate", "b"]).where("ra <> rb")
        moved = moved.groupBy("replicate", F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("e").alias("e"))
        links = scratch.keep(moved, f"links-{i}")
        scratch.drop(f"links-{i - 1}")
    return held.drop("__at")


def label_at(limit: Column) -> Column:
    """A node's component within a limit on weights, as (round, node), null for the node itself."""
    within = F.aggregate("weights", F.struct(F.lit(0).alias("j"), F.lit(True).alias("on")), lambda s, w: F.struct((s["j"] + (s["on"] & (w <= limit)).cast("int")).alias("j"), (s["on"] & (w <= limit)).alias("on")))
    return F.when(within["j"] > 0, F.struct(within["j"].alias("j"), F.element_at("ups", within["j"]).alias("top")))


def share_components(edges: DataFrame, scores: DataFrame, fractions: Sequence[float], scratch: Scratch | None = None, p_threshold: float = 5e-8) -> DataFrame:
    """A row for each (replicate, rank_fraction) and component of the graph that its top share induces, single nodes included.

    scores: replicate, node, score and, where known, p; nodes outside the graph are left out before shares are taken. n_genes, n_edges,
    mean_score, max_score, n_weak (members with p above the threshold; null without p), n_selected, and ``print``, equal for equal sets.
    """
    scratch = scratch or Scratch(scores.sparkSession, "shares")
    grid = sorted({float(f) for f in fractions})
    on = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    by = Window.partitionBy("replicate")
    ranked = scores.join(on, "node").withColumns({"rank": F.row_number().over(by.orderBy(F.desc("score"), "node")), "n": F.count("*").over(by)})
    limits = F.array(*(F.greatest(F.lit(1), F.bround(F.col("n") * f)).cast("int") for f in grid))
    ranked = scratch.keep(ranked.withColumn("limits", limits).where(F.col("rank") <= F.element_at("limits", -1)), "ranked")
    end = lambda c: ranked.select("replicate", F.col("node").alias(c), F.col("rank").alias(f"r_{c}"))
    weighted = edges.select("src", "dst").join(end("src"), "src").join(end("dst"), ["replicate", "dst"])
    weighted = scratch.keep(weighted.select("replicate", "src", "dst", F.greatest("r_src", "r_dst").alias("w")), "weighted")
    tree = merge_tree(weighted, ranked, scratch)
    joined = weighted.join(ranked.select("replicate", F.col("node").alias("src"), "limits"), ["replicate", "src"])
    links = joined.groupBy("replicate", F.col("src").alias("node")).agg(F.array(*(F.sum((F.col("w") <= F.element_at("limits", i + 1)).cast("long")) for i in range(len(grid)))).alias("links"))
    each = tree.join(links, ["replicate", "node"], "left").withColumn("x", F.explode(F.arrays_zip(F.array(*map(F.lit, grid)).alias("f"), F.col("limits").alias("k"), F.sequence(F.lit(1), F.lit(len(grid))).alias("i"))))
    each = each.where(F.col("rank") <= F.col("x.k")).withColumns({"rank_fraction": F.col("x.f"), "label": label_at(F.col("x.k"))})
    each = each.withColumns({"own": F.when(F.col("label").isNull(), F.col("node")), "n_links": F.coalesce(F.element_at("links", F.col("x.i")), F.lit(0))})
    weak = F.sum((F.coalesce(F.col("p"), F.lit(1.0)) > p_threshold).cast("int")) if "p" in scores.columns else F.lit(None).cast("long")
    print_ = F.concat_ws("-", F.count("*").cast("string"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).cast("string"), F.sum(F.hash("node").cast("long")).cast("string"))
    return each.groupBy("replicate", "rank_fraction", "label", "own").agg(
        F.max("x.k").alias("n_selected"), F.count("*").alias("n_genes"), F.sum("n_links").alias("n_edges"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"),
        weak.alias("n_weak"), F.min("node").alias("least_node"), print_.alias("print"),
    ).drop("label", "own")


def modules_of_shares(
    each: DataFrame, min_size: int = 5, min_weak: int = 3, max_modules: int = 20, broad_size: int = 200, broad_share: float = 0.5, repeats: bool = False
) -> DataFrame:
    """Of the components those that count as modules: each replicate's first ``max_modules``, narrow ones before broad ones, by mean score, size and density.

    A set found at several shares counts at the smallest, or at each of them with ``repeats``.
    """
    n = F.col("n_genes")
    held = each.where((n >= min_size) & F.coalesce(F.col("n_weak") >= min_weak, F.lit(True)))
    held = held.withColumns({"is_broad": (n >= broad_size) | (n >= broad_share * F.col("n_selected")), "edge_density": F.when(n > 1, 2 * F.col("n_edges") / (n * F.greatest(n - 1, F.lit(1)))).otherwise(0.0)})
    if not repeats:
        once = Window.partitionBy("replicate", "print").orderBy("rank_fraction", "least_node")
        held = held.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    order = Window.partitionBy("replicate").orderBy("is_broad", F.desc("mean_score"), F.desc("n_genes"), F.desc("edge_density"), "rank_fraction", "least_node")
    return held.withColumn("module_rank", F.row_number().over(order)).where(F.col("module_rank") <= max_modules).drop("print")


def reselection_null(
    edges: DataFrame, scores: DataFrame, replicates: int, fractions: Sequence[float] = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20), seed: int = 1,
    repeats: bool = False, scratch: Scratch | None = None, **options,
) -> tuple[DataFrame, DataFrame]:
    """(modules, nulls): the search for modules on the scores, and the greatest statistics of the same search on each replicate of permuted scores.

    scores: node, score, bin and, where known, p, which stays with its node. Scores are dealt anew within bins among nodes of the graph. modules: the observed ones
    with an upper empirical p for mean score, density and size against the replicates' maxima; a replicate that finds none counts as
    minus infinity, 0 and 0. One merge tree serves the observed scores and all replicates.
    """
    scratch = scratch or Scratch(scores.sparkSession, "reselection")
    on = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    p = ["p"] if "p" in scores.columns else []
    held = scratch.keep(scores.select("node", "score", "bin", *p).join(on, "node"), "scores")
    dealt = hash_permute(held, "score", "node", ["bin"], replicates, seed).select("replicate", "node", "score")
    if p:
        dealt = dealt.join(held.select("node", "p"), "node")
    every = dealt.unionByName(held.select(F.lit(-1).alias("replicate"), "node", "score", *p))
    found = scratch.keep(modules_of_shares(share_components(edges, every, fractions, scratch), repeats=repeats, **options), "modules")
    top = found.where("replicate >= 0").groupBy("replicate").agg(
        F.count("*").alias("n_modules"), F.max("mean_score").alias("max_mean_score"), F.max("edge_density").alias("max_edge_density"), F.max("n_genes").alias("max_n_genes")
    )
    nulls = scores.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate")).join(top, "replicate", "left")
    nulls = nulls.select("replicate", F.coalesce("n_modules", F.lit(0)).alias("n_modules"), F.coalesce("max_mean_score", F.lit(float("-inf"))).alias("max_mean_score"), F.coalesce("max_edge_density", F.lit(0.0)).alias("max_edge_density"), F.coalesce("max_n_genes", F.lit(0)).alias("max_n_genes"))
    nulls = scratch.keep(nulls, "nulls")
    modules = found.where("replicate = -1").drop("replicate")
    for name, value in (("max_mean_score", "mean_score"), ("max_edge_density", "edge_density"), ("max_n_genes", "n_genes")):
        seen = modules.select("module_rank", F.round(F.col(value).cast("double"), 9).alias("observed"))
        rows = seen.select("module_rank").crossJoin(F.broadcast(nulls.select(F.round(F.col(name).cast("double"), 9).alias("value"))))  # modules of a report by replicates
        modules = modules.join(empirical(rows, seen, ["module_rank"]).select("module_rank", F.col("p_upper").alias(f"{value}_p")), "module_rank")
    return modules, nulls
