"""Backbone edges: the best further edges that attach components to the largest one, up to a share of all nodes.

The scan that defines them goes once through the candidates in order of priority and takes an edge if just one end lies in the largest component at
that moment. When a component is attached is therefore the least place, along any way from the largest component, of edges in
ascending order: a search of earliest arrival, in rounds of one join over the components that moved. It goes through the places window by window, as an
arrival depends on earlier edges alone, and ends with the window in which the target is reached. A running sum of the attached sizes then gives the cut.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch
from .components import components

#: Shares of the candidates at which windows of the search end.
SHARES = (0.125, 0.25, 0.5)


def candidate_edges(edges: DataFrame, existing: DataFrame, support: DataFrame, universe: DataFrame) -> DataFrame:
    """(src, dst, weight, edge_support, priority) of the edges within the universe that are not yet there.

    Priority is 0.75 weight + 0.25 root of the product of both ends' support (node, support; 0 where missing). Edges and existing ones are canonical: src < dst.
    """
    new = edges.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")
    known = universe.select("node").distinct().join(support.select("node", "support"), "node", "left")
    side = lambda c: known.select(F.col("node").alias(c), F.col("support").alias(f"s_{c}"))
    both = new.join(side("src"), "src").join(side("dst"), "dst")
    shared = F.sqrt(F.coalesce("s_src", F.lit(0.0)) * F.coalesce("s_dst", F.lit(0.0)))
    return both.select("src", "dst", F.col("weight").cast("double").alias("weight"), shared.alias("edge_support"), (0.75 * F.col("weight") + 0.25 * shared).alias("priority"))


def _arrivals(links: DataFrame, windows: int, sizes: DataFrame, largest, missing: int, scratch: Scratch, name: str) -> DataFrame:
    """(c, at): the components that edges in ascending order lead to from the largest, and the place of the edge that attaches each.

    links: a, b, place and the ``window`` of the place, either way round. No window is opened after one by whose end the attached sizes add up to ``missing``.
    """
    one = sizes.where(F.col("c") == F.lit(largest)).select("c")
    known = None
    for w in range(windows):
        inside = one if known is None else one.unionByName(known.select("c"))
        # whatever lies inside came with an earlier window, before all places of this one
        some = links.where(F.col("window") == w).select("a", "b", "place")
        some = some.join(inside.select(F.col("c").alias("a"), F.lit(True).alias("in_a")), "a", "left").join(inside.select(F.col("c").alias("b"), F.lit(True).alias("in_b")), "b", "left")
        some = scratch.keep(some.where("in_a is null or in_b is null"), f"window-{name}-{w}")
        out = F.when(F.col("in_a"), F.col("b")).otherwise(F.col("a"))
        new = some.where("in_a or in_b").groupBy(out.alias("c")).agg(F.min("place").alias("at"))
        new = scratch.keep(new.withColumn("moved", F.lit(True)), f"arrivals-{name}-{w}-0")
        outer = some.where("in_a is null and in_b is null").select("a", "b", "place")
        outer = outer.unionByName(outer.select(F.col("b").alias("a"), F.col("a").alias("b"), "place"))
        i = 0
        while new.where("moved").limit(1).count():
            i += 1
            onward = new.where("moved").join(outer, F.col("c") == F.col("a")).where("place > at").groupBy("b").agg(F.min("place").alias("new"))
            later = new.select("c", "at").join(onward.withColumnRenamed("b", "c"), "c", "full")
            earlier = F.col("new").isNotNull() & (F.col("at").isNull() | (F.col("new") < F.col("at")))
            new = scratch.keep(later.select("c", F.when(earlier, F.col("new")).otherwise(F.col("at")).alias("at"), earlier.alias("moved")), f"arrivals-{name}-{w}-{i}")
            scratch.drop(f"arrivals-{name}-{w}-{i - 1}")
        scratch.drop(f"window-{name}-{w}")
        both = new.select("c", "at") if known is None else known.unionByName(new.select("c", "at"))
        known = scratch.keep(both, f"known-{name}-{w}")
        if w + 1 < windows and (known.join(sizes, "c").agg(F.sum("size")).first()[0] or 0) >= missing:
            break
    return known


def add_backbone(existing: DataFrame, candidates: DataFrame, universe: DataFrame, target: float = 0.65, most: float = 0.70, scratch: Scratch | None = None, shares: tuple[float, ...] = SHARES) -> tuple[DataFrame, dict]:
    """(edges, report): the candidates taken, in order, with ``component_size`` after each, and sizes before and after.

    Equal priorities are ordered by weight, support and ends. A component that would lift the largest above ``most`` of the universe while it is below ``target`` is passed
    over; the scan ends when ``target`` is reached. The running sum is one task over the attached components. ``shares`` of the candidates, by priority, are where windows end; they decide
    what is searched together, not what is found.
    """
    if not 0 < target <= most <= 1:
        raise ValueError("0 < target <= most <= 1")
    scratch = scratch or Scratch(universe.sparkSession, "backbone")
    nodes = universe.select("node").distinct()
    inner = existing.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    found = components(inner.select(F.col("src").alias("a"), F.col("dst").alias("b")), scratch)
    named = scratch.keep(nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("c")), "components")
    sizes = scratch.keep(named.groupBy("c").agg(F.count("*").alias("size")), "sizes")
    first = sizes.orderBy(F.desc("size"), "c").first()
    if first is None:
        return candidates.withColumn("component_size", F.lit(0).cast("long")).limit(0), {"n_universe": 0, "initial_size": 0, "final_size": 0, "n_added": 0}
    n = named.count()
    target_size, most_size, start = math.ceil(target * n), math.floor(most * n), first["size"]
    place = F.struct((-F.col("priority")).alias("p"), (-F.col("weight")).alias("w"), (-F.col("edge_support")).alias("s"), "src", "dst")
    end = lambda c, out: named.select(F.col("node").alias(c), F.col("c").alias(out))
    links = candidates.join(end("src", "a"), "src").join(end("dst", "b"), "dst").where("a <> b").withColumn("place", place)
    links = scratch.keep(links.select("a", "b", "place"), "links")
    bounds = sorted(set(links.select("place.p").approxQuantile("p", list(shares), 0.01))) if shares else []
    links = links.withColumn("window", sum((F.coalesce((F.col("place.p") > x).cast("int"), F.lit(0)) for x in bounds), F.lit(0)))
    passed, taken, k = None, None, 0
    while True:
        open_ = links if passed is None else links.join(passed.select(F.col("c").alias("a")), "a", "left_anti").join(passed.select(F.col("c").alias("b")), "b", "left_anti")
        arrived = _arrivals(open_, len(bounds) + 1, sizes, first["c"], target_size - start, scratch, str(k)).join(sizes, "c")
        by = Window.orderBy("at")
        run = arrived.withColumns({"i": F.row_number().over(by), "before": F.lit(start) + F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        run = scratch.keep(run.where((F.col("i") == 1) | (F.col("before") < target_size)), f"run-{k}")
        over = run.where(F.col("before") + F.col("size") > most_size).orderBy("i").first()
        taken = run if over is None else run.where(F.col("i") < over["i"])
        if over is None or over["before"] >= target_size:
            break
        # the largest only grows: whatever is too large now stays so
        big = sizes.where((F.col("size") > most_size - over["before"]) & (F.col("c") != F.lit(first["c"]))).join(taken.select("c"), "c", "left_anti").select("c")
        passed = scratch.keep(big if passed is None else passed.unionByName(big).distinct(), f"passed-{k}")
        k += 1
    added = taken.select(F.col("at.src").alias("src"), F.col("at.dst").alias("dst"), (-F.col("at.w")).alias("weight"), (-F.col("at.s")).alias("edge_support"), (-F.col("at.p")).alias("priority"), (F.col("before") + F.col("size")).alias("component_size"))
    added = scratch.keep(added, "added")
    end_ = added.agg(F.count("*"), F.max("component_size")).first()
    return added, {"n_universe": n, "target_size": target_size, "most_size": most_size, "initial_size": start, "final_size": end_[1] or start, "n_added": end_[0]}
