"""Fixed-library tests of gene sets whose signal may be spread over many loci.

All is long tables: a set's loci, its statistics, and the draws of each replicate are rows. Draws are places in
one hash order of a pool (as in ``nulls``), so a draw is an equi join, any engine with md5 repeats it, and no pool is multiplied by the
sets that draw from it. Windows without a key run over loci, of which a genome has thousands.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..shipping import grouped
from ..storage import Scratch
from . import claims
from .components import components
from .modules import familywise, module_statistics, penalties, top_fraction_mean
from .nulls import hashed, matched_draws, matched_sample
from .relational import average_rank, bh_fdr, empirical, quantile_bins


@dataclass(frozen=True)
class DistributedConfig:
    score_cap: float = 3.0
    moderate_low: float = 2.0
    moderate_high: float = 4.0
    degree_bins: int = 10
    property_bins: int = 4
    match_annotation: bool = True
    min_present: int = 5
    top_share: float = 0.01
    max_replacement: float = 0.05


#: The statistics of a set of loci; greater is more extreme in all of them.
STATISTICS = ("locus_robust", "positive_locus", "penalised", "penalised_top5", "membership_rank", "specific_rank", "moderate", "leave_top1", "leave_top3", "leave_top5")


def score_columns(genes: DataFrame, cap: float = 3.0, score: str = "score") -> DataFrame:
    """genes with ``capped`` (from above), ``huber`` (from both sides), and the average rank from the top as a share and its complement."""
    n = genes.agg(F.count("*").alias("__n"))
    ranked = average_rank(genes, score, "__r", ascending=False).crossJoin(F.broadcast(n))
    share = F.col("__r") / F.col("__n")
    return ranked.withColumns({"capped": S.cap_upper(F.col(score), cap), "huber": S.huberize(F.col(score), cap), "rank_fraction": share, "rank_percentile": 1 - share}).drop("__r", "__n")


def predefined_loci(genes: DataFrame, column: str) -> DataFrame:
    """Genes with the locus that a column names; genes without one are loci of their own."""
    name = S.clean_ids(F.col(column).cast("string"))
    return genes.withColumn("locus_id", F.coalesce(name, F.concat(F.lit("UNMAPPED:"), F.col("gene").cast("string"))))


def is_moderate(score: Column, config: DistributedConfig) -> Column:
    return F.coalesce(((score > config.moderate_low) & (score < config.moderate_high)).cast("int"), F.lit(0))


def match_background(genes: DataFrame, sets: DataFrame, config: DistributedConfig = DistributedConfig()) -> DataFrame:
    """One row a locus: span, capped score, its rank from the top, and the bin of loci that it may be exchanged with.

    genes: gene, locus_id, chrom, g_start, g_end, score, degree and, where known, n_snps and local_ld_score.
    """
    held = genes.withColumns({c: F.lit(0.0) for c in ("n_snps", "local_ld_score") if c not in genes.columns})
    counts = sets.select("module", "gene").distinct().groupBy("gene").agg(F.count("*").alias("__sets"))
    agg = held.join(counts, "gene", "left").groupBy("locus_id").agg(
        F.min("chrom").alias("chrom"), F.min("g_start").alias("l_start"), F.max("g_end").alias("l_end"), F.countDistinct("gene").alias("n_genes"),
        F.avg(F.coalesce("degree", F.lit(0))).alias("mean_degree"), F.avg(F.coalesce("n_snps", F.lit(0))).alias("mean_snps"),
        F.avg(F.coalesce("local_ld_score", F.lit(0))).alias("mean_ld"), F.avg(F.coalesce("__sets", F.lit(0))).alias("mean_sets"),
        F.max(S.cap_upper(F.col("score"), config.score_cap)).alias("locus_score"), F.max(is_moderate(F.col("score"), config)).alias("moderate"),
    )
    every = Window.partitionBy()
    agg = agg.withColumn("score_rank", F.row_number().over(Window.orderBy(F.desc("locus_score"), "locus_id"))).withColumn("n_loci", F.count("*").over(every))
    agg = agg.withColumn("rank_fraction", F.col("score_rank") / F.col("n_loci"))
    binned = {"degree_bin": ("mean_degree", config.degree_bins)} | {f"{c}_bin": (c, config.property_bins) for c in ("n_genes", "mean_sets", "mean_ld", "mean_snps")}
    for out, (column, q) in binned.items():
        agg = quantile_bins(agg, column, q, "locus_id", out)
        agg = agg.withColumn(out, F.when(F.min(column).over(every) == F.max(column).over(every), 0).otherwise(F.col(out)))
    parts = ["degree_bin", "n_genes_bin", *(["mean_sets_bin"] if config.match_annotation else []), "mean_ld_bin", "mean_snps_bin"]
    return agg.withColumn("match_bin", F.concat_ws("|", *parts))


def background_audit(background: DataFrame) -> DataFrame:
    """Genes a locus and spans, over all loci and on each chromosome; one row of missing numbers for no locus."""
    d = background.select("chrom", "n_genes", (F.col("l_end") - F.col("l_start")).alias("span"))
    rows = d.withColumn("g", F.explode(F.array(*(F.struct(F.lit(level).alias("audit_level"), name.alias("group")) for level, name in (("overall", F.lit("all")), ("chromosome", F.col("chrom")))))))
    p = lambda c, q: F.percentile(c, F.lit(q))
    return rows.where("g.group is not null").groupBy("g.audit_level", "g.group").agg(
        F.count("*").alias("n_loci"), p("n_genes", 0.5).alias("median_genes"), p("n_genes", 0.9).alias("p90_genes"), p("n_genes", 0.95).alias("p95_genes"),
        F.max("n_genes").alias("max_genes"), p("span", 0.5).alias("median_span"), p("span", 0.95).alias("p95_span"), F.max("span").alias("max_span"),
    )


def share_at_least(values: DataFrame, background: DataFrame, value: str = "value", against: str = "locus_score", out: str = "value_rank") -> DataFrame:
    """values with the share of background numbers that are as great or greater; the window runs over distinct numbers."""
    both = background.where(F.col(against).isNotNull()).groupBy(F.col(against).alias("__v")).agg(F.count("*").alias("__k"))
    both = both.unionByName(values.select(F.col(value).alias("__v"), F.lit(0).cast("long").alias("__k")).distinct()).groupBy("__v").agg(F.sum("__k").alias("__k"))
    share = F.sum("__k").over(Window.orderBy(F.desc("__v"))) / F.sum("__k").over(Window.partitionBy())
    return values.join(both.select(F.col("__v").alias(value), share.alias(out)), value)


def set_loci(genes: DataFrame, sets: DataFrame, config: DistributedConfig = DistributedConfig()) -> DataFrame:
    """(module, locus_id, value, moderate, n_genes, raw): each locus of a set by the set's own genes in it, with the highest capped and uncapped score."""
    j = sets.select("module", "gene").distinct().join(genes.select("gene", "locus_id", "score"), "gene")
    value = F.max(S.cap_upper(F.col("score"), config.score_cap))
    return j.groupBy("module", "locus_id").agg(value.alias("value"), F.max(is_moderate(F.col("score"), config)).alias("moderate"), F.countDistinct("gene").alias("n_genes"), F.max("score").alias("raw"))


def locus_statistics(loci: DataFrame, by: tuple[str, ...] = ("module",)) -> DataFrame:
    """The statistics of each group of loci (value, moderate, rank_fraction of the locus, value_rank of the value), and their shape."""
    d = loci.where(S.finite(F.col("value"))).withColumns({"p": F.greatest("value", F.lit(0.0)), "r": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "locus_id"))})
    upto = lambda k, c: F.sum(F.when(F.col("r") <= k, F.col(c)))
    left = lambda k: F.sum(F.when(F.col("r") > k, F.col("value")))
    a = d.groupBy(*by).agg(
        F.count("*").alias("n_loci"), F.sum("value").alias("s"), F.sum("p").alias("p"), F.sum(F.col("p") * F.col("p")).alias("p2"), upto(1, "p").alias("p_1"), upto(5, "p").alias("p_5"),
        (1 - F.avg("rank_fraction")).alias("membership_rank"), (1 - F.avg("value_rank")).alias("specific_rank"), F.sum("moderate").cast("double").alias("moderate"),
        *(left(k).alias(f"left_{k}") for k in (1, 3, 5)),
    )
    n, some = F.col("n_loci"), F.col("p") > 0
    a = a.withColumns({
        "n_effective": F.when(some, F.col("p") * F.col("p") / F.nullif("p2", F.lit(0.0))).otherwise(0.0),
        "top1": F.when(some, F.col("p_1") / F.nullif("p", F.lit(0.0))).otherwise(1.0),
        "top5": F.when(some, F.col("p_5") / F.nullif("p", F.lit(0.0))).otherwise(1.0),
        "locus_robust": F.col("s") / F.sqrt(n.cast("double")),
        "positive_locus": F.col("p") / F.sqrt(n.cast("double")),
    } | {f"leave_top{k}": F.when(n > k, F.col(f"left_{k}") / F.sqrt(F.greatest(n - k, F.lit(1)).cast("double"))) for k in (1, 3, 5)})
    cut = penalties(F.col("n_effective"), F.col("top1"), F.col("top5"))
    once = F.col("locus_robust") * cut["n_eff_penalty"] * cut["top1_penalty"]
    return a.withColumns({"penalised": once, "penalised_top5": once * cut["top5_penalty"]}).select(*by, "n_loci", "n_effective", "top1", "top5", *STATISTICS)


def tail_diagnostics(loci: DataFrame, config: DistributedConfig = DistributedConfig()) -> DataFrame:
    """Per set how much of its signal comes from its strongest loci. loci: as of ``set_loci``, with the rank_fraction of each locus."""
    d = loci.withColumn("p", F.greatest("value", F.lit(0.0)))
    strong = F.col("raw") > config.score_cap
    n = F.count("*").cast("double")
    return d.groupBy("module").agg(
        (F.sum((F.col("value") >= config.score_cap - 1e-12).cast("int")) / n).alias("share_at_cap"), (F.sum(strong.cast("int")) / n).alias("share_over_cap"),
        F.when(F.sum("p") > 0, F.coalesce(F.sum(F.when(strong, F.col("p"))), F.lit(0.0)) / F.nullif(F.sum("p"), F.lit(0.0))).otherwise(0.0).alias("signal_over_cap"),
        F.sum(strong.cast("int")).alias("n_over_cap"), F.sum((F.col("rank_fraction") <= 0.01).cast("int")).alias("n_top1pct"), F.sum((F.col("rank_fraction") <= 0.05).cast("int")).alias("n_top5pct"),
        F.coalesce(F.median(F.when(F.col("p") > 0, F.col("p"))), F.lit(0.0)).alias("median_positive"), (F.sum("moderate") / n).alias("moderate_share"),
    )


def module_summary(genes: DataFrame, sets: DataFrame, background: DataFrame, config: DistributedConfig = DistributedConfig()) -> DataFrame:
    """A row a set: its genes' and loci's statistics, its first gene and locus, and how much its strongest ones carry. Ties go to the lesser name."""
    by = Window.partitionBy("module")
    g = sets.select("module", "gene").distinct().join(genes.select("gene", "score"), "gene").withColumn("capped", S.cap_upper(F.col("score"), config.score_cap))
    g = g.withColumns({"r": F.row_number().over(by.orderBy(F.desc("capped"), "gene")), "n": F.count("*").over(by)})
    left = lambda k: F.sum(F.when(F.col("r") > k, F.col("capped"))) / F.sqrt(F.nullif(F.max("n") - k, F.lit(0)).cast("double"))
    root = F.sqrt(F.count("*").cast("double"))
    first = F.min(F.struct((-F.col("score")).alias("s"), "gene"))
    per_gene = g.groupBy("module").agg(
        F.count("*").alias("n_present"), (F.sum("score") / root).alias("raw_gene_stat"), (F.sum("capped") / root).alias("capped_gene_stat"),
        *(F.when(F.max("n") > k, left(k)).alias(f"leave_top{k}_gene") for k in (1, 5, 10)), first.alias("f"),
    ).select("*", F.col("f.gene").alias("top_gene"), (-F.col("f.s")).alias("top_gene_score")).drop("f")
    loci = set_loci(genes, sets, config).join(background.select("locus_id", "rank_fraction"), "locus_id")
    top = loci.groupBy("module").agg(F.min(F.struct((-F.col("value")).alias("s"), "locus_id")).alias("f")).select("module", F.col("f.locus_id").alias("top_locus"), (-F.col("f.s")).alias("top_locus_score"))
    shape = locus_statistics(share_at_least(loci, background))
    return per_gene.join(shape, "module").join(top, "module").join(tail_diagnostics(loci, config), "module")


def draw_level(wanted: DataFrame, pool: DataFrame, used: DataFrame, key: str, seed: int) -> DataFrame:
    """(replicate, module, slot, drawn, pool_size): for each wanted (replicate, module, slot, need, key) a locus of its bin, with ``need`` genes or more where one is free.

    A set takes, from its hashed offset in the replicate's order of the bin on, as many places as it wants and has used
    there, leaves out the used ones, and deals the others to its slots; then slots for which none is left take free loci of any size, and those for which none is left stay out. Two
    needs of one bin that meet in a locus: the first slot has it. A task has the bin, the slots and the used loci of a replicate; only bins that a replicate wants are put in order.
    """
    kinds = dict(pool.dtypes) | dict(wanted.dtypes)
    k = F.col(key).cast("string").alias("key")
    slots = wanted.select("replicate", k, F.lit(0).alias("kind"), "module", F.col("slot").alias("locus"), F.col("need").cast("long").alias("n"))
    held = pool.select(k, F.col("locus_id").alias("locus"), F.col("n_genes").cast("long").alias("n"))
    places = slots.select("replicate", "key").distinct().join(held, "key").select("replicate", "key", F.lit(1).alias("kind"), F.lit(None).cast(kinds["module"]).alias("module"), "locus", "n")
    gone = used.withColumnRenamed("drawn", "locus").join(held, "locus").select("replicate", "key", F.lit(2).alias("kind"), "module", "locus", "n")
    schema = f"replicate int, module {kinds['module']}, slot {kinds['slot']}, drawn {kinds['locus_id']}, pool_size long"
    return grouped(slots.unionByName(places).unionByName(gone), ["replicate", "key"], _deal(seed), schema)


def _deal(seed: int):
    """What deals the loci of a bin to the slots of a replicate."""

    def number(*parts) -> int:
        return int(hashlib.md5("-".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rep, key, out = int(frame["replicate"].iloc[0]), frame["key"].iloc[0], []
        slots, places, gone = (frame[frame["kind"] == i] for i in range(3))
        order = sorted((number(rep, x), x, n) for x, n in zip(places["locus"], places["n"], strict=True))
        loci, genes, at = [x for _, x, _ in order], np.array([n for *_, n in order], dtype=np.int64), {x: i for i, (_, x, _) in enumerate(order)}
        used = {m: [at[x] for x in g["locus"]] for m, g in gone.groupby("module")} if len(slots) else {}
        for module, g in slots.groupby("module"):
            taken = np.zeros(len(loci), dtype=bool)
            taken[used.get(module, [])] = True
            left = sorted((x, int(n)) for x, n in zip(g["locus"], g["n"], strict=True))
            for enough in (True, False):
                by_need, picks, held = {}, [], taken.copy()
                for x, n in left:
                    by_need.setdefault(n if enough else 1, []).append(x)
                for need, names in by_need.items():
                    fit = np.flatnonzero(genes >= need)
                    if len(fit):
                        n_used = int(held[fit].sum())
                        walk = np.roll(fit, -(number(rep, module, key, need) % len(fit)))[: len(names) + n_used]
                        picks += [(x, int(i), len(fit) - n_used) for x, i in zip(names, walk[~held[walk]], strict=False)]
                found = set()
                for x, i, size in sorted(picks):
                    if not taken[i]:
                        taken[i] = True
                        found.add(x)
                        out.append((rep, module, x, loci[i], size))
                left = [s for s in left if s[0] not in found]
        return pd.DataFrame(out, columns=["replicate", "module", "slot", "drawn", "pool_size"])

    return run


def matched_loci(slots: DataFrame, pool: DataFrame, replicates: int, scratch: Scratch, name: str, used: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """(replicate, module, slot, need, drawn, level, pool_size): for each observed locus (module, slot, need, match_bin, degree_bin) another one.

    First from its match bin, then from its degree bin, then from all; on each level from the loci with genes enough, and if none of these is free from the other free ones, whose
    genes are then drawn with replacement. A set has no locus twice and none of its own, unless all are used up, when any
    is drawn again. ``used``: further (replicate, module, drawn) that are taken.
    """
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    wanted = scratch.keep(slots.withColumns({"replicate": reps, "all": F.lit(0)}), f"{name}-wanted")
    taken = wanted.select("replicate", "module", F.col("slot").alias("drawn"))
    taken = taken if used is None else taken.unionByName(used.select("replicate", "module", "drawn")).distinct()
    pool, made = pool.withColumn("all", F.lit(0)), None
    for i, (level, key) in enumerate((("exact", "match_bin"), ("degree", "degree_bin"), ("global", "all"))):
        got = draw_level(wanted.select("replicate", "module", "slot", "need", key), pool.select("locus_id", "n_genes", key), taken, key, seed + i)
        got = scratch.keep(got.withColumn("level", F.lit(level)), f"{name}-{level}")
        made = got if made is None else made.unionByName(got)
        taken = taken.unionByName(got.select("replicate", "module", "drawn"))
        wanted = scratch.keep(wanted.join(got.select("replicate", "module", "slot"), ["replicate", "module", "slot"], "left_anti"), f"{name}-{level}-left")
    numbered = pool.select(F.col("locus_id").alias("drawn"), (F.row_number().over(Window.orderBy("locus_id")) - 1).alias("place"))
    size = pool.agg(F.count("*").alias("pool_size"))
    again = wanted.crossJoin(F.broadcast(size)).withColumn("place", (hashed(F.lit(seed + 3), "replicate", "module", "slot") % F.col("pool_size")).cast("int")).join(numbered, "place")
    made = made.unionByName(again.select("replicate", "module", "slot", "drawn", "pool_size", F.lit("reuse").alias("level")))
    return scratch.keep(made.join(slots.select("module", "slot", "need"), ["module", "slot"]), f"{name}-draws")


def subset_scores(draws: DataFrame, genes: DataFrame, config: DistributedConfig, seed: int = 1) -> DataFrame:
    """Each drawn locus scored on as many of its genes as the observed one has in the set.

    The genes are the first in an order by hash of the draw and the gene, a uniform sample without replacement; a locus with too few gives each of them by a hash of its own, with replacement.
    """
    held = genes.select(F.col("locus_id").alias("drawn"), "gene", "score")
    sizes = held.groupBy("drawn").agg(F.count("*").alias("size"))
    d = draws.join(sizes, "drawn")
    slot = ["replicate", "module", "slot"]
    order = Window.partitionBy(*slot).orderBy(hashed(F.lit(seed + 7), *slot, "gene"), "gene")
    enough = d.where(F.col("need") <= F.col("size")).join(held, "drawn").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("need")).drop("r", "gene")
    placed = held.withColumn("place", F.row_number().over(Window.partitionBy("drawn").orderBy("gene")) - 1).drop("gene")
    few = d.where(F.col("need") > F.col("size")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("need") - 1)))
    few = few.withColumn("place", (hashed(F.lit(seed + 8), *slot, "j") % F.col("size")).cast("int")).join(placed, ["drawn", "place"]).drop("j", "place")
    return enough.unionByName(few).groupBy(*slot, "drawn", "level", "pool_size", "need", "size").agg(
        F.max(S.cap_upper(F.col("score"), config.score_cap)).alias("value"), F.max(is_moderate(F.col("score"), config)).alias("moderate")
    )


def long_of(stats: DataFrame, by: tuple[str, ...], names=STATISTICS) -> DataFrame:
    return stats.unpivot(list(by), list(names), "statistic", "value")


def distributed_tests(genes: DataFrame, sets: DataFrame, replicates: int, config: DistributedConfig = DistributedConfig(), seed: int = 1, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, nulls) of a library of sets. genes: gene, locus_id and the columns of ``match_background``.

    results: a row a set with its statistics, for each an upper empirical p and a z against loci drawn to match, p against conditioned and permuted
    draws, rates of the levels of draws, FDRs and the label; a set with fewer than ``min_present`` genes is ``not_tested_low_overlap``.
    nulls: (null_type, replicate, module, statistic, value).
    """
    scratch = scratch or Scratch(genes.sparkSession, "distributed")
    genes = scratch.keep(genes.where(S.finite(F.col("score"))), "genes")
    background = scratch.keep(match_background(genes, sets, config), "background")
    query = scratch.keep(sets.select("module", "gene").distinct(), "sets")
    sizes = scratch.keep(query.join(genes.select("gene", F.lit(1).alias("__in")), "gene", "left").groupBy("module").agg(F.count("*").alias("n_query"), F.count("__in").alias("n_present")), "sizes")
    tested = query.join(sizes.where(F.col("n_present") >= config.min_present).select("module"), "module")
    bins = background.select("locus_id", "match_bin", "degree_bin", "rank_fraction", "score_rank", "n_loci")
    own = scratch.keep(share_at_least(set_loci(genes, tested, config).join(bins, "locus_id"), background), "observed")
    observed = locus_statistics(own)
    slots = own.select("module", F.col("locus_id").alias("slot"), F.col("n_genes").alias("need"), "match_bin", "degree_bin", (F.col("score_rank") <= F.ceil(F.col("n_loci") * config.top_share)).alias("top"))
    pool = background.select("locus_id", "n_genes", "match_bin", "degree_bin", (F.col("score_rank") <= F.ceil(F.col("n_loci") * config.top_share)).alias("top"))

    def scored(draws: DataFrame, name: str) -> DataFrame:
        d = subset_scores(draws, genes, config, seed).join(background.select(F.col("locus_id").alias("drawn"), "rank_fraction"), "drawn")
        return scratch.keep(share_at_least(d, background).withColumn("locus_id", F.col("slot")), name)

    by = ("replicate", "module")
    drawn = scored(matched_loci(slots.drop("top"), pool, replicates, scratch, "matched", seed=seed), "matched-scores")
    matched = long_of(locus_statistics(drawn, by), by).withColumn("null_type", F.lit("matched_loci"))
    forced = matched_loci(slots.where("top").drop("top"), pool.where("top"), replicates, scratch, "top", seed=seed + 10)
    held = slots.join(slots.where("top").select("module").distinct(), "module", "left_semi")
    others = matched_loci(held.where("not top").drop("top"), pool, replicates, scratch, "rest", used=forced, seed=seed + 20)
    conditioned = scored(forced.unionByName(others), "conditioned-scores")
    conditioned = long_of(locus_statistics(conditioned, by), by, ("leave_top1", "leave_top3")).withColumn("null_type", F.lit("top_conditioned"))
    swapped = matched_draws(background.select("locus_id", F.col("match_bin").alias("bin")), own.select("module", "locus_id", F.col("match_bin").alias("bin")), replicates, "module", "locus_id", seed + 30)
    swapped = swapped.join(background.select(F.col("locus_id").alias("drawn"), F.col("locus_score").alias("value")), "drawn").withColumns({c: F.lit(0.0) for c in ("moderate", "rank_fraction", "value_rank")})
    permuted = long_of(locus_statistics(swapped, by), by, ("penalised",)).withColumn("null_type", F.lit("permuted_scores"))
    present = tested.join(genes.select("gene"), "gene")
    one = genes.select("gene", "score", F.lit(0).alias("bin"))
    any_genes = matched_sample(one, present.groupBy("module").agg(F.count("*").alias("n")).withColumn("bin", F.lit(0)), replicates, seed=seed + 40).join(genes.select("gene", "score"), "gene")
    raw = any_genes.groupBy(*by).agg((F.sum("score") / F.sqrt(F.count("*").cast("double"))).alias("value")).select(*by, F.lit("raw").alias("statistic"), "value", F.lit("random_genes").alias("null_type"))
    nulls = scratch.keep(matched.unionByName(conditioned).unionByName(permuted).unionByName(raw).where("value is not null"), "nulls")

    raw_observed = module_statistics(present, genes).select("module", F.col("sqrt_n_mean").alias("raw"))
    observed = scratch.keep(observed.join(raw_observed, "module").join(sizes, "module"), "statistics")
    values = long_of(observed, ("module",), (*STATISTICS, "raw")).withColumnRenamed("value", "observed").where("observed is not null")
    named = F.concat_ws(":", "null_type", "statistic")
    values = values.join(nulls.select("null_type", "statistic").distinct(), "statistic").select("module", named.alias("statistic"), "observed")
    test = empirical(nulls.select("replicate", "module", named.alias("statistic"), "value"), values, ["module", "statistic"])
    names = [f"matched_loci:{s}" for s in STATISTICS] + ["top_conditioned:leave_top1", "top_conditioned:leave_top3", "permuted_scores:penalised", "random_genes:raw"]
    wide = test.groupBy("module").pivot("statistic", names).agg(F.first("p_upper").alias("p"), F.first("z").alias("z"))
    plain = lambda n, c: f"{n.split(':')[1] if n.startswith(('matched', 'random')) else n.replace(':', '_')}_{c}"
    wide = wide.select("module", *(F.col(f"`{n}_{c}`").alias(plain(n, c)) for n in names for c in "pz"))
    rate = lambda level: F.avg((F.col("level") == level).cast("int")).alias(f"{level}_rate")
    audit = drawn.groupBy("module").agg(*map(rate, ("exact", "degree", "global", "reuse")), F.min("pool_size").alias("min_pool"), F.median("pool_size").alias("median_pool"), F.avg((F.col("need") > F.col("size")).cast("int")).alias("replacement_rate"), F.avg(F.greatest(F.col("need") - F.col("size"), F.lit(0))).alias("replacement_draws"))
    tails = tail_diagnostics(own, config).withColumnsRenamed({"moderate_share": "moderate_locus_share"})
    out = observed.join(tails, "module").join(wide, "module", "left").join(audit, "module", "left").withColumn("degraded", F.coalesce(F.col("replacement_rate") > config.max_replacement, F.lit(False)))
    p = {"locus": "locus_robust_p", "penalised": "penalised_p", "positive": "positive_locus_p", "rank": "specific_rank_p", "moderate": "moderate_p", "leave_top1": "leave_top1_p", "raw": "raw_p"}
    out = out.withColumn("label", claims.distributed_class(F.col("degraded"), {k: F.col(c) for k, c in p.items()}, F.col("n_effective"), F.col("top1"), F.col("top5")))
    out = scratch.keep(out, "tests")  # a row a set; each FDR reads it twice
    for c in ("locus_robust", "positive_locus", "penalised", "penalised_top5", "membership_rank", "specific_rank"):
        out = bh_fdr(out, f"{c}_p", f"{c}_fdr")
    few = sizes.where(F.col("n_present") < config.min_present).withColumn("label", F.lit("not_tested_low_overlap"))
    return out.unionByName(few, allowMissingColumns=True), nulls


def _library_nulls(genes: DataFrame, members: DataFrame, replicates: int, seed: int, share: int = 10) -> DataFrame:
    """(replicate, module, value, rank, dealt): of each draw of ``matched_sample`` the root-n mean score and the mean rank, and the root-n mean of the scores of ``hash_permute``.

    genes: gene, score, rank_fraction, bin. A task has a bin, in the order of its genes, and a share of the replicates. It orders the bin once for each; a draw is a slice of that
    order, so neither the ordered bins nor the drawn genes are ever rows.
    """
    module = dict(members.dtypes)["module"]
    of = members.groupBy("gene").agg(F.collect_list("module").alias("modules"))
    dealt = genes.select("gene", "score", "rank_fraction", "bin").join(of.hint("merge"), "gene", "left")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // share))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("gene")
        b, part, size = frame["bin"].iloc[0], int(frame["part"].iloc[0]), len(frame)
        score, rank, lists = frame["score"].to_numpy(float), frame["rank_fraction"].to_numpy(float), [() if m is None else m for m in frame["modules"]]
        names = sorted({m for x in lists for m in x})
        number = {m: i for i, m in enumerate(names)}
        at, code = np.repeat(np.arange(size), [len(x) for x in lists]), np.array([number[m] for x in lists for m in x], dtype=np.int64)
        counts, keys = np.bincount(code, minlength=len(names)), [f"-{g}".encode() for g in frame["gene"]]
        out = []
        for r in range(part * share, min(replicates, (part + 1) * share)) if names else ():
            head = hashlib.md5(f"{seed}-{r}".encode())
            digests = np.empty((size, 2), dtype=np.uint64)
            text = b"".join(_digest(head, k) for k in keys)
            digests[:] = np.frombuffer(text, dtype=">u8").reshape(size, 2)
            mixed = np.lexsort((digests[:, 1], digests[:, 0]))
            order = np.argsort(digests[:, 0] >> np.uint64(32), kind="stable")
            sums = np.bincount(code, score[mixed][at], minlength=len(names))
            # around the end: no draw is longer than the bin
            scores, ranks = np.tile(score[order], 2), np.tile(rank[order], 2)
            for i, m in enumerate(names):
                start = int(hashlib.md5(f"{seed}-{r}-{m}-{b}".encode()).hexdigest()[:8], 16) % size
                out.append((r, m, int(counts[i]), scores[start : start + counts[i]].sum(), ranks[start : start + counts[i]].sum(), sums[i]))
        return pd.DataFrame(out, columns=["replicate", "module", "n", "s", "r", "d"])

    made = grouped(dealt, ["bin", "part"], run, f"replicate int, module {module}, n long, s double, r double, d double").groupBy("replicate", "module").agg(*(F.sum(c).alias(c) for c in "nsrd"))
    root = F.sqrt(F.col("n").cast("double"))
    return made.select("replicate", "module", F.round(F.col("s") / root, 9).alias("value"), F.round(F.col("r") / F.col("n"), 9).alias("rank"), F.round(F.col("d") / root, 9).alias("dealt"))


def _digest(head, tail: bytes) -> bytes:
    h = head.copy()
    h.update(tail)
    return h.digest()


def library_tests(sets: DataFrame, scores: DataFrame, edges: DataFrame, replicates: int, min_present: int = 5, degree_bins: int = 10, seed: int = 1) -> DataFrame:
    """Fixed sets (module, gene) against two nulls: genes drawn with the set's degree profile, and scores dealt anew within degree bins.

    scores: gene, score, degree; the background is the graph's nodes that have a score, and a set's other genes are not present. A row a set: statistics, its largest component in the
    graph, p, z, mean and deviation of each null, the family-wise p over the library, three
    FDRs, and the status; a set with fewer than ``min_present`` genes is ``not_tested_low_overlap``.
    """
    scratch = Scratch(scores.sparkSession, "library")
    edges = scratch.keep(edges.select("src", "dst"), "edges")
    scores = scratch.keep(scores.join(edges.select(F.explode(F.array("src", "dst")).alias("gene")).distinct(), "gene", "left_semi"), "scores")
    binned = scratch.keep(quantile_bins(scores.select("gene", "score", "degree"), "degree", degree_bins, "gene"), "bins")
    n = scores.agg(F.count("*").alias("n"))
    ranks = scratch.keep(binned.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("score"), "gene"))).crossJoin(F.broadcast(n)).select("gene", (F.col("__r") / F.col("n")).alias("rank_fraction")), "ranks")
    query = sets.select("module", "gene").distinct()
    sizes = query.join(scores.select("gene", F.lit(1).alias("__in")).hint("merge"), "gene", "left").groupBy("module").agg(F.count("*").alias("n_query"), F.count("__in").alias("n_present"))
    sizes = scratch.keep(sizes, "sizes")
    # no table of the genes or members is broadcast: written, they look smaller than the rows that the driver would hold
    known = scores.select("gene").hint("merge")
    held = scratch.keep(query.join(sizes.where(F.col("n_present") >= min_present).select("module"), "module").join(known, "gene"), "members")
    stat = F.round(F.sum("score") / F.sqrt(F.count("*").cast("double")), 9)
    rows = scratch.keep(binned.join(ranks.hint("merge"), "gene"), "genes")
    own = held.hint("merge").join(rows, "gene").groupBy("module").agg(stat.alias("observed"), F.avg("score").alias("mean_score"), F.avg("rank_fraction").alias("mean_rank_fraction"), F.avg("degree").alias("mean_degree"))
    own = own.join(top_fraction_mean(held.hint("merge"), scores).select("module", F.col("top_mean").alias("top20_mean")), "module")
    own = scratch.keep(own, "own")
    ends = [held.withColumnRenamed("gene", c).hint("merge") for c in ("src", "dst")]
    links = scratch.keep(edges.join(ends[0], "src").join(ends[1], ["dst", "module"]), "links")
    pairs = F.col("n") * (F.col("n") - 1)
    inner = held.groupBy("module").agg(F.count("*").alias("n")).join(links.groupBy("module").agg(F.count("*").alias("e")), "module", "left").withColumn("n_edges", F.coalesce("e", F.lit(0)))
    inner = inner.select("module", "n_edges", F.when(F.col("n") > 1, 2 * F.col("n_edges") / F.nullif(pairs, F.lit(0))).otherwise(0.0).alias("density"))
    key = lambda c: F.concat_ws("|", "module", F.col(c).cast("string"))
    roots = components(links.select(key("src").alias("a"), key("dst").alias("b")), scratch, dense=True).withColumnRenamed("node", "key")
    parts = held.withColumn("key", key("gene")).join(roots.hint("merge"), "key", "left").groupBy("module", F.coalesce("root", "key").alias("root")).agg(F.count("*").alias("n"))
    inner = inner.join(parts.groupBy("module").agg(F.max("n").alias("largest_component")), "module")
    nulls = scratch.keep(_library_nulls(rows, held, replicates, seed), "nulls")
    drawn = nulls.select("replicate", "module", "value", "rank")
    dealt = nulls.select("replicate", "module", F.col("dealt").alias("value"))
    seen = own.select("module", "observed")
    moments = lambda name: (F.col("z").alias(f"{name}_z"), F.col("null_mean").alias(f"{name}_mean"), F.col("null_sd").alias(f"{name}_sd"))
    matched = empirical(drawn, seen, ["module"]).select("module", F.col("p_upper").alias("matched_p"), *moments("matched"))
    ranked = empirical(drawn.withColumn("value", F.col("rank")), own.select("module", F.round("mean_rank_fraction", 9).alias("observed")), ["module"]).select("module", F.col("p_lower").alias("rank_p"), (-F.col("z")).alias("rank_z"))
    permuted = empirical(dealt, seen, ["module"]).select("module", F.col("p_upper").alias("permuted_p"), *moments("permuted"))
    family = familywise(dealt, seen).select("module", F.col("p_family").alias("family_p"))
    out = own.join(inner, "module").join(matched, "module").join(ranked, "module").join(permuted, "module").join(family, "module")
    out = scratch.keep(out, "tests")  # a row a set; each FDR reads it twice
    for c in ("matched", "permuted", "family"):
        out = bh_fdr(out, f"{c}_p", f"{c}_fdr")
    status = F.when((F.col("matched_p") <= 0.05) & (F.col("family_p") <= 0.05), "familywise_supported").when(F.col("matched_p") <= 0.05, "degree_supported").otherwise("negative")
    return sizes.join(out.withColumn("status", status), "module", "left").withColumn("status", F.coalesce("status", F.lit("not_tested_low_overlap")))
