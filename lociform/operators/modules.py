"""Gene-set (module) and locus statistics. Sets are long tables (module, gene)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import average_rank, islands


def module_statistics(sets: DataFrame, scores: DataFrame) -> DataFrame:
    """Per module: genes, mean, mean times root n, positive sum over root n."""
    j = sets.select("module", "gene").distinct().join(scores.select("gene", "score"), "gene")
    pos = F.greatest("score", F.lit(0.0))
    return j.groupBy("module").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), (F.sum("score") / F.sqrt(F.count("*").cast("double"))).alias("sqrt_n_mean"),
        (F.sum(pos) / F.sqrt(F.count("*").cast("double"))).alias("positive_stat"),
    )


def _ranked(sets: DataFrame, scores: DataFrame) -> DataFrame:
    j = sets.select("module", "gene").distinct().join(scores.select("gene", "score"), "gene")
    w = Window.partitionBy("module").orderBy(F.desc("score"), "gene")
    return j.withColumns({"r": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("module"))})


def top_fraction_mean(sets: DataFrame, scores: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Mean of the top ceil(n f), one at least."""
    top = _ranked(sets, scores).where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * fraction)))
    return top.groupBy("module").agg(F.avg("score").alias("top_mean"), F.count("*").alias("n_top"))


def leave_top_k(sets: DataFrame, scores: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """The root-n mean without the top k genes; NULL if none is left."""
    d = _ranked(sets, scores).withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks))))
    left = F.when(F.col("r") > F.col("k"), F.col("score"))
    return d.groupBy("module", "k").agg(F.count(left).alias("n_left"), (F.sum(left) / F.sqrt(F.nullif(F.count(left), F.lit(0)).cast("double"))).alias("stat"))


def robust_statistics(sets: DataFrame, scores: DataFrame, share: float = 0.1) -> DataFrame:
    """Trimmed and winsorised means: floor(n share) genes of each tail."""
    d = _ranked(sets, scores).withColumn("g", F.floor(F.col("n") * share))
    inner = (F.col("r") > F.col("g")) & (F.col("r") <= F.col("n") - F.col("g"))
    low = F.max(F.when(F.col("r") == F.col("n") - F.col("g"), F.col("score"))).over(Window.partitionBy("module"))
    high = F.max(F.when(F.col("r") == F.col("g") + 1, F.col("score"))).over(Window.partitionBy("module"))
    d = d.withColumn("w", F.least(F.greatest("score", low), high))
    return d.groupBy("module").agg(F.avg(F.when(inner, F.col("score"))).alias("trimmed_mean"), F.avg("w").alias("winsor_mean"))


def contribution_metrics(values: DataFrame, by: str = "module", value: str = "score") -> DataFrame:
    """Of positive values: sum, effective number 1 / sum of squared shares, shares of the top one and five."""
    pos = F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("p")))
    d = values.select(by, pos.alias("p")).withColumn("r", r)
    s = F.sum("p")
    share = lambda c: F.when(s > 0, c / F.nullif(s, F.lit(0.0)))
    return d.groupBy(by).agg(
        s.alias("positive_sum"), F.when(s > 0, s * s / F.nullif(F.sum(F.col("p") * F.col("p")), F.lit(0.0))).otherwise(0.0).alias("effective_number"),
        share(F.sum(F.when(F.col("r") <= 1, F.col("p")))).alias("top1_share"), share(F.sum(F.when(F.col("r") <= 5, F.col("p")))).alias("top5_share"),
    )


def penalties(n_eff: Column, top1: Column, top5: Column) -> dict[str, Column]:
    """Factors of at most one for few effective loci and for concentration in the top one and top five."""
    one = F.lit(1.0)
    return {
        "n_eff_penalty": F.least(one, n_eff / 5),
        "top1_penalty": F.when(top1 > 0, F.least(one, F.lit(0.35) / F.nullif(top1, F.lit(0.0)))).otherwise(one),
        "top5_penalty": F.when(top5 > 0, F.least(one, F.lit(0.70) / F.nullif(top5, F.lit(0.0)))).otherwise(one),
    }


def pseudo_loci(genes: DataFrame, window: int = 500_000) -> DataFrame:
    """Genes with the locus of their merged, widened intervals: chr<c>:L<k>, numbered from 1 on each chromosome."""
    wide = genes.withColumns({"w_start": F.greatest(F.col("g_start") - window, F.lit(0)), "w_end": F.col("g_end") + window})
    held = islands(wide.where("chrom is not null and g_start is not null and g_end is not null"), "w_start", "w_end", ["chrom"], "k")
    named = held.withColumn("locus_id", F.concat(F.lit("chr"), "chrom", F.lit(":L"), F.lpad(F.col("k").cast("string"), 5, "0")))
    rest = wide.where("chrom is null or g_start is null or g_end is null").withColumn("locus_id", F.concat(F.lit("UNMAPPED:"), F.col("gene").cast("string")))
    return named.drop("k", "w_start", "w_end").unionByName(rest.drop("w_start", "w_end"))


def collapse_loci(genes: DataFrame, how: str = "max", by: tuple[str, ...] = ()) -> DataFrame:
    """One score a locus: max, mean, or mean of the positive parts."""
    agg = {"max": F.max("score"), "mean": F.avg("score"), "positive_mean": F.avg(F.greatest("score", F.lit(0.0)))}[how]
    return genes.groupBy(*by, "locus_id").agg(agg.alias("locus_score"), F.countDistinct("gene").alias("n_genes"))


def locus_background(genes: DataFrame) -> DataFrame:
    """Per locus: chromosome, span, genes, score, whether any gene is moderate (2 to 4), and average rank share."""
    agg = genes.groupBy("locus_id").agg(
        F.min("chrom").alias("chrom"), F.min("g_start").alias("l_start"), F.max("g_end").alias("l_end"), F.countDistinct("gene").alias("n_genes"),
        F.max("score").alias("locus_score"), F.max(((F.col("score") > 2) & (F.col("score") < 4)).cast("int")).alias("moderate"),
    )
    n = agg.agg(F.count("*").alias("n_loci"))
    return average_rank(agg, "locus_score", "rank", ascending=False).crossJoin(F.broadcast(n)).withColumn("rank_share", F.col("rank") / F.col("n_loci")).drop("n_loci", "rank")


def familywise(nulls: DataFrame, observed: DataFrame) -> DataFrame:
    """Per module the +1-corrected share of replicates whose largest null statistic over all modules reaches the observed."""
    top = nulls.groupBy("replicate").agg(F.max("value").alias("top"))
    return observed.crossJoin(F.broadcast(top)).groupBy("module", "observed").agg(((F.sum((F.col("top") >= F.col("observed")).cast("int")) + 1) / (F.count("*") + 1)).alias("p_family"))


def rank_sum(sets: DataFrame, scores: DataFrame) -> DataFrame:
    """Per module the Mann-Whitney U of its genes against all others and its z (ties averaged, continuity corrected)."""
    ranked = average_rank(scores.select("gene", "score"), "score", "rank")
    counts = scores.groupBy("score").agg(F.count("*").alias("t")).agg((F.sum("t")).alias("n"), F.sum(F.expr("cast(t as double) * t * t - t")).alias("ties"))
    m = sets.select("module", "gene").distinct().join(ranked, "gene").groupBy("module").agg(F.count("*").alias("n_present"), F.sum("rank").alias("rank_sum"))
    k, n = F.col("n_present"), F.col("n").cast("double")
    u = F.col("rank_sum") - k * (k + 1) / 2
    sd = F.sqrt(k * (n - k) / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return m.crossJoin(F.broadcast(counts)).select("module", "n_present", u.alias("u"), F.when(sd > 0, (u - k * (n - k) / 2 - 0.5) / sd).alias("z"))


def marker_sets(metrics: DataFrame, top: int, min_detected: float, min_log2fc: float) -> DataFrame:
    """(group, gene, rank): of each group's genes over both thresholds the first ``top`` by marker score, detection, fold change."""
    over = metrics.where((F.col("detected") >= min_detected) & (F.col("log2fc") >= min_log2fc))
    r = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("marker_score"), F.desc("detected"), F.desc("log2fc"), "gene"))
    return over.withColumn("rank", r).where(F.col("rank") <= top).select("group", "gene", "rank", "marker_score")


def marker_metrics(counts: DataFrame, min_cells: int = 1, eps: float = 1e-9) -> DataFrame:
    """Per group and gene, of (group, gene, value) cells: mean, detected share, and log2 fold change against all other
    groups, whose sums are the gene's totals less the group's own."""
    own = counts.groupBy("group", "gene").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum((F.col("value") > 0).cast("int")).alias("d"))
    all_ = own.groupBy("gene").agg(F.sum("n").alias("n0"), F.sum("s").alias("s0"), F.sum("d").alias("d0"))
    rest = (F.col("s0") - F.col("s")) / F.nullif(F.col("n0") - F.col("n"), F.lit(0))
    mean = F.col("s") / F.col("n")
    return own.where(F.col("n") >= min_cells).join(all_, "gene").select(
        "group", "gene", "n", mean.alias("mean"), (F.col("d") / F.col("n")).alias("detected"),
        F.log2((mean + eps) / (F.coalesce(rest, F.lit(0.0)) + eps)).alias("log2fc"),
    )
