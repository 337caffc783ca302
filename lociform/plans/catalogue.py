"""Registered queries: operators over the domain views, each with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import claims, communities, distributed, graph, ld, mapping, modules, nulls, percolation, qc
from ..operators import relational as R
from ..storage import Scratch
from .views import view, with_views

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def register(oracle: str | None = None):
    """Add a query under its function's name; doubles of its result are rounded to 6 digits, as in the oracle."""

    def add(f):
        def query(spark, sf_dir: str) -> DataFrame:
            out = f(lambda name: view(spark, sf_dir, name) if name.startswith("v_") else spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            return out.select(*(F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in out.dtypes))

        _QUERIES[f.__name__] = query
        if oracle:
            _ORACLES[f.__name__] = with_views(oracle) if "v_" in oracle else oracle
        return f

    return add


def give_sql(name: str, oracle: str) -> None:
    """The DuckDB text of a query that is registered without one."""
    _ORACLES[name] = with_views(oracle)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


SNP1 = "SELECT snp_id, chrom, pos, z, beta, se FROM (SELECT *, row_number() OVER (PARTITION BY snp_id ORDER BY k1, k2, k3, z, beta, se) AS n FROM v_snp) WHERE n = 1"
EDGE = "SELECT least(a, b) AS src, greatest(a, b) AS dst, {agg}(weight) AS weight FROM v_edge WHERE a <> b GROUP BY 1, 2"
MAPPED = f"s AS ({SNP1}), m AS (SELECT DISTINCT s.snp_id, g.gene_id FROM s JOIN v_gene g ON s.chrom = g.chrom AND s.pos BETWEEN g.g_start AND g.g_end)"
WEIGHTED = MAPPED + ", w AS (SELECT snp_id, gene_id, 1.0 / count(*) OVER (PARTITION BY snp_id) AS weight FROM m)"


def snps(t) -> DataFrame:
    return R.dedupe_first(t("v_snp"), ["snp_id"], ["k1", "k2", "k3", "z", "beta", "se"]).select("snp_id", "chrom", "pos", "z", "beta", "se")


def edges(t, how: str = "max") -> DataFrame:
    return graph.canonical_edges(t("v_edge"), how=how)


def held_edges(t, how: str = "sum") -> DataFrame:
    """Canonical edges for queries that read them more than once: the join of all lines is made and written once."""
    e = edges(t, how)
    return Scratch(e.sparkSession, "edges").keep(e, how)


def weights(t) -> DataFrame:
    return mapping.mapping_weights(mapping.map_variants(snps(t), t("v_gene")))


def scored_genes(t) -> DataFrame:
    g = t("v_gene").withColumnRenamed("gene_id", "gene")
    return g.join(t("v_score"), "gene").select("gene", "chrom", "g_start", "g_end", "score", "degree")


@register(f"WITH {WEIGHTED} SELECT gene_id, count(DISTINCT w.snp_id) AS n_snps, round(sum(weight * z), 6) AS sum_wz, round(sum(weight * weight), 6) AS sum_w2, round(sum(weight * weight * z * z), 6) AS q, round(sum(weight * z) / sqrt(sum(weight * weight)), 6) AS signed_score FROM w JOIN s USING (snp_id) GROUP BY gene_id")
def flagship_gene_scores(t):
    return mapping.identity_gene_scores(weights(t), snps(t))


@register(SNP1.replace("snp_id, chrom, pos, z, beta, se FROM", "snp_id, chrom, pos, round(z, 6) AS z, round(beta, 6) AS beta, round(se, 6) AS se FROM"))
def dedupe_first(t):
    return snps(t)


@register(f"WITH s AS ({SNP1}) SELECT s.snp_id, g.gene_id, greatest(g.g_start - s.pos, s.pos - g.g_end, 0) AS distance FROM s JOIN v_gene g ON s.chrom = g.chrom AND s.pos BETWEEN greatest(g.g_start - 2000, 0) AND g.g_end + 1000")
def range_join_map(t):
    return mapping.map_variants(snps(t), t("v_gene"), 2000, 1000)


@register(f"WITH {WEIGHTED} SELECT snp_id, gene_id, count(*) OVER (PARTITION BY snp_id) AS n_genes, round(weight, 6) AS weight FROM w")
def mapping_weights(t):
    return weights(t)


@register(f"WITH {MAPPED}, n AS (SELECT snp_id, count(*) AS n FROM m GROUP BY snp_id) SELECT CAST(sum(n) AS BIGINT) AS n_pairs, count(*) AS n_snps, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_multi, max(n) AS max_genes, (SELECT count(DISTINCT gene_id) FROM m) AS n_genes FROM n")
def mapping_summary(t):
    return mapping.summarize_mapping(mapping.map_variants(snps(t), t("v_gene")))


@register(f"WITH {MAPPED} SELECT snp_id, gene_id, CAST(snp_id % 5 + gene_id % 7 + 1 - 6 * (gene_id % 2) AS DOUBLE) AS raw_weight, round((snp_id % 5 + gene_id % 7 + 1 - 6 * (gene_id % 2)) / sum(abs(snp_id % 5 + gene_id % 7 + 1 - 6 * (gene_id % 2))) OVER (PARTITION BY snp_id), 6) AS weight FROM m WHERE snp_id % 5 + gene_id % 7 + 1 - 6 * (gene_id % 2) <> 0")
def split_weights_signed(t):
    raw = F.expr("cast(snp_id % 5 + gene_id % 7 + 1 - 6 * (gene_id % 2) as double)")
    m = mapping.map_variants(snps(t), t("v_gene")).select("snp_id", "gene_id").distinct().withColumn("raw_weight", raw)
    return mapping.split_weights(m.where("raw_weight <> 0"))


def _edges_query(how: str, agg: str) -> None:
    def q(t):
        return edges(t, how)

    q.__name__ = f"canonical_edges_{how}"
    register(f"SELECT src, dst, round(weight, 6) AS weight FROM ({EDGE.format(agg=agg)})")(q)


for _how, _agg in (("max", "max"), ("mean", "avg"), ("sum", "sum")):
    _edges_query(_how, _agg)


@register(f"WITH e AS ({EDGE.format(agg='max')}), b AS (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e) SELECT node, count(*) AS degree, round(sum(weight), 6) AS strength FROM b GROUP BY node")
def node_degree(t):
    return graph.degrees(edges(t))


@register(f"WITH e AS ({EDGE.format(agg='max')}) SELECT src, dst, weight FROM e WHERE src IN (SELECT gene_id FROM v_gene WHERE size <= 20) AND dst IN (SELECT gene_id FROM v_gene WHERE size <= 20)")
def edge_semi_filter(t):
    return graph.induced(edges(t), t("v_gene").where("size <= 20").select(F.col("gene_id").alias("node"))).select("src", "dst", "weight")


def _laplacian_query(kind: str, off: str, diag: str) -> None:
    def q(t):
        return graph.laplacian(edges(t), kind)

    q.__name__ = f"laplacian_{kind}"
    register(
        f"WITH e AS ({EDGE.format(agg='max')}), b AS (SELECT src AS i, dst AS j, weight AS w FROM e UNION ALL SELECT dst, src, weight FROM e), "
        f"d AS (SELECT i AS node, sum(w) AS d FROM b GROUP BY i) SELECT b.i, b.j, round({off}, 6) AS v FROM b JOIN d di ON di.node = b.i JOIN d dj ON dj.node = b.j "
        f"UNION ALL SELECT node, node, round({diag}, 6) FROM d"
    )(q)


for _k, _o, _d in (("unnormalized", "-b.w", "d"), ("normalized", "-b.w / sqrt(di.d * dj.d)", "1.0::DOUBLE"), ("random_walk", "-b.w / di.d", "1.0::DOUBLE")):
    _laplacian_query(_k, _o, _d)


@register(f"WITH e AS ({EDGE.format(agg='max')}), m AS (SELECT avg(score) AS m FROM v_score) SELECT round(sum(e.weight * (a.score - b.score) * (a.score - b.score)), 6) AS smoothness, round((SELECT sum((score - m) * (score - m)) FROM v_score, m), 6) AS energy FROM e JOIN v_score a ON a.gene = e.src JOIN v_score b ON b.gene = e.dst")
def smoothness(t):
    return graph.smoothness(edges(t), t("v_score").select(F.col("gene").alias("node"), F.col("score").alias("x")))


#: The least node within so many steps of each node; more than the graph's diameter at any scale of the tables.
LABEL_ROUNDS = 8
_LABELS = ", ".join(f"r{i + 1} AS MATERIALIZED (SELECT r.node, least(r.root, coalesce(min(o.root), r.root)) AS root FROM r{i} r LEFT JOIN b ON b.x = r.node LEFT JOIN r{i} o ON o.node = b.y GROUP BY r.node, r.root)" for i in range(LABEL_ROUNDS))
COMPONENTS = f"""WITH e AS MATERIALIZED (SELECT src, dst FROM ({EDGE.format(agg='sum')})),
b AS MATERIALIZED (SELECT src AS x, dst AS y FROM e UNION ALL SELECT dst, src FROM e),
r0 AS (SELECT gene_id AS node, gene_id AS root FROM v_gene), {_LABELS},
c AS (SELECT node, root FROM r{LABEL_ROUNDS}), s AS (SELECT root, count(*) AS n_nodes FROM c GROUP BY root),
l AS (SELECT root, count(*) AS n_edges FROM e JOIN c ON c.node = e.src GROUP BY root),
k AS (SELECT s.root, n_nodes, coalesce(n_edges, 0) AS n_edges, row_number() OVER (ORDER BY n_nodes DESC, s.root) AS component_id FROM s LEFT JOIN l ON l.root = s.root)
SELECT node, component_id, n_nodes, n_edges, component_id = 1 AS is_largest FROM c JOIN k ON k.root = c.root"""


@register(COMPONENTS)
def component_table(t):
    return graph.component_table(edges(t, "sum"), t("v_gene").select(F.col("gene_id").alias("node")))


@register("WITH n AS (SELECT gene, score, row_number() OVER (ORDER BY score DESC, gene) AS r, count(*) OVER () AS n FROM v_score), f AS (SELECT unnest([0.01, 0.05, 0.1]) AS rank_fraction) SELECT gene, score, CAST(rank_fraction AS DOUBLE) AS rank_fraction FROM n, f WHERE r <= greatest(1, round_even(n * rank_fraction, 0))")
def top_fraction_sets(t):
    return R.top_fraction(t("v_score").select("gene", "score"), "score", "gene", [0.1, 0.01, 0.05])


@register("SELECT gene, CAST(greatest(0, ceil((r - 1) * 10 / (n - 1)) - 1) AS INT) AS bin FROM (SELECT gene, row_number() OVER (ORDER BY degree, gene) AS r, count(*) OVER () AS n FROM v_score)")
def degree_bins(t):
    return R.quantile_bins(t("v_score"), "degree", 10, "gene").select("gene", "bin")


@register("SELECT gene, round((r + (k - 1) / 2.0) / n, 6) AS pct FROM (SELECT gene, rank() OVER (ORDER BY degree) AS r, count(*) OVER (PARTITION BY degree) AS k, count(*) OVER () AS n FROM v_score)")
def avg_rank_pct(t):
    ranked = R.average_rank(t("v_score"), "degree")
    return ranked.select("gene", (F.col("rank") / F.count("*").over(Window.partitionBy())).alias("pct"))


LOCI = """w AS (SELECT p_partkey AS gene, chrom, g_start, g_end, score, degree, greatest(g_start - 4000, 0) AS ws, g_end + 4000 AS we
  FROM part JOIN v_gene ON gene_id = p_partkey JOIN v_score ON gene = p_partkey),
i AS (SELECT *, CASE WHEN ws <= max(we) OVER (PARTITION BY chrom ORDER BY ws, we ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM w),
l AS (SELECT *, 'chr' || chrom || ':L' || lpad(CAST(sum(new) OVER (PARTITION BY chrom ORDER BY ws, we ROWS UNBOUNDED PRECEDING) AS VARCHAR), 5, '0') AS locus_id FROM i)"""


@register(f"WITH {LOCI} SELECT gene, locus_id FROM l")
def islands_loci(t):
    return modules.pseudo_loci(scored_genes(t), 4000).select("gene", "locus_id")


@register(f"WITH {LOCI} SELECT locus_id, round(max(score), 6) AS locus_score, count(DISTINCT gene) AS n_genes FROM l GROUP BY locus_id")
def locus_collapse(t):
    return modules.collapse_loci(modules.pseudo_loci(scored_genes(t), 4000))


@register(f"WITH {LOCI}, a AS (SELECT locus_id, min(chrom) AS chrom, min(g_start) AS l_start, max(g_end) AS l_end, count(DISTINCT gene) AS n_genes, max(score) AS locus_score, CAST(max(CASE WHEN score > 2 AND score < 4 THEN 1 ELSE 0 END) AS INT) AS moderate FROM l GROUP BY locus_id) SELECT locus_id, chrom, l_start, l_end, n_genes, round(locus_score, 6) AS locus_score, moderate, round((rank() OVER (ORDER BY locus_score DESC) + (count(*) OVER (PARTITION BY locus_score) - 1) / 2.0) / count(*) OVER (), 6) AS rank_share FROM a")
def locus_background(t):
    return modules.locus_background(modules.pseudo_loci(scored_genes(t), 4000))


@register("WITH b AS (SELECT CAST(chrom AS VARCHAR) || '-' || CAST(k AS VARCHAR) AS block_id, chrom, k * 150000 AS b_start, k * 150000 + 140000 AS b_end FROM (SELECT DISTINCT chrom FROM v_gene), (SELECT unnest(range(0, (SELECT max(g_end) FROM v_gene) // 150000 + 1)) AS k)), h AS (SELECT g.gene_id, b.block_id, row_number() OVER (PARTITION BY g.gene_id ORDER BY CASE WHEN (g.g_start + g.g_end) / 2.0 BETWEEN b_start AND b_end THEN 0 ELSE 1 END, least(g.g_end, b_end) - greatest(g.g_start, b_start) DESC, b_start) AS n FROM v_gene g JOIN b ON b.chrom = g.chrom AND g.g_start <= b_end AND b_start <= g.g_end) SELECT g.gene_id, coalesce(h.block_id, 'UNBLOCKED') AS block_id FROM v_gene g LEFT JOIN h ON h.gene_id = g.gene_id AND n = 1")
def ld_block_assign(t):
    b = t("v_gene").groupBy("chrom").agg(F.max("g_end").alias("end")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end") / 150000))))
    b = b.select("chrom", F.concat_ws("-", "chrom", F.col("k").cast("string")).alias("block_id"), (F.col("k") * 150000).alias("b_start"), (F.col("k") * 150000 + 140000).alias("b_end"))
    return mapping.assign_blocks(t("v_gene"), b)


MEMBERS = "j AS (SELECT module, gene, score, row_number() OVER (PARTITION BY module ORDER BY score DESC, gene) AS r, count(*) OVER (PARTITION BY module) AS n FROM (SELECT DISTINCT module, gene FROM v_module) JOIN v_score USING (gene))"


@register(f"WITH {MEMBERS} SELECT module, count(*) AS n, round(avg(score), 6) AS mean, round(sum(score) / sqrt(count(*)), 6) AS sqrt_n_mean, round(sum(greatest(score, 0)) / sqrt(count(*)), 6) AS positive_stat FROM j GROUP BY module")
def module_statistics(t):
    return modules.module_statistics(t("v_module"), t("v_score"))


@register(f"WITH {MEMBERS} SELECT module, round(avg(score), 6) AS top_mean, count(*) AS n_top FROM j WHERE r <= greatest(1, ceil(n * 0.2)) GROUP BY module")
def module_top_fraction(t):
    return modules.top_fraction_mean(t("v_module"), t("v_score"))


@register(f"WITH {MEMBERS} SELECT module, k, count(*) FILTER (r > k) AS n_left, round(sum(score) FILTER (r > k) / sqrt(nullif(count(*) FILTER (r > k), 0)), 6) AS stat FROM j, (SELECT unnest([1, 3, 5]) AS k) GROUP BY module, k")
def leave_top_k(t):
    return modules.leave_top_k(t("v_module"), t("v_score"))


@register(f"WITH {MEMBERS}, g AS (SELECT *, floor(n * 0.1) AS g FROM j), b AS (SELECT module, max(score) FILTER (r = n - g) AS lo, max(score) FILTER (r = g + 1) AS hi FROM g GROUP BY module) SELECT module, round(avg(score) FILTER (r > g AND r <= n - g), 6) AS trimmed_mean, round(avg(least(greatest(score, lo), hi)), 6) AS winsor_mean FROM g JOIN b USING (module) GROUP BY module")
def winsor_trim_stats(t):
    return modules.robust_statistics(t("v_module"), t("v_score"))


@register(f"WITH {MEMBERS} SELECT module, round(sum(score), 6) AS positive_sum, round(sum(score) * sum(score) / sum(score * score), 6) AS effective_number, round(sum(score) FILTER (r <= 1) / sum(score), 6) AS top1_share, round(sum(score) FILTER (r <= 5) / sum(score), 6) AS top5_share FROM j GROUP BY module")
def contribution_metrics(t):
    return modules.contribution_metrics(t("v_module").distinct().join(t("v_score"), "gene"))


@register(f"WITH {MEMBERS}, c AS (SELECT module, sum(score) * sum(score) / sum(score * score) AS e, sum(score) FILTER (r <= 1) / sum(score) AS t1, sum(score) FILTER (r <= 5) / sum(score) AS t5 FROM j GROUP BY module) SELECT module, round(least(1, e / 5), 6) AS n_eff_penalty, round(least(1, 0.35 / t1), 6) AS top1_penalty, round(least(1, 0.7 / t5), 6) AS top5_penalty FROM c")
def module_penalties(t):
    c = modules.contribution_metrics(t("v_module").distinct().join(t("v_score"), "gene"))
    return c.select("module", *(x.alias(n) for n, x in modules.penalties(F.col("effective_number"), F.col("top1_share"), F.col("top5_share")).items()))


PERMUTED = "b AS (SELECT gene, score, CAST(degree % 4 AS INT) AS bin FROM v_score), r AS (SELECT unnest(range(0, {n}))::INT AS replicate), h AS (SELECT replicate, gene, bin, row_number() OVER (PARTITION BY replicate, bin ORDER BY gene) AS k FROM b, r), v AS (SELECT replicate, bin, score, row_number() OVER (PARTITION BY replicate, bin ORDER BY md5('1-' || replicate || '-' || gene), gene) AS k FROM b, r), p AS (SELECT h.replicate, h.gene, h.bin, v.score FROM h JOIN v USING (replicate, bin, k))"


def permuted(t, n: int) -> DataFrame:
    b = t("v_score").select("gene", "score", (F.col("degree") % 4).cast("int").alias("bin"))
    return R.hash_permute(b, "score", "gene", ["bin"], n)


@register("WITH " + PERMUTED.format(n=5) + " SELECT * FROM p")
def hash_permute_within_bins(t):
    return permuted(t, 5)


NULLS = PERMUTED.format(n=20) + f", {MEMBERS}, o AS (SELECT module, sum(score) / sqrt(count(*)) AS observed FROM j GROUP BY module), n AS (SELECT replicate, module, sum(p.score) / sqrt(count(*)) AS value FROM p JOIN (SELECT DISTINCT module, gene FROM v_module) USING (gene) GROUP BY ALL)"


def null_statistics(t) -> tuple[DataFrame, DataFrame]:
    sets = t("v_module").distinct()
    stat = F.round(F.sum("score") / F.sqrt(F.count("*").cast("double")), 9)
    null = permuted(t, 20).join(sets, "gene").groupBy("replicate", "module").agg(stat.alias("value"))
    return null, sets.join(t("v_score"), "gene").groupBy("module").agg(stat.alias("observed"))


@register(f"WITH {NULLS} SELECT module, round(any_value(observed), 6) AS observed, count(*) AS n_null, round(avg(value), 6) AS null_mean, round(stddev_samp(value), 6) AS null_sd, round((count(*) FILTER (round(value, 9) >= round(observed, 9)) + 1) / (count(*) + 1), 6) AS p_upper, round((count(*) FILTER (round(value, 9) <= round(observed, 9)) + 1) / (count(*) + 1), 6) AS p_lower, round((any_value(observed) - avg(value)) / stddev_samp(value), 6) AS z FROM n JOIN o USING (module) GROUP BY module")
def empirical_p_z(t):
    return R.empirical(*null_statistics(t), ["module"])


@register(f"WITH {NULLS}, x AS (SELECT replicate, max(round(value, 9)) AS top FROM n GROUP BY replicate) SELECT module, round(observed, 6) AS observed, round((count(*) FILTER (top >= round(observed, 9)) + 1) / (count(*) + 1), 6) AS p_family FROM o, x GROUP BY module, observed")
def module_familywise_max(t):
    return modules.familywise(*null_statistics(t))


@register("WITH p AS (SELECT gene, CASE WHEN gene % 17 = 0 THEN NULL ELSE (gene * 7919 % 1000 + 1) / 1000.0 END AS p FROM v_score), n AS (SELECT p, count(*) AS k FROM p WHERE p IS NOT NULL GROUP BY p), s AS (SELECT p, p * sum(k) OVER () / sum(k) OVER (ORDER BY p) AS q FROM n), q AS (SELECT p, least(1, min(q) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q FROM s) SELECT gene, round(p.p, 6)::DOUBLE AS p, round(q, 6)::DOUBLE AS q FROM p LEFT JOIN q ON q.p = p.p")
def bh_fdr(t):
    p = F.when(F.col("gene") % 17 != 0, ((F.col("gene") * 7919) % 1000 + 1) / 1000.0)
    return R.bh_fdr(t("v_score").select("gene", p.alias("p")), "p").select("gene", "p", "q")


@register("WITH s AS (SELECT DISTINCT module, gene FROM v_module), n AS (SELECT module, count(*) AS n FROM s GROUP BY module), x AS (SELECT a.module AS a, b.module AS b, count(*) AS shared FROM s a JOIN s b ON a.gene = b.gene AND a.module < b.module GROUP BY ALL) SELECT a, b, shared, round(shared / (na.n + nb.n - shared), 6) AS jaccard FROM x JOIN n na ON na.module = a JOIN n nb ON nb.module = b")
def pairwise_jaccard(t):
    return R.pairwise_jaccard(t("v_module"), "module", "gene")


@register("WITH u AS (SELECT gene FROM v_score WHERE degree > 25) SELECT module, CAST(sum(CASE WHEN u.gene IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_present, CAST(sum(CASE WHEN u.gene IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped FROM (SELECT DISTINCT module, gene FROM v_module) s LEFT JOIN u ON u.gene = s.gene GROUP BY module")
def present_dropped_sets(t):
    return R.present_dropped(t("v_module"), t("v_score").where("degree > 25"), "module", "gene")


@register("WITH s AS (SELECT module, rank_fraction, n FROM (SELECT DISTINCT module, gene FROM v_module) JOIN v_score USING (gene), (SELECT unnest([0.1, 0.2, 0.5]) AS rank_fraction), (SELECT 1 AS n)), g AS (SELECT module, CAST(rank_fraction AS DOUBLE) AS x, round(count(*) * rank_fraction, 6)::DOUBLE AS y FROM s GROUP BY module, rank_fraction), a AS (SELECT module, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM g WINDOW w AS (PARTITION BY module ORDER BY x)) SELECT module, round(coalesce(sum(a), 0), 6) AS auc FROM a GROUP BY module")
def trapezoid_auc(t):
    s = t("v_module").distinct().join(t("v_score"), "gene").groupBy("module").agg(F.count("*").alias("n"))
    g = s.withColumn("x", F.explode(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.5)))).withColumn("y", F.round(F.col("n") * F.col("x"), 6))
    return R.trapezoid(g, "x", "y", ["module"])


@register("SELECT gene, round(score - (regr_intercept(score, degree) OVER () + regr_slope(score, degree) OVER () * degree), 6) AS residual FROM v_score")
def ols_residual(t):
    return R.ols_residual(t("v_score"), "score", ["degree"]).select("gene", "residual")


@register("SELECT round(corr(score, degree), 6) AS pearson, round(corr(rs, rd), 6) AS spearman FROM (SELECT score, degree, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rs, rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2.0 AS rd FROM v_score)")
def pearson_spearman(t):
    r = R.average_rank(R.average_rank(t("v_score"), "score", "rs"), "degree", "rd")
    return r.agg(F.corr("score", "degree").alias("pearson"), F.corr("rs", "rd").alias("spearman"))


GENO = "g AS (SELECT vec_id AS sample, CAST(unnest(range(0, 64)) AS INT) AS snp, embedding FROM embeddings), x AS (SELECT sample, snp, CAST(embedding[snp + 1] AS DOUBLE) AS v FROM g)"


def genotypes(t) -> DataFrame:
    e = t("embeddings").select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("snp", "value"))
    return e.withColumn("value", F.col("value").cast("double"))


@register(f"WITH {GENO} SELECT a.snp AS snp_i, b.snp AS snp_j, CASE WHEN a.snp = b.snp THEN 1.0 ELSE round(corr(a.v, b.v), 6) END::DOUBLE AS r FROM x a JOIN x b USING (sample) WHERE a.snp <= b.snp GROUP BY a.snp, b.snp")
def ld_correlation(t):
    return ld.genotype_correlation(genotypes(t))


@register(f"WITH {GENO}, r AS (SELECT a.snp AS i, b.snp AS j, CASE WHEN a.snp = b.snp THEN 1.0 ELSE corr(a.v, b.v) END AS r FROM x a JOIN x b USING (sample) GROUP BY a.snp, b.snp) SELECT CAST(count(*) FILTER (i = j) AS BIGINT) AS n, round(count(*) FILTER (i = j) * count(*) FILTER (i = j) / sum(r * r), 6) AS m_eff, round(sum(r * r) / count(*) FILTER (i = j), 6) AS local_ld_score FROM r")
def ld_summary(t):
    return ld.summarize_correlation(ld.genotype_correlation(genotypes(t)))


ALLELES = "SELECT snp_id, ['A','C','G','T'][1 + snp_id % 4] AS e, ['A','C','G','T'][1 + (snp_id // 4) % 4] AS o, ['A','C','G','T'][1 + (snp_id // 16) % 4] AS r1, ['A','C','G','T'][1 + (snp_id // 64) % 4] AS r2 FROM (SELECT DISTINCT snp_id FROM v_snp)"


def alleles(t) -> DataFrame:
    base = lambda d: F.element_at(F.array(*map(F.lit, "ACGT")), (1 + F.floor(F.col("snp_id") / d) % 4).cast("int"))
    return t("v_snp").select("snp_id").distinct().select("snp_id", base(1).alias("e"), base(4).alias("o"), base(16).alias("r1"), base(64).alias("r2"))


@register(f"WITH a AS ({ALLELES}) SELECT snp_id, CASE WHEN e = r1 AND o = r2 THEN 'same' WHEN e = r2 AND o = r1 THEN 'flip' WHEN translate(e, 'ACGT', 'TGCA') = r1 AND translate(o, 'ACGT', 'TGCA') = r2 THEN 'strand' WHEN translate(e, 'ACGT', 'TGCA') = r2 AND translate(o, 'ACGT', 'TGCA') = r1 THEN 'strand_flip' END AS alignment, translate(e, 'ACGT', 'TGCA') = o AS palindromic FROM a")
def qc_allele_case(t):
    return alleles(t).select("snp_id", S.allele_case(*map(F.col, ("e", "o", "r1", "r2"))).alias("alignment"), S.palindromic(F.col("e"), F.col("o")).alias("palindromic"))


@register("SELECT snp_id, pos, concat_ws(';', CASE WHEN beta = 0 THEN 'zero_beta' END, CASE WHEN se < 0.03 THEN 'small_se' END, CASE WHEN abs(z) > 1.5 THEN 'large_z' END) AS qc_fail_reason FROM v_snp")
def qc_fail_reasons(t):
    checks = [("zero_beta", F.col("beta") == 0), ("small_se", F.col("se") < 0.03), ("large_z", F.abs("z") > 1.5)]
    return t("v_snp").select("snp_id", "pos", S.fail_reasons(checks).alias("qc_fail_reason"))


@register("SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(concat_ws(';', CASE WHEN beta = 0 THEN 'zero_beta' END, CASE WHEN se < 0.03 THEN 'small_se' END, CASE WHEN abs(z) > 1.5 THEN 'large_z' END), ';')) AS reason FROM v_snp) WHERE reason <> '' GROUP BY reason")
def qc_fail_counts(t):
    return qc.fail_counts(qc_fail_reasons(t))


@register("SELECT gene_id, size < 2 AS low_information, size > 40 AS high_snp_count, concat_ws(';', CASE WHEN chrom = '6' AND g_start * 20 <= 35000000 AND g_end * 20 >= 25000000 THEN 'MHC' END, CASE WHEN chrom = '19' AND g_start * 20 <= 46500000 AND g_end * 20 >= 44000000 THEN 'APOE' END) AS special_regions FROM v_gene")
def safety_flags(t):
    g = t("v_gene").select("gene_id", "chrom", (F.col("g_start") * 20).alias("g_start"), (F.col("g_end") * 20).alias("g_end"), F.col("size").cast("double").alias("m_eff"), F.col("size").alias("n_snps"))
    return qc.gene_flags(g, 40).select("gene_id", "low_information", "high_snp_count", "special_regions")


@register("SELECT gene, score - 12 AS z, CASE WHEN score - 12 >= 2.5 THEN 'final_positive' WHEN score - 12 >= 2.0 THEN 'supportive' ELSE 'negative' END AS claim FROM (SELECT gene, score FROM v_score)".replace("score - 12 AS z", "round(score - 12, 6) AS z"))
def z_claims(t):
    return t("v_score").select("gene", (F.col("score") - 12).alias("z"), claims.z_claim(F.col("score") - 12).alias("claim"))


@register("SELECT gene, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, gene) AS rank FROM v_score ORDER BY score DESC, gene LIMIT 20")
def top20_genes(t):
    ranked = t("v_score").orderBy(F.desc("score"), "gene").limit(20)
    return ranked.select("gene", "score", F.row_number().over(Window.orderBy(F.desc("score"), "gene")).alias("rank"))


@register()
def percolation_curve(t):
    s = t("v_score").select(F.col("gene").alias("node"), "score")
    return percolation.percolation_curve(edges(t, "sum"), s, [0.01, 0.05, 0.1, 0.2])


@register()
def percolation_null_auc(t):
    s = permuted(t, 3).select("replicate", F.col("gene").alias("node"), "score")
    curve = percolation.percolation_curve(edges(t, "sum"), s, [0.05, 0.1, 0.2], ("replicate",))
    return percolation.percolation_auc(curve, ("replicate",))


@register()
def heat_diffusion(t):
    s = permuted(t, 3).select("replicate", F.col("gene").alias("node"), "score")
    return percolation.heat_diffusion(edges(t, "sum"), s)


@register()
def gene_mixture_tests(t):
    return ld.gene_tests(weights(t).join(snps(t).select("snp_id", "z"), "snp_id"))


def degree_bin(t) -> DataFrame:
    return t("v_score").select("gene", "score", (F.col("degree") % 4).cast("int").alias("bin"))


def library(t) -> DataFrame:
    return t("v_module").distinct()


HASH = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
PROFILE = "bins AS (SELECT gene, score, CAST(degree % 4 AS INT) AS bin FROM v_score), lib AS (SELECT DISTINCT module, gene FROM v_module), prof AS (SELECT module, bin, count(*) AS n FROM lib JOIN bins USING (gene) GROUP BY module, bin), reps AS (SELECT unnest(range(0, {n}))::INT AS replicate), sizes AS (SELECT bin, count(*) AS size FROM bins GROUP BY bin)"
SAMPLED = (
    PROFILE.format(n=4)
    + f", placed AS (SELECT replicate, bin, gene, score, row_number() OVER (PARTITION BY replicate, bin ORDER BY {HASH.format('concat_ws(chr(45), 1, replicate, gene)')}, gene) - 1 AS place FROM bins, reps), "
    + "wanted AS (SELECT replicate, module, bin, size, n, unnest(range(0, n)) AS j FROM prof JOIN sizes USING (bin), reps), "
    + f"smp AS (SELECT w.replicate, w.module, w.bin, p.gene, p.score FROM wanted w JOIN placed p ON p.replicate = w.replicate AND p.bin = w.bin AND p.place = ({HASH.format('concat_ws(chr(45), 1, w.replicate, w.module, w.bin)')} + w.j) % w.size)"
)


@register("WITH " + PROFILE.format(n=1) + " SELECT module, bin, n FROM prof")
def degree_bin_profile(t):
    return nulls.bin_profile(library(t), degree_bin(t))


@register("WITH " + SAMPLED + " SELECT replicate, module, bin, gene FROM smp")
def degree_matched_sample(t):
    return nulls.matched_sample(degree_bin(t), nulls.bin_profile(library(t), degree_bin(t)), 4)


@register("WITH " + SAMPLED + " SELECT replicate, module, round(sum(greatest(score, 0)) / sqrt(count(*)), 6) AS value FROM smp GROUP BY replicate, module")
def degree_matched_null_statistics(t):
    s = nulls.matched_sample(degree_bin(t), nulls.bin_profile(library(t), degree_bin(t)), 4).join(t("v_score").select("gene", "score"), "gene")
    return s.groupBy("replicate", "module").agg((F.sum(F.greatest("score", F.lit(0.0))) / F.sqrt(F.count("*").cast("double"))).alias("value"))


@register("WITH " + PROFILE.format(n=3) + f", placed AS (SELECT bin, gene AS drawn, row_number() OVER (PARTITION BY bin ORDER BY gene) - 1 AS place FROM bins) SELECT replicate, module, l.gene, b.bin, drawn FROM lib l JOIN bins b USING (gene) JOIN sizes s USING (bin), reps, placed p WHERE p.bin = b.bin AND p.place = {HASH.format('concat_ws(chr(45), 1, replicate, module, l.gene)')} % size")
def matched_draws_with_replacement(t):
    return nulls.matched_draws(degree_bin(t), library(t).join(degree_bin(t), "gene"), 3)


HEAVY = f"e AS (SELECT src, dst, weight FROM ({EDGE.format(agg='sum')})), both_ways AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e)"
BALLS = HEAVY + ", s AS (SELECT DISTINCT x AS seed FROM both_ways), b AS (SELECT seed, seed AS node, 0 AS distance FROM s UNION ALL SELECT seed, y, 1 FROM s JOIN both_ways ON x = seed UNION ALL SELECT seed, w.y, 2 FROM s JOIN both_ways v ON v.x = seed JOIN both_ways w ON w.x = v.y), ball AS (SELECT seed, node, min(distance) AS distance FROM b GROUP BY seed, node)"


def all_seeds(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("seed")).distinct()


def node_scores(t) -> DataFrame:
    return t("v_score").select(F.col("gene").alias("node"), "score")


@register("WITH " + BALLS + " SELECT seed, node, CAST(distance AS INT) AS distance, CASE WHEN distance <= 1 THEN 'inner' ELSE 'annulus' END AS layer FROM ball")
def neighbourhood_layers(t):
    e = held_edges(t)
    return communities.layers(e, all_seeds(e), 1, 2)


@register("WITH " + BALLS + ", x AS (SELECT seed, distance, score, CAST(unnest([0.5, 1.0, 2.0]) AS DOUBLE) AS tau FROM ball JOIN v_score ON gene = node) SELECT seed, tau, count(*) AS n, round(sum(exp(-distance / tau) * greatest(score, 0)) / sqrt(sum(exp(-2 * distance / tau))), 6) AS stat FROM x GROUP BY seed, tau")
def diffusion_neighbourhoods(t):
    e = held_edges(t)
    return communities.diffusion_neighbourhoods(e, node_scores(t), all_seeds(e))


@register("WITH d AS (SELECT DISTINCT module, gene FROM v_module), m AS (SELECT module, median(score) AS location, stddev_samp(score) AS sd FROM d JOIN v_score USING (gene) GROUP BY module), a AS (SELECT module, location, sd, 1.4826 * median(abs(score - location)) AS mad FROM d JOIN v_score USING (gene) JOIN m USING (module) GROUP BY module, location, sd) SELECT module, round(location, 6) AS location, round(CASE WHEN mad > 1e-6 THEN mad WHEN coalesce(sd, 0) > 1e-6 THEN sd ELSE 1e-6 END + 1e-6, 6) AS scale FROM a")
def robust_location_scale(t):
    return communities.location_scale(t("v_module").distinct().join(t("v_score"), "gene"), ("module",))


@register("WITH " + BALLS + """, x AS (SELECT seed, node, layer, score FROM (SELECT *, CASE WHEN distance <= 1 THEN 'inner' ELSE 'annulus' END AS layer FROM ball) JOIN v_score ON gene = node),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, node) AS r FROM x WHERE layer = 'inner'), t AS (SELECT seed, avg(score) AS top_mean, count(*) AS k FROM r WHERE r <= 10 GROUP BY seed),
m AS (SELECT seed, median(score) AS l, stddev_samp(score) AS sd, count(*) AS n FROM x WHERE layer = 'annulus' GROUP BY seed),
a AS (SELECT seed, l, sd, n, 1.4826 * median(abs(score - l)) AS mad FROM x JOIN m USING (seed) WHERE layer = 'annulus' GROUP BY seed, l, sd, n),
z AS (SELECT seed, n, l, CASE WHEN mad > 1e-6 THEN mad WHEN coalesce(sd, 0) > 1e-6 THEN sd ELSE 1e-6 END + 1e-6 AS s FROM a),
g0 AS (SELECT median(score) AS l FROM v_score), g AS (SELECT l, 1.4826 * median(abs(score - l)) + 1e-6 AS s FROM v_score, g0 GROUP BY l)
SELECT t.seed, k, coalesce(n, 0) AS n_background, CASE WHEN n >= 10 THEN 'annulus' ELSE 'global' END AS background, round((top_mean - CASE WHEN n >= 10 THEN z.l ELSE g.l END) * sqrt(k) / CASE WHEN n >= 10 THEN z.s ELSE g.s END, 6) AS contrast FROM t LEFT JOIN z USING (seed), g""")
def annulus_contrast(t):
    e = held_edges(t)
    return communities.annulus_contrast(e, node_scores(t), all_seeds(e))


@register("WITH " + HEAVY + """, lib AS (SELECT DISTINCT module, gene AS node FROM v_module),
i AS (SELECT a.module, e.src, e.dst FROM e JOIN lib a ON a.node = e.src JOIN lib b ON b.node = e.dst AND b.module = a.module), d AS (SELECT module, node, count(*) AS d FROM (SELECT module, src AS node FROM i UNION ALL SELECT module, dst FROM i) GROUP BY module, node),
f AS (SELECT l.module, l.node, score, coalesce(d, 0) AS d FROM lib l JOIN v_score ON gene = l.node LEFT JOIN d ON d.module = l.module AND d.node = l.node),
r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY score DESC, d DESC, node DESC) AS r, count(*) OVER (PARTITION BY module) AS n, median(d) OVER (PARTITION BY module) AS cut FROM f),
c AS (SELECT *, d >= cut AS core, max(CAST(d >= cut AS INT)) OVER (PARTITION BY module) AS any_core FROM r WHERE r <= greatest(1, ceil(n * 0.2))) SELECT module, node FROM c WHERE core OR (any_core = 0 AND r = 1)""")
def module_core_genes(t):
    return communities.core_genes(library(t).withColumnRenamed("gene", "node"), edges(t, "sum"), node_scores(t))


@register("WITH " + HEAVY + ", n AS (SELECT gene AS node, row_number() OVER (ORDER BY score DESC, gene) AS r, count(*) OVER () AS n FROM v_score), top AS (SELECT node, CAST(f AS DOUBLE) AS rank_fraction FROM n, (SELECT unnest([0.05, 0.1, 0.2]) AS f) WHERE r <= greatest(1, round_even(n * f, 0))), k AS (SELECT rank_fraction, count(*) AS n FROM top GROUP BY 1), q AS (SELECT a.rank_fraction, count(*) AS m FROM e JOIN top a ON a.node = e.src JOIN top b ON b.node = e.dst AND a.rank_fraction = b.rank_fraction GROUP BY 1) SELECT rank_fraction, n, coalesce(m, 0) AS n_edges, round(CASE WHEN n > 1 THEN 2.0 * coalesce(m, 0) / (n * (n - 1)) ELSE 0 END, 6) AS density FROM k LEFT JOIN q USING (rank_fraction)")
def induced_density_curve(t):
    return nulls.density_curve(edges(t, "sum"), R.top_fraction(node_scores(t), "score", "node", [0.05, 0.1, 0.2]))


@register("WITH r AS (SELECT gene, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM v_score), c AS (SELECT sum(t) AS n, sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM v_score GROUP BY score)), m AS (SELECT module, count(*) AS k, sum(r) AS s FROM (SELECT DISTINCT module, gene FROM v_module) JOIN r USING (gene) GROUP BY module) SELECT module, k AS n_present, round(s - k * (k + 1) / 2, 6) AS u, round((s - k * (k + 1) / 2 - k * (n - k) / 2 - 0.5) / sqrt(k * (n - k) / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM m, c")
def module_rank_sum(t):
    return modules.rank_sum(t("v_module"), t("v_score"))


@register("WITH c AS (SELECT l_returnflag || l_linestatus AS g, l_partkey AS gene, greatest(l_quantity - 20, 0)::DOUBLE AS v FROM lineitem), o AS (SELECT g, gene, count(*) AS n, sum(v) AS s, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS d FROM c GROUP BY g, gene), a AS (SELECT gene, sum(n) AS n0, sum(s) AS s0 FROM o GROUP BY gene), m AS (SELECT g, gene, d / n AS detected, s / n AS mean, log2((s / n + 1) / (coalesce((s0 - s) / nullif(n0 - n, 0), 0) + 1)) AS log2fc FROM o JOIN a USING (gene) WHERE n >= 3), r AS (SELECT *, mean * detected AS marker_score FROM m), k AS (SELECT g, gene, marker_score, row_number() OVER (PARTITION BY g ORDER BY round(marker_score, 9) DESC, round(detected, 9) DESC, round(log2fc, 9) DESC, gene) AS rank FROM r WHERE detected >= 0.5 AND round(log2fc, 9) >= 0.25) SELECT g AS \"group\", gene, CAST(rank AS INT) AS rank, round(marker_score, 6) AS marker_score FROM k WHERE rank <= 15")
def marker_gene_sets(t):
    cells = t("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("group"), F.col("l_partkey").alias("gene"), F.greatest(F.col("l_quantity") - 20, F.lit(0)).cast("double").alias("value"))
    m = modules.marker_metrics(cells, min_cells=3, eps=1.0)
    m = m.withColumns({"marker_score": F.round(F.col("mean") * F.col("detected"), 9), "detected": F.round("detected", 9), "log2fc": F.round("log2fc", 9)})
    return modules.marker_sets(m, 15, 0.5, 0.25)


@register("SELECT gene, CASE WHEN m >= 2 AND r >= 2 THEN 'topology_specific_module_excess' WHEN m >= 2 AND r <= -2 THEN 'degree_aware_aggregation_topology_sensitive' WHEN m >= 2 THEN 'degree_aware_network_aggregation' WHEN s >= 2 OR d >= 2 THEN 'broad_genetic_signal_without_degree_aware_graph_aggregation' ELSE 'no_graph_coupled_signal' END AS architecture FROM (SELECT gene, CASE WHEN gene % 11 = 0 THEN NULL ELSE gene % 7 - 3 END AS m, gene % 9 - 4 AS r, gene % 5 - 2 AS s, gene % 4 - 1 AS d FROM v_score)")
def percolation_architecture(t):
    z = lambda e: F.expr(f"cast({e} as double)")
    matched = F.when(F.col("gene") % 11 != 0, z("gene % 7 - 3"))
    return t("v_score").select("gene", claims.architecture(z("gene % 5 - 2"), z("gene % 4 - 1"), matched, z("gene % 9 - 4")).alias("architecture"))


P_COLUMNS = {"locus": 7, "penalised": 11, "positive": 13, "rank": 5, "moderate": 6, "leave_top1": 9, "raw": 4}


@register(
    "WITH x AS (SELECT gene, gene % 29 = 0 AS degraded, " + ", ".join(f"(gene % {m}) / {4 * m}.0 AS p_{k}" for k, m in P_COLUMNS.items()) + ", (gene % 8 + 2)::DOUBLE AS n_eff, (gene % 10) / 20.0 AS top1, (gene % 12) / 14.0 AS top5 FROM v_score) "
    "SELECT gene, CASE WHEN degraded THEN 'null_degraded_unresolved' WHEN p_locus < 0.05 AND p_penalised < 0.05 AND p_moderate < 0.1 AND p_leave_top1 < 0.1 AND n_eff >= 5 AND top1 <= 0.35 AND top5 <= 0.7 AND (p_positive < 0.05 OR p_rank < 0.05) THEN 'distributed_weak_signal_module_candidate' "
    "WHEN (p_locus < 0.05 OR p_penalised < 0.05) AND top1 <= 0.35 AND n_eff >= 5 AND (p_positive < 0.05 OR p_rank < 0.05 OR p_leave_top1 < 0.1 OR p_moderate < 0.1) THEN 'mixed_sparse_distributed_candidate' "
    "WHEN (p_locus < 0.05 OR p_penalised < 0.05) AND p_moderate < 0.1 AND top1 <= 0.35 THEN 'moderate_locus_supported_module' WHEN (p_locus < 0.05 OR p_penalised < 0.05) AND p_rank < 0.05 AND top1 <= 0.35 THEN 'module_specific_rank_supported_module' "
    "WHEN p_raw < 0.05 AND (top1 > 0.35 OR n_eff < 5) THEN 'top_locus_dominant_module' WHEN p_raw < 0.05 AND p_locus < 0.1 THEN 'sparse_locus_pathway_overlap' WHEN p_raw < 0.05 THEN 'raw_gene_set_enrichment_only' ELSE 'negative' END AS label FROM x"
)
def distributed_module_class(t):
    p = {k: F.expr(f"cast((gene % {m}) / {4 * m}.0 as double)") for k, m in P_COLUMNS.items()}
    num = lambda e: F.expr(f"cast({e} as double)")
    return t("v_score").select("gene", claims.distributed_class(F.expr("gene % 29 = 0"), p, num("gene % 8 + 2"), num("(gene % 10) / 20.0"), num("(gene % 12) / 14.0")).alias("label"))


@register()
def random_density_null(t):
    nodes = t("v_score").select(F.col("gene").alias("node"))
    return nulls.random_density_null(edges(t, "sum"), nodes, [0.05, 0.1, 0.2], 5)


@register()
def degree_preserving_rewiring(t):
    return nulls.rewired(edges(t, "sum"), 3)


@register()
def discovered_modules(t):
    return communities.discover(edges(t, "sum"), node_scores(t), [0.05, 0.1, 0.2], min_size=3)[0]


@register()
def louvain_communities(t):
    return communities.louvain(edges(t, "sum"), min_size=2)


@register()
def pruned_gene_sets(t):
    sizes = t("v_module").distinct().groupBy("module").agg(F.count("*").alias("n"))
    return communities.prune(t("v_module").distinct().join(sizes, "module"), [F.desc("n")], 0.02)


#: Scores of the tables lie around ten; less ten, the cap and the moderate range hold some of them.
DISTRIBUTED = LOCI.replace("score, degree, greatest", "round(score - 10, 6) AS score, degree, greatest") + """,
k AS (SELECT locus_id, max(least(score, 3)) AS locus_score FROM l GROUP BY locus_id),
o AS (SELECT *, rank_n / n_loci AS rank_fraction FROM (SELECT *, row_number() OVER (ORDER BY locus_score DESC, locus_id) AS rank_n, count(*) OVER () AS n_loci FROM k)),
x AS (SELECT module, locus_id, max(least(score, 3)) AS value, max(CASE WHEN score > 2 AND score < 4 THEN 1 ELSE 0 END) AS moderate FROM (SELECT DISTINCT module, gene FROM v_module) JOIN l USING (gene) GROUP BY module, locus_id),
v AS (SELECT value, (SELECT count(*) FROM k WHERE locus_score >= value) / (SELECT count(*) FROM k) AS value_rank FROM (SELECT DISTINCT value FROM x)),
y AS (SELECT x.module, x.locus_id, x.value, moderate, rank_fraction, value_rank, greatest(x.value, 0) AS p, row_number() OVER (PARTITION BY module ORDER BY x.value DESC, x.locus_id) AS r FROM x JOIN o USING (locus_id) JOIN v ON v.value = x.value),
a AS (SELECT module, count(*) AS n_loci, sum(value) AS s, sum(p) AS p, sum(p * p) AS p2, sum(p) FILTER (r <= 1) AS p1, sum(p) FILTER (r <= 5) AS p5, 1 - avg(rank_fraction) AS membership_rank, 1 - avg(value_rank) AS specific_rank, sum(moderate) AS moderate,
  sum(value) FILTER (r > 1) AS l1, sum(value) FILTER (r > 3) AS l3, sum(value) FILTER (r > 5) AS l5 FROM y GROUP BY module),
b AS (SELECT *, CASE WHEN p > 0 THEN p * p / p2 ELSE 0 END AS n_effective, CASE WHEN p > 0 THEN p1 / p ELSE 1 END AS top1, CASE WHEN p > 0 THEN p5 / p ELSE 1 END AS top5, s / sqrt(n_loci) AS locus_robust FROM a),
c AS (SELECT *, locus_robust * least(1, n_effective / 5) * CASE WHEN top1 > 0 THEN least(1, 0.35 / top1) ELSE 1 END AS penalised FROM b)"""


def distributed_genes(t) -> DataFrame:
    return modules.pseudo_loci(scored_genes(t).withColumn("score", F.round(F.col("score") - 10, 6)), 4000)


@register(f"WITH {DISTRIBUTED} SELECT module, n_loci, round(n_effective, 6) AS n_effective, round(top1, 6) AS top1, round(top5, 6) AS top5, round(locus_robust, 6) AS locus_robust, round(p / sqrt(n_loci), 6) AS positive_locus, round(penalised, 6) AS penalised, round(penalised * CASE WHEN top5 > 0 THEN least(1, 0.7 / top5) ELSE 1 END, 6) AS penalised_top5, round(membership_rank, 6) AS membership_rank, round(specific_rank, 6) AS specific_rank, CAST(moderate AS DOUBLE) AS moderate, round(CASE WHEN n_loci > 1 THEN l1 / sqrt(n_loci - 1) END, 6) AS leave_top1, round(CASE WHEN n_loci > 3 THEN l3 / sqrt(n_loci - 3) END, 6) AS leave_top3, round(CASE WHEN n_loci > 5 THEN l5 / sqrt(n_loci - 5) END, 6) AS leave_top5 FROM c")
def module_locus_statistics(t):
    genes, sets = distributed_genes(t), t("v_module").distinct()
    background = distributed.match_background(genes, sets)
    loci = distributed.set_loci(genes, sets).join(background.select("locus_id", "rank_fraction"), "locus_id")
    return distributed.locus_statistics(distributed.share_at_least(loci, background))


def _bin(column: str, q: int) -> str:
    n = f"least({q}, n_loci)" if q > 10 else str(q)
    return f"CASE WHEN min({column}) OVER () = max({column}) OVER () THEN 0 ELSE greatest(0, ceil((row_number() OVER (ORDER BY {column}, locus_id) - 1) * {n} / (n_loci - 1)) - 1) END"


@register(f"""WITH {LOCI}, q AS (SELECT gene, count(*) AS n FROM (SELECT DISTINCT module, gene FROM v_module) GROUP BY gene),
a AS (SELECT locus_id, count(DISTINCT l.gene) AS n_genes, avg(degree) AS mean_degree, avg(coalesce(q.n, 0)) AS mean_sets FROM l LEFT JOIN q ON q.gene = l.gene GROUP BY locus_id), n AS (SELECT *, count(*) OVER () AS n_loci FROM a)
SELECT locus_id, n_genes, CAST({_bin("mean_degree", 10)} AS INT) AS degree_bin, CAST({_bin("mean_degree", 10)} AS INT) || '|' || CAST({_bin("n_genes", 4)} AS INT) || '|' || CAST({_bin("mean_sets", 4)} AS INT) || '|0|0' AS match_bin FROM n""")
def locus_match_bins(t):
    return distributed.match_background(distributed_genes(t), t("v_module")).select("locus_id", "n_genes", "degree_bin", "match_bin")


@register(f"""WITH {LOCI}, a AS (SELECT locus_id, min(chrom) AS chrom, count(DISTINCT gene) AS n, max(g_end) - min(g_start) AS span FROM l GROUP BY locus_id),
g AS (SELECT 'overall' AS audit_level, 'all' AS "group", n, span FROM a UNION ALL SELECT 'chromosome', chrom, n, span FROM a)
SELECT audit_level, "group", count(*) AS n_loci, round(quantile_cont(n, 0.5), 6) AS median_genes, round(quantile_cont(n, 0.9), 6) AS p90_genes, round(quantile_cont(n, 0.95), 6) AS p95_genes, max(n) AS max_genes, round(quantile_cont(span, 0.5), 6) AS median_span, round(quantile_cont(span, 0.95), 6) AS p95_span, max(span) AS max_span FROM g GROUP BY ALL""")
def locus_background_audit(t):
    return distributed.background_audit(distributed.match_background(distributed_genes(t), t("v_module")))


@register()
def distributed_module_tests(t):
    return distributed.distributed_tests(distributed_genes(t), t("v_module").distinct(), 10)[0]


FIXED = f"""e AS MATERIALIZED ({EDGE.format(agg='max')}), known AS (SELECT * FROM v_score WHERE gene IN (SELECT unnest([src, dst]) FROM e)), bins AS (SELECT gene, score, degree, CAST(greatest(0, ceil((r - 1) * 10 / (n - 1)) - 1) AS INT) AS bin, row_number() OVER (ORDER BY score DESC, gene) / n AS rank_fraction FROM (SELECT *, row_number() OVER (ORDER BY degree, gene) AS r, count(*) OVER () AS n FROM known)),
lib AS (SELECT module, gene FROM (SELECT module, gene, count(*) OVER (PARTITION BY module) AS n FROM (SELECT DISTINCT module, gene FROM v_module) JOIN (SELECT gene FROM known) USING (gene)) WHERE n >= 5), reps AS (SELECT unnest(range(0, 200))::INT AS replicate),
q AS (SELECT module, count(*) AS n_query, count(s.gene) AS n_present FROM (SELECT DISTINCT module, gene FROM v_module) m LEFT JOIN known s ON s.gene = m.gene GROUP BY module),
own AS (SELECT module, round(sum(score) / sqrt(count(*)), 9) AS observed, avg(score) AS mean_score, avg(rank_fraction) AS mean_rank_fraction, avg(degree) AS mean_degree FROM lib JOIN bins USING (gene) GROUP BY module),
top AS (SELECT module, avg(score) AS top20_mean FROM (SELECT module, score, row_number() OVER (PARTITION BY module ORDER BY score DESC, gene) AS r, count(*) OVER (PARTITION BY module) AS n FROM lib JOIN bins USING (gene)) WHERE r <= greatest(1, ceil(n * 0.2)) GROUP BY module),
near_m AS MATERIALIZED (SELECT a.module, e.src AS x, e.dst AS y FROM e JOIN lib a ON a.gene = e.src JOIN lib b ON b.gene = e.dst AND b.module = a.module UNION ALL SELECT a.module, e.dst, e.src FROM e JOIN lib a ON a.gene = e.src JOIN lib b ON b.gene = e.dst AND b.module = a.module),
lab_m(module, gene, root) USING KEY (module, gene) AS (SELECT module, gene, gene FROM lib UNION SELECT c.module, c.gene, c.root FROM (SELECT n.module, n.y AS gene, min(l.root) AS root FROM lab_m l JOIN near_m n ON n.module = l.module AND n.x = l.gene GROUP BY ALL) c JOIN recurring.lab_m o ON o.module = c.module AND o.gene = c.gene WHERE c.root < o.root),
big AS (SELECT module, max(n) AS largest_component FROM (SELECT module, root, count(*) AS n FROM lab_m GROUP BY ALL) GROUP BY module), inner_e AS (SELECT a.module, count(*) AS m FROM e JOIN lib a ON a.gene = e.src JOIN lib b ON b.gene = e.dst AND b.module = a.module GROUP BY 1),
sizes AS (SELECT bin, count(*) AS size FROM bins GROUP BY bin), prof AS (SELECT module, bin, count(*) AS n FROM lib JOIN bins USING (gene) GROUP BY module, bin),
placed AS (SELECT replicate, bin, gene, row_number() OVER (PARTITION BY replicate, bin ORDER BY {HASH.format('concat_ws(chr(45), 1, replicate, gene)')}, gene) - 1 AS place FROM bins, reps),
wanted AS (SELECT replicate, module, bin, size, unnest(range(0, n)) AS j FROM prof JOIN sizes USING (bin), reps),
smp AS (SELECT w.replicate, w.module, p.gene FROM wanted w JOIN placed p ON p.replicate = w.replicate AND p.bin = w.bin AND p.place = ({HASH.format('concat_ws(chr(45), 1, w.replicate, w.module, w.bin)')} + w.j) % w.size),
mn AS (SELECT replicate, module, round(sum(score) / sqrt(count(*)), 9) AS value, round(avg(rank_fraction), 9) AS rnk FROM smp JOIN bins USING (gene) GROUP BY replicate, module),
h AS (SELECT replicate, gene, bin, row_number() OVER (PARTITION BY replicate, bin ORDER BY gene) AS k FROM bins, reps), v AS (SELECT replicate, bin, score, row_number() OVER (PARTITION BY replicate, bin ORDER BY md5('1-' || replicate || '-' || gene), gene) AS k FROM bins, reps),
pn AS (SELECT replicate, module, round(sum(v.score) / sqrt(count(*)), 9) AS value FROM h JOIN v USING (replicate, bin, k) JOIN lib USING (gene) GROUP BY replicate, module), fam AS (SELECT replicate, max(value) AS top FROM pn GROUP BY replicate),
m1 AS (SELECT module, (count(*) FILTER (value >= observed) + 1) / (count(*) + 1) AS matched_p, (any_value(observed) - avg(value)) / stddev_samp(value) AS matched_z, avg(value) AS matched_mean, stddev_samp(value) AS matched_sd, (count(*) FILTER (rnk <= round(mean_rank_fraction, 9)) + 1) / (count(*) + 1) AS rank_p, -(any_value(round(mean_rank_fraction, 9)) - avg(rnk)) / stddev_samp(rnk) AS rank_z FROM mn JOIN own USING (module) GROUP BY module),
m2 AS (SELECT module, (count(*) FILTER (value >= observed) + 1) / (count(*) + 1) AS permuted_p, (any_value(observed) - avg(value)) / stddev_samp(value) AS permuted_z, avg(value) AS permuted_mean, stddev_samp(value) AS permuted_sd FROM pn JOIN own USING (module) GROUP BY module),
m3 AS (SELECT module, (count(*) FILTER (top >= observed) + 1) / (count(*) + 1) AS family_p FROM own, fam GROUP BY module)"""


FIXED += ", ranked AS (SELECT *, count(*) OVER () AS n_all, " + ", ".join(f"count(*) OVER (ORDER BY {c}_p RANGE UNBOUNDED PRECEDING) AS {c}_k" for c in ("matched", "permuted", "family"))
FIXED += " FROM own JOIN top USING (module) LEFT JOIN inner_e USING (module) JOIN big USING (module) JOIN m1 USING (module) JOIN m2 USING (module) JOIN m3 USING (module)), "
FIXED += "fdr AS (SELECT module, " + ", ".join(f"round(least(1, min({c}_p * n_all / {c}_k) OVER (ORDER BY {c}_p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS {c}_fdr" for c in ("matched", "permuted", "family")) + " FROM ranked)"


@register(f"""WITH RECURSIVE {FIXED} SELECT module, n_query, n_present, round(observed, 6) AS observed, round(mean_score, 6) AS mean_score, round(mean_rank_fraction, 6) AS mean_rank_fraction, round(mean_degree, 6) AS mean_degree, round(top20_mean, 6) AS top20_mean,
CASE WHEN observed IS NOT NULL THEN coalesce(m, 0) END AS n_edges, CASE WHEN observed IS NOT NULL THEN round(2.0 * coalesce(m, 0) / (n_present * (n_present - 1)), 6) END AS density, round(matched_p, 6) AS matched_p, round(matched_z, 6) AS matched_z, round(matched_mean, 6) AS matched_mean, round(matched_sd, 6) AS matched_sd, largest_component, round(rank_p, 6) AS rank_p, round(rank_z, 6) AS rank_z,
round(permuted_p, 6) AS permuted_p, round(permuted_z, 6) AS permuted_z, round(permuted_mean, 6) AS permuted_mean, round(permuted_sd, 6) AS permuted_sd, round(family_p, 6) AS family_p, matched_fdr, permuted_fdr, family_fdr,
CASE WHEN observed IS NULL THEN 'not_tested_low_overlap' WHEN matched_p <= 0.05 AND family_p <= 0.05 THEN 'familywise_supported' WHEN matched_p <= 0.05 THEN 'degree_supported' ELSE 'negative' END AS status FROM q LEFT JOIN ranked USING (module) LEFT JOIN fdr USING (module)""")
def fixed_library_tests(t):
    return distributed.library_tests(t("v_module"), t("v_score"), edges(t), 200)


from . import formats, scores, searches  # noqa: E402, F401  register their queries
