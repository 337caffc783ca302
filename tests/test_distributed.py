"""Tests of distributed modules: draws keep their rules, and p-values follow from the draws returned."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociform.operators import distributed as D
from lociform.operators.nulls import bin_profile, matched_sample
from lociform.operators.relational import hash_permute
from lociform.storage import Scratch


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(1)
    rows = [(f"G{i:03d}", f"L{i // 2:03d}", "1", i * 1000, i * 1000 + 900, float(x), int(i % 7), 1.0, 1.0) for i, x in enumerate(rng.normal(0, 0.5, 160))]
    rows = [(*r[:5], 2.5 if i < 40 and i % 4 == 0 else 9.0 if i == 81 else r[5], *r[6:]) for i, r in enumerate(rows)]
    genes = spark.createDataFrame(rows, "gene string, locus_id string, chrom string, g_start long, g_end long, score double, degree int, n_snps double, local_ld_score double")
    sets = [("spread", f"G{i:03d}") for i in range(0, 40, 4)] + [("single", f"G{i:03d}") for i in (81, 90, 100, 111, 121, 130)] + [("small", "G001"), ("spread", "absent")]
    results, nulls = D.distributed_tests(genes, spark.createDataFrame(sets, "module string, gene string"), 20)
    return genes, {r["module"]: r for r in results.collect()}, nulls.toPandas()


def test_results(case):
    _, got, nulls = case
    assert got["small"]["label"] == "not_tested_low_overlap" and got["small"]["locus_robust_p"] is None
    assert got["spread"]["n_present"] == 10 and got["spread"]["n_query"] == 11 and got["spread"]["locus_robust_p"] < 0.1 and got["spread"]["top1"] == pytest.approx(0.1)
    assert got["single"]["top1"] > 0.35 and got["single"]["label"] not in ("distributed_weak_signal_module_candidate", "mixed_sparse_distributed_candidate")
    for module in ("spread", "single"):
        for s in D.STATISTICS:
            v = nulls[(nulls["module"] == module) & (nulls["statistic"] == s) & (nulls["null_type"] == "matched_loci")]["value"]
            if got[module][s] is not None and len(v):
                assert got[module][f"{s}_p"] == pytest.approx(((v >= got[module][s]).sum() + 1) / (len(v) + 1))


def test_draws(spark, case):
    genes, _, _ = case
    background = D.match_background(genes, spark.createDataFrame([("m", "G000")], "module string, gene string"))
    pool = background.select("locus_id", "n_genes", "match_bin", "degree_bin")
    slots = pool.limit(12).select(F.lit("m").alias("module"), F.col("locus_id").alias("slot"), F.lit(1).cast("long").alias("need"), "match_bin", "degree_bin")
    slots = spark.createDataFrame(slots.collect(), slots.schema)
    draws = D.matched_loci(slots, pool, 5, Scratch(spark, "test"), "t").toPandas()
    bins = {r["locus_id"]: r for r in pool.collect()}
    own = {r["slot"] for r in slots.collect()}
    assert len(draws) == 5 * 12 and not draws.duplicated(["replicate", "drawn"]).any() and not set(draws["drawn"]) & own
    for r in draws.itertuples():
        assert r.level != "exact" or bins[r.slot]["match_bin"] == bins[r.drawn]["match_bin"]
        assert r.level != "degree" or bins[r.slot]["degree_bin"] == bins[r.drawn]["degree_bin"]


def test_small_tables(spark, case):
    genes, _, _ = case
    few = genes.limit(0)
    assert D.match_background(few, spark.createDataFrame([], "module string, gene string")).count() == 0
    ranked = {r["gene"]: r for r in D.score_columns(genes).collect()}
    assert ranked["G081"]["capped"] == 3.0 and ranked["G081"]["rank_fraction"] == pytest.approx(1 / 160)


def test_draws_stay_in_their_bin(spark):
    """A locus of three genes whose match bin holds two-gene loci draws there, and says that genes are drawn with replacement."""
    pool = [(f"A{i}", 2, "near", 0) for i in range(10)] + [(f"B{i}", 4, "far", 0) for i in range(10)] + [("own", 3, "near", 0)]
    pool = spark.createDataFrame(pool, "locus_id string, n_genes long, match_bin string, degree_bin int")
    slots = spark.createDataFrame([("m", "own", 3, "near", 0)], "module string, slot string, need long, match_bin string, degree_bin int")
    draws = D.matched_loci(slots, pool, 20, Scratch(spark, "test"), "t").toPandas()
    assert len(draws) == 20 and set(draws["level"]) == {"exact"} and all(x.startswith("A") for x in draws["drawn"]) and set(draws["need"]) == {3}
    # with only two free loci in the bin, three slots take them both and one of the degree bin
    few = pool.where("locus_id in ('A0', 'A1', 'own', 'B0', 'B1')")
    slots = spark.createDataFrame([("m", f"own{i}", 3, "near", 0) for i in range(3)], slots.schema)
    levels = D.matched_loci(slots, few.where("locus_id <> 'own'"), 5, Scratch(spark, "test"), "u").toPandas()
    assert (levels.groupby("replicate")["level"].apply(sorted).apply(tuple) == ("degree", "exact", "exact")).all()


def test_a_level_is_one_step(spark, monkeypatch):
    """Slots with genes enough and those that take any locus are dealt together; an earlier slot has a locus that two needs meet in."""
    kept = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: kept.append(name) or keep(self, df, name))
    pool = spark.createDataFrame([(f"A{i}", i % 4 + 1, "near", 0) for i in range(12)], "locus_id string, n_genes long, match_bin string, degree_bin int")
    slots = spark.createDataFrame([("m", f"A{i}", i % 4 + 1, "near", 0) for i in (0, 3, 5, 7, 11)], "module string, slot string, need long, match_bin string, degree_bin int")
    draws = D.matched_loci(slots, pool, 8, Scratch(spark, "test"), "t").toPandas()
    assert len(kept) == 8 and len(draws) == 40 and not draws.duplicated(["replicate", "drawn"]).any() and not set(draws["drawn"]) & {"A0", "A3", "A5", "A7", "A11"}
    assert set(draws["level"]) == {"exact"}
    sizes = {f"A{i}": i % 4 + 1 for i in range(12)}
    # no locus of four genes is free, all slots of need one and two find enough
    assert (draws["drawn"].map(sizes) >= draws["need"])[draws["need"] <= 2].all()


def test_genes_of_a_locus_are_drawn_uniformly(spark):
    genes = spark.createDataFrame([("L4", g, s) for g, s in zip("abcd", (0.0, 0.0, 2.0, 2.0), strict=True)] + [("L2", "e", 0.0), ("L2", "f", 2.0)], "locus_id string, gene string, score double")
    draws = spark.range(3000).select(F.col("id").alias("replicate"), F.lit("m").alias("module"), F.lit("s").alias("slot"), F.lit("exact").alias("level"), F.lit(1).alias("pool_size"))
    share = lambda locus, need: D.subset_scores(draws.withColumns({"drawn": F.lit(locus), "need": F.lit(need).cast("long")}), genes, D.DistributedConfig()).agg(F.avg((F.col("value") == 2).cast("int")), F.count("*")).first()
    two, three = share("L4", 2), share("L2", 3)
    assert two[1] == three[1] == 3000 and two[0] == pytest.approx(5 / 6, abs=0.03) and three[0] == pytest.approx(7 / 8, abs=0.03)
    assert share("L4", 4)[0] == 1.0 and share("L4", 1)[0] == pytest.approx(0.5, abs=0.03)


def test_library_keeps_to_the_graph(spark):
    """A set of genes outside the graph is not tested, and others do not take them into their background."""
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{(i + 1) % 30:02d}", 1.0) for i in range(30)], "src string, dst string, weight double")
    edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    rng = np.random.default_rng(5)
    scores = spark.createDataFrame([(f"n{i:02d}", float(rng.normal()), 2) for i in range(30)] + [(f"x{i}", 9.0, 0) for i in range(10)], "gene string, score double, degree int")
    sets = [("outside", f"x{i}") for i in range(10)] + [("inside", f"n{i:02d}") for i in (0, 1, 2, 9, 10, 20)] + [("inside", "x1")]
    got = {r["module"]: r for r in D.library_tests(spark.createDataFrame(sets, "module string, gene string"), scores, edges, 8).collect()}
    assert got["outside"]["n_present"] == 0 and got["outside"]["status"] == "not_tested_low_overlap" and got["outside"]["observed"] is None
    assert got["inside"]["n_present"] == 6 and got["inside"]["n_query"] == 7 and got["inside"]["largest_component"] == 3 and got["inside"]["n_edges"] == 3
    assert abs(got["inside"]["matched_mean"]) < 3 and got["inside"]["matched_sd"] > 0  # scores of nine are in no draw


def test_each_fdr_does_not_repeat_the_tests(spark):
    """The plan of the library's result reads the written tests, not all that led to them once for each use."""
    edges = spark.createDataFrame([(v, (v * 7 + 3) % 60) for v in range(60) if v != (v * 7 + 3) % 60], "src long, dst long")
    scores = spark.range(60).select(F.col("id").alias("gene"), (F.col("id") % 11).cast("double").alias("score"), (F.col("id") % 5).alias("degree"))
    sets = spark.range(60).select(F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("module"), F.col("id").alias("gene"))
    out = D.library_tests(sets, scores, edges, 3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 10
    assert out.count() == 3


def test_library_nulls_are_those_of_single_draws(spark):
    """The slices of a bin's order are the rows that matched_sample and hash_permute draw."""
    genes = spark.range(90).select(F.col("id").alias("gene"), (F.col("id") * 7 % 11).cast("double").alias("score"), (F.col("id") / 90).alias("rank_fraction"), (F.col("id") % 3).cast("int").alias("bin"))
    members = genes.select(F.concat(F.lit("m"), (F.col("gene") % 4).cast("string")).alias("module"), "gene").where("gene % 5 < 3")
    got = {(r.replicate, r.module): r for r in D._library_nulls(genes, members, 13, 1).collect()}
    root = F.sqrt(F.count("*").cast("double"))
    drawn = matched_sample(genes, bin_profile(members, genes), 13).join(genes.select("gene", "score", "rank_fraction"), "gene")
    drawn = drawn.groupBy("replicate", "module").agg((F.sum("score") / root).alias("value"), F.avg("rank_fraction").alias("rank")).collect()
    dealt = hash_permute(genes, "score", "gene", ["bin"], 13).join(members, "gene").groupBy("replicate", "module").agg((F.sum("score") / root).alias("value")).collect()
    assert len(got) == len(drawn) == len(dealt) == 13 * 4
    assert all(got[r.replicate, r.module].value == pytest.approx(r.value) and got[r.replicate, r.module].rank == pytest.approx(r["rank"]) for r in drawn)
    assert all(got[r.replicate, r.module].dealt == pytest.approx(r.value) for r in dealt)


def test_library_query_can_support_a_set(monkeypatch):
    """With the query's replicates the least p lies under the 0.05 of its status."""
    from lociform.plans import catalogue

    taken = []
    monkeypatch.setattr(catalogue.distributed, "library_tests", lambda sets, scores, edges, replicates: taken.append(replicates))
    monkeypatch.setattr(catalogue, "edges", lambda t: None)
    catalogue.fixed_library_tests(lambda name: None)
    assert 1 / (taken[0] + 1) <= 0.05 and f"range(0, {taken[0]})" in catalogue.FIXED
