import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociform.functions import scalars, special
from lociform.operators import claims, graph, ld, modules, percolation, qc, relational
from lociform.operators.components import components
from lociform.sources import tables
from lociform.storage import Scratch


def test_normal_tails_invert():
    for p in (1e-300, 1e-100, 1e-12, 1e-3, 0.3, 0.5, 0.9):
        z = special.normal_isf(p)
        assert special.normal_sf(z) == pytest.approx(p, rel=1e-9)


def test_chi_square_closed_forms():
    assert special.chi2_sf(3.0, 2) == pytest.approx(math.exp(-1.5), rel=1e-12)
    assert special.chi2_sf(4.0, 1) == pytest.approx(2 * special.normal_sf(2), rel=1e-10)
    # a shifted normal square
    nc = 2.25
    want = special.normal_sf(2 - 1.5) + special.normal_sf(2 + 1.5)
    assert special.ncx2_sf(4.0, 1, nc) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("method", ["liu", "satterthwaite", "saddlepoint"])
def test_mixture_of_equal_weights_is_chi_square(method):
    assert special.mixture_sf(9.0, [1.5] * 4, method) == pytest.approx(special.chi2_sf(6.0, 4), rel=0.02)
    assert math.isnan(special.mixture_sf(1.0, [], method))


def test_hypergeometric_and_wilson():
    assert special.hypergeometric_sf(0, 10, 4, 3) == pytest.approx(1)
    assert special.hypergeometric_sf(3, 10, 4, 3) == pytest.approx(4 / 120)
    lo, hi = special.wilson(17, 100)
    assert (round(lo, 3), round(hi, 3)) == (0.109, 0.255)


def test_components_of_path_and_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[i] for i in range(31)} == {0} and {got[100 + i] for i in range(20)} == {100}


def test_percolation_counts(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0)], "src long, dst long, weight double")
    scores = spark.createDataFrame([(i, float(-i)) for i in range(1, 7)], "node long, score double")
    got = {r["rank_fraction"]: r for r in percolation.percolation_curve(edges, scores, [0.5, 0.75]).collect()}
    assert (got[0.5]["n_components"], got[0.5]["largest_component_size"]) == (1, 3)
    assert (got[0.75]["n_components"], got[0.75]["n_selected"]) == (2, 4)


def test_heat_diffusion_matches_eigenvectors(spark):
    rng = np.random.default_rng(3)
    i, j = np.array([0, 1, 2, 3, 0]), np.array([1, 2, 3, 4, 2])
    w, s = rng.random(5) + 0.5, rng.normal(size=6)  # node 5 is isolated
    a = np.zeros((6, 6))
    a[i, j] = a[j, i] = w
    d = a.sum(1)
    inv = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    lap = np.diag((d > 0).astype(float)) - inv[:, None] * a * inv
    values, vectors = np.linalg.eigh(lap)
    edges = spark.createDataFrame([(int(a), int(b), float(x)) for a, b, x in zip(i, j, w, strict=True)], "src long, dst long, weight double")
    vs = [s, s**2 - 1, np.ones(6)]
    rows = [(r, v, float(x[v])) for r, x in enumerate(vs) for v in range(6) if not (r == 1 and v == 4)]
    got = {(r["replicate"], r["tau"]): r["value"] for r in percolation.heat_diffusion(edges, spark.createDataFrame(rows, "replicate int, node long, score double"), (0.25, 4.0), block=2).collect()}
    for r, x in enumerate(vs):
        x = np.where(np.arange(6) == 5, 0, x)  # the isolated node is outside the graph
        x = np.where((r == 1) & (np.arange(6) == 4), 0, x)
        for tau in (0.25, 4.0):
            assert got[r, tau] == pytest.approx((vectors.T @ x) ** 2 @ np.exp(-tau * values) / (x @ x), rel=1e-8)


def test_harmonize(spark):
    df = spark.createDataFrame(
        [("rs1", "a", "g", 0.2, 0.1, 0.01, 0.2), ("rs2", "G", "A", 0.2, 0.1, 0.01, 0.2), ("rs3", "A", "T", 0.2, 0.1, 0.01, 0.45), ("rs9", "A", "C", 0.2, 0.1, 0.01, 0.2)],
        "snp_id string, effect_allele string, other_allele string, beta double, se double, p double, eaf double",
    )
    ref = spark.createDataFrame([("rs1", "6", 26_000_000, "A", "G"), ("rs2", "1", 5, "A", "G"), ("rs3", "1", 6, "A", "T")], "snp_id string, chrom_ref string, pos_ref long, ref_a1 string, ref_a2 string")
    got = {r["snp_id"]: r for r in qc.harmonize_to_reference(df, ref).collect()}
    assert got["rs1"]["qc_pass"] and got["rs1"]["in_mhc"] and got["rs1"]["z"] == pytest.approx(2)
    assert got["rs2"]["beta"] == -0.2 and got["rs2"]["eaf"] == pytest.approx(0.8)
    assert (got["rs2"]["effect_allele"], got["rs2"]["other_allele"], got["rs2"]["source_effect_allele"]) == ("A", "G", "G")
    odd = [("b1", "A", "G", 0.1, 0.1, 0.5, 1.5, 0.9), ("b2", "A", "G", 0.1, 0.0, 2.0, 0.2, None), ("b2", "AT", "G", None, 0.1, 0.0, 0.2, 0.9), ("x1", "A", "G", 0.1, 0.1, 0.5, None, 0.9)]
    odd = spark.createDataFrame(odd, "snp_id string, effect_allele string, other_allele string, beta double, se double, p double, eaf double, info double")
    at = spark.createDataFrame([(i, c, 1, "A", "G") for i, c in (("b1", "1"), ("b2", "2"), ("x1", "X"))], "snp_id string, chrom_ref string, pos_ref long, ref_a1 string, ref_a2 string")
    made = [(r["qc_fail_reason"], r["repeated_id"], r["p_was_clipped"]) for r in qc.harmonize_to_reference(odd, at).orderBy("snp_id", F.desc("p")).collect()]
    assert made == [
        ("invalid_eaf;low_maf", False, False), ("invalid_p;invalid_se;low_or_missing_info", True, False),
        ("invalid_beta;non_snp_or_non_acgt", True, True), ("invalid_eaf;low_maf;non_autosome", False, False),
    ]
    assert got["rs3"]["qc_fail_reason"] == "ambiguous_palindrome" and got["rs9"]["qc_fail_reason"] == "not_in_reference"


def test_signed_z_sources(spark):
    one = lambda schema, row: qc.harmonize_table(spark.createDataFrame([row], "snp_id string, n int, " + schema), "n").first()
    assert one("beta double, se double", ("a", 1, 0.2, 0.1))["z"] == pytest.approx(2)
    assert one("p double, beta double", ("a", 1, 0.05, -0.1))["z"] == pytest.approx(-1.959964, rel=1e-6)
    r = one("p double", ("a", 1, 0.5))
    assert r["z"] is None and not r["signed_available"] and r["z_source"] == "unavailable"


def test_islands_fixture(spark):
    genes = spark.createDataFrame([("A", "1", 1000, 1200), ("B", "1", 1800, 2000), ("C", "1", 10000, 10200), ("D", None, None, None)], "gene string, chrom string, g_start long, g_end long")
    got = {r["gene"]: r["locus_id"] for r in modules.pseudo_loci(genes, 500).collect()}
    assert got == {"A": "chr1:L00001", "B": "chr1:L00001", "C": "chr1:L00002", "D": "UNMAPPED:D"}


def test_edges_fixture(spark):
    e = spark.createDataFrame([("B", "A", 0.2), ("A", "B", 0.8), ("A", "A", 1.0), ("C", "D", 0.5)], "a string, b string, weight double")
    assert {tuple(r) for r in graph.canonical_edges(e).collect()} == {("A", "B", 0.8), ("C", "D", 0.5)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert graph.degrees(none).count() == 0 and components(none.select(F.col("src").alias("a"), F.col("dst").alias("b"))).count() == 0
    assert relational.bh_fdr(spark.createDataFrame([], "p double"), "p").count() == 0


def test_claims(spark):
    z = spark.createDataFrame([(2.6,), (2.1,), (0.0,), (None,), (float("nan"),)], "z double")
    assert [r[0] for r in z.select(claims.z_claim(F.col("z"))).collect()] == ["final_positive", "supportive", "negative", "not_tested", "not_tested"]


def test_identifiers(spark):
    d = spark.createDataFrame([("rs1, rs2;.;None", " chr7 ")], "i string, c string")
    r = d.select(scalars.split_ids(F.col("i")).alias("i"), scalars.chromosome(F.col("c")).alias("c")).first()
    assert r["i"] == ["rs1", "rs2"] and r["c"] == "7"


def test_sources(spark, tmp_path):
    (tmp_path / "a.bim").write_text("1 rs1 0 100 A G\n1\trs2\t0\tx\tC\tT\n")
    assert [(r["snp_id"], r["pos"]) for r in tables.read_variants_bim(spark, str(tmp_path / "a.bim")).collect()] == [("rs1", 100), ("rs2", None)]
    (tmp_path / "s.gmt").write_text("m1\tx\tA\tB\nm2\ty\tC\n")
    assert tables.read_gene_sets(spark, str(tmp_path / "s.gmt")).count() == 3
    (tmp_path / "t.tsv").write_text("snp\tp\nrs1\t0.5\n")
    assert tables.read_delimited(spark, str(tmp_path / "t.tsv")).first()["p"] == "0.5"
    (tmp_path / "o.obo").write_text("format\n\n[Term]\nid: GO:1\nname: a\nnamespace: p\n\n[Term]\nid: GO:2\nname: b\nis_a: GO:1 ! a\n")
    got = {r["term"]: list(r["parents"]) for r in tables.read_ontology(spark, str(tmp_path / "o.obo")).collect()}
    assert got == {"GO:1": [], "GO:2": ["GO:1"]}


def test_protein_links(spark, tmp_path):
    (tmp_path / "l.txt").write_text("protein1 protein2 combined_score\nP1 P2 700\nP2 P1 900\nP1 P3 300\nP2 P4 950\nP1 P5 800\n")
    (tmp_path / "i.tsv").write_text("#string_protein_id\tpreferred_name\nP1\tA\nP2\tB\nP3\tC\nP5\tA\n")
    (tmp_path / "a.tsv").write_text("#string_protein_id\talias\tsource\nP1\tx\tS\nP1\ty\tT\n")
    genes = graph.protein_genes(tables.read_protein_info(spark, str(tmp_path / "i.tsv")))
    edges = lambda least: {tuple(r) for r in graph.gene_links(tables.read_protein_links(spark, str(tmp_path / "l.txt"), least), genes).collect()}
    assert edges(400) == {("A", "B", 900.0)} and edges(None) == {("A", "B", 900.0), ("A", "C", 300.0)}
    assert [r["alias"] for r in tables.read_protein_aliases(spark, str(tmp_path / "a.tsv"), ["T"]).collect()] == ["y"]


def test_descendants(spark):
    terms = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["b", "z"]), ("d", ["c", "a"]), ("e", ["d"])], "term string, parents array<string>")
    got = {tuple(r) for r in graph.descendants(terms).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("b", "c"), ("b", "d"), ("b", "e"), ("c", "d"), ("c", "e"), ("d", "e")}


def test_spectrum_energy(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    s = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, -1.0)], "node long, score double")
    got = percolation.spectrum(e, s).toPandas().sort_values("eigenvalue")
    assert isinstance(got, pd.DataFrame) and got["energy"].sum() == pytest.approx(2.0) and got["eigenvalue"].tolist() == pytest.approx([0, 1, 2], abs=1e-9)


@pytest.mark.parametrize("method", ["liu", "satterthwaite"])
def test_gene_tests_without_correlation_start_no_group(spark, method):
    rng = np.random.default_rng(4)
    rows = [(g, s, float(rng.normal()), float(rng.normal())) for g in range(6) for s in range(1 if g == 0 else 3 + 5 * g)] + [(7, 0, 0.0, 1.0), (8, 0, 0.5, None), (8, 1, 0.5, 1.0)]
    members = spark.createDataFrame(rows, "gene_id long, snp_id long, weight double, z double")
    out = ld.gene_tests(members, method=method)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    got = {r["gene_id"]: r for r in out.collect()}
    for g in range(6):
        w, z = np.array([(r[2], r[3]) for r in rows if r[0] == g]).T
        p = special.mixture_sf(float(w**2 @ z**2), w**2, method)
        assert got[g]["n_snps"] == len(w) and np.allclose([got[g]["q"], got[g]["signed_score"], got[g]["p"], got[g]["normal_score"]], [w**2 @ z**2, w @ z / (w @ w) ** 0.5, p, special.normal_isf(p)], atol=1e-6)
    assert got[7]["signed_score"] is None and np.isnan(got[7]["p"]) and np.isnan(got[8]["p"]) and np.isnan(got[8]["normal_score"])


def test_dense_components_are_few_links_before_the_first_round(spark):
    class Seen(Scratch):
        def keep(self, df, name):
            out = super().keep(df, name)
            if name == "edges-0":
                first.append(out.count())
            return out

    rng, first = np.random.default_rng(6), []
    links = [(int(a), int(b)) for k in (0, 100, 200) for a, b in k + rng.choice(80, (1500, 2))] + [(300 + k, 301 + k) for k in range(9)] + [(400, 401)] * 3
    want = {}
    for _ in range(12):
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want.get(a, a), want.get(b, b))
    frame = spark.createDataFrame(links, "a long, b long").repartition(3)
    assert {r["node"]: r["root"] for r in components(frame, Seen(spark, "dense"), dense=True).collect()} == want
    assert first[0] < 3 * len(want) < frame.distinct().count() / 3
