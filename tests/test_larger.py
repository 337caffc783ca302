"""Faults that only larger tables show: several files of a format, long sets, large batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lociform.operators import scoring
from lociform.sources import tables


def test_ontology_in_several_files(spark, tmp_path):
    block = F.concat(F.lit("[Term]\nid: T"), F.col("id").cast("string"), F.lit("\nname: n\nis_a: T0\n"))
    path = str(tmp_path / "terms")
    spark.range(1, 31, numPartitions=5).select(block.alias("value")).write.text(path)
    assert sorted(int(r.term[1:]) for r in tables.read_ontology(spark, path).collect()) == list(range(1, 31))


def test_gene_sets_split_a_line_once(spark, tmp_path):
    path = str(tmp_path / "sets.gmt")
    spark.createDataFrame([("m\tabout\ta\tb\t\tb",), ("short\tx",)], "value string").write.text(path)
    read = tables.read_gene_sets(spark, path)
    assert sorted(map(tuple, read.collect())) == [("m", "about", "a"), ("m", "about", "b")]
    above = read._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "split(" not in above


def test_payload_kernels_hold_few_genes(spark):
    batch = pa.RecordBatch.from_pydict({"gene_id": list(range(1000))})
    assert max(b.num_rows for b in scoring._slices([batch])) <= 16
    assert sum(b.num_rows for b in scoring._slices([batch])) == 1000


def test_panel_payloads_equal_those_of_pairs(spark):
    rng = np.random.default_rng(3)
    mapping = spark.createDataFrame([(int(g), int(s), float(rng.uniform(-1, 1))) for g in range(6) for s in rng.choice(40, 1 + 4 * g, replace=False)], "gene_id long, snp_id long, weight double")
    table = np.corrcoef(rng.normal(size=(4, 30)))
    panel = spark.createDataFrame([(i, j, float(table[i, j])) for i in range(4) for j in range(i, 4)], "snp_i int, snp_j int, r double")
    snps = mapping.select("snp_id").distinct()
    pairs = spark.createDataFrame([(a, b, 1.0 if a % 4 == b % 4 else float(table[a % 4, b % 4])) for a in range(40) for b in range(a + 1, 40)], "snp_i long, snp_j long, r double")
    known = mapping.where("gene_id % 2 = 0")
    want = {r.gene_id: r for r in scoring.ld_payloads(mapping, scoring.ld_entries(pairs, known, max_snps=9), snps).collect()}
    got = {r.gene_id: r for r in scoring.panel_payloads(mapping, panel, F.col("gene_id") % 2 == 0, 4, max_snps=9).collect()}
    assert got.keys() == want.keys()
    for g, x in got.items():
        y = want[g]
        assert (x.snp_ids, x.weights, x.ld_status) == (y.snp_ids, y.weights, y.ld_status)
        assert np.allclose([x.denominator_variance, x.m_eff, x.local_ld_score, *x.lambdas], [y.denominator_variance, y.m_eff, y.local_ld_score, *y.lambdas])
    plan = scoring.panel_payloads(mapping, panel, F.lit(True), 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_panel_payloads_of_a_gene_of_any_size(spark):
    """A gene of more variants than a matrix of pairs may have is computed as any other."""
    rng = np.random.default_rng(4)
    n = scoring.MAX_SNPS + 200
    weights = rng.choice([1.0, 0.5, -0.5, 1 / 3], n)
    mapping = spark.createDataFrame([(0, s, float(weights[s])) for s in range(n)], "gene_id long, snp_id long, weight double")
    table = np.corrcoef(rng.normal(size=(4, 30)))
    panel = spark.createDataFrame([(i, j, float(table[i, j])) for i in range(4) for j in range(i, 4)], "snp_i int, snp_j int, r double")
    got = scoring.panel_payloads(mapping, panel, F.lit(True), 4).first()
    at = np.arange(n) % 4
    want = scoring._payload(0, list(range(n)), weights, table[np.ix_(at, at)], 0.05, n**2 / (table[np.ix_(at, at)] ** 2).sum(), 0.0, "computed")
    assert got.ld_status == "computed" and len(got.lambdas) == len(want[4]) == n
    assert np.allclose(got.lambdas, want[4]) and np.allclose([got.denominator_variance, got.m_eff], [want[3], want[5]])


def test_residuals_run_their_inputs_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(g, float(g % 3), float(g * g % 7)) for g in range(20)], "gene_id long, x double, score double").coalesce(1)
    once = rows.mapInArrow(count, rows.schema)
    want = scoring.residual_from_scores(rows, ["x"]).orderBy("gene_id").collect()
    assert scoring.residual_from_scores(once, ["x"]).orderBy("gene_id").collect() == want and runs.value == 20
    nulls = spark.range(3).selectExpr("cast(id as int) as replicate").crossJoin(rows).selectExpr("replicate", "gene_id", "score + replicate * x as score").coalesce(1)
    runs.value = 0
    scoring.residual_from_null(rows, nulls.mapInArrow(count, nulls.schema), ["x"]).collect()
    assert runs.value == 60


def test_descendants_where_keys_have_gaps(spark, tmp_path):
    """Shifted copies leave gaps between the keys of parts; SQL counts a parent that has no row, unless its number ends in 0."""
    import duckdb

    from lociform.plans import catalogue, formats  # noqa: F401

    keys = [*range(30), *range(50, 80)]
    spark.createDataFrame([(k, "B") for k in keys], "p_partkey long, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, catalogue.queries()["ontology_descendants"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(db.execute(catalogue.oracle_sql()["ontology_descendants"]).fetchall())
    assert ("T35", "T71") in got
