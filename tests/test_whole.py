"""Registered queries over all of their input: against their DuckDB text with its cuts taken out, or brute force."""

import duckdb
import pandas as pd
import pytest
from test_catalogue import SF, TABLES, rows, same

from lociform.plans import catalogue

CUTS = (" WHERE weight >= 120", " WHERE weight >= 60", " WHERE x % 25 = 0", " WHERE module LIKE 'Brand%'")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def compare(spark, db, name: str) -> None:
    sql = catalogue.oracle_sql()[name]
    for cut in CUTS:
        sql = sql.replace(cut, "")
    got, want = catalogue.queries()[name](spark, SF).toPandas(), db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    wrong = [(x, y) for x, y in zip(rows(got), rows(want), strict=True) if not same(x, y)]
    assert not wrong, wrong[:2]


def pairs(db) -> pd.DataFrame:
    made = db.sql("SELECT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey").df()
    return pd.DataFrame({"src": made.min(axis=1), "dst": made.max(axis=1)}).drop_duplicates()


@pytest.mark.parametrize("name", ["component_table", "induced_density_curve"])
def test_all_edges(spark, db, name):
    compare(spark, db, name)


def test_searches_take_all_edges(spark, db):
    e = pairs(db)
    run = lambda name: catalogue.queries()[name](spark, SF).toPandas()
    out = run("degree_preserving_rewiring")
    assert set(out.groupby("replicate").size()) == {len(e)}
    top = run("percolation_curve").set_index("rank_fraction")["n_selected"]
    score = db.sql("SELECT l_partkey AS gene, sum(l_extendedprice * (1 - l_discount)) AS s FROM lineitem GROUP BY 1 ORDER BY s DESC").df()["gene"]
    linked = set(e["src"]) | set(e["dst"])
    for f in (0.05, 0.1, 0.2):
        assert top[f] == len(linked.intersection(score[: round(len(score) * f)]))
    assert set(run("louvain_communities")["node"]) == linked


@pytest.mark.parametrize("name", ["neighbourhood_layers", "diffusion_neighbourhoods", "annulus_contrast"])
def test_all_seeds(spark, db, name):
    compare(spark, db, name)


def grow_by_hand(near, score, seed, size):
    """The nodes that one seed takes: positive sum over root n plus density, while it rises."""
    have, total, inner, best = [seed], max(score[seed], 0.0), 0, max(score[seed], 0.0)
    links = dict.fromkeys(near[seed], 1)
    while links and len(have) < size:
        n = len(have) + 1
        stat, _, u = max(((total + max(score[v], 0.0)) / n**0.5 + 2 * (inner + k) / (n * (n - 1)), score[v], v) for v, k in links.items())
        if stat <= best:
            break
        best, total, inner = stat, total + max(score[u], 0.0), inner + links.pop(u)
        have.append(u)
        for v in near[u] - set(have):
            links[v] = links.get(v, 0) + 1
    return have


def test_greedy_modules_grow_from_all_nodes(spark, db):
    e = pairs(db)
    out = catalogue.queries()["greedy_dense_modules"](spark, SF).toPandas()
    assert set(out["seed"]) == set(e["src"]) | set(e["dst"])
    names = sorted(set(out["seed"]))
    near = [set() for _ in names]
    at = {v: k for k, v in enumerate(names)}
    for a, b in zip(e["src"], e["dst"], strict=True):
        near[at[a]].add(at[b])
        near[at[b]].add(at[a])
    s = db.sql("SELECT l_partkey AS gene, round(sum(l_extendedprice * (1 - l_discount)) / 100000.0, 6) AS s FROM lineitem GROUP BY 1").df().set_index("gene")["s"]
    score = s.loc[names].to_numpy(float)
    for seed, part in out.groupby("seed"):
        assert set(part["node"]) == {names[k] for k in grow_by_hand(near, score, at[seed], 20)}


def test_ld_takes_the_whole_embedding(spark, db):
    import numpy as np

    x = np.stack(db.sql("SELECT embedding FROM embeddings").df()["embedding"]).astype(float)
    want = np.corrcoef(x.T)
    got = catalogue.queries()["ld_correlation"](spark, SF).toPandas()
    k = x.shape[1]
    assert len(got) == k * (k + 1) // 2
    assert np.allclose(got["r"], want[got["snp_i"], got["snp_j"]], atol=2e-6)
    one = catalogue.queries()["ld_summary"](spark, SF).first()
    assert one["n"] == k and abs(one["m_eff"] - k * k / (want**2).sum()) < 1e-4 and abs(one["local_ld_score"] - (want**2).sum() / k) < 1e-4


def test_blocks_reach_the_last_gene(spark, tmp_path):
    part = pd.DataFrame({"p_partkey": [1, 2900, 3100, 7770, 20000], "p_size": [5, 9, 1, 50, 30]})
    part.to_parquet(tmp_path / "part.parquet")
    got = dict(map(tuple, catalogue.queries()["ld_block_assign"](spark, str(tmp_path)).select("gene_id", "block_id").collect()))
    want = {}
    for g, size in part.itertuples(index=False):
        start, end = g * 1000, (g + size) * 1000
        over = [(k * 150000 <= (start + end) / 2 <= k * 150000 + 140000, min(end, k * 150000 + 140000) - max(start, k * 150000), -k) for k in range(end // 150000 + 1) if start <= k * 150000 + 140000 and end >= k * 150000]
        want[g] = f"{g % 22 + 1}-{-max(over)[2]}" if over else "UNBLOCKED"
    assert got == want and sum(v != "UNBLOCKED" for v in got.values()) >= 4


@pytest.mark.parametrize("name", ["degree_bin_profile", "degree_matched_sample", "degree_matched_null_statistics", "matched_draws_with_replacement", "module_core_genes"])
def test_all_modules(spark, db, name):
    compare(spark, db, name)
