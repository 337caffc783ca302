"""Domain views over the star-schema tables: one SQL text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_snp": """SELECT l_orderkey * 10 + l_linenumber AS snp_id, CAST(l_partkey % 22 + 1 AS STRING) AS chrom,
        l_partkey * 1000 + l_linenumber * 37 AS pos, (l_quantity - 25.5) / 14.43 AS z, l_discount - 0.05 AS beta, l_tax + 0.01 AS se,
        l_partkey AS k1, l_suppkey AS k2, l_extendedprice AS k3 FROM lineitem""",
    "v_gene": """SELECT p_partkey AS gene_id, CONCAT('G', CAST(p_partkey AS STRING)) AS gene_symbol, CAST(p_partkey % 22 + 1 AS STRING) AS chrom,
        p_partkey * 1000 AS g_start, p_partkey * 1000 + p_size * 1000 AS g_end, p_size AS size FROM part""",
    "v_edge": """SELECT a.l_partkey AS a, b.l_partkey AS b, CAST(a.l_quantity AS DOUBLE) AS weight
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber < b.l_linenumber""",
    "v_score": """SELECT l_partkey AS gene, ROUND(SUM(l_extendedprice * (1 - l_discount)) / 100000.0, 6) AS score, COUNT(*) AS degree,
        ROUND(AVG(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY l_partkey""",
    "v_module": "SELECT p_brand AS module, p_partkey AS gene FROM part UNION ALL SELECT p_type AS module, p_partkey AS gene FROM part",
}
NEEDS = {"v_snp": ["lineitem"], "v_gene": ["part"], "v_edge": ["lineitem"], "v_score": ["lineitem"], "v_module": ["part"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in NEEDS[name]}
    for t in frames:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **frames)


def with_views(body: str) -> str:
    """body with the views that it names, as DuckDB SQL."""
    used = [n for n in VIEWS if n in body]
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
