"""Sources and sinks of the domain's text files. All are Spark readers and writers: no path is opened by Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, comment: str | None = None, limit: int | None = None) -> DataFrame:
    """All columns as strings; without a separator it is the first of tab, comma, semicolon, space in the first line."""
    if sep is None:
        first = spark.read.text(path).where("value <> ''").limit(1).collect()
        line = first[0][0] if first else ""
        sep = next((s for s in ("\t", ",", ";", " ") if s in line), "\t")
    reader = spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    return df.limit(limit) if limit is not None else df


def read_fields(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """White-space separated fields without a header; lines with fewer fields and bad numbers give NULL."""
    names = [x.strip().split(" ") for x in schema.split(",")]
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("f", parts)
    return rows.select(*(F.get("f", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)))


def read_variants_bim(spark: SparkSession, path: str) -> DataFrame:
    return read_fields(spark, path, "chrom string, snp_id string, cm double, pos long, allele1 string, allele2 string")


def read_samples_fam(spark: SparkSession, path: str) -> DataFrame:
    return read_fields(spark, path, "family_id string, sample_id string, father string, mother string, sex string, phenotype string")


def read_gene_locations(spark: SparkSession, path: str) -> DataFrame:
    g = read_fields(spark, path, "gene_id string, chrom string, g_start long, g_end long, strand string, gene_symbol string")
    return g.where("g_start is not null and g_start <= g_end")


def read_id_set(spark: SparkSession, path: str) -> DataFrame:
    first = F.get(F.split(F.trim("value"), r"\s+"), F.lit(0))
    ids = spark.read.text(path).select(first.alias("snp_id")).where("snp_id <> ''")
    return ids.where(~F.upper("snp_id").isin("SNP", "RSID", "SNP_ID")).distinct()


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(module, description, gene) of a GMT file."""
    f = F.split("value", "\t")
    # fields are taken before the explode: above it, Spark would split a set's line again for each of its genes
    rows = spark.read.text(path).where(F.size(f) >= 3).select(F.get(f, F.lit(0)).alias("module"), F.get(f, F.lit(1)).alias("description"), F.slice(f, 3, F.size(f)).alias("genes"))
    return rows.select("module", "description", F.explode("genes").alias("gene")).where("gene <> ''").distinct()


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """(term, name, namespace, parents) of an OBO file's live terms."""
    # a file's first block has no line break before its bracket
    blocks = spark.read.option("lineSep", "\n[").text(path).where(F.col("value").rlike(r"^\[?Term\]"))
    line = lambda k: F.regexp_extract("value", rf"(?m)^{k}: (.*)$", 1)
    parents = F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1))
    return blocks.where(~F.col("value").rlike(r"(?m)^is_obsolete: true")).select(line("id").alias("term"), line("name").alias("name"), line("namespace").alias("namespace"), parents.alias("parents"))


def read_gene_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(term, gene) of a GAF file, without negated rows."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("!")).select(F.get(f, F.lit(4)).alias("term"), F.get(f, F.lit(2)).alias("gene"), F.get(f, F.lit(3)).alias("q"))
    return rows.where(~F.array_contains(F.split("q", r"\|"), "NOT")).select("term", "gene").distinct()


def read_protein_links(spark: SparkSession, path: str, min_score: int | None = None) -> DataFrame:
    """(protein1, protein2, combined_score) of a space-separated link file; the least score is pushed to the scan."""
    links = spark.read.option("header", True).option("sep", " ").schema("protein1 string, protein2 string, combined_score int").option("enforceSchema", False)
    df = links.csv(path)
    return df if min_score is None else df.where(F.col("combined_score") >= min_score)


def read_protein_info(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a protein table; the leading # of its first name goes."""
    df = read_delimited(spark, path, "\t")
    return df.withColumnsRenamed({c: c.lstrip("#") for c in df.columns if c.startswith("#")})


def read_protein_aliases(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """Aliases of proteins, of all sources or of the named ones."""
    df = read_protein_info(spark, path)
    return df if sources is None else df.where(F.col("source").isin(*sources))


def write_delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_partitioned(df: DataFrame, path: str, by: str = "replicate") -> None:
    """Replicates of graphs or statistics, one folder each, so that a reader prunes them."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)
