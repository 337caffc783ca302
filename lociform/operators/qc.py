"""Summary-statistic tables: harmonisation to a reference, z-scores and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions.special import normal_isf
from .relational import assert_unique, dedupe_first


@F.udf(T.DoubleType())
def _isf(p):
    return None if p is None else normal_isf(p)


def signed_z(df: DataFrame) -> tuple[Column, str]:
    """The table's z expression: the first source for which it has columns: z, beta / se, log odds / se, p with the
    sign of beta, p with the sign of log odds."""
    has = lambda *c: all(x in df.columns for x in c)
    if has("z"):
        return F.col("z"), "z"
    if has("beta", "se"):
        return F.col("beta") / F.nullif(F.col("se"), F.lit(0.0)), "beta_se"
    if has("odds_ratio", "se"):
        return S.log_odds(F.col("odds_ratio")) / F.nullif(F.col("se"), F.lit(0.0)), "log_or_se"
    if has("p", "beta"):
        return S.sign_z(_isf(S.clip_p(F.col("p")) / 2), F.col("beta")), "p_beta"
    if has("p", "odds_ratio"):
        return S.sign_z(_isf(S.clip_p(F.col("p")) / 2), S.log_odds(F.col("odds_ratio"))), "p_or"
    return F.lit(None).cast("double"), "unavailable"


def harmonize_table(df: DataFrame, order: str) -> DataFrame:
    """Canonical chromosome and alleles, z with its source, first row of each variant."""
    z, source = signed_z(df)
    fresh = {"z": z, "z_source": F.lit(source)}
    fresh |= {c: f(F.col(c)) for c, f in (("chrom", S.chromosome), ("effect_allele", S.allele), ("other_allele", S.allele)) if c in df.columns}
    out = df.withColumns(fresh).withColumn("signed_available", S.finite(F.col("z")))
    return dedupe_first(out, ["snp_id"], [order])


def harmonize_to_reference(df: DataFrame, reference: DataFrame, min_maf: float = 0.01, min_info: float = 0.8) -> DataFrame:
    """Left join to a reference of unique ids; alignment, flips, flags and the ordered list of failed checks.

    Alleles and position become those of the reference (null without one), the table's own stay as ``source_*``; effect and frequency of
    a flipped variant are those of the reference's effect allele. ``info`` is judged if any row of the table has it.
    """
    ref = assert_unique(reference.select("snp_id", "chrom_ref", "pos_ref", "ref_a1", "ref_a2"), ["snp_id"])
    j = df.withColumn("repeated_id", F.count("*").over(Window.partitionBy("snp_id")) > 1).join(ref, "snp_id", "left")
    a, b = S.allele(F.col("effect_allele")), S.allele(F.col("other_allele"))
    j = j.withColumns({"source_effect_allele": a, "source_other_allele": b, "p_was_clipped": F.coalesce(F.col("p") < 1e-300, F.lit(False)), "p": F.when(F.col("p") < 1e-300, 1e-300).otherwise(F.col("p"))})
    own = F.col("source_effect_allele"), F.col("source_other_allele")
    j = j.withColumns({
        "alignment": S.allele_case(*own, F.col("ref_a1"), F.col("ref_a2")),
        "palindromic": F.coalesce(S.palindromic(*own), F.lit(False)),
        "indel": ~S.single_base(*own),
        "maf": S.maf(F.col("eaf")),
    })
    info = F.lit(False)
    if "info" in df.columns:
        any_info = df.agg(F.coalesce(F.max(F.col("info").isNotNull()), F.lit(False)).alias("__any_info"))
        j = j.crossJoin(F.broadcast(any_info))
        info = F.col("__any_info") & (F.col("info").isNull() | (F.col("info") < min_info))
    flip = F.coalesce(F.col("alignment").isin("flip", "strand_flip"), F.lit(False))
    mapped = F.col("chrom_ref").isNotNull()
    checks = [
        ("not_in_reference", ~mapped),
        ("invalid_p", F.col("p").isNull() | (F.col("p") > 1)),
        ("invalid_se", ~S.finite(F.col("se")) | (F.col("se") <= 0)),
        ("invalid_beta", ~S.finite(F.col("beta"))),
        ("invalid_eaf", ~S.finite(F.col("eaf")) | ~F.col("eaf").between(0, 1)),
        ("non_snp_or_non_acgt", F.col("indel")),
        ("allele_mismatch", mapped & ~F.col("indel") & F.col("alignment").isNull()),
        ("ambiguous_palindrome", F.col("palindromic") & F.col("maf").between(0.42, 0.58)),
        ("low_maf", F.col("maf").isNull() | (F.col("maf") < min_maf)),
        ("low_or_missing_info", info),
        ("non_autosome", mapped & ~F.col("chrom_ref").isin([str(c) for c in range(1, 23)])),
    ]
    out = j.withColumns({
        "qc_fail_reason": S.fail_reasons(checks),
        "effect_allele": F.col("ref_a1"),
        "other_allele": F.col("ref_a2"),
        "beta": F.when(flip, -F.col("beta")).otherwise(F.col("beta")),
        "eaf": F.when(flip, 1 - F.col("eaf")).otherwise(F.col("eaf")),
        "in_mhc": S.in_region(F.col("chrom_ref"), F.col("pos_ref"), "MHC"),
        "in_apoe": S.in_region(F.col("chrom_ref"), F.col("pos_ref"), "APOE"),
    }).drop("__any_info")
    return out.withColumns({"maf": S.maf(F.col("eaf")), "z": F.col("beta") / F.nullif(F.col("se"), F.lit(0.0)), "qc_pass": F.col("qc_fail_reason") == ""})


def fail_counts(df: DataFrame) -> DataFrame:
    reason = F.explode(F.split("qc_fail_reason", ";"))
    return df.where("qc_fail_reason <> ''").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def explode_ids(df: DataFrame, column: str = "snp_id") -> DataFrame:
    return df.withColumn(column, F.explode(S.split_ids(F.col(column))))


def gene_flags(df: DataFrame, high_count: int = 5000) -> DataFrame:
    """Low information (effective number missing or below 2), many variants, and overlap with the special regions."""
    def over(name: str) -> Column:
        c, lo, hi = S.REGIONS[name]
        return F.coalesce((F.col("chrom") == c) & (F.col("g_start") <= hi) & (F.col("g_end") >= lo), F.lit(False))

    return df.withColumns({
        "low_information": ~S.finite(F.col("m_eff")) | (F.col("m_eff") < 2),
        "high_snp_count": F.coalesce(F.col("n_snps") > high_count, F.lit(False)),
        "special_regions": F.array_join(F.array_compact(F.array(*(F.when(over(n), F.lit(n)) for n in S.REGIONS))), ";"),
    })
