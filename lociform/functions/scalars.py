"""Column expressions for variant, allele and p-value handling. NULL is the one missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Closed intervals (chromosome, first, last base) of regions treated apart.
REGIONS = {"MHC": ("6", 25_000_000, 35_000_000), "APOE": ("19", 44_000_000, 46_500_000)}
SENTINELS = ["", ".", "nan", "None"]


def finite(c: Column) -> Column:
    """True for a number that is neither missing nor infinite; never NULL."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def chromosome(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "(?i)^chr", "")


def allele(c: Column) -> Column:
    return F.upper(F.trim(c))


def complement(c: Column) -> Column:
    return F.translate(c, "ACGT", "TGCA")


def single_base(a: Column, b: Column) -> Column:
    return F.coalesce(a.rlike("^[ACGT]$") & b.rlike("^[ACGT]$"), F.lit(False))


def palindromic(a: Column, b: Column) -> Column:
    return complement(a) == b


def in_region(chrom: Column, pos: Column, name: str) -> Column:
    c, lo, hi = REGIONS[name]
    return F.coalesce((chrom == c) & pos.between(lo, hi), F.lit(False))


def allele_case(effect: Column, other: Column, ref1: Column, ref2: Column) -> Column:
    """'same', 'flip', 'strand', 'strand_flip' or NULL for a mismatch."""
    ce, co = complement(effect), complement(other)
    return (
        F.when((effect == ref1) & (other == ref2), "same")
        .when((effect == ref2) & (other == ref1), "flip")
        .when((ce == ref1) & (co == ref2), "strand")
        .when((ce == ref2) & (co == ref1), "strand_flip")
    )


def fail_reasons(checks: list[tuple[str, Column]]) -> Column:
    """Labels of the failed checks in their order, joined by ';'."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks))), ";")


def clip_p(p: Column, epsilon: float = 1e-300) -> Column:
    return F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - max(epsilon, 1e-16)))


def se_from_interval(lo: Column, hi: Column) -> Column:
    """Standard error of log odds from a 95 % interval of the odds ratio."""
    return F.when((lo > 0) & (hi > lo), (F.log(hi) - F.log(lo)) / F.lit(3.92))


def log_odds(c: Column) -> Column:
    return F.when(c > 0, F.log(c))


def weighted_frequency(fa: Column, na: Column, fb: Column, nb: Column) -> Column:
    return (fa * na + fb * nb) / F.nullif(na + nb, F.lit(0))


def maf(f: Column) -> Column:
    return F.least(f, 1 - f)


def huberize(c: Column, cap: float) -> Column:
    return F.greatest(F.least(c, F.lit(cap)), F.lit(-cap))


def cap_upper(c: Column, cap: float) -> Column:
    return F.least(c, F.lit(cap))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "t", "yes", "y"), F.lit(False))


def slug(c: Column, length: int = 60) -> Column:
    plain = F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_")
    return F.substring(F.regexp_replace(plain, "^_+|_+$", ""), 1, length)


def clean_ids(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.isin(SENTINELS), t)


def split_ids(c: Column) -> Column:
    """Identifiers of a list parted by ',' or ';', without blanks and sentinels."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, ";", ","), ","), lambda x: F.trim(x)), lambda x: ~x.isin(SENTINELS))


def sign_z(p_z: Column, effect: Column) -> Column:
    return F.signum(effect) * p_z


def band(value: Column, edges: list[tuple[str, float, float]]) -> Column:
    """Label of the half-open interval that holds the value; 'unassigned' if none; small negatives count as 0."""
    v = F.when((value < 0) & (value > -1e-8), F.lit(0.0)).otherwise(value)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, lo, hi in edges:
        out = out.when((v >= lo) & (v < hi), name)
    return out.otherwise("unassigned")
