"""Relational building blocks: every one maps DataFrames to a DataFrame, lazily."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def project_to(df: DataFrame, schema) -> DataFrame:
    """Columns of a schema, in order and cast; those that df lacks are NULL."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def alias_project(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Rename to canonical names: of each name's aliases the first that df has, in normalised spelling."""
    plain = {c.strip().lower().replace(" ", "_"): c for c in reversed(df.columns)}
    chosen = [(plain[a], name) for name, options in aliases.items() for a in [next((o for o in options if o in plain), None)] if a]
    return df.select(*(F.col(f"`{c}`").alias(name) for c, name in chosen))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, failing at run time if a key repeats: the many-to-one contract of a join."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__n", F.when(n > 1, F.raise_error(F.lit(f"repeated key {list(keys)}")).cast("long")).otherwise(n)).where("__n = 1").drop("__n")


def ordinal_rank(df: DataFrame, value: str, tie: str, out: str = "rank", by: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    order = F.asc(value) if ascending else F.desc(value)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(order, tie)))


def average_rank(df: DataFrame, value: str, out: str = "rank", by: Sequence[str] = (), ascending: bool = True) -> DataFrame:
    """Rank with ties averaged, from the counts of distinct values: rows of equal value are counted
    before the running sum, so the window runs over values, not rows."""
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__k"))
    w = Window.partitionBy(*by).orderBy(F.asc(value) if ascending else F.desc(value))
    ranks = counts.withColumn("__r", F.sum("__k").over(w) - (F.col("__k") - 1) / 2)
    return df.join(ranks.select(*by, value, F.col("__r").alias(out)), [*by, value])


def quantile_bins(df: DataFrame, value: str, q: int, tie: str, out: str = "bin", by: Sequence[str] = ()) -> DataFrame:
    """Equal-frequency bins over ordinal ranks: max(0, ceil((r - 1) q / (n - 1)) - 1)."""
    n = F.count("*").over(Window.partitionBy(*by))
    r = F.row_number().over(Window.partitionBy(*by).orderBy(value, tie))
    return df.withColumn(out, F.when(n > 1, F.greatest(F.lit(0), F.ceil((r - 1) * q / F.nullif(n - 1, F.lit(0))) - 1)).otherwise(0).cast("int"))


def bh_fdr(df: DataFrame, p: str, out: str = "q", by: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg: the running minimum of p n / rank from the largest p down; missing p stay missing."""
    held = df.where(F.col(p).isNotNull())
    counts = held.groupBy(*by, p).agg(F.count("*").alias("__k"))
    rank = F.sum("__k").over(Window.partitionBy(*by).orderBy(p))
    n = F.sum("__k").over(Window.partitionBy(*by))
    raw = counts.withColumn("__q", F.col(p) * n / rank)
    down = Window.partitionBy(*by).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    final = raw.select(*by, p, F.least(F.lit(1.0), F.min("__q").over(down)).alias(out))
    return df.join(final, [*by, p], "left")


def islands(df: DataFrame, start: str, end: str, by: Sequence[str], out: str = "island") -> DataFrame:
    """Number the merged intervals of each group from 1; an interval that starts at or before the end so far joins."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def trapezoid(df: DataFrame, x: str, y: str, by: Sequence[str], out: str = "auc") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("__a", part).groupBy(*by).agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias(out))


def top_fraction(df: DataFrame, value: str, tie: str, fractions: Sequence[float], by: Sequence[str] = (), least: int = 1) -> DataFrame:
    """Rows of the top share of each fraction; the size is rounded half to even."""
    n = F.count("*").over(Window.partitionBy(*by))
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie))
    grid = F.explode(F.array(*(F.lit(float(f)) for f in sorted(set(fractions)))))
    ranked = df.withColumns({"__n": n, "__r": r}).withColumn("rank_fraction", grid)
    return ranked.where(F.col("__r") <= F.greatest(F.lit(least), F.bround(F.col("__n") * F.col("rank_fraction")))).drop("__n", "__r")


def empirical(nulls: DataFrame, observed: DataFrame, by: Sequence[str], null: str = "value", value: str = "observed") -> DataFrame:
    """Upper and lower empirical p with the +1 correction, mean, sd and z of a null distribution; missing nulls are dropped."""
    both = observed.join(nulls.where(F.col(null).isNotNull()), list(by))
    out = both.groupBy(*by, value).agg(
        F.count("*").alias("n_null"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"),
        F.sum((F.col(null) >= F.col(value)).cast("int")).alias("__u"), F.sum((F.col(null) <= F.col(value)).cast("int")).alias("__l"),
    )
    return out.select(
        *by, value, "n_null", "null_mean", "null_sd",
        ((F.col("__u") + 1) / (F.col("n_null") + 1)).alias("p_upper"), ((F.col("__l") + 1) / (F.col("n_null") + 1)).alias("p_lower"),
        F.when(F.col("null_sd") > 0, (F.col(value) - F.col("null_mean")) / F.nullif(F.col("null_sd"), F.lit(0.0))).alias("z"),
    )


def pairwise_jaccard(sets: DataFrame, set_id: str, item: str, empty: float | None = None) -> DataFrame:
    """(a, b, shared, jaccard) of every two sets with a common item: a join on items, not of all sets."""
    s = sets.select(F.col(set_id).alias("s"), F.col(item).alias("i")).distinct()
    sizes = s.groupBy("s").agg(F.count("*").alias("n"))
    shared = s.alias("x").join(s.alias("y"), "i").where("x.s < y.s").groupBy(F.col("x.s").alias("a"), F.col("y.s").alias("b")).agg(F.count("*").alias("shared"))
    out = shared.join(sizes.withColumnsRenamed({"s": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"s": "b", "n": "nb"}), "b")
    return out.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def present_dropped(sets: DataFrame, universe: DataFrame, set_id: str, item: str) -> DataFrame:
    """Counts of a set's items inside and outside a universe."""
    u = universe.select(F.col(item)).distinct().withColumn("__in", F.lit(True))
    both = sets.select(set_id, item).distinct().join(u, item, "left")
    inside = F.col("__in").isNotNull().cast("long")
    return both.groupBy(set_id).agg(F.sum(inside).alias("n_present"), F.sum(1 - inside).alias("n_dropped"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def hash_permute(df: DataFrame, value: str, node: str, by: Sequence[str], replicates: int, seed: int = 1) -> DataFrame:
    """(replicate, node, by, value): values dealt anew within each bin by a hash order; both windows share
    one partitioning by (replicate, bin), and the order is the same in any engine with md5."""
    keys = ["replicate", *by]
    reps = df.select(node, *by, value).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    mixed = F.md5(F.concat_ws("-", F.lit(seed), "replicate", F.col(node).cast("string")))
    here = reps.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(node)))
    there = reps.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(mixed, node))).select(*keys, "__k", F.col(value).alias("__v"))
    return here.join(there, [*keys, "__k"]).select("replicate", node, *by, F.col("__v").alias(value))


def ols_residual(df: DataFrame, y: str, xs: Sequence[str], out: str = "residual") -> DataFrame:
    """Least-squares residual: one aggregation to the k x k normal equations, solved on the driver, one projection."""
    import numpy as np

    names = ["__one", *xs]
    col = {"__one": F.lit(1.0)} | {x: F.col(x).cast("double") for x in xs}
    k = len(names)
    cells = [F.sum(col[a] * col[b]) for i, a in enumerate(names) for b in names[i:]]
    row = df.agg(*cells, *(F.sum(col[a] * F.col(y)) for a in names)).first()
    if row[0] is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    m, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[at]
            at += 1
    beta = np.linalg.pinv(m) @ np.array([float(row[at + i]) for i in range(k)])
    fit = sum((F.lit(float(b)) * col[n] for b, n in zip(beta, names, strict=True)), F.lit(0.0))
    return df.withColumn(out, F.col(y) - fit)
