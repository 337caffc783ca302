"""Source divergence: how far the term frequencies of each source of a language are from those of every other.

A group is a (lang, source); its frequency of a kept term with ``c`` occurrences is ``p(c) = 1 + floor(10^9 (c + 1) / (N + V))``, N its occurrences of
all V kept terms of the language. The divergence of g from h is the sum over all kept terms of ``f(p, q) = floor((p - q)^2 / q)``.
The terms that neither has, and those that only one has, are never visited, as f there depends on one count alone:

    sum = V f(0, 0)                                       both zero: a constant
        + sum over counts c of g: n_g(c) (f(c, 0) - f(0, 0))     g's histogram of counts
        + sum over counts d of h: n_h(d) (f(0, d) - f(0, 0))     h's histogram of counts
        + sum over shared terms: f(c, d) - f(c, 0) - f(0, d) + f(0, 0)    corrections of the overlap

where f(c, d) stands for f(p_g(c), p_h(d)). Only the last sum needs terms: a term's posting (its groups with their counts) is joined
with itself inside bounded blocks, and each block returns a sum for each pair of groups.

All is whole numbers in 64 bits: a sum of squares of frequencies is at most (10^9 + V)^2, below 2^62 for V up to 10^9.

A posting is one row, with an entry for each source of the language that has the term. The result holds a row for each ordered pair of
sources, so sources of a language are far fewer than what a row can hold; blocks bound the memory of a long posting.

Defined results: null text, lang and source are ''. A group without kept terms has all counts zero; V = 0 gives value 0. Repeated rows are documents
of their own. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import Scratch, lowered, quoted, stretches, text_or_empty

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
CUT = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: A task's counts are passed on when they hold so many (group, term) entries.
HELD = 600_000
#: Pairs of groups that a block computes at once.
BLOCK = 1 << 20

COUNTS = "lang string, term string, source string, n long, docs long"


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, term, source, n, docs): occurrences and documents, summed over what a task has read so far; several rows a key."""

    def run(batches):
        words: dict[tuple, Counter] = defaultdict(Counter)
        docs: dict[tuple, Counter] = defaultdict(Counter)

        def rows():
            for (lang, source), counts in words.items():
                inside = docs[lang, source]
                columns = [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array([source] * len(counts), pa.string())]
                columns += [pa.array(list(counts.values()), pa.int64()), pa.array([inside[t] for t in counts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "n", "docs"])
            words.clear()
            docs.clear()

        size = 0
        for b in batches:
            for text, lang, source in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                seen: set[str] = set()
                for part in stretches(text.as_py(), CUT):
                    found = TERM.findall(lowered(part))
                    counts = words[lang, source]
                    size -= len(counts)
                    counts.update(found)
                    size += len(counts)
                    seen.update(found)
                docs[lang, source].update(seen)
                if size > held:
                    yield from rows()
                    size = 0
        yield from rows()

    return map_arrow(docs, run, COUNTS)


def divergence(p, q):
    """floor((p - q)^2 / q) of whole numbers."""
    return (p - q) * (p - q) // q


def overlap_sums(postings: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(lang, g, h, s): the corrections of each block's terms, summed for each ordered pair of groups. postings: lang, entries of (source, p, p0)."""

    def block(lang: str, names: np.ndarray, g: np.ndarray, h: np.ndarray, p, p0) -> pa.RecordBatch:
        value = divergence(p[g], p[h]) - divergence(p[g], p0[h]) - divergence(p0[g], p[h]) + divergence(p0[g], p0[h])
        named, index = np.unique(names, return_inverse=True)
        code = index[g] * len(named) + index[h]
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sums, code = np.add.reduceat(value[order], first), code[first]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(named[code // len(named)]), pa.array(named[code % len(named)]), pa.array(sums)], names=["lang", "g", "h", "s"])

    def run(batches):
        for b in batches:
            langs, entries = b.column(0).to_pylist(), b.column(1)
            flat = entries.flatten()
            names, p, p0 = np.array(flat.field("source").to_pylist(), object), flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            sizes = np.array([len(e) for e in entries])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            by_lang = defaultdict(list)
            for i, lang in enumerate(langs):
                by_lang[lang].append(i)
            for lang, rows in by_lang.items():
                rows, at = np.array(rows), 0
                while at < len(rows):
                    cost = np.cumsum(sizes[rows[at:]] ** 2)
                    n = max(1, int(np.searchsorted(cost, limit, "right")))
                    part, at = rows[at : at + n], at + n
                    # a posting of more pairs than that is taken alone, some of its left sides at a time
                    width = max(1, limit // int(sizes[part[0]])) if n == 1 else int(sizes[part].max())
                    for low in range(0, int(sizes[part].max()), width):
                        left = np.concatenate([np.arange(starts[i] + low, min(starts[i] + low + width, starts[i + 1])) for i in part])
                        own = np.repeat(part, np.minimum(np.maximum(sizes[part] - low, 0), width))
                        reps = sizes[own]
                        g = np.repeat(left, reps)
                        h = np.repeat(starts[own], reps) + np.arange(len(g)) - np.repeat(np.cumsum(reps) - reps, reps)
                        other = g != h
                        if other.any():
                            used, local = np.unique(np.concatenate([g[other], h[other]]), return_inverse=True)
                            k = int(other.sum())
                            yield block(lang, names[used], local[:k], local[k:], p[used], p0[used])

    return map_arrow(postings.select("lang", "entries"), run, "lang string, g string, h string, s long")


def one_sided(pairs: DataFrame) -> DataFrame:
    """pairs with ``base``: all terms priced as if no term were shared, from the histograms hg and hh of (p, n)."""
    fields = [f.name for f in pairs.schema.fields if f.name not in ("hg", "hh")]

    def run(batches):
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            v, p0, q0 = (b.column(at[n]).to_numpy() for n in ("v", "p0", "q0"))
            zero = divergence(p0, q0)
            base = v * zero
            for side, left in (("hg", True), ("hh", False)):
                column = b.column(at[side])
                flat, row = column.flatten(), np.repeat(np.arange(len(column)), [len(x) if x.is_valid else 0 for x in column])
                p, n = flat.field("p").to_numpy(), flat.field("n").to_numpy()
                np.add.at(base, row, n * ((divergence(p, q0[row]) if left else divergence(p0[row], p)) - zero[row]))
            yield pa.RecordBatch.from_arrays([*(b.column(at[n]) for n in fields), pa.array(base, pa.int64())], names=[*fields, "base"])

    schema = ", ".join(f"{n} {pairs.schema[n].dataType.simpleString()}" for n in fields)
    return map_arrow(pairs.select(*fields, "hg", "hh"), run, schema + ", base long")


def audit(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, limit: int = 200,
    held: int = HELD, block: int = BLOCK, scratch: Scratch | None = None,
) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: for each source of a language every other one with the divergence from it;
    ``term``: a source's first ``limit`` terms that it has more often than its language as a whole, by f. Ranks by value
    descending, item ascending."""
    scratch = scratch or Scratch(df.sparkSession, "divergence")
    docs = df.select(text_or_empty(text_col).alias("text"), *(F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))))
    # one exchange by (lang, term) serves the sums, the languages' totals and the postings
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = term_counts(docs, held).repartition(parts, "lang", "term")
    counts = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("entries"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = scratch.keep(kept.where(F.col("docs") >= min_docs).drop("docs"), "terms")
    counts = kept.select("lang", "term", "total", F.inline("entries"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["v", "n_lang", "n_group"])
    share = lambda n, all_: F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * cast({n} + 1 as decimal(19, 0))) div nullif({all_} + v, 0)")
    groups = scratch.keep(groups.withColumn("p0", F.coalesce(share("0L", "n_group"), F.lit(1).cast("long"))), "groups")

    priced = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "total", "n_lang", "v", "p0", "n", share("n", "n_group").alias("p"))
    priced = scratch.keep(priced.withColumn("q", share("total", "n_lang")).select("lang", "source", "term", "p", "p0", "q"), "priced")
    hist = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("hist"))
    sides = scratch.keep(groups.join(hist, ["lang", "source"], "left").select("lang", "source", "v", "p0", "hist"), "sides")
    one = sides.select("lang", F.col("source").alias("g"), "v", "p0", F.col("hist").alias("hg"))
    two = sides.select("lang", F.col("source").alias("h"), F.col("p0").alias("q0"), F.col("hist").alias("hh"))
    base = one_sided(one.join(two, "lang").where("g <> h")).select("lang", "g", "h", "base")
    postings = priced.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("entries")).where("size(entries) > 1")
    shared = overlap_sums(postings, block).groupBy("lang", "g", "h").agg(F.sum("s").alias("s"))
    pairs = base.join(shared, ["lang", "g", "h"], "left").select("lang", F.col("g").alias("source"), F.lit("pair").alias("part"), F.col("h").alias("item"), (F.col("base") + F.coalesce("s", F.lit(0))).alias("value"))
    terms = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    order = (F.desc("value"), F.asc("item"))
    # the first of a source are among the first of each of its shares
    terms = terms.withColumn("share", F.pmod(F.xxhash64("item"), F.lit(16)))
    terms = terms.withColumn("r", F.row_number().over(Window.partitionBy("lang", "source", "share").orderBy(*order))).where(F.col("r") <= limit).drop("r", "share")
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= limit)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return pairs.unionByName(terms)
