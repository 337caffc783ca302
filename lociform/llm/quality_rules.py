"""Quality rules, line first: clean line by line, then judge what is left.

Built of DataFrame functions only. Every line of a text meets three rules:

* punctuation: marks ``#*$%&|<>!~^={}`` make up over ``max_mark_share`` of its
  non-space characters,
* navigation: at least ``min_separators`` separators ``|``, ``»``, ``•`` or ``>``, one for every
  ``separator_chars`` of its non-space characters or more,
* boilerplate: a licence, copyright, cookie, sign-up or script notice in a line of at most ``notice_chars`` of them.

A long line that says "cookie" once, or holds a few separators, is prose and stays.

Lines that fail are removed; a document is rejected if it fails a base rule or if
less than ``min_left_share`` of its non-space characters is left.

Defined results: a null or empty text has no words and is rejected; blank lines cost
nothing and are dropped from the cleaned text; repeated rows are judged one by one;
extra columns pass through, those named like an added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, quoted, text_or_empty, without

SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&|<>!~^={}"
NAVIGATION_MARKS = "|»•>"
#: Lower-cased strings of notices.
BOILERPLATE = (
    "licensed under", "all rights reserved", "copyright (c)", "©", "cookie", "terms of use", "terms of service", "privacy policy", "sign up",
    "subscribe", "click here", "read more", "share this", "javascript", "lorem ipsum", "warranty of any kind", "permission is hereby granted",
    "spdx-license-identifier",
)
ADDED = (
    "clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "base_failed", "kept",
)


def _count(text: Column, chars: str) -> Column:
    """How many of these characters a text has: what is left without the runs of others."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _solid(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"{SPACE_CLASS}+", ""))


def _notice(text: Column) -> Column:
    low = F.lower(text)
    out = F.contains(low, F.lit(BOILERPLATE[0]))
    for x in BOILERPLATE[1:]:
        out = out | F.contains(low, F.lit(x))
    return out


def clean_lines(
    df: DataFrame,
    text_col: str = "text",
    max_mark_share: float = 0.08,
    min_separators: int = 3,
    separator_chars: int = 40,
    notice_chars: int = 240,
    min_left_share: float = 0.5,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """df with the columns ADDED. A map without a shuffle.

    Arrays that a lambda reads are named columns with several uses, so that the
    optimizer computes each once per row. Three-word windows are compared by their
    64-bit hashes: sort (hash, position), flag equal neighbours, then add up the
    words that the flagged windows cover; linear but for the sort.
    """
    kept = without(df, ADDED)
    out = df.select(*(F.col(quoted(c)) for c in kept), text_or_empty(text_col).alias("__t"))
    out = out.withColumns({
        "__w": F.array_remove(F.split("__t", f"{SPACE_CLASS}+"), ""),
        "__l": F.filter(F.split("__t", "\n"), lambda x: x.rlike(rf"[^{SPACE_CLASS[1:]}")),
        "__n": _notice(F.col("__t")),
        "__m": F.col("__t").rlike(f"[{MARKS}{NAVIGATION_MARKS}]"),
    })
    windows = F.transform(
        F.when(F.size("__w") >= 3, F.sequence(F.lit(0), F.size("__w") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("i")),
    )
    # most texts have neither a mark nor a notice, and most lines of the others neither
    good = F.filter(
        F.col("__l"),
        lambda x: ~(
            (F.col("__m") & x.rlike(f"[{MARKS}{NAVIGATION_MARKS}]") & ((_count(x, MARKS) > max_mark_share * _solid(x)) | ((_count(x, NAVIGATION_MARKS) >= min_separators) & (separator_chars * _count(x, NAVIGATION_MARKS) >= _solid(x)))))
            | (F.col("__n") & _notice(x) & (_solid(x) <= notice_chars))
        ),
    )
    out = out.withColumns({"__s": F.sort_array(windows), "__g": good, "__c": F.length(F.array_join("__w", "")).cast("long"), "n_words": F.size("__w").cast("long")})
    flagged = F.transform(
        F.filter(
            F.col("__s"),
            lambda x, j: (F.get("__s", j + 1)["h"] == x["h"]) | ((j > 0) & (F.get("__s", F.greatest(j - 1, F.lit(0)))["h"] == x["h"])),
        ),
        lambda x: x["i"],
    )
    out = out.withColumns({"__p": F.sort_array(flagged), "clean_text": F.array_join("__g", "\n")})
    covered = F.aggregate(
        F.transform(F.col("__p"), lambda p, j: F.least(F.lit(3), F.coalesce(F.get("__p", j + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    out = out.withColumns({
        "word_chars": F.col("__c"),
        "n_symbols": _count(F.col("__t"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": covered,
        "n_lines_removed": (F.size("__l") - F.size("__g")).cast("long"),
        "__left": _solid(F.col("clean_text")),
    })
    out = out.withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    )
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("__left") >= min_left_share * F.col("word_chars")))
    # A filter on the result must not be pushed down into the lambdas, where it would
    # compute whole arrays for each of their elements; it stays above a generator.
    out = out.select(*(F.col(quoted(c)) for c in kept), F.explode(F.array(F.struct(*ADDED))).alias("__r"))
    return out.select(*(F.col(quoted(c)) for c in kept), *(F.col(f"__r.{c}").alias(c) for c in ADDED))
