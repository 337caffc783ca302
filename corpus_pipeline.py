"""From raw documents to packed sequences: rules, language, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again.
A null text is treated as empty, which the rules reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociform.llm import langid, packing, quality_rules, simhash
from lociform.llm.common import Scratch, quoted, table

#: A language below this posterior is rejected.
MIN_LANGUAGE_SCORE = 0.5


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str], str]:
    """docs under names that no operator uses, the way back to its own names, and the name of the text."""
    names = {f"column_{i}": c for i, c in enumerate(docs.columns)}
    text = next(n for n, c in names.items() if c.lower() == "text")
    return docs.select(*(F.col(quoted(c)).alias(n) for n, c in names.items())), names, text


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail; n_chars follows the text. Repeated rows are judged
    alike; columns keep their names and values, also where an operator's own have the same name."""
    held, names, text = numbered(docs)
    out = quality_rules.clean_lines(held, text).where("kept")
    fresh = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return out.select(*(fresh.get(c, F.col(n)).alias(c) for n, c in names.items()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or of no certain language go; equal texts are judged alike. A tie between two languages is below the limit or goes to the first."""
    held, names, text = numbered(docs)
    lang = next(n for n, c in names.items() if c.lower() == "lang")
    out = langid.predict(held, langid.train(held, text, lang), text)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*(F.col(n).alias(c) for n, c in names.items()))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays, one row of repeated ones; a null doc_id comes last."""
    return simhash.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens along the space-filling curve; a row for each piece."""
    out = packing.pack(docs)
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", rules), ("language", language), ("near copies", near_copies), ("packing", packed)]

#: Language scores, fingerprints and token ids are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
