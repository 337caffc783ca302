"""The opN queries: each operator over its whole table, reduced to digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, collocations, divergence, embedding_dedup, langid, media, packing, quality_rules, simhash, sptok, warc, wavelet
from .common import Scratch, table

CONTROL = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    read = chat.digests(chat.format_conversations(rows.unionByName(own)))
    return read.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    docs = media.store(docs, F.col("data")).select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), "media")
    docs = media.decode(docs, payload=True, tensor=True)
    return docs.select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "feature", F.concat(F.lit("rgb="), F.lower(F.hex(F.crc32("rgb"))))).alias("feature"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = classifier.train(docs, labels.where(langid.fold("doc_id", 5) != 0), threshold=0.3)
    out = classifier.score(docs, model)
    return out.select("doc_id", (langid.fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), length=2048, end_id=1)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.link_components(table(spark, sf_dir, "documents"), width=3, max_distance=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wavelet.read_shards(wavelet.write_shards(table(spark, sf_dir, "documents"), end_id=2))
    return out.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.fold("doc_id", 3) != 1))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (langid.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    # the digests are made while reading; the archives are read once
    records = scratch.keep(warc.read_archive(warc.write_archive(table(spark, sf_dir, "pages"), scratch=scratch)).drop("payload"), "records")
    captures = scratch.keep(
        warc.assemble(records, payload=False).select(
            "capture_id", "page_id", F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("target"),
            F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_sha1").alias("payload_digest"),
        ),
        "captures",
    )
    first = captures.where("record_type = 'response'")
    # only revisits are joined; a target of very many of them is one that Spark deals to several tasks, both sides being plain tables
    again = captures.where("record_type = 'revisit'").drop("own_bytes").join(first.select(F.col("capture_id").alias("target"), F.col("page_id").alias("first_id"), "own_bytes"), "target", "left")
    return first.select("page_id", F.col("own_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        again.select("page_id", F.col("own_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("first_id").alias("refers_to"))
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sptok.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op11_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.similar_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), threshold=0.93)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents").select("text", "lang"), min_count=10, limit=2000, covered=50)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"), min_docs=3, limit=200)


def queries() -> dict:
    made = (op1_chat_format, op2_media, op3_quality, op4_packing, op5_simhash, op6_wavelet, op7_language, op8_quality_rules, op9_warc, op10_sentencepiece,
            op11_embeddings, op12_collocations, op13_divergence)
    return {f.__name__: f for f in made}
