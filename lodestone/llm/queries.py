"""The driver-facing queries of this subpackage, each over whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bagminhash, chat, decontam, language, media, quality, sentencepiece_codec, token_counts, toxicity
from lodestone.llm.common import fresh, table
from lodestone.llm.sharding import ShardStore


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train=~held_out)
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in four appends, are compacted, and are read back through the last manifest."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, fresh(spark, "shards"), docs.schema)
    store.append(docs, arrival=F.expr("pmod(xxhash64(doc_id), 4)"))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars")


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and every document; of a document only its text and its source, as the host, are evidence."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language.fit(docs)
    a = language.identify(docs.select("doc_id", "source", "text"), model, F.col("text"), host=F.col("source"), keep=["doc_id"])
    parts = language.page_parts(F.col("url"), F.col("html"))
    b = language.identify(pages.select("page_id", "url", "html"), model, **parts, keep=["page_id"])
    out = ["language", "confidence", "rejected"]
    none = F.lit(None).cast("bigint")
    return a.select("doc_id", none.alias("page_id"), *out).unionByName(b.select(none.alias("doc_id"), "page_id", *out))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -7, whose texts spell control strings."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    return chat.formatted(talk.unionByName(own))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"), ["doc_id"], with_media=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality, op2_sentencepiece, op3_decontamination, op4_sharding, op5_bagminhash, op6_toxicity, op7_language, op8_chat, op9_media, op10_token_counts,
    )
}
#: The others fit models or follow a tokenizer or a hash; tests hold them against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {"op4_sharding": "SELECT doc_id, sha256(text) AS text_sha256, lang, source, n_chars FROM documents"}
