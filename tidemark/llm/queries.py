"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, hamming, importance, lm, mixing, neardup, ngramjoin, ordinal, ranked, sharding, toxicity, urllists, winnow


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_documents(_table(spark, folder, "documents"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, folder, "documents"), 8)
    return out.withColumn("grown_shard", F.lit(None).cast("int"))


def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code("embedding").alias("code"))
    return hamming.top_k(rows, rows.where("id % 20 = 0"), 10)


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


def op9_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """``pages`` has neither dates nor lists, so Spark derives both from it.

    Page i was fetched on day ``i * 7919 % 366`` of 2024. With f the smallest page id of a host or of a host's first path
    segment: it is listed on day ``f * 31 % 366`` if ``f % 3 = 0``, taken off ``f * 17 % 90 + 1`` days later if f is even,
    and listed again 60 days after that if ``f % 4 = 0``.
    """
    pages = _table(spark, folder, "pages")
    start = F.lit("2024-01-01").cast("date")
    captures = pages.select("page_id", "url", F.date_add(start, (F.col("page_id") * 7919 % 366).cast("int")).alias("fetched"))
    keys = F.filter(urllists.url_keys(F.col("url")), lambda k: (k == urllists.host(F.col("url"))) | (F.length(F.regexp_replace(k, "[^/]", "")) == 1))
    named = pages.select("page_id", F.explode(keys).alias("pattern")).groupBy("pattern").agg(F.min("page_id").alias("f"))
    on = F.date_add(start, (F.col("f") * 31 % 366).cast("int"))
    off = F.date_add(on, (F.col("f") * 17 % 90 + 1).cast("int"))
    dated = F.array(
        F.struct(on.alias("day"), F.lit("add").alias("action"), F.lit(True).alias("real")),
        F.struct(off.alias("day"), F.lit("remove").alias("action"), (F.col("f") % 2 == 0).alias("real")),
        F.struct(F.date_add(off, 60).alias("day"), F.lit("add").alias("action"), (F.col("f") % 4 == 0).alias("real")),
    )
    entries = named.where("f % 3 = 0").select("pattern", F.inline(dated)).where("real")
    return urllists.judge(captures, entries)


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))



def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    trap = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_conversations(rows))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return ordinal.quality_grades(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"))


def op11_ranked(spark: SparkSession, folder: str) -> DataFrame:
    found = ranked.ranked_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op12_importance(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngramjoin.ngram_join(_table(spark, folder, "documents"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_sharding": op2_sharding,
    "op3_chat": op3_chat,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_neardup": op6_neardup,
    "op7_topk": op7_topk,
    "op8_mixing": op8_mixing,
    "op9_url_filters": op9_url_filters,
    "op10_decontamination": op10_decontamination,
    "op11_ranked": op11_ranked,
    "op12_importance": op12_importance,
    "op13_ngram_join": op13_ngram_join,
}
