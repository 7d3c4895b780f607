"""The queries over the training-data operators, each over its whole table, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_ids, chat, decontaminate, fingerprints, lm_score, near_dups, packing, prefix_trie, resampling, secret_scan, sharding, token_counts, toxicity
from .common import shared_dir, table

def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _text().alias("text"))
    sketched = lambda rows: fingerprints.sketched(rows, "text", "sketch")
    docs = fingerprints.with_next(docs, "doc_id", {"text": "next_text", "sketch": "next_sketch"}, "text", sketched)
    half = F.floor(F.length("text") / 2).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    docs = fingerprints.sketched(docs, "edited", "edited_sketch")
    docs = docs.withColumn("e", fingerprints.compared(F.col("sketch"), F.col("edited_sketch"))).withColumn("n", fingerprints.compared(F.col("sketch"), F.col("next_sketch")))
    return docs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"), fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.col("e.likeness").alias("near_edited"), F.col("n.likeness").alias("near_next"),
        F.col("e.containment").alias("in_edited"), F.col("n.containment").alias("in_next"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = toxicity.with_toxicity(docs, table(spark, sf_dir, "labels"), out="score")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return docs.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secret_scan.with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), battery="battery")
    base = F.filter("secrets", lambda s: s["rank"] < 3)
    kind = F.transform("secrets", lambda s: s["rank"])
    counts = [(F.size("secrets") - F.size(F.array_remove(kind, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    return docs.select("doc_id", *counts, F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"), secret_scan.evidence(F.col("battery")).alias("battery"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.scored(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", "n_seen", "n_backed_off", F.round("log10_sum", 4).alias("log10_sum"), F.round("log10_mean", 6).alias("log10_mean"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized(table(spark, sf_dir, "documents"))
    return packing.placed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "nth"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text().cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(_text()) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    docs = sharding.interleaved(docs, 24)
    return docs.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = decontaminate.with_contamination(docs, table(spark, sf_dir, "benchmark"), out="c")
    digest = F.sha2(F.concat_ws(",", "c.items").cast("binary"), 256).alias("items_sha256")
    return docs.select("doc_id", "c.n_words", "c.n_hit", F.size("c.items").cast("long").alias("n_items"), digest, (F.col("c.n_hit") > 0).alias("contaminated"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.formatted(turns.unionByName(own)))


def op9_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/ids"
    binary_ids.write_ids(table(spark, sf_dir, "documents"), path)
    return binary_ids.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.linked(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = token_counts.prefix_counts(F.col("text"))  # both functions in one Python worker, prefixes do not travel between
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(_text()).cast("long").alias("n_bytes"), token_counts.answered(prefixes).alias("a"))
    return docs.select("doc_id", "n_bytes", "a.n_tokens", (F.col("a.n_tokens") > token_counts.LIMIT).alias("over_limit"), "a.fit_chars", "a.fit_tokens")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    convs = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv")).where("conv IS NOT NULL").distinct()
    return prefix_trie.trie(prefix_trie.rebuilt(turns, convs), convs)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_fingerprint, op2_toxicity, op3_secrets, op4_lm_score, op5_packing, op6_sharding, op7_decontaminate, op8_chat, op9_binary_ids, op10_near_dups, op11_token_counts, op12_prefix_trie, op13_resampling, pipeline)}
