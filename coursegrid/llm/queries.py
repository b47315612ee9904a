"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursegrid.llm import cross_entropy, max_sketch, near_dup, packing, perspective, prefix_trie, quality_rules, secret_ledger, substring, toxicity, vector_graph, warc, winnowing
from coursegrid.llm.shared import settled


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    derived = warc.derive(warc.responses(table(spark, folder, "pages")))
    return derived.withColumn("record_sha256", F.sha2(warc.serialized(), 256))


def op2_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    ledger = settled(secret_ledger.scan(documents))
    found = secret_ledger.findings(documents, ledger, path_col="doc_id")
    base = [r.kind for r in secret_ledger.BASE]
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        F.col("path").alias("doc_id"),
        *counts,
        F.sha2(secret_ledger.joined(of_base), 256).alias("base_sha256"),
        secret_ledger.joined(F.col("spans")).alias("spans"),
    )


def op3_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = winnowing.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed, "contaminated")


def op4_bbit_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.group(table(spark, folder, "documents"), shingle=3, threshold=85)


def op5_cross_entropy_difference(spark: SparkSession, folder: str) -> DataFrame:
    """The target are the documents labelled as of good quality."""
    good = table(spark, folder, "labels").filter("quality = 1")
    scored = cross_entropy.score(table(spark, folder, "documents"), good)
    losses = ("target_loss", "background_loss", "difference")
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in losses])


def op6_perspective_rotation(spark: SparkSession, folder: str) -> DataFrame:
    rotated = perspective.rotate(table(spark, folder, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"]))
    return rotated.withColumn("mask", F.array_join(spans, ","))


def op7_nnls_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, folder, "documents"), path).drop("ids")


def op8_nb_char_linear(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.train(documents, table(spark, folder, "labels"))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_rabin_karp(spark: SparkSession, folder: str) -> DataFrame:
    left = substring.remove_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.assess(table(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.tree(table(spark, folder, "conversations"))


def op12_pruned_graph(spark: SparkSession, folder: str) -> DataFrame:
    return vector_graph.links(table(spark, folder, "embeddings"))


def op13_max_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return max_sketch.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_derivatives, op2_secret_ledger, op3_winnowing, op4_bbit_minhash, op5_cross_entropy_difference, op6_perspective_rotation, op7_nnls_packing, op8_nb_char_linear, op9_rabin_karp, op10_quality_rules, op11_prefix_trie, op12_pruned_graph, op13_max_sketches)}
