"""The registered queries of the thirteen operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygraph.llm import decontamination, embedding_dedup, fim, hamerly, importance, language_id, licenses, line_dedup, minhash, packing, simple8b, token_counts, toxicity
from skygraph.llm.common import remainder_of, table
from skygraph.llm.oracles import ORACLES  # noqa: F401


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = toxicity.learn(docs, labels, remainder_of(F.col("doc_id"), 3) != 1)
    found = toxicity.score(docs, field)
    return found.select("doc_id", (remainder_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs, remainder_of(F.col("doc_id"), 4) != 2)
    return language_id.predict(docs, model).select("doc_id", (remainder_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=4096)


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: is it contaminated, by how much, and by which tests."""
    docs = table(spark, sf_dir, "documents")
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).withColumnRenamed("doc_id", "_doc_id")
    keys = docs.select("doc_id", F.xxhash64("text").alias("_hash"))
    told = keys.join(found, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_hash") == F.col("text_hash")), "left")
    return told.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), window=2048)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_words=10, longest_runs=False)
    return found.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), "text")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("base_places.label")))
    labels = F.array_sort(F.array_union(F.col("base_places.label"), F.col("matches.label")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("bigint").alias("n_base"),
        F.array_min("base_places.word").alias("first_word"),
        F.array_max("base_places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("matches") > 0, 1.0).when(F.size("base_places") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def op11_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3).drop("scans")


def op12_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simple8b.round_trip(table(spark, sf_dir, "documents"), end_id=2)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(table(spark, sf_dir, "documents"), rate=100, suffix_first=50, seed=7)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_embedding_dedup, op4_minhash, op5_token_counts, op6_importance, op7_decontamination, op8_packing, op9_line_dedup, op10_licenses, op11_hamerly, op12_simple8b, op13_fim)}
