"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import audit, jaccard, language, neighbours, ppm, quality, repeats, resampling, topk, toxicity, warc
from pulsegrid.llm.common import remainder, table
from pulsegrid.llm.mixing import schedule, words
from pulsegrid.llm.packing import pack

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 ids."""
    return pack(table(spark, sf_dir, "documents"), TOKENIZER).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a byte model learned from six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ppm.score(docs, remainder("doc_id", 7) != 2).select(
        "doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    rows = schedule(table(spark, sf_dir, "documents").select("doc_id", "source", words("text").alias("size")), size=F.col("size"))
    served = F.aggregate(F.coalesce("entries.served", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("doc_id", "size", "source_size", "target", served.alias("taken"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every 50th vector with all others."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where("vec_id % 50 = 0"), 5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of all documents; graded 0 poor, 1 good but toxic, 2 good and clean."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2)).when(F.col("quality") == 0, 0)
    model = quality.fit(docs, labels, grade, use=remainder("doc_id", 5) != 0)
    return quality.score(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "expected_grade", F.col("tail").alias("score"), "grade",
        (F.col("tail") >= 0.5).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = table(spark, sf_dir, "documents")
    net = language.fit(docs, use=remainder("doc_id", 3) != 1)
    return language.predict(docs.select("doc_id", "text"), net).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of all documents without strings of 400 bytes that repeat."""
    removed = F.col("removed")
    return repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", F.aggregate(removed, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_removed"),
        F.size(removed).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), use=remainder("doc_id", 5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.where("vec_id % 20 = 0"), 20)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and draw of all documents towards the texts of the benchmark."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written to archives and read back."""
    return warc.archived(table(spark, sf_dir, "pages"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents, in each of their 120 orders."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_jaccard, op2_packing, op3_ppm, op4_mixing, op5_topk, op6_quality, op7_language, op8_repeats, op9_toxicity, op10_neighbours, op11_resampling, op12_warc, op13_audit)}
