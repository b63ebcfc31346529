"""The corpus queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, kneser_ney, language_id, line_dedup, ngram_join, packing, pii, quality_rules, toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a vocabulary file is; it is opened on the executors too."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows of an Arrow batch: texts are long, so a batch of few rows bounds the memory of Python workers and of the JVM beside its heap.
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """crc32 of a document's id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.perplexity_filter(table(spark, sf_dir, "documents"), trusted)


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), ann.fit(vectors))


#: Stands in for a secret that a real run takes from its key store.
PII_KEY = "public example key"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_checked(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return toxicity.score(docs, learnt).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op7_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False, with_text=False)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learnt = language_id.fit(docs.where(fold(3) != 1))
    return language_id.identify(docs, learnt).select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_kneser_ney, op2_learned_partitions, op3_pii, op4_toxicity, op5_quality_rules, op6_line_dedup, op7_bpe_encode, op8_ngram_jaccard_join, op9_packing, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": line_dedup.SQL}
