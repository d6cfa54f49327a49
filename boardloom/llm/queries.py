"""The corpus queries, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLE_SQL  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge_urls, mined_rules

    pages = _read(spark, sf_dir, "pages")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return judge_urls(pages, mined_rules(pages, _read(spark, sf_dir, "labels"), blocked=bad))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import top_k

    vectors = _read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import with_kept_text

    out = with_kept_text(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import removed_words

    return removed_words(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import schedule

    return schedule(_read(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "block_offset")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge_documents

    return judge_documents(_read(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicate_components

    return near_duplicate_components(_read(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import counted, runs, variant_groups, with_slips

    return variant_groups(counted(with_slips(runs(_read(spark, sf_dir, "documents")))))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_rules, op2_topk, op3_line_dedup, op4_language_id, op5_substring_dedup, op6_packing, op7_token_counts, op8_mixing, op9_quality, op10_minhash, op11_spelling, op12_embedding_dedup, op13_alignment)}
