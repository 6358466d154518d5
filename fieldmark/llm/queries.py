"""Registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, report=True).select("doc_id", "n_lines", "n_removed_lines", "emptied", "text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def piece_model() -> str:
    """Vocabulary file of the registered query; operators take any path."""
    return vocabulary("piece_bpe_32k.model")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_digest, license_scan

    return license_digest(license_scan(table(spark, sf_dir, "documents")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import piece_digest

    return piece_digest(table(spark, sf_dir, "documents"), piece_model())


def op5_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz_lm import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"), order=3)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import similar_vectors

    return similar_vectors(table(spark, sf_dir, "embeddings"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train_toxicity, training_fold

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels, training_fold(F.col("doc_id")))
    return score_toxicity(docs, model).select("doc_id", (~training_fold(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .huffman_files import huffman_round_trip

    return huffman_round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import code_digest, compress

    return code_digest(compress(table(spark, sf_dir, "embeddings")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import identifiers, pii_digest

    return pii_digest(identifiers(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_katz_lm": op5_katz_lm,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_huffman_files": op10_huffman_files,
    "op11_vector_codes": op11_vector_codes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_pii": op13_pii,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .quality_sql import quality_sql
    from .vector_sql import codes_sql, negatives_sql

    return {"op3_quality_rules": quality_sql(), "op11_vector_codes": codes_sql(), "op12_hard_negatives": negatives_sql()}
