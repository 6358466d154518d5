"""A training corpus in five stages: quality rules, toxicity, line dedup, MinHash near-dedup, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. No stage can be written in SQL as a whole (the classifier, sketches and tokenizer), so
ORACLE_SQL is None and the tests compare run() with a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import stage, table
from fieldmark.llm.line_dedup import line_dedup
from fieldmark.llm.minhash_dedup import drop_near_duplicates
from fieldmark.llm.packing import pack_documents
from fieldmark.llm.quality_rules import quality_filter
from fieldmark.llm.queries import vocabulary
from fieldmark.llm.toxicity import toxicity_filter, train_toxicity, training_fold

ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts have too few words and go. Ties,
    repeated rows and ids are judged row by row."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, row by row; null and empty texts get the intercept's score. Without
    labels nothing goes."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), training_fold(F.col("doc_id")))
    return toxicity_filter(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines; those that lose all their words go. ``n_chars``
    is counted anew, null for a null text; other columns pass untouched."""
    out = line_dedup(docs, drop_emptied=True)
    return out.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Rows that share an
    id are judged by their own texts; of equal rows one stays."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of 2048 ids; a null or empty text is one end id,
    repeated rows are packed one by one, other columns go."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("minhash_dedup", near_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
