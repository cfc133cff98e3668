"""From raw documents to token ids: quality, exact and near copies, benchmark leaks, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. ``run`` writes each stage's rows as
Parquet to the shared folder of ``spark.checkpoint.dir`` and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.byte_bpe import public_encoding
from strideframe.llm.common import Store, read
from strideframe.llm.decontaminate import contaminated
from strideframe.llm.exact_dedup import drop_copies
from strideframe.llm.near_dedup import near_groups
from strideframe.llm.quality import classify_quality


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in ``ids``; a null doc_id stays."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity isn't over their language's threshold."""
    return _without(docs, classify_quality(docs, read(spark, sf_dir, "labels")).where(~F.col("kept")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity from 0.8), the one with the smallest id."""
    return _without(docs, near_groups(docs, size=5, percent=80).where(~F.col("kept")))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also not with other numbers or names."""
    return _without(docs, contaminated(docs, read(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document as a digest, with the digest of what they decode to."""
    return public_encoding(docs)


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("leaks", leaks), ("tokens", tokens)]
#: The models and encodings of the stages can't be expressed in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = store.put(name, stage(spark, docs, sf_dir))
        if before:
            store.release(before)
        before = name
    return docs
