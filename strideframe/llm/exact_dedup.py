"""Exact deduplication by content sort (operator 2), DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_az, read, shuffles

#: Bytes of normalised text that lead the sort key; whole texts are compared after it and a hash.
PREFIX = 48
#: A text with over 1/HOT_SHARE of an even partition's rows is dealt over several ranges.
HOT_SHARE = 4


def _runs(docs: DataFrame, id_col: str, text_col: str, n: int, carried: list[Column]) -> DataFrame:
    """The rows in content order with ``top`` and ``size`` of their group and ``first``, true for one row of each group."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # equal normalised texts are equal in lower case, so no hot text is missed
    rough = F.xxhash64(F.lower(text))
    least = max(2 * HOT_SHARE, docs.count() // (HOT_SHARE * n) + 1)
    hot = [r[0] for r in docs.groupBy(rough.alias("h")).count().where(F.col("count") >= least).select("h").collect()]
    lot = F.when(rough.isin(hot), F.pmod(F.xxhash64(F.col(id_col)), F.lit(HOT_SHARE * n)))
    key = ["head", "hash"] + ["lot"] * bool(hot)
    rows = docs.select(F.col(id_col).alias("doc_id"), lower_az(F.col(text_col)).alias("norm"), *[lot.alias("lot")] * bool(hot), *carried).select(
        "*", F.substring("norm", 1, PREFIX).alias("head"), F.xxhash64("norm").alias("hash")
    )
    same = Window.partitionBy(*key, "norm")
    runs = rows.repartitionByRange(n, *key).select(
        "doc_id",
        *key[2:],
        F.sha2("norm", 256).alias("text_sha256"),
        F.row_number().over(same.orderBy(F.col("doc_id").desc_nulls_last())).alias("at"),
        F.max("doc_id").over(same).alias("top"),
        F.count(F.lit(1)).over(same).alias("size"),
        *[c for c in rows.columns if c.startswith("_row")],
    )
    first = F.col("at") == 1
    if hot:
        lots = runs.where("lot is not null and at = 1").select("text_sha256", "lot", "top", "size")
        # at most HOT_SHARE * n texts are hot, so this has as few rows
        merged = lots.groupBy("text_sha256").agg(
            F.max("top").alias("all_top"), F.sum("size").alias("all_size"), F.max(F.struct("top", "lot"))["lot"].alias("top_lot")
        )
        cold = F.col("lot").isNull()
        runs = runs.join(F.broadcast(merged), "text_sha256", "left").withColumns(
            {"top": F.when(cold, F.col("top")).otherwise(F.col("all_top")), "size": F.when(cold, F.col("size")).otherwise(F.col("all_size"))}
        )
        first &= cold | (F.col("lot") == F.col("top_lot"))
    return runs.withColumn("first", first)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. The sort key is a prefix of the normalised text, a hash of
    it and the text itself; splitters sampled from prefix and hash cut the rows into ranges, each range is sorted
    externally, and neighbours are compared in full. Of equal texts the largest id stays. Texts frequent enough to
    unbalance a range are cut into lots by id and the lots' results are merged; there are at most
    ``HOT_SHARE * partitions`` such texts, so the merged table is small by construction.

    Null text is an empty text. A null id never wins unless the whole group has null ids; then ``keep_id`` is null and
    the rows are kept. Rows that repeat id and text are all marked kept if their id wins. No rows in, no rows out.
    """
    runs = _runs(docs, id_col, text_col, partitions or shuffles(docs.sparkSession), [])
    return runs.select("doc_id", F.col("top").alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("top")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: the one with the largest id, any of those that repeat it."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    return _runs(docs, "doc_id", "text", shuffles(docs.sparkSession), [row]).where("first").select("_row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g USING (norm)
"""
