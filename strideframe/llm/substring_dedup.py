"""Substring deduplication by content-defined chunks (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, utf8

#: A chunk ends at a word's end with probability ODDS / 2**32, after LEAST words and at MOST words at the latest.
ODDS, LEAST, MOST = 1 << 30, 6, 24
#: Words that a run of chunks from other documents needs to count as a repeated passage. A chunk that lies partly
#: outside a passage doesn't repeat, so passages of 50 words have runs well under that.
PASSAGE = 16

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """Gear rolling hash after each byte; it depends on the last 32 bytes."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        shifted = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += shifted
    return h


def cut(text: bytes) -> list[tuple[int, int, int]]:
    """Start, end and words of the chunks of a text; each chunk but the last ends with a word."""
    if not text:
        return []
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    last = np.flatnonzero(~space & np.append(space[1:], True))  # last byte of each word
    if not len(last):
        return []
    ends = np.flatnonzero(gear(data)[last] < ODDS).tolist()
    chunks, begun, start = [], 0, 0
    ends.append(len(last) - 1)
    stops = last.tolist()
    for e in ends:
        while e - begun + 1 > MOST:
            chunks.append((start, stops[begun + MOST - 1] + 1, MOST))
            begun += MOST
            start = chunks[-1][1]
        if e - begun + 1 >= LEAST or e == len(stops) - 1 and e >= begun:
            chunks.append((start, stops[e] + 1, e - begun + 1))
            begun = e + 1
            start = chunks[-1][1]
    return chunks


def chunk_table(docs: DataFrame) -> DataFrame:
    """``digest, doc_id, seq, start, end, words`` of every chunk of LEAST words or more; offsets count UTF-8 bytes."""

    def run(batches):
        kinds = {"digest": pa.binary(), "doc_id": pa.int64(), "seq": pa.int32(), "start": pa.int32(), "end": pa.int32(), "words": pa.int16()}
        for batch in batches:
            out: dict[str, list] = {c: [] for c in kinds}

            def table(out=out):
                return pa.RecordBatch.from_arrays([pa.array(out[c], kind) for c, kind in kinds.items()], list(kinds))

            for name, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                chunks = [x for x in enumerate(cut(text)) if x[1][2] >= LEAST] if name is not None else []
                out["digest"] += [xxhash.xxh3_128_digest(text[a:b].strip()) for _, (a, b, _) in chunks]
                out["doc_id"] += [name] * len(chunks)
                out["seq"] += [k for k, _ in chunks]
                out["start"] += [x[0] for _, x in chunks]
                out["end"] += [x[1] for _, x in chunks]
                out["words"] += [x[2] for _, x in chunks]
                if len(out["seq"]) > 200_000:
                    yield table()
                    out = {c: [] for c in kinds}
                    table.__defaults__ = (out,)
            yield table()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "digest binary, doc_id long, seq int, start int, end int, words short")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """One row per passage that an earlier document already has: ``doc_id, start, end, words, first_doc_id``.

    Texts are cut where a gear hash of the last 32 bytes says so, at ends of words, so an insertion moves only the
    chunks around it. Chunks are deduplicated by 128-bit digest; the document with the smallest id keeps a chunk. Runs
    of neighbouring chunks that others keep, with ``passage`` words or more, are the repeated passages; offsets count
    UTF-8 bytes, and ``first_doc_id`` keeps the run's first chunk. Repeats inside one document are left alone.

    Null and empty texts have no chunks; rows with null ids take no part; rows that repeat an id are one document.
    """
    chunks = chunk_table(docs)
    # a digest's rows are reduced before the shuffle; the join is one that Spark splits where a digest is frequent
    kept = chunks.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id")).where("first_doc_id < last_doc_id").drop("last_doc_id")
    later = chunks.join(kept, "digest").where("doc_id <> first_doc_id").select("doc_id", "seq", "start", "end", "words", "first_doc_id").distinct()
    runs = later.withColumn("island", F.col("seq") - F.dense_rank().over(Window.partitionBy("doc_id").orderBy("seq")))
    return (
        runs.groupBy("doc_id", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min_by("first_doc_id", "seq").alias("first_doc_id"))
        .where(F.col("words") >= passage)
        .drop("island")
    )


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the passages (``doc_id, start, end``) cut out of ``text``; every other row and column as it was."""

    spans = passages.groupBy(F.col("doc_id").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))

    @F.pandas_udf("string")
    def without(text, spans):
        def one(t, gone):
            if t is None or gone is None:
                return t
            raw, at, left = t.encode(), 0, []
            for s in gone:
                left.append(raw[at : s["start"]])
                at = max(at, s["end"])
            return b"".join([*left, raw[at:]]).decode(errors="ignore")

        return text.combine(spans, one)

    joined = docs.join(spans, docs["doc_id"] == spans["_of"], "left")
    return joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(without("text", "_spans"))).select(*docs.columns)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))
