"""Language identification by compression (operator 9)."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, read

#: The bounded training sample of a language: one text from each of SLOTS slots of the ids' hash, cut to SLICE characters.
SLOTS, SLICE = 64, 1536
#: Languages that are learned, the most frequent ones.
LANGUAGES = 64
LEVEL = 3


#: Digits, punctuation and signs of ASCII say little of a language and go before compression.
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalpha())


def plain(text: str) -> bytes:
    return text.lower().encode().translate(None, _SIGNS)


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Raw-content dictionary of each language, most frequent first: the sampled texts, at most SLOTS * SLICE characters.

    ``docs`` has ``doc_id, text, lang``; rows with null text or lang teach nothing.
    """
    rows = docs.where("text is not null and lang is not null")
    hashed = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # at most SLOTS rows a language; equal hashes are settled by the text
    picked = rows.groupBy("lang", F.pmod(hashed, F.lit(SLOTS)).alias("slot")).agg(
        F.min(F.struct(hashed.alias("h"), F.substring("text", 1, SLICE).alias("text"))).alias("row"), F.count(F.lit(1)).alias("n")
    )
    langs = picked.groupBy("lang").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("slot", "row.text"))).alias("texts"))
    return {r.lang: plain("\n".join(x.text for x in r.texts)) for r in langs.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}


def identify(docs: DataFrame, known: dict[str, bytes], margin: float = 0.0) -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score, accepted``.

    The whole text, in lower case and without ASCII signs, is compressed once with each language's dictionary; the smallest result names the language, the
    first of ``known`` among equals. ``score`` is the margin to the next language as a share of the larger size, 1
    with a single language. ``accepted`` is false where the score is under ``margin`` or nothing was decided. A text
    that is null or has no letter is ``und`` with score 0, as is every text if nothing is known.
    """
    names = list(known)
    sent = docs.sparkSession.sparkContext.broadcast([known[x] for x in names])

    def run(batches):
        packers = []
        for raw in sent.value:
            d = zstandard.ZstdCompressionDict(raw or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                if not names or not text or not any(map(str.isalpha, text)):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                raw = plain(text)
                sizes = [len(p.compress(raw)) for p in packers]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                after = min(sizes[:best] + sizes[best + 1 :], default=None)
                langs.append(names[best])
                scores.append(1.0 if after is None else (after - sizes[best]) / after)
            accepted = [x != "und" and s >= margin for x, s in zip(langs, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = crc_remainder(F.col("doc_id"), 5) == 0
    found = identify(docs, dictionaries(docs.where(~held)), margin=0.01)
    return found.withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "accepted")
