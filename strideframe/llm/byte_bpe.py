"""Byte-level BPE encoding and decoding (operator 8)."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, Store, read

#: Distinct words whose ids Spark computes once; rarer words are merged where they occur. A bound of memory, not of results.
DICTIONARY = 1 << 15
#: Units that a Python worker remembers; those not met lately go first.
REMEMBERED = 1_000_000
#: Maps into which the literal rank map is cut, since Spark scans a map from its start.
SHARDS = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal: ``array<map<string,int>>`` by hex piece, cut by crc32."""
    shards: list[dict[str, int]] = [{} for _ in range(SHARDS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        shards[zlib.crc32(key.encode()) % SHARDS][key] = rank
    return F.from_json(F.lit(json.dumps(shards)), "array<map<string,int>>")


def _rank(table: Column, piece: Column) -> Column:
    return F.try_element_at(F.element_at(table, (F.pmod(F.crc32(piece.cast("binary")), F.lit(SHARDS)) + 1).cast("int")), piece)


def _merge_step(table: Column, pieces: Column) -> Column:
    """``pieces`` with the first pair of lowest rank merged; unchanged without such a pair."""
    ranked = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: _rank(table, F.concat(F.element_at(pieces, i), F.element_at(pieces, i + 1))))

    def merged(r: Column) -> Column:
        at = F.array_position(r, F.array_min(r)).cast("int")
        joined = F.array(F.concat(F.element_at(pieces, at), F.element_at(pieces, at + 1)))
        return F.concat(F.slice(pieces, F.lit(1), at - 1), joined, F.slice(pieces, at + 2, F.size(pieces)))

    # a one-element array binds the ranks, so that they are computed once
    tried = F.element_at(F.transform(F.array(ranked), lambda r: F.when(F.array_min(r).isNotNull(), merged(r))), 1)
    return F.when(F.size(pieces) > 1, F.coalesce(tried, pieces)).otherwise(pieces)


def fold_merges(word: Column, table: Column) -> Column:
    """Ids of a word (binary): its bytes with ranked merges folded over them, then looked up. ``table``: ``rank_literal``."""
    hexed = F.hex(word)
    start = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(hexed, i * 2 - 1, F.lit(2)))
    steps = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    pieces = F.aggregate(steps, start, lambda acc, _: _merge_step(table, acc))
    return F.when(F.length(word) > 0, F.transform(pieces, lambda p: _rank(table, p)))


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_pairs(ranks: dict[bytes, int]) -> list[int]:
    """Ranks of all pairs of bytes, by the first times 256 plus the second."""
    return [ranks.get(bytes((a, b)), len(ranks) + 1 << 40) for a in range(256) for b in range(256)]


def merge_word(word: bytes, ranks: dict[bytes, int], pairs: list[int] | None = None) -> list[int]:
    """The same fold for one word. ``pairs``: ``byte_pairs`` of the ranks, for many words."""
    if word in ranks:
        return [ranks[word]]
    get, none = ranks.get, len(ranks) + 1 << 40
    cuts = list(range(len(word) + 1))
    scores = [pairs[a << 8 | b] for a, b in pairwise(word)] if pairs else [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while scores and (low := min(scores)) < none:
        i = scores.index(low)
        del cuts[i + 1], scores[i]
        if i:
            scores[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], none)
        if i < len(scores):
            scores[i] = get(word[cuts[i] : cuts[i + 2]], none)
    return [ranks[word[a:b]] for a, b in pairwise(cuts)]


class _Splitter:
    """Words (matches of the pattern) of texts, with the words of each space-separated unit remembered.

    Between a character that isn't white space and a single space before another such character every word ends, so
    these units can be split on their own; a text with any other white space around a space is split as a whole.
    """

    def __init__(self, pattern: str, of_words: Callable[[list[str]], object]):
        self.find, self.of_words, self.units = regex.compile(pattern).findall, of_words, Recent(self.unit, REMEMBERED)

    def unit(self, unit: str) -> object:
        body = unit[1:] if unit[:1] == " " else unit
        if body.isalpha():
            return self.of_words([unit])
        if body[-1:] in (",", ".") and body[:-1].isalpha():
            return self.of_words([unit[:-1], body[-1]])
        whole = body and not body[0].isspace() and not body[-1].isspace()
        return self.of_words(self.find(unit)) if whole else None

    def text(self, text: str) -> list:
        self.units.trim()
        first, *rest = text.split(" ")
        found = list(map(self.units.__getitem__, [first, *[" " + x for x in rest]]))
        return found if all(found) else [self.of_words(self.find(text))]


#: The splitter of the running query; a Python worker keeps it from task to task.
_kept: dict[str, _Splitter] = {}


def _remembering(query: str, pattern: str, of_words: Callable[[list[str]], object]) -> _Splitter:
    if query not in _kept:
        _kept.clear()
        _kept[query] = _Splitter(pattern, of_words)
    return _kept[query]


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    return (x or "" for x in batch.column("text").to_pylist())


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """Distinct words of ``text`` with their number of uses: ``word binary, n long``."""

    def count(batches):
        splitter = _Splitter(pattern, tuple)
        for batch in batches:
            uses: Counter = Counter()
            for text in _texts(batch):
                uses.update(splitter.text(text))
            totals: Counter = Counter()
            for words, n in uses.items():
                for w in words:
                    totals[w] += n
            yield pa.RecordBatch.from_arrays([pa.array([w.encode() for w in totals], pa.binary()), pa.array(totals.values(), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, store: Store) -> dict[bytes, bytes]:
    """Ids (little-endian unsigned 32-bit) of the most frequent words, at most DICTIONARY of them."""
    counts = store.put("bpe_words", word_counts(docs, pattern))
    room, least = DICTIONARY, None
    # as many rows as there are different counts, which grows with the root of the corpus at most
    for n, words in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if (room := room - words) < 0:
            break
        least = n
    if least is None:
        return {}
    table = rank_literal(ranks)
    rows = counts.where(F.col("n") >= least).select("word", fold_merges(F.col("word"), table).alias("ids")).collect()
    store.release("bpe_words")
    return {bytes(w): np.array(ids, "<u4").tobytes() for w, ids in rows}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, digests: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_tokens`` and, with ``digests``, sha-256 of the ids and of the decoded bytes;
    without, ``ids array<int>`` and ``decoded binary``.

    Every match of ``pattern`` is encoded on its own by ranked merges, without special tokens. Spark folds the merges
    over the distinct frequent words once; these ids are broadcast, at most DICTIONARY words, and rarer words are merged
    by the same rule where they occur, so the result doesn't depend on the bound. Decoding joins the ids' pieces.

    Null text is an empty text: no tokens, digests of no bytes. Rows keep their ids, repeated or null.
    """
    spark = docs.sparkSession
    store = Store(spark)
    known = spark.sparkContext.broadcast((ranks, dictionary(docs.select("text"), ranks, pattern, store)))
    out = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")

    query = store.at

    def run(batches):
        ranks, words = known.value
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        pairs = byte_pairs(ranks)

        def ids(found: list[str]) -> bytes:
            return b"".join([words.get(w) or packed(merge_word(w, ranks, pairs)) for w in (x.encode() for x in found)])

        splitter = _remembering(query, pattern, ids)
        for batch in batches:
            rows = []
            for text in _texts(batch):
                encoded = b"".join(splitter.text(text))
                tokens = np.frombuffer(encoded, "<u4")
                decoded = b"".join(map(pieces.__getitem__, tokens.tolist()))
                rows.append((len(tokens), hashlib.sha256(encoded).hexdigest(), hashlib.sha256(decoded).hexdigest()) if digests else (len(tokens), tokens.astype("i4"), decoded))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, kinds[0]), pa.array(b, kinds[1])], [x.split()[0] for x in out.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, out)


def public_encoding(docs: DataFrame, digests: bool = True) -> DataFrame:
    """``encode`` by the multilingual vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return encode(docs, load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN, digests)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return public_encoding(read(spark, sf_dir, "documents"))
