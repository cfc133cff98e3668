"""Ranked lexical search over posting lists in geometric blocks (operator 11)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER_AZ, UPPER_AZ, Store, lower_az, read

#: Hits of an item.
TOP = 50
#: Documents and terms with repeats at which a shard is full, and bytes of text that are cut into terms at once.
SHARD_DOCS, SHARD_TERMS, SLICE = 4096, 1 << 21, 1 << 22
#: Documents of a block; lists up to this long have one block and are always opened.
BLOCK = 64
#: Terms of the items that are searched for together.
ITEM_TERMS = 200_000
#: One shard in so many gives each item a score that its last hit has at least.
FIRST = 16
#: Coordinates of the sketch by which documents are told near or far.
SKETCH = 16

_APART = bytes(c for c in range(128) if not chr(c).isalnum())
_TERMS = bytes.maketrans(_APART + UPPER_AZ.encode(), b" " * len(_APART) + LOWER_AZ.encode())
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class _Numbers(dict):
    """A number for each term in the order of arrival."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _terms(text: str) -> Iterator[list[bytes]]:
    raw = text.encode().translate(_TERMS)
    at = 0
    while len(raw) - at > SLICE and (gap := raw.find(b" ", at + SLICE)) > 0:
        yield raw[at:gap].split()
        at = gap
    yield raw[at:].split()


def index_documents(docs: DataFrame) -> DataFrame:
    """The posting lists of each shard of documents, a row a shard: ``doc_ids, lengths, terms, sizes, docs, tfs``.

    ``doc_ids`` and ``lengths`` (terms with repeats) are the shard's documents in their order; ``terms`` and ``sizes``
    its distinct terms and the lengths of their lists; ``docs`` (places in the shard) and ``tfs`` hold the lists one
    after the other. Terms are runs of ASCII letters, digits and all characters beyond ASCII, only A-Z lower-cased. A
    shard is a run of neighbouring rows of a partition, so nothing is shuffled and a frequent term's list is spread
    over all shards. Documents without terms (null and empty texts too) have no place in it.
    """
    columns = [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))]

    def shard(ids, lengths, found, numbers):
        each = np.concatenate(found).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), lengths)
        keys, tfs = np.unique(each, return_counts=True)
        terms, docs = np.divmod(keys, len(ids))
        rows = [ids, lengths, [x.decode() for x in numbers], np.bincount(terms, minlength=len(numbers)), docs, tfs]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], pa.array(x, kind.value_type)) for x, (_, kind) in zip(rows, columns, strict=True)], [c for c, _ in columns])

    def run(batches):
        ids, lengths, found, numbers, size = [], [], [], _Numbers(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in _terms(text or "")]
                if n := sum(map(len, parts)):
                    ids.append(doc_id)
                    lengths.append(n)
                    found += parts
                    size += n
                if len(ids) >= SHARD_DOCS or size >= SHARD_TERMS:
                    yield shard(ids, lengths, found, numbers)
                    ids, lengths, found, numbers, size = [], [], [], _Numbers(), 0
        if ids:
            yield shard(ids, lengths, found, numbers)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_ids array<long>, lengths array<long>, terms array<string>, sizes array<int>, docs array<int>, tfs array<int>")


def stored_index(docs: DataFrame) -> DataFrame:
    """``index_documents`` stored once; a shard is a row group of its own, so a task holds one at a time however many it has."""
    return Store(docs.sparkSession).put("index", index_documents(docs), together=1)


class _Shard:
    """The lists that the items ask for in one shard: impacts of documents, long lists in blocks with their summaries."""

    def __init__(self, row: dict, wanted: dict[str, tuple[int, int]], items: list[np.ndarray], size: int, mean: tuple[int, int]):
        n_docs, all_terms = mean
        self.weights = np.array([w for _, w in wanted.values()], np.int64)
        lengths = row["lengths"]
        rate = 20 * (50 + 50 * lengths * n_docs // all_terms)
        stops = np.cumsum(row["sizes"])
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for at, term in enumerate(row["terms"]):
            if term in wanted:
                part = slice(stops[at] - row["sizes"][at], stops[at])
                docs, tfs = row["docs"][part], row["tfs"][part].astype(np.int64)
                self.lists[wanted[term][0]] = docs, 1_000_000_000 * tfs // (1000 * tfs + rate[docs])
        self.n = len(lengths)
        self.long = sorted((t for t, (docs, _) in self.lists.items() if len(docs) > size), key=lambda t: (len(self.lists[t][0]), t))
        self.column = {t: c for c, t in enumerate(self.long)}
        self.impacts = np.zeros((self.n, len(self.long)), np.int32)  # under a million each
        for t, c in self.column.items():
            self.impacts[self.lists[t][0], c] = self.lists[t][1]
        self._block(items, size)

    def _block(self, items: list[np.ndarray], size: int) -> None:
        """Each long list is cut into groups of documents that lie near each other; a summary holds the largest impacts of a group."""
        together: dict[int, list] = {c: [] for c in range(len(self.long))}
        for item in items:
            columns = [self.column[t] for t in item.tolist() if t in self.column]
            for c in columns:
                together[c].append(columns)
        sketch = np.zeros((self.n, SKETCH), np.float32)
        directions = np.random.default_rng(SKETCH).standard_normal((len(self.long), SKETCH))
        for t, along in zip(self.long, directions, strict=True):
            docs, impacts = self.lists[t]
            sketch[docs] += (impacts * (self.weights[t] / 1e9))[:, None] * along
        self.blocks = []
        for c, t in enumerate(self.long):
            docs = self.lists[t][0]
            parts = -(-len(docs) // size)
            centres = sketch[docs[np.arange(parts) * len(docs) // parts]]
            group = np.argmin((centres * centres).sum(1) - 2 * sketch[docs] @ centres.T, axis=1)
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            # later columns are all that counts when this list is opened
            columns = np.unique(np.concatenate([np.array(x)[np.array(x) >= c] for x in together[c]]))
            docs = docs[order]
            self.blocks.append((np.split(docs, starts[1:]), columns, np.maximum.reduceat(self.impacts[np.ix_(docs, columns)], starts, axis=0).astype(np.int64)))

    def search(self, item: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that include the ``top`` best of at least ``least``.

        Short lists are opened first, so a document not seen after them has no impact on their terms. A block of a long
        list, the shorter lists first, is left out only if the summary's score over this and the later lists is under
        that of the ``top``-th best so far.
        """
        score = np.zeros(self.n, np.int64)
        seen = np.zeros(self.n, bool)
        columns = []
        for t in item.tolist():
            if t in self.column:
                columns.append(self.column[t])
            elif t in self.lists:
                docs, impacts = self.lists[t]
                score[docs] += self.weights[t] * impacts
                seen[docs] = True
        columns = np.array(sorted(columns), np.int64)
        weights = self.weights[np.array(self.long, np.int64)[columns]]

        def finish(docs):
            score[docs] += self.impacts[np.ix_(docs, columns)] @ weights
            return score[docs]

        docs = np.flatnonzero(seen)
        best = finish(docs)
        for k, c in enumerate(columns):
            if len(best) > top:
                best = np.partition(best, len(best) - top)[-top:]
            if len(best) == top:
                least = max(least, int(best.min()))
            members, of, summary = self.blocks[c]
            opened = np.flatnonzero(summary[:, np.searchsorted(of, columns[k:])] @ weights[k:] >= least)
            if not len(opened):
                continue
            docs = np.concatenate([members[b] for b in opened.tolist()])
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                best = np.concatenate([best, finish(docs)])
        docs = np.flatnonzero(seen & (score >= max(least, 1)))
        return docs, score[docs]


def search_shards(index: DataFrame, items: list[tuple], weights: dict[str, int], totals: tuple[int, int], floors: dict, top: int, size: int = BLOCK) -> DataFrame:
    """``item, doc_id, score`` of each shard's best documents, at most ``top`` of an item (a place in ``items``).

    ``items`` are lists of terms, ``weights`` their weights, ``totals`` the documents and terms of all shards, and
    ``floors`` scores under which a document of an item can't be a hit.
    """
    wanted = {term: (k, w) for k, (term, w) in enumerate(weights.items())}
    numbered = [np.array([wanted[t][0] for t in terms if t in wanted], np.int64) for terms in items]
    sent = index.sparkSession.sparkContext.broadcast((wanted, numbered, floors))

    def run(batches):
        wanted, numbered, floors = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                # the lists' numbers as arrays, without a Python object each
                cells = {c: batch.column(c)[k].values for c in ("lengths", "sizes", "docs", "tfs", "doc_ids")}
                row = {c: cells[c].to_numpy() for c in ("lengths", "sizes", "docs", "tfs")} | {"terms": batch.column("terms")[k].values.to_pylist()}
                shard = _Shard(row, wanted, numbered, size, totals)
                names = cells["doc_ids"].fill_null(np.iinfo(np.int64).max).to_numpy()
                found = [[], [], []]
                for item, terms in enumerate(numbered):
                    docs, scores = shard.search(terms, top, floors.get(item, 1))
                    if len(docs) > top:
                        first = np.lexsort((names[docs], -scores))[:top]
                        docs, scores = docs[first], scores[first]
                    found[0].append(np.full(len(docs), item))
                    found[1].append(docs)
                    found[2].append(scores)
                item, docs, scores = map(np.concatenate, found) if numbered else (np.zeros(0, np.int64),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), cells["doc_ids"].take(pa.array(docs, pa.int64())), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def _best(hits: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search_index(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of ``index`` (``index_documents``) for each item: ``item_id, rank, doc_id, score``.

    ``items`` has ``item_id, text``; rows that repeat an id are one item with the terms of all. Scores are whole numbers
    (see ``ranked_search``). Items are taken in blocks of about ITEM_TERMS terms, whose terms, weights and floors go to
    all tasks; the index stays where it is, and each shard sends its best hits only. One shard in FIRST is searched
    first: the score of an item's last hit there is a floor for all.
    """
    spark = index.sparkSession
    totals = index.agg(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    asked = items.groupBy("item_id").agg(F.flatten(F.collect_list(F.regexp_extract_all(lower_az(F.col("text")), F.lit(TERM), 0))).alias("terms")).select("item_id", F.array_distinct("terms").alias("terms"))
    blocks = math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / ITEM_TERMS)
    shape, found = "item_id long, rank int, doc_id long, score long", []
    for b in range(blocks if totals[0] else 0):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        terms = spark.createDataFrame([(t,) for t in {t for r in rows for t in r.terms}], "term string")
        lists = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.sizes").alias("n"))
        # a row a term asked for, so no more than the block has
        counts = lists.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")).collect()
        weights = {r.term: math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * r.df + 1))) for r in counts}
        lists = [r.terms for r in rows]
        few = index.where(F.pmod(F.xxhash64(F.element_at("doc_ids", 1), F.size("terms")), F.lit(FIRST)) == 0)
        last = _best(search_shards(few, lists, weights, totals, {}, top), top).where(F.col("rank") == top)
        floors = {r["item"]: r["score"] for r in last.select("item", "score").collect()}
        hits = _best(search_shards(index, lists, weights, totals, floors, top), top)
        names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], "item int, item_id long")
        found.append(hits.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    out = spark.createDataFrame([], shape)
    for part in found:
        out = out.unionByName(part)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best of all ``docs`` (``doc_id, text``) for each of ``items`` (``item_id, text``), by whole numbers.

    A document's score is the sum over the item's distinct terms of ``w * ((10^9 tf) div (1000 tf + 20 m))`` with
    ``w = floor(1000 ln((2N + 2) / (2df + 1)))`` and ``m = 50 + (50 n N) div L``: N documents with terms, L their terms
    with repeats, n those of the document. Hits have a score above 0; equal scores go by ascending doc_id, null last.

    Null and empty texts have no terms and are no hits; items without terms have none. Rows that repeat a document's
    id are documents of their own. An empty table on either side gives no rows.
    """
    return search_index(stored_index(docs), items, top)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), sums AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM docs WHERE len(terms) > 0),
tf AS (SELECT doc_id, len(terms)::BIGINT AS n, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM docs) GROUP BY doc_id, terms, term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS (
  SELECT item_id, doc_id, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS s
  FROM asked JOIN df USING (term) JOIN tf USING (term), sums
), scored AS (SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM part GROUP BY item_id, doc_id HAVING sum(s) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored
QUALIFY rank <= 50
"""
