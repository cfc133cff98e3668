"""Spelling variants grouped by blocked Gram matrices of letter counts (operator 12)."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _TO_LOWER, Store, read

#: Least code points of a word, least uses, and how many times as frequent a form is as its variant.
LEAST, USES, RATIO = 6, 5, 5
#: Words of a tile. A block of equal letter-class counts is cut into tiles; two tiles are one task's matrix product.
TILE = 2048
#: Letter classes (code point modulo CLASSES) whose counts name a block.
CLASSES = 5
#: Distinct words that a task counts before it passes the counts on, and characters that are searched at once.
HELD, SLICE = 300_000, 1 << 22

_GAP = re.compile("[^A-Za-zÀ-ÿ]").search


def _slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE and (gap := _GAP(text, at + SLICE)):
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


def word_counts(docs: DataFrame, least: int = LEAST, slip: int = 0) -> DataFrame:
    """Runs of letters (A-Z, a-z, U+00C0 to U+00FF) of all texts with their uses: ``word, n``; only A-Z is lower-cased.

    With ``slip``, a run whose crc32 of ``<doc_id>:<run>`` is a multiple of it has lost the code point at that crc32
    modulo its length. Only results of ``least`` code points or more are counted. Counts are summed in the task first,
    so a frequent word is one row a task. Null texts have no words; a null id counts as empty text.
    """
    find = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall

    def run(batches):
        totals: Counter = Counter()

        def table():
            return pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for part in _slices(text or ""):
                    found = Counter(find(part.encode().translate(_TO_LOWER).decode()))
                    slipped = [x for x in found if zlib.crc32(x.encode(), begun) % slip == 0] if slip else []
                    for word in slipped:
                        n, at = found.pop(word), zlib.crc32(word.encode(), begun) % len(word)
                        if len(word) > least:
                            totals[word[:at] + word[at + 1 :]] += n
                    totals.update(found)
                if len(totals) > HELD:
                    yield table()
                    totals.clear()
        yield table()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def tiles(words: DataFrame) -> DataFrame:
    """``block, tile, words, ns``: the words of a block in code-point order, at most about TILE of them in a row.

    A block is the words with the same number of letters of each class, and so of one length; it is cut by hash.
    """
    letters = F.split("word", "")
    block = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.size(F.filter(letters, lambda c: F.ascii(c) % CLASSES == k)))
    placed = words.withColumn("block", block)
    sizes = placed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    cut = placed.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("parts")))
    rows = cut.groupBy("block", "tile").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("rows"))
    return rows.select("block", "tile", F.col("rows.word").alias("words"), F.col("rows.n").alias("ns"))


def _near_blocks() -> list[list[int]]:
    """What to add to a block's counts for the blocks to meet: itself, one letter more, and one letter of a later class for one of an earlier."""
    steps = [[0] * CLASSES]
    for a in range(CLASSES):
        steps.append([int(k == a) for k in range(CLASSES)])
        steps += [[int(k == a) - int(k == b) for k in range(CLASSES)] for b in range(a)]
    return steps


def tile_pairs(cut: DataFrame) -> DataFrame:
    """Each pair of tiles that can hold near words once: words and counts of either (``a_words, a_ns, b_words, b_ns, same``)."""
    names = cut.select("block", "tile")
    steps = F.array(*[F.array(*map(F.lit, step)) for step in _near_blocks()])
    met = names.select(F.col("block").alias("a_block"), F.col("tile").alias("a_tile"), F.explode(F.transform(steps, lambda s: F.zip_with("block", s, lambda x, y: x + y))).alias("block"))
    met = met.join(names, "block").where("a_block <> block or a_tile <= tile")
    # names meet first and bring the words after, so that a block of many tiles is dealt out by tile
    a = cut.select(F.col("block").alias("a_block"), F.col("tile").alias("a_tile"), F.col("words").alias("a_words"), F.col("ns").alias("a_ns"))
    b = cut.select("block", "tile", F.col("words").alias("b_words"), F.col("ns").alias("b_ns"))
    same = (F.col("a_block") == F.col("block")) & (F.col("a_tile") == F.col("tile"))
    return met.join(a, ["a_block", "a_tile"]).join(b, ["block", "tile"]).select("a_words", "a_ns", "b_words", "b_ns", same.alias("same"))


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def near_in_tiles(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (code points; ``b`` as long or one longer) that differ by one edit; each pair once if ``same``.

    A replaced letter makes the squared distance of letter counts 2, an inserted one 1; these alone are verified.
    """
    alphabet = np.unique(np.concatenate([a.ravel(), b.ravel()]))
    kind = np.float32 if b.shape[1] < 2000 else np.float64  # whole numbers stay exact

    def counts(x):
        at = np.searchsorted(alphabet, x) + np.arange(len(x))[:, None] * len(alphabet)
        return np.bincount(at.ravel(), minlength=len(x) * len(alphabet)).reshape(len(x), -1).astype(kind)

    x, y = counts(a), counts(b)
    longer = b.shape[1] - a.shape[1]
    # squared distances in one product: |x|^2 + |y|^2 - 2 x.y
    left = np.column_stack([x, (x * x).sum(1), np.ones(len(x), kind)])
    right = np.column_stack([-2 * y, np.ones(len(y), kind), (y * y).sum(1)])
    i, j = np.nonzero(left @ right.T == (1 if longer else 2))
    if same:
        i, j = i[i < j], j[i < j]
    keep = []
    for k in range(0, len(i), 1 << 18):
        p, q = a[i[k : k + (1 << 18)]], b[j[k : k + (1 << 18)]]
        if longer:
            n = p.shape[1]
            head = np.logical_and.accumulate(p == q[:, :n], axis=1).sum(1)
            tail = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1).sum(1)
            keep.append(head + tail >= n)
        else:
            keep.append((p != q).sum(1) == 1)
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def near_words(cut: DataFrame) -> DataFrame:
    """``word, n_near, form, form_n`` of each word of ``cut`` (``tiles``) with a near one: how many there are, and the most frequent (the first among equals).

    Near words differ by one inserted, deleted or replaced code point, so they lie in the same block of letter classes
    or in one that differs by a letter; every such pair of tiles is compared once by a product of letter counts.
    """

    def summary(words, of, to, to_ns, to_words):
        order = np.lexsort((to, -to_ns[to], of))
        of, to = of[order], to[order]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        near = np.diff(np.append(first, len(of)))
        return [words[k] for k in of[first].tolist()], near, to_ns[to[first]], [to_words[k] for k in to[first].tolist()]

    def run(batches):
        for batch in batches:
            found = [[], [], [], []]
            for a, a_ns, b, b_ns, same in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i, j = near_in_tiles(_codes(a), _codes(b), same)
                a_ns, b_ns = np.array(a_ns), np.array(b_ns)
                for part in (summary(a, i, j, b_ns, b), summary(b, j, i, a_ns, a)):
                    for column, more in zip(found, part, strict=True):
                        column.extend(more)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(found, kinds, strict=True)], ["word", "n_near", "form_n", "form"])

    parts = tile_pairs(cut).mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``words`` (``word, n``).

    ``form`` is the near word of largest n (ties: the first by code points) if that is at least ``ratio`` times the
    word's n, else null; ``root`` follows forms to the last. A form is more frequent by ``ratio``, so chains are as
    long as the logarithm of the largest n at most and are doubled as often as its logarithm says.

    Null and empty words and null n are left out; rows that repeat a word add up. An empty table has no rows.
    """
    store = Store(words.sparkSession)
    clean = words.where("length(word) > 0 and n is not null").groupBy("word").agg(F.sum("n").alias("n"))
    clean = store.put("words", clean)
    cut = store.put("tiles", tiles(clean))
    near = store.put("near", near_words(cut))
    store.release("tiles")
    takes = F.col("form_n") >= ratio * F.col("n")
    joined = clean.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n"))
    joined = store.put("forms", joined)
    store.release("words", "near")
    most = joined.agg(F.max("n").alias("most")).first().most or 1
    steps = max(1, int(math.log(max(most, 2), max(ratio, 2))))
    roots = joined.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(steps.bit_length()):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = store.put(f"roots{k}", roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        if k:
            store.release(f"roots{k - 1}")
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(word_counts(read(spark, sf_dir, "documents"), slip=199).where(F.col("n") >= USES))


#: DuckDB has no crc32, so its table of 256 remainders is derived; a run's bytes are those of ``<doc_id>:`` and of its
#: code points, which take two bytes from U+00C0 on.
SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
), runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]{6,}')) AS run FROM documents)
  GROUP BY ALL
), hashed AS (
  SELECT run, k, xor(list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''),
      lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM runs, crc_table
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS last, form FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.form = f.word
)
SELECT word, f.form, c.last AS root, n, n_near, form_n FROM forms f JOIN (SELECT word, last FROM chain WHERE form IS NULL) c USING (word)
"""
