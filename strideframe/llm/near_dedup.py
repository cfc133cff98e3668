"""Near-duplicate groups by HyperMinHash (operator 6)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, read, utf8, words

#: Registers of a signature and those of a band. Two sets of similarity 0.85 miss all of the 25 bands once in two million pairs.
REGISTERS, ROWS = 128, 5
BANDS = REGISTERS // ROWS
#: Bits of a register's mantissa; the leading zeros take the upper bits.
MANTISSA = 10
#: Standard errors by which the estimate of a pair may lie under the limit before the pair is given up: about
#: 1.4 links at the limit in 10**8 (4 in 10**5 at 4 standard errors), by the binomial of independent registers.
DOUBT = 6.0
#: Members of a bucket that are compared in one piece; a larger bucket is compared by pairs of such pieces.
PIECE = 1000
#: Token hashes that a task remembers before it starts anew.
REMEMBERED = 600_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(tokens: list[bytes], size: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than ``size`` are one shingle; no words, no shingle."""
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for k in range(min(size, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The HyperMinHash of a sorted set: the top bits of a hash choose a bucket; of the bucket's least hash its leading
    zeros and the MANTISSA bits after the first one are kept; 0 is an empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    bucket = (shingles >> np.uint64(57)).astype(np.int64)
    at, first = np.unique(bucket, return_index=True)
    rest = shingles[first] << np.uint64(7)
    top = rest >> np.uint64(11)  # 53 bits, exact as a float
    zeros = np.where(top > 0, 53 - np.frexp(top.astype(np.float64))[1], 53)
    zeros = np.minimum(zeros, 62)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out[at] = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def _corrected(equal: np.ndarray, filled: np.ndarray) -> np.ndarray:
    # registers of different minima agree with the chance that leading zeros (1/3) and mantissa (2**-MANTISSA) both do
    n = np.maximum(filled, 1)
    chance = n * (1 / 3) * 2.0**-MANTISSA
    return np.clip((equal - chance) / (n - chance), 0, 1)


def _hopeful(equal: np.ndarray, filled: np.ndarray, limit: float) -> np.ndarray:
    n = np.maximum(filled, 1)
    return _corrected(equal, filled) >= limit - DOUBT * np.sqrt(limit * (1 - limit) / n) - 1 / n


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    filled = (a > 0) | (b > 0)
    return ((a == b) & filled).sum(-1), filled.sum(-1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers (last axis), corrected for registers that agree by chance."""
    return _corrected(*_counts(a, b))


def hopeful(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Whether the estimate leaves the pair a chance to reach ``limit``; few filled registers leave more doubt."""
    return _hopeful(*_counts(a, b), limit)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _sets(docs: DataFrame, size: int, out: str, row: Callable[[int | None, np.ndarray], tuple]) -> DataFrame:
    """``row(doc_id, set)`` of each document as the columns ``out``."""
    names = [x.split()[0] for x in out.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    kinds = [types[x.split()[1]] for x in out.split(", ")]

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            rows = []
            for name, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                if len(hashes) > REMEMBERED:
                    hashes.clear()
                rows.append(row(name, shingle_set(words(text), size, hashes)))
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, set_digest, registers`` of each document."""

    def row(name, s):
        return name, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), registers(s).tobytes()

    return _sets(docs, size, "doc_id long, n_shingles long, set_digest binary, registers binary", row)


def band_keys(reps: DataFrame) -> DataFrame:
    """``bucket, band, doc_id`` for every band with a filled register."""

    def run(batches):
        for batch in batches:
            names = np.array(batch.column("doc_id").to_pylist(), np.int64)
            regs = np.array([np.frombuffer(x, np.uint16) for x in batch.column("registers").to_pylist()]).reshape(-1, REGISTERS)
            for j in range(BANDS if len(names) else 0):
                band = np.ascontiguousarray(regs[:, j * ROWS : (j + 1) * ROWS])
                filled = band.any(axis=1)
                keys = [xxhash.xxh64_intdigest(x.tobytes(), seed=j) for x in band[filled]]
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.array(keys, np.uint64))), pa.array(np.full(len(keys), j, np.int32)), pa.array(names[filled])], ["bucket", "band", "doc_id"])

    return reps.select("doc_id", "registers").mapInArrow(run, "bucket long, band int, doc_id long")


def _linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _star_pairs(members: DataFrame, regs: DataFrame, percent: int) -> DataFrame:
    """``a, b``: each bucket's least member with every other one, if the registers leave the pair a chance."""
    least = members.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("bucket", "a")
    pairs = members.join(least, "bucket").where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()
    both = pairs.join(regs.select(F.col("doc_id").alias("a"), F.col("registers").alias("ra")), "a").join(regs.select(F.col("doc_id").alias("b"), F.col("registers").alias("rb")), "b")

    @F.pandas_udf("boolean")
    def near(ra: pd.Series, rb: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(r), np.uint16).reshape(-1, REGISTERS) for r in (ra, rb))
        return pd.Series(hopeful(x, y, percent / 100))

    return both.where(near("ra", "rb")).select("a", "b")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, store: Store) -> DataFrame:
    """The pairs ``a, b`` that are linked by their full sets. The sets of a frequent ``a`` go to pieces of its partners."""
    pieces = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), (F.col("n") / 200).cast("long")))
    pairs = store.put("pairs", pairs)
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(counts, "a").select("a", "b", pieces.alias("piece"))
    right = dealt.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").select(F.col("a").alias("of"), F.col("piece").alias("at"), "b", "sb")
    left = dealt.select("a", "piece").distinct().join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")

    def check(one: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        found = []
        for sa in one["sa"]:
            x = np.frombuffer(sa, np.uint64)
            for a, b, sb in zip(many["of"], many["b"], many["sb"], strict=True):
                y = np.frombuffer(sb, np.uint64)
                if _linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                    found.append((a, b))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return left.groupBy("a", "piece").cogroup(right.groupBy("of", "at")).applyInPandas(check, "a long, b long")


def _compare(ids: np.ndarray, own: np.ndarray, component: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], band: int, across: bool, percent: int) -> list[tuple[int, int]]:
    """Links ``a, b`` among the members of two pieces of a bucket, rows by ascending id, that join components.

    Only members outside the largest component are held against all others. Pairs that share an earlier band too are
    left to that band's bucket.
    """
    n, found = len(ids), []
    root = np.unique(component, return_inverse=True)[1]
    large = root == np.bincount(root).argmax()
    size = np.array([len(x) for x in sets])
    # an empty register equals none
    right, empty = np.where(regs > 0, regs, np.uint16(65535)), (regs == 0).astype(np.float32)
    flat = np.ascontiguousarray(right.T)
    minor = np.flatnonzero(~large)
    for low in range(0, len(minor), 128):
        here = minor[low : low + 128]
        if n <= 64:
            equal = (regs[here][:, None, :] == right[None]).sum(-1)
        else:  # register by register, many pairs at once
            equal = np.zeros((len(here), n), np.uint8)
            for r in range(REGISTERS):
                equal += regs[here, r][:, None] == flat[r][None, :]
        filled = REGISTERS - empty[here] @ empty.T
        pairs = _hopeful(equal, filled, percent / 100) & (root[here][:, None] != root[None, :])
        pairs &= large[None, :] | (here[:, None] < np.arange(n)[None, :])
        pairs &= 100 * np.minimum(size[here][:, None], size[None, :]) >= percent * np.maximum(size[here][:, None], size[None, :])
        if across:
            pairs &= own[here][:, None] != own[None, :]
        for i in here[pairs.any(axis=1)].tolist():
            others = np.flatnonzero(pairs[np.searchsorted(here, i)])
            others = others[root[others] != root[i]]
            if band and len(others):
                shared = (regs[others, : band * ROWS] == regs[i, : band * ROWS]).reshape(-1, band, ROWS).all(axis=2)
                others = others[~(shared & regs[i, : band * ROWS].reshape(band, ROWS).any(axis=1)).any(axis=1)]
            if not len(others):
                continue
            every = np.concatenate([sets[j] for j in others])
            at = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
            common = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(size[others])[:-1]]))
            for j in others[100 * common >= percent * (size[others] + size[i] - common)].tolist():
                if root[j] != root[i]:
                    found.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                    root[root == root[j]] = root[i]
    return found


def _rest(members: DataFrame, labels: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets whose members don't all hang together yet: ``a, b``, enough of them to join what is linked.

    A bucket is cut into pieces of PIECE members and compared by pairs of pieces, each pair of members only in the first
    bucket that they share and only if they are of different components; within a pair of pieces, links already implied
    are left out. Most buckets hold two members, so a task goes through its sorted rows as one stream and holds one pair
    of pieces at a time. ``members``: ``bucket, band, doc_id``; ``full``: ``doc_id, registers, shingles``.
    """
    joined = members.join(labels, "doc_id")
    mixed = joined.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    cuts = F.greatest(F.lit(1), F.ceil(F.col("n") / PIECE)).cast("int")
    mine = joined.join(mixed, "bucket").select("bucket", "band", "doc_id", "component", cuts.alias("cuts"), F.pmod(F.xxhash64("doc_id"), cuts.cast("long")).cast("int").alias("own"))
    # a member goes to all pairs of pieces that hold its own
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.select("bucket", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "doc_id", "component")
    ready = dealt.join(full, "doc_id").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "doc_id")

    def run(batches):
        names = ("bucket", "band", "p", "q", "own", "doc_id", "component", "registers", "shingles")
        held: list[tuple] = []

        def links() -> list[tuple[int, int]]:
            _, bands, ps, qs, own, ids, component, regs, sets = zip(*held, strict=True)
            regs = np.frombuffer(b"".join(regs), np.uint16).reshape(-1, REGISTERS)
            return _compare(np.array(ids), np.array(own), np.array(component), regs, [np.frombuffer(x, np.uint64) for x in sets], bands[0], ps[0] != qs[0], percent)

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            found = []
            for row in zip(*[batch.column(x).to_pylist() for x in names], strict=True):
                if held and (held[0][0], held[0][2], held[0][3]) != (row[0], row[2], row[3]):
                    found += links()
                    held.clear()
                held.append(row)
            yield batch_of(found)
        if held:
            yield batch_of(links())

    return ready.mapInArrow(run, "a long, b long")


def components(links: DataFrame, store: Store, name: str) -> DataFrame:
    """``doc_id, component`` of all ends of the links ``a, b``: the smallest id that can be reached.

    Each round links every end to the smallest label around it and to that label's own label; the table is stored, and
    rounds end when no label falls. Labels only pass along links, so a chain of n documents takes about log n rounds.
    """
    both = store.put(f"{name}_links", links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = store.put(f"{name}_0", both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).select(F.col("a").alias("doc_id"), "component"))
    k = 0
    while True:
        around = both.join(labels, F.col("b") == F.col("doc_id")).groupBy("a").agg(F.min("component").alias("near"))
        merged = labels.join(around, F.col("doc_id") == F.col("a")).select("doc_id", "component", F.least("component", "near").alias("low"))
        # a document's old label follows it to the lower one
        hooked = merged.where("low < component").groupBy("component").agg(F.min("low").alias("under")).withColumnRenamed("component", "of")
        jump = merged.join(hooked, F.col("component") == F.col("of"), "left").select("doc_id", "component", F.least("low", F.coalesce("under", "low")).alias("low"))
        step = store.put(f"{name}_{k + 1}", jump)
        changed = step.where("low < component").limit(1).count()
        store.release(f"{name}_{k}")
        labels = step.select("doc_id", F.col("low").alias("component"))
        k += 1
        if not changed:
            return labels


def near_groups(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Words are lower-cased (A-Z) runs without white space; a document's set holds its distinct ``size``-word shingles.
    Documents are linked if ``100 * intersection >= percent * union``; components are those of all links.

    Equal sets are one class, by digest. Class representatives get HyperMinHash registers; bands of registers make
    buckets. Each bucket's least member is first compared with the others: estimated, then confirmed on full sets. What
    then doesn't hang together in a bucket is compared by pieces, so a link between members of a bucket is lost only
    if its estimate lies DOUBT standard errors under the limit, and no bucket is expanded into pairs. Registers are read again, and full sets made again, only for documents in buckets.

    Null and empty texts and texts without words have no shingles and are linked with nothing. Null ids: component null,
    kept. Rows that repeat an id are one node: their texts' links are united, each row has its own ``n_shingles``.
    """
    spark = docs.sparkSession
    store = Store(spark)
    sigs = store.put("signatures", signatures(docs, size))
    live = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = live.groupBy("set_digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.min("registers").alias("registers"))
    reps = classes.select(F.col("rep").alias("doc_id"), "registers")
    buckets = store.put("bands", band_keys(reps))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = store.put("members", buckets.join(shared, "bucket"))
    store.release("bands")
    wanted = members.select("doc_id").distinct()
    again = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    full = store.put("sets", _sets(again, size, "doc_id long, registers binary, shingles binary", lambda name, s: (name, registers(s).tobytes(), s.tobytes())))
    copies = live.join(classes.select("set_digest", "rep"), "set_digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    stars = store.put("stars", _confirm(_star_pairs(members, full, percent), full, percent, store))
    first = components(stars.union(copies), store, "first")
    labels = wanted.join(first, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    rest = store.put("rest", _rest(members, labels, full, percent))
    firsts = first.where("doc_id <> component").select(F.col("component").alias("a"), F.col("doc_id").alias("b"))
    last = components(firsts.union(rest), store, "last")
    store.release("members", "sets", "stars")
    out = sigs.join(last, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))
