"""Quality classification by an interpolated modified Kneser-Ney model of trusted text (operator 1)."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, read, utf8

#: Length of the longest n-grams, in characters; contexts run on over the ends of words.
ORDER = 6
#: Languages that get a model of their own, the most frequent ones; others and null use the one of all trusted texts.
LANGUAGES = 64
#: A document is rejected if its perplexity is over its language's quantile of trusted texts by more than the slack.
QUANTILE, SLACK = 0.99, 1.25
#: Steps of the logarithm of perplexity in which quantiles are counted, and windows that are looked up at once.
STEPS, WINDOW = 1000, 1 << 19
#: Bytes of one model's texts whose distinct windows are looked up together. Bounds of memory, not of results.
BLOCK = 6_000_000
#: Characters whose windows, and n-grams that, share a bucket.
BUCKET, BUCKET_GRAMS = 32_000_000, 300_000
ANY = "*"
_PAD, _END = "\x02", "\x03"
#: Odd multipliers of the n-gram hash, one a place, from a fixed seed.
_PLACES = np.random.default_rng(1).integers(1, 2**63, ORDER + 1, dtype=np.uint64) | np.uint64(1)
#: An odd multiplier, which spreads keys over 64 bits, and its inverse.
_SPREAD, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def text_codes(raw: bytes) -> np.ndarray:
    """Code points of a text with runs of white space as one space and none at its ends."""
    return np.frombuffer(b" ".join(raw.split()).decode().encode("utf-32-le"), np.uint32)


class Windows:
    """The n-grams of length ORDER of some texts, each with ORDER - 1 signs before it and one after it.

    ``keys`` are the distinct ones, as numbers from which their code points can be told, with their ``counts``.
    """

    def __init__(self, texts: list[np.ndarray]):
        pad, end = np.full(ORDER - 1, ord(_PAD), np.uint32), np.array([ord(_END)], np.uint32)
        codes = np.concatenate([x for t in texts for x in (pad, t, end)]) if texts else np.zeros(0, np.uint32)
        self.sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.starts = np.cumsum(np.append(0, self.sizes + ORDER - 1))[:-1]
        self.n = max(0, len(codes) - ORDER + 1)
        self.own = np.ones(self.n, bool)  # windows over the ends of texts are nobody's
        self.own[(self.starts[1:, None] - np.arange(1, ORDER)).ravel()] = False
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        self.alphabet = np.flatnonzero(seen)
        number = np.zeros(0x110000, np.uint32)
        number[self.alphabet] = np.arange(len(self.alphabet))
        self.units, self.parts = number[codes], ORDER
        self.bits = max(1, (len(self.alphabet) - 1).bit_length())
        if self.bits * ORDER > 64:  # a large alphabet: halves of windows are numbered first
            half, wide = ORDER // 2, self.units.astype(np.uint64)
            joined = np.zeros(len(wide) - half + 1, np.uint64)
            for k in range(half):
                joined = joined << np.uint64(21) | wide[k : len(wide) - half + 1 + k]
            self.alphabet, self.units = (x.astype(kind) for x, kind in zip(np.unique(joined, return_inverse=True), (np.uint64, np.uint32), strict=True))
            self.parts, self.bits = 2, 32
        found = [np.unique(self.at(lo)[self.own[lo : lo + WINDOW]], return_counts=True) for lo in range(0, self.n, WINDOW)]
        every = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.uint64)
        self.keys, which = np.unique(every, return_inverse=True)
        self.counts = np.bincount(which, np.concatenate([c for _, c in found]) if found else None, len(self.keys)).astype(np.int64)

    def at(self, lo: int) -> np.ndarray:
        """Keys of the WINDOW windows from place ``lo`` on."""
        n, step = min(WINDOW, self.n - lo), ORDER // self.parts
        out = np.zeros(n, np.uint64)
        for k in range(self.parts):
            out = out << np.uint64(self.bits) | self.units[lo + k * step : lo + k * step + n]
        return out * _SPREAD

    def codes(self) -> np.ndarray:
        """Code points of the distinct windows, a row each."""
        plain, mask = self.keys * _BACK, np.uint64((1 << self.bits) - 1)
        out = [self.alphabet[(plain >> np.uint64(self.bits * k) & mask).astype(np.int64)] for k in range(self.parts - 1, -1, -1)]
        if self.parts == 2:
            out = [x >> np.uint64(21 * k) & np.uint64(0x1FFFFF) for x in out for k in range(ORDER // 2 - 1, -1, -1)]
        return np.stack(out, 1).astype(np.uint32) if len(plain) else np.zeros((0, ORDER), np.uint32)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Each text's sum of the ``values`` of its windows; ``values`` in the order of ``keys``."""
        table, got = _Logs(self.keys, values), np.zeros(self.n)
        for lo in range(0, self.n, WINDOW):
            got[lo : lo + WINDOW] = table.find(self.at(lo))[1]
        got[~self.own] = 0.0
        return np.add.reduceat(got, self.starts) if len(self.starts) else np.zeros(0)


def gram_counts(texts: DataFrame) -> DataFrame:
    """``lang, ctx, sym, n``: n-grams of length ORDER of all ``texts`` (``lang, text``), first counted within a task.

    A text has ORDER - 1 signs before it and one after it, so every context has full length.
    """

    def count(batches):
        held: dict[str, list] = {}

        def rows():
            for lang, mine in held.items():
                found = Windows(mine)
                text = found.codes().tobytes().decode("utf-32-le")
                ctx = [text[i : i + ORDER - 1] for i in range(0, len(text), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ctx), pa.string()), pa.array(ctx, pa.string()), pa.array(list(text[ORDER - 1 :: ORDER]), pa.string()), pa.array(found.counts)], ["lang", "ctx", "sym", "n"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
                text = text_codes(raw)
                if len(text):
                    held.setdefault(lang, []).append(text)
                    size += len(text)
                if size > BLOCK:
                    yield from rows()
                    size = 0
        yield from rows()

    counted = texts.select("lang", "text").mapInArrow(count, "lang string, ctx string, sym string, n long")
    return counted.groupBy("lang", "ctx", "sym").agg(F.sum("n").alias("n"))


def kneser_ney(grams: DataFrame, store: Store) -> DataFrame:
    """``lang, ctx, sym, p, gamma``: the probability of every seen n-gram and the weight of what lies under its context.

    ``grams``: ``lang, ctx, sym, n`` as from ``gram_counts``. An n-gram's count is that of the text if it has full
    length, otherwise the number of characters seen before it. Counts 1, 2 and 3 or more are
    discounted by the usual estimates of each language and order; what is taken off goes to the next shorter context,
    by joins of the count tables on (language, context). Under single characters stands the uniform distribution over
    those seen and one for the rest.
    """
    levels = {ORDER - 1: store.put(f"level{ORDER - 1}", grams)}
    for size in range(ORDER - 2, -1, -1):
        levels[size] = store.put(f"level{size}", levels[size + 1].groupBy("lang", F.expr("substring(ctx, 2)").alias("ctx"), "sym").agg(F.count(F.lit(1)).alias("n")))
    once = [F.count_if(F.col("n") == k).cast("double").alias(f"t{k}") for k in (1, 2, 3, 4)]
    of_level = [own.groupBy("lang").agg(F.lit(size).alias("size"), *once) for size, own in levels.items()]
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))

    def discount(k: int) -> Column:
        d = F.lit(float(k)) - (k + 1) * y * F.try_divide(F.col(f"t{k + 1}"), F.col(f"t{k}"))
        return F.when(d.isNull(), 0.5 * k).otherwise(F.greatest(F.lit(0.05), F.least(d, F.lit(k - 0.05))))  # least skips nulls

    steps = store.put("steps", reduce(DataFrame.unionByName, of_level).select("lang", "size", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)]))
    taken = F.least(F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")), F.col("n"))
    same = Window.partitionBy("lang", "ctx")  # a group has a row a character of the alphabet at most
    for size, own in sorted(levels.items()):
        own = own.join(F.broadcast(steps.where(F.col("size") == size).drop("size")), "lang").withColumn("taken", taken)  # one row a language
        own = own.select("lang", "ctx", "sym", "n", "taken", F.sum("n").over(same).alias("total"), (F.sum("taken").over(same) / F.sum("n").over(same)).alias("gamma"), F.count(F.lit(1)).over(same).alias("syms"))
        if size:
            below = lower.select("lang", F.col("ctx").alias("short"), "sym", F.col("p").alias("q"))
            own = own.withColumn("short", F.expr("substring(ctx, 2)")).join(below, ["lang", "short", "sym"])
        else:
            own = own.withColumn("q", 1 / (1 + F.col("syms")))
        lower = store.put(f"p{size}", own.select("lang", "ctx", "sym", ((F.col("n") - F.col("taken")) / F.col("total") + F.col("gamma") * F.col("q")).alias("p"), "gamma"))
        store.release(f"level{size}")
    store.release("steps")
    out = lower
    for size in range(ORDER - 1):
        out = out.unionByName(store.spark.read.schema(lower.schema).parquet(f"{store.at}/p{size}"))
    return out


def _hash(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` code points that end at each place of the last axis, from place ``size`` - 1 on."""
    n = codes.shape[-1] - size + 1
    out = np.full((*codes.shape[:-1], n), _PLACES[size], np.uint64)
    for k in range(size):
        out += codes[..., size - 1 - k : size - 1 - k + n] * _PLACES[k]
    return out ^ (out >> np.uint64(29))


class _Logs:
    """Logarithms by hash: a sorted array, entered by the upper bits of the hash."""

    def __init__(self, hashes: np.ndarray, logs: np.ndarray):
        self.hashes, self.logs = hashes, logs
        bits = max(1, len(self.hashes).bit_length())
        self.shift = np.uint64(64 - bits)
        first = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.first = np.append(first, len(self.hashes))
        self.longest = int(np.diff(self.first).max())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is listed, and its logarithm or 0."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(len(h))
        at = self.first[(h >> self.shift).astype(np.int64)]
        found, out = np.zeros(len(h), bool), np.zeros(len(h))
        last = len(self.hashes) - 1
        here = np.arange(len(h))
        for _ in range(self.longest):
            place = np.minimum(at[here], last)
            seen = self.hashes[place]
            equal = seen == h[here]
            hit = here[equal]
            found[hit], out[hit] = True, self.logs[place[equal]]
            here = here[seen < h[here]]  # sorted: a larger hash ends the search
            at[here] += 1
            here = here[at[here] <= last]
            if not len(here):
                break
        return found, out


class Model:
    """The part of one language's model that a bucket has: n-gram probabilities ``p`` and context weights ``g`` by length."""

    def __init__(self, ctx: pa.Array, sym: pa.Array, p: np.ndarray, gamma: np.ndarray):
        size = pc.add(pc.utf8_length(ctx), 1).to_numpy()
        self.p, self.g = {}, {}
        for k in range(1, ORDER + 1):
            mine = np.flatnonzero(size == k)
            grams = pc.binary_join_element_wise(ctx.take(pa.array(mine)), sym.take(pa.array(mine)), "").to_pylist()
            codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, k)
            for kind, h, values in ((self.p, _hash(codes, k)[:, 0], p[mine]), (self.g, _hash(codes[:, : k - 1], k - 1)[:, 0], gamma[mine])):
                h, first = np.unique(h, return_index=True)
                kind[k] = _Logs(h, np.log(values[first].astype(float)))
        self.unseen = -np.log(1 + len(self.p[1].hashes))

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Natural log-probability of the last code point of each row, given those before it."""
        codes = codes.astype(np.uint64)
        out, todo = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(ORDER, 0, -1):
            now = codes[todo, ORDER - k :]
            found, logs = self.p[k].find(_hash(now, k)[:, 0])
            out[todo] += logs
            todo, now = todo[~found], now[~found]
            if not len(todo):
                return out
            out[todo] += self.g[k].find(_hash(now[:, : k - 1], k - 1)[:, 0])[1]
        out[todo] += self.unseen
        return out


def text_blocks(docs: DataFrame, names: list[str]) -> DataFrame:
    """Blocks of whole texts of one model: ``block, model, units, doc_ids, langs, lengths, text``, the texts compressed.

    ``names``: languages with a model of their own; a text of another one goes to ANY, if there is such a model.
    """

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: dict[str | None, list] = {}
        sizes: dict[str | None, int] = {}

        def block(name: str | None) -> pa.RecordBatch:
            nonlocal number
            ids, langs, texts = zip(*held.pop(name), strict=True)
            sizes.pop(name)
            text = b"".join(texts)
            lengths = [len(x) for x in texts]
            number += 1
            row = [(part << 24) + number, name, len(text), list(ids), list(langs), lengths, pa.compress(text, codec="zstd", asbytes=True)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], ["block", "model", "units", "doc_ids", "langs", "lengths", "text"])

        for batch in batches:
            for name, lang, raw in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
                model = lang if lang in names else ANY if ANY in names else None
                text = b" ".join(raw.split())
                held.setdefault(model, []).append((name, lang, text))
                sizes[model] = sizes.get(model, 0) + len(text) + 40
                if sizes[model] > BLOCK:
                    yield block(model)
                elif sum(sizes.values()) > 4 * BLOCK:
                    yield block(max(sizes, key=sizes.get))
        for model in list(held):
            yield block(model)

    out = "block long, model string, units long, doc_ids array<long>, langs array<string>, lengths array<long>, text binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, out)


def _open(row: dict, only: list[int] | None = None) -> tuple[Windows, list[int]]:
    """A block's windows, of its texts numbered ``only`` or of all, and the numbers of those texts that aren't empty."""
    text = memoryview(pa.decompress(row["text"], decompressed_size=row["units"], codec="zstd", asbytes=True)) if row["units"] else b""
    edges = np.cumsum([0, *row["lengths"]]).tolist()
    full = [i for i in (range(len(row["lengths"])) if only is None else only) if row["lengths"][i]] if row["model"] is not None else []
    return Windows([np.frombuffer(bytes(text[edges[i] : edges[i + 1]]).decode().encode("utf-32-le"), np.uint32) for i in full]), full


def _dealt(found: Windows, model: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct windows the code points, the bucket, which is that of the three characters before the last one, and
    the order by bucket and alphabet."""
    codes = found.codes()
    middle, which = np.unique(codes[:, -4:-1].astype(np.uint64) @ np.array([1 << 42, 1 << 21, 1], np.uint64), return_inverse=True)
    three = np.stack([middle >> np.uint64(42), middle >> np.uint64(21) & np.uint64(0x1FFFFF), middle & np.uint64(0x1FFFFF)], 1).astype("<u4").tobytes().decode("utf-32-le")
    bucket = np.array([zlib.crc32(((model or "") + three[i : i + 3]).encode()) % buckets for i in range(0, len(three), 3)], np.int64)[which]
    order = np.argsort(found.keys * _BACK)  # alphabetic, which packs well
    return codes, bucket, order[np.argsort(bucket[order], kind="stable")]


_SENT = "block long, model string, bucket int, n int, codes binary, counts binary"


def _sent(row: dict, found: Windows, buckets: int, counted: bool) -> pa.Table:
    """A block's distinct windows as one row a bucket."""
    codes, bucket, order = _dealt(found, row["model"], buckets)
    edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)).tolist()
    parts = [order[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    packed = lambda x: pa.compress(x.tobytes(), codec="zstd", asbytes=True)
    out = [[row["block"]] * len(parts), [row["model"]] * len(parts), [int(bucket[x[0]]) for x in parts], [len(x) for x in parts], [packed(codes[x].T) for x in parts], [packed(found.counts[x]) if counted else b"" for x in parts]]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({c.split()[0]: pa.array(x, kind) for c, x, kind in zip(_SENT.split(", "), out, kinds, strict=True)})


def _codes_of(row: dict) -> np.ndarray:
    return np.frombuffer(pa.decompress(row["codes"], decompressed_size=4 * ORDER * row["n"], codec="zstd", asbytes=True), np.uint32).reshape(ORDER, -1).T


def block_grams(blocks: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """``lang, ctx, sym, n`` as from ``gram_counts``, of all texts in ``blocks`` whose doc_id is in ``trusted``.

    Only ids are joined. A block sends the distinct windows of its trusted texts with their counts to buckets, which add them up.
    """
    at = blocks.select("block", F.posexplode("doc_ids").alias("i", "doc_id")).join(trusted, "doc_id", "left_semi").groupBy(F.col("block").alias("of")).agg(F.array_sort(F.collect_list("i")).alias("texts"))

    def send(block: pa.Table, mine: pa.Table) -> pa.Table:
        (row,) = block.to_pylist()
        chosen = [i for x in mine.column("texts").to_pylist() for i in x]
        return _sent(row, _open(row, chosen)[0], buckets, True)

    def add(sent: pa.Table) -> pa.Table:
        held: dict[str, list] = {}
        for row in sent.to_pylist():
            held.setdefault(row["model"], []).append((_codes_of(row), np.frombuffer(pa.decompress(row["counts"], decompressed_size=8 * row["n"], codec="zstd", asbytes=True), np.int64)))
        out: list[list] = [[], [], [], []]
        for lang, parts in held.items():
            codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            wide = codes.astype(np.uint64)
            a, b = ((wide[:, k] << np.uint64(42)) | (wide[:, k + 1] << np.uint64(21)) | wide[:, k + 2] for k in (0, 3))
            order = np.lexsort((b, a))
            first = np.flatnonzero(np.append(True, (np.diff(a[order]) > 0) | (np.diff(b[order]) != 0)))
            text = codes[order[first]].tobytes().decode("utf-32-le")
            out[0] += [lang] * len(first)
            out[1] += [text[i : i + ORDER - 1] for i in range(0, len(text), ORDER)]
            out[2] += list(text[ORDER - 1 :: ORDER])
            out[3] += np.add.reduceat(n[order], first).tolist()
        return pa.table({c: pa.array(x, kind) for c, x, kind in zip(("lang", "ctx", "sym", "n"), out, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)})

    sent = blocks.groupBy("block").cogroup(at.groupBy("of")).applyInArrow(send, _SENT)
    return sent.groupBy("bucket").applyInArrow(add, "lang string, ctx string, sym string, n long")


def with_any(grams: DataFrame) -> DataFrame:
    """The counts of each language, and under ANY those of all together; texts of no language's model are under ANY before."""
    every = grams.groupBy("ctx", "sym").agg(F.sum("n").alias("n")).select(F.lit(ANY).alias("lang"), "ctx", "sym", "n")
    return grams.where(F.col("lang") != ANY).unionByName(every)


def _n_buckets(blocks: DataFrame) -> int:
    return 1 + (blocks.agg(F.sum("units").alias("n")).first().n or 0) // BUCKET


def block_scores(blocks: DataFrame, table: DataFrame, store: Store) -> DataFrame:
    """``doc_id, lang, model, n_units, perplexity`` of every text of ``blocks`` by the ``table`` of ``kneser_ney``.

    A block sends its distinct windows to buckets and gets their scores back, so even the most frequent window comes from
    as many places as there are blocks. A bucket has the n-grams of four characters or more that belong to its windows,
    and all shorter ones. So neither the driver nor a task holds a model.
    """
    buckets = max(_n_buckets(blocks), 1 + table.count() // BUCKET_GRAMS)
    own = F.pmod(F.crc32(F.concat("lang", F.substring("ctx", -3, 3)).cast("binary")), F.lit(buckets)).cast("int")
    spread = table.select("lang", "ctx", "sym", F.col("p").cast("float"), F.col("gamma").cast("float")).withColumn("bucket", F.explode(F.when(F.length("ctx") >= 3, F.array(own)).otherwise(F.sequence(F.lit(0), F.lit(buckets - 1)))))

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _sent(row, _open(row)[0], buckets, False).to_batches()

    def look_up(wanted: pa.Table, known: pa.Table) -> pa.Table:
        known, scores = known.combine_chunks(), []
        models: dict[str, Model] = {}
        for row in wanted.select(["model", "n", "codes"]).to_pylist():
            if (name := row["model"]) not in models:
                mine = known.filter(pc.equal(known.column("lang"), name)).combine_chunks()
                models[name] = Model(*(mine.column(c).combine_chunks() for c in ("ctx", "sym")), *(mine.column(c).to_numpy() for c in ("p", "gamma")))
            scores.append(models[name].scores(_codes_of(row)).astype("<f4").tobytes())
        return pa.table({"of": wanted.column("block"), "part": wanted.column("bucket"), "value": pa.array(scores, pa.binary())})

    sent = blocks.select("block", "model", "units", "lengths", "text").mapInArrow(send, _SENT)
    back = store.put("back", sent.groupBy("bucket").cogroup(spread.groupBy("bucket")).applyInArrow(look_up, "of long, part int, value binary"))
    store.release(*[x for x in store.paths if x not in ("blocks", "back")])

    def score(block: pa.Table, came: pa.Table) -> pa.Table:
        (row,) = block.to_pylist()
        found, full = _open(row)
        order = _dealt(found, row["model"], buckets)[2]
        values, size = np.empty(len(order)), len(row["doc_ids"])
        values[order] = np.frombuffer(b"".join(came.sort_by("part").column("value").to_pylist()), "<f4")
        n, rated = [0] * size, [None] * size
        for i, units, total in zip(full, found.sizes.tolist(), found.sums(values).tolist(), strict=True):
            n[i], rated[i] = units, float(np.exp(min(700.0, -total / units)))
        out = (row["doc_ids"], row["langs"], [row["model"]] * size, n, rated)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64())
        return pa.table({c: pa.array(x, kind) for c, x, kind in zip(("doc_id", "lang", "model", "n_units", "perplexity"), out, kinds, strict=True)})

    out = "doc_id long, lang string, model string, n_units long, perplexity double"
    return store.put("scored", blocks.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(score, out))


def perplexities(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``doc_id, lang, model, n_units, perplexity`` of every whole text under its language's model, per character and end.

    ``sample``: ``lang, text``, the training texts; ANY is a language like others.
    An empty or null text has no units and perplexity null; so has every text without a model.
    """
    store = Store(docs.sparkSession)
    table = kneser_ney(gram_counts(sample), store)
    names = [r.lang for r in table.where("ctx = ''").select("lang").distinct().collect()]
    scored = block_scores(store.put_by("blocks", text_blocks(docs, names), "block"), table, store)
    store.release(*[x for x in store.paths if x != "scored"])
    return scored


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id``, once each, of documents that some label calls good and none calls bad or toxic."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select("doc_id")


def trusted_perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``perplexities`` by models of all texts of ``docs`` whose doc_id is in ``trusted``.

    The LANGUAGES languages with most trusted texts get a model each, and ANY has one of all trusted texts. Texts are
    stored once in blocks of one model, as a table bucketed by block; no text is shuffled.
    """
    store = Store(docs.sparkSession)
    known = docs.where(F.col("text").rlike(r"[^\x09-\x0D ]")).select("doc_id", "lang").join(trusted, "doc_id", "left_semi")
    langs = [r.lang for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()]
    names = [x for x in langs if x not in (None, ANY)][:LANGUAGES] + [ANY] * bool(langs)
    blocks = store.put_by("blocks", text_blocks(docs, names), "block")
    grams = with_any(store.put("grams", block_grams(blocks, trusted, _n_buckets(blocks))))
    table = kneser_ney(grams, store)
    store.release("grams")
    scored = block_scores(blocks, table, store)
    store.release(*[x for x in store.paths if x != "scored"])
    return scored


def classify_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """One row per document: ``doc_id, lang, model, n_units, perplexity, threshold, kept``.

    A character model of each language is trained on all its trusted documents. A language's threshold is
    ``slack`` times the ``quantile`` of the perplexities of all its trusted documents, rounded up to 1/STEPS of its
    logarithm. A document goes if its perplexity is over the threshold. Rows that repeat an id are each scored and kept
    or not; a null id has no label and is scored. Texts without words, and all texts if nothing is trusted, have null perplexity
    and are kept. Null and rare languages use the model and threshold of all trusted texts.
    """
    trusted = trusted_ids(labels)
    scored = trusted_perplexities(docs, trusted)
    good = scored.join(trusted, "doc_id", "left_semi").where("perplexity is not null")
    both = good.select("perplexity", F.explode(F.array_distinct(F.array("model", F.lit(ANY)))).alias("model"))
    # counted in steps of the logarithm: a few thousand rows a model, however many documents
    steps = both.groupBy("model", F.ceil(F.ln("perplexity") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    so_far = steps.select("model", "step", F.sum("n").over(Window.partitionBy("model").orderBy("step")).alias("upto"), F.sum("n").over(Window.partitionBy("model")).alias("all"))
    limits = so_far.where(F.col("upto") >= quantile * F.col("all")).groupBy("model").agg((F.exp(F.min("step") / STEPS) * slack).alias("threshold"))  # one row a model
    out = scored.join(F.broadcast(limits), "model", "left")
    over = F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False))
    return out.select("doc_id", "lang", "model", "n_units", "perplexity", "threshold", (~over).alias("kept"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
