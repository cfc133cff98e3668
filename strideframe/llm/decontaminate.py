"""Benchmark decontamination by template windows (operator 5)."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, read, utf8

#: Tokens of a window; an item with fewer, but LEAST at least before runs of names or numbers become one, is one window.
#: A window needs half of its tokens literal, and as many as half of LEAST.
WINDOW, LEAST = 8, 5
#: A document holds an item if this share of the item's windows stands in it in a row, or so many windows.
COVERAGE, RUN = 0.5, 20
#: Tokens that may be added or dropped inside an item: shifts that lie so close count as one run.
BAND = 8
#: Slots of a run whose values change one-to-one, as a share of all its slots.
CONSISTENT = 0.8
#: Bits of the filter of benchmark windows that is sent to the tasks, as bytes: 4 MB, whatever the benchmark.
FILTER = 1 << 22
#: Tokens that a task remembers before it starts anew.
REMEMBERED = 600_000
#: Units, in lower case.
UNITS = frozenset(
    "% $ € £ mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees".split()
)
_EDGE = b"\"'`.,;:!?()[]{}<>*#&|-_/\\~^=+"
_LITERAL, _NUMBER, _UNIT, _CAPITAL = 0, 1, 2, 3


class _Tokens(dict):
    """Index of each whitespace token; ``keys``, ``kinds`` and ``ends`` hold what canonicalisation makes of it."""

    def __init__(self):
        self.keys_, self.kinds, self.ends, self.raw = [], [], [], []

    def __missing__(self, token: bytes) -> int:
        text = token.decode()
        core = text.strip(_EDGE.decode()) or text
        low = core.lower()
        kind = _LITERAL
        if any(c.isdigit() for c in core):
            kind = _NUMBER
        elif low in UNITS:
            kind = _UNIT
        elif core[:1].isupper() and (len(core) == 1 or core[1:].islower()):
            kind = _CAPITAL
        self.keys_.append(xxhash.xxh64_intdigest(low.encode()))
        self.kinds.append(kind)
        self.ends.append(text.rstrip("\"')]}*")[-1:] in (".", "!", "?", ":"))
        self.raw.append(low)
        self[token] = at = len(self) + 1
        return at


_PLACES = np.array([xxhash.xxh64_intdigest(x) for x in (b"", b"<number>", b"<unit>", b"<name>")], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _windows(keys: np.ndarray, literal: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` keys and whether enough of its tokens are literal."""
    n = len(keys) - size + 1
    h = np.full(n, size, np.uint64)
    words = np.zeros(n, np.int16)
    for k in range(size):
        h = (h ^ keys[k : k + n]) * _STEP
        h ^= h >> np.uint64(29)
        words += literal[k : k + n]
    return h, (2 * words >= size) & (2 * words >= LEAST)


def _scan(rows: DataFrame, id_col: str, sizes, known=None) -> DataFrame:
    """``id, pos, size, key, slots`` of windows; with ``known`` (a broadcast filter) of those that may be the benchmark's.

    ``sizes`` gives the window sizes of a text by its tokens and its places. Neighbouring names, or numbers, of a sentence
    are one place. ``slots`` lists position and value of each placeholder.
    """

    def run(batches):
        tokens = _Tokens()
        arrays = {"size": 0}
        for batch in batches:
            out: dict[str, list] = defaultdict(list)
            if len(tokens) > REMEMBERED:
                tokens, arrays = _Tokens(), {"size": 0}
            split = [text.split() for text in utf8(batch.column("text"))]
            coded = [np.fromiter(map(tokens.__getitem__, raw), np.int64, len(raw)) for raw in split]
            if arrays["size"] != len(tokens):
                arrays = {"size": len(tokens), "keys": np.array([0, *tokens.keys_], np.uint64), "kinds": np.array([0, *tokens.kinds], np.int8), "ends": np.array([0, *tokens.ends], bool)}
            for name, at in zip(batch.column("id").to_pylist(), coded, strict=True):
                if not len(at):
                    continue
                kinds = arrays["kinds"][at]
                first = np.ones(len(at), bool)  # a capital after the end of a sentence isn't a name
                first[1:] = arrays["ends"][at[:-1]]
                kinds[(kinds == _CAPITAL) & first] = _LITERAL
                again = np.zeros(len(at), bool)
                again[1:] = (kinds[1:] == kinds[:-1]) & ((kinds[1:] == _CAPITAL) | (kinds[1:] == _NUMBER)) & ~first[1:]
                begins = np.flatnonzero(~again)
                ends, kinds = np.append(begins[1:], len(at)), kinds[begins]
                keys = np.where(kinds == _LITERAL, arrays["keys"][at[begins]], _PLACES[kinds])
                for size in sizes(len(at), len(begins)):
                    if len(begins) < size:
                        continue
                    h, fit = _windows(keys, kinds == _LITERAL, size)
                    if known is not None:
                        fit &= known.value[(h >> np.uint64(42)).astype(np.int64)]
                    for p in np.flatnonzero(fit).tolist():
                        places = np.flatnonzero(kinds[p : p + size]).tolist()
                        out["id"].append(name)
                        out["pos"].append(p)
                        out["size"].append(size)
                        out["key"].append(int(h[p].astype(np.int64)))
                        out["slots"].append([f"{k} {' '.join(tokens.raw[t - 1] for t in at[begins[p + k] : ends[p + k]])}" for k in places])
            kinds_ = {"id": pa.int64(), "pos": pa.int32(), "size": pa.int32(), "key": pa.int64(), "slots": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kind) for c, kind in kinds_.items()], list(kinds_))

    return rows.select(F.col(id_col).cast("long").alias("id"), "text").mapInArrow(run, "id long, pos int, size int, key long, slots array<string>")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``id, pos, size, key, slots`` of every informative window of the benchmark's items."""
    return _scan(benchmark, "item_id", lambda n, places: [min(places, WINDOW)] * (n >= LEAST))


def window_matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows that documents share with the benchmark: ``doc_id, doc_pos, item_id, item_pos, doc_slots, item_slots``."""
    spark = docs.sparkSession
    cells = windows.select(F.shiftrightunsigned("key", 42).alias("cell")).distinct()
    seen = np.zeros(FILTER, bool)
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # WINDOW sizes at most
    for (cell,) in cells.toLocalIterator():  # FILTER cells at most
        seen[cell] = True
    hits = _scan(docs, "doc_id", lambda n, places: sizes, spark.sparkContext.broadcast(seen))
    left = hits.select(F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), "size", "key", F.col("slots").alias("doc_slots"))
    right = windows.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "size", "key", F.col("slots").alias("item_slots"))
    return left.join(right, ["key", "size"]).where("doc_id is not null and item_id is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id, item_id, n_windows, coverage, n_slots, n_changed``.

    Tokens between white space lose their punctuation and case; numbers, units and names (capitalised inside a
    sentence) become typed placeholders, neighbouring names or numbers one. Windows of WINDOW such places are joined by
    hash. A run is the matches with one shift, the distance between the places in document and item, or those with
    shifts within BAND of each other, each window of the item at the shift that has most; so tokens may be added or
    dropped. It holds the item if it has COVERAGE of the item's windows or RUN of them, and if its slots are consistent:
    a value of the item always becomes the same value. So questions with other numbers or names are found
    (``n_changed`` slots differ), and texts that merely share a frame are not.

    Null and empty texts have no windows. Null ids are left out; rows that repeat an id count as one document. Items of
    fewer than LEAST tokens are too short to name and match nothing. No documents or no items: no rows.
    """
    windows = benchmark_windows(benchmark)
    totals = windows.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct("pos").alias("all"))
    matches = window_matches(docs, windows).withColumn("shift", F.col("doc_pos") - F.col("item_pos"))
    matches = Store(docs.sparkSession).put("matches", matches.select("doc_id", "item_id", "shift", "item_pos", "doc_slots", "item_slots"))
    shifts = matches.groupBy("doc_id", "item_id", "shift").agg(F.countDistinct("item_pos").alias("n"))
    # two of the bands 2 * BAND wide hold a shift; shifts within BAND of each other share one
    start = F.floor(F.col("shift") / BAND).cast("int")
    wide = matches.join(shifts, ["doc_id", "item_id", "shift"]).withColumn("band", F.explode(F.array(start, start - 1)))
    wide = wide.groupBy("doc_id", "item_id", "band", "item_pos").agg(F.max(F.struct("n", "shift", "doc_slots", "item_slots")).alias("m"))
    wide = wide.select("doc_id", "item_id", F.col("band").alias("shift"), "item_pos", "m.doc_slots", "m.item_slots", F.lit(True).alias("wide"))
    matches = matches.withColumn("wide", F.lit(False)).unionByName(wide)
    run = ["doc_id", "item_id", "wide", "shift"]
    # both sides have placeholders of the same kinds at the same places, or the keys would differ
    pairs = F.expr("transform(item_slots, (s, i) -> struct(item_pos + int(substring_index(s, ' ', 1)) as at, substr(s, instr(s, ' ') + 1) as of, substr(doc_slots[i], instr(doc_slots[i], ' ') + 1) as to))")
    # the item's first word, a capital inside a document's sentence, may have joined the name after it
    value = F.when(F.endswith("s.to", F.concat(F.lit(" "), "s.of")), F.col("s.of")).otherwise(F.col("s.to"))
    runs = matches.groupBy(*run).agg(F.countDistinct("item_pos").alias("n_windows"))
    slots = matches.where(F.size("item_slots") > 0).select(*run, F.explode(pairs).alias("s")).select(*run, "s.at", "s.of", value.alias("to")).distinct()
    values = slots.groupBy(*run, "of").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("to").alias("kinds"), F.count_if(F.col("to") != F.col("of")).alias("changed"))
    fits = values.groupBy(*run).agg(F.sum("n").alias("n_slots"), F.sum(F.when(F.col("kinds") == 1, F.col("n")).otherwise(0)).alias("same"), F.sum("changed").alias("n_changed"))
    held = runs.join(totals, "item_id").where((F.col("n_windows") >= COVERAGE * F.col("all")) | (F.col("n_windows") >= RUN))
    held = held.join(fits, run, "left").where((F.col("n_slots").isNull()) | (F.col("same") >= CONSISTENT * F.col("n_slots")))
    return held.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"),
        F.max(F.col("n_windows") / F.col("all")).alias("coverage"),
        F.max(F.coalesce("n_slots", F.lit(0))).alias("n_slots"),
        F.max(F.coalesce("n_changed", F.lit(0))).alias("n_changed"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
