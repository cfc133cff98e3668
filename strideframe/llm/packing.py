"""Packing documents into training sequences by order-preserving dynamic programming (operator 13)."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Recent, read

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END_ID = 2048, 1
#: What a cut costs, in tokens of padding: between sentences of a document, and anywhere else inside one.
AT_SENTENCE, INSIDE = 4, 32
#: What a sequence costs besides, so that few are made.
SEQUENCE = 8
#: The least power of two that counts as a length without padding before the end of a stream.
SHORTEST = 64
#: Stretches without a boundary can be cut every so many tokens.
STEP = 32
#: Tokens over which cuts are chosen together; a partition's stream goes through in such blocks, what is left open is carried on.
BLOCK = 1 << 18
#: Units of text that a Python worker remembers (those not met lately go first), and the longest that it remembers.
REMEMBERED, LONG = 2_000_000, 48
MARK = 0xFFFFFFFF
#: Characters that are encoded at once.
SLICE = 1 << 20

#: Texts without other characters than these are composed already and have lower-case forms that don't depend on their neighbours.
_OTHER = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u20ac]").search
#: White space of the vocabulary's pattern, which str.split() takes with four separators besides.
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_STOP = re.compile("[\"')\\].!?]*[.!?][\"')\\].!?]*</w>").fullmatch


def _plain(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _OTHER(text)
    return True


def _byte_letters() -> list[str]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as it is, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Units(Recent):
    """Token ids (little-endian unsigned 32-bit) of units without white space, found once and remembered.

    MARK follows those of a unit that ends a sentence.
    """

    def __init__(self, vocabulary: str):
        super().__init__(self.ids, REMEMBERED)
        self.whole = Tokenizer.from_str(vocabulary)
        self.model, self.letters = self.whole.model, _byte_letters()
        self.stops = {i for token, i in self.whole.get_vocab().items() if _STOP(token)}

    def __missing__(self, unit: str) -> bytes:
        return super().__missing__(unit) if len(unit) <= LONG else self.ids(unit)

    def ids(self, unit: str) -> bytes:
        if unit.isalpha() and unit.islower():  # one word, so the merges are all that is left to do
            written = unit if unit.isascii() else "".join(map(self.letters.__getitem__, unit.encode()))
            return _packed([x.id for x in self.model.tokenize(written)])
        if unit[-1] in ".," and unit[:-1].isalpha() and unit[:-1].islower():
            return self[unit[:-1]] + self[unit[-1]]
        found = self.whole.encode(unit, add_special_tokens=False).ids
        return _packed([*found, MARK] if found and found[-1] in self.stops else found)

    def text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text, and the places after its sentences."""
        self.trim()
        raw = []
        for part in _slices(text):
            # lower case and white space are what the vocabulary's own rules begin with
            part = part.lower() if _plain(part) else part
            units = filter(None, _SPACE.split(part)) if any(x in part for x in _SEPARATORS) else part.split()
            raw += map(self.__getitem__, units)
        ids = np.frombuffer(b"".join(raw), "<u4")
        marked = ids == MARK
        places = np.flatnonzero(marked)
        return ids[~marked], places - np.arange(len(places))


def _slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE:
        gap = _SPACE.search(text, at + SLICE)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


def choose_cuts(places: np.ndarray, penalties: np.ndarray, capacity: int = CAPACITY, shortest: int = 1) -> tuple[list[float], list[int]]:
    """Least cost of a packing that ends at each place, and the place (by index) before it.

    ``places`` ascend by ``capacity`` at most, and the first is where the packing begins. A sequence from one place to another costs SEQUENCE,
    its padding and the penalty of its end; at a power of two, ``shortest`` at least, there is no padding. The cheapest
    begin within ``capacity`` is the front of a queue that is kept monotone in cost plus place; the few begins a power
    of two back are looked up.
    """
    size = len(places)
    begins: list[tuple] = [()] * size  # of sequences without padding, by end
    for k in range(shortest.bit_length() - 1, capacity.bit_length() - 1):
        found = np.searchsorted(places, places - (1 << k))
        ends = np.flatnonzero(places[found] == places - (1 << k))
        for end, i in zip(ends.tolist(), found[ends].tolist(), strict=True):
            begins[end] = (*begins[end], i)
    at, extra = places.tolist(), (penalties + SEQUENCE).tolist()
    first = np.searchsorted(places, places - capacity).tolist()
    cost, before = [0] * size, [-1] * size
    # the queue: places by index and their keys, from ``front`` on; the place just before is always in it
    queue, keys, front = [0], [at[0]], 0
    for j in range(1, size):
        while queue[front] < first[j]:
            front += 1
        begin, place = queue[front], at[j]
        best = keys[front] + capacity - place
        for i in begins[j]:
            if cost[i] < best:
                best, begin = cost[i], i
        cost[j] = best = best + extra[j]
        before[j] = begin
        key = best + place
        while len(queue) > front and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
    return cost, before


class _Stream:
    """The open documents of a partition and the sequences made of them so far."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.sequence = capacity, first
        self.docs: list[list] = []  # id, ids, places after sentences, tokens that are packed already
        self.size = 0

    def add(self, doc_id, ids: np.ndarray, sentences: np.ndarray) -> None:
        self.docs.append([doc_id, ids, sentences, 0])
        self.size += len(ids)

    def places(self, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where the open tokens can be cut, and what each cut costs."""
        at, penalties, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, ids, sentences, done in self.docs:
            inner = sentences[(sentences > done) & (sentences < len(ids) - 1)] - done
            left = len(ids) - done
            at += [inner + base, np.array([left + base])]
            penalties += [np.full(len(inner), AT_SENTENCE), np.zeros(1, np.int64)]
            base += left
        at, penalties = np.concatenate(at), np.concatenate(penalties)
        steps = (np.diff(at) - 1) // STEP
        nth = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
        more = np.repeat(at[:-1], steps) + STEP * (nth + 1)
        if last:  # the end of the stream can be cut anywhere
            more = np.union1d(more, np.arange(max(1, base - self.capacity), base))
        more = np.setdiff1d(more, at)
        at, penalties = np.concatenate([at, more]), np.concatenate([penalties, np.full(len(more), INSIDE)])
        order = np.argsort(at, kind="stable")
        return at[order], penalties[order]

    def pack(self, last: bool) -> Iterator[tuple]:
        """Rows of the sequences that are settled: all, or those up to the cheapest place within reach of the end."""
        if not self.docs:
            return
        at, penalties = self.places(last)
        cost, before = choose_cuts(at, penalties, self.capacity, 1 if last else SHORTEST)
        end = len(at) - 1
        if not last:
            near = int(np.searchsorted(at, at[-1] - self.capacity, "right"))
            end = near + int(np.argmin(cost[near:]))
        cuts = []
        while end > 0:
            cuts.append(int(at[end]))
            end = before[end]
        begun = 0
        for cut in reversed(cuts):
            offset, room = 0, cut - begun
            while room:
                doc = self.docs[0]
                start, n = doc[3], min(room, len(doc[1]) - doc[3])
                yield doc[0], start, n, doc[1][start : start + n].tobytes(), len(doc[1]), self.sequence, offset
                offset, room, doc[3] = offset + n, room - n, start + n
                if doc[3] == len(doc[1]):
                    self.docs.pop(0)
            self.sequence += 1
            self.size -= cut - begun
            begun = cut


#: The units that a Python worker keeps from task to task, by the vocabulary's length and hash.
_kept: dict[tuple, Units] = {}


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    A document is its ids by ``vocabulary`` (a tokenizers file with lower case and dropped white space), without added
    special tokens, then ``end_id``. The documents of a partition stay in order and form one stream of ids, which is
    cut into sequences of at most ``capacity`` ids. Cuts lie between documents, else between sentences, else anywhere
    in long stretches without either (and near the end of the stream); they are chosen so that padding plus the
    penalties of cuts inside documents are least over each block of BLOCK ids. ``ids`` holds a piece's ids as
    little-endian unsigned 32-bit integers, ``start`` counts the ids of its document before it, ``offset`` those of
    its sequence. Nothing is shuffled and a task holds one block and one document at a time; at most one sequence a
    partition ends without a choice.

    Null text is an empty text: one piece with ``end_id`` alone. Rows keep their ids, repeated or null. An empty table
    has no pieces.
    """
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        text = sent.value
        if (name := (len(text), hash(text))) not in _kept:
            _kept.clear()
            _kept[name] = Units(text)
        units, end = _kept[name], np.array([end_id], "<u4")
        stream = _Stream(capacity, TaskContext.get().partitionId() << 33)

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, sentences = units.text(text or "")
                stream.add(doc_id, np.concatenate([ids, end]), sentences)
                if stream.size < BLOCK:
                    continue
                for row in stream.pack(last=False):
                    rows.append(row)
                    if (held := held + row[2]) > BLOCK:
                        yield table(rows)
                        rows, held = [], 0
        rows += stream.pack(last=True)
        if rows:
            yield table(rows)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def public_packing(docs: DataFrame) -> DataFrame:
    """``pack`` by the word vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = public_packing(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
