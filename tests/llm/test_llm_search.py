"""Ranked search, spelling variants and packing against plain Python over all rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import unquote, urlparse

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from strideframe.llm import lexical_search, packing, spelling

DOCS = "doc_id long, text string, lang string, term string, word string, n long, item int, rank int, score long, tile int, ids string"


def documents(spark, rows):
    """Rows of (doc_id, text), with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", "x", "y", 1, 2, 3, 4, 5, "z") for i, t in rows], DOCS)


def prose(seed, docs, words, longest):
    """Texts of a few frequent and many rare words."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñz") for _ in range(r.randint(3, 9))) for _ in range(words)]
    return [" ".join(vocabulary[min(int(r.paretovariate(0.6)) - 1, words - 1)] for _ in range(r.randint(0, longest))) for _ in range(docs)]


# --- ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter()
    for _, b in bags:
        df.update(b.keys())
    asked = defaultdict(set)
    for name, text in items:
        asked[name].update(terms(text))
    out = []
    for name, wanted in asked.items():
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in wanted if t in df}
        scored = []
        for i, b in bags:
            m = 100 - 50 + 50 * sum(b.values()) * n_docs // total
            if (s := sum(w * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t, w in weights.items() if t in b)) > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(name, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("top", [1, 7, 50])
def test_search_equals_scoring_all(spark, monkeypatch, top):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 150)
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", 120)
    texts = prose(1, 900, 150, 60)
    docs = [(i * 3 % 1000, t) for i, t in enumerate(texts)]
    items = [(k, " ".join(random.Random(k).sample(t.split(), min(12, len(t.split()))))) for k, t in enumerate(prose(1, 30, 150, 60))]
    got = found(lexical_search.ranked_search(documents(spark, docs).repartition(2), spark.createDataFrame(items, "item_id long, text string"), top))
    assert got == plain_search(docs, items, top)


def test_blocks_are_left_out_but_no_hit_is(monkeypatch):
    """Two kinds of documents share frequent terms; the far kind's blocks stay closed."""
    r, rows = random.Random(5), []
    for i in range(3000):
        near = i % 3 == 0
        rows.append(["the", "of"] * (8 if near else 1) + [f"{'n' if near else 'f'}{r.randrange(40)}" for _ in range(30)])
    vocabulary = sorted({w for x in rows for w in x})
    counts = [Counter(x) for x in rows]
    lists = [[(k, c[w]) for k, c in enumerate(counts) if w in c] for w in vocabulary]
    row = {"lengths": np.array([len(x) for x in rows]), "sizes": np.array([len(x) for x in lists]), "terms": vocabulary}
    row |= {"docs": np.array([k for x in lists for k, _ in x], np.int32), "tfs": np.array([n for x in lists for _, n in x], np.int32)}
    wanted = {w: (k, 1000 if w[0] == "n" else 300) for k, w in enumerate(("the", "of", "n1", "n2", "n3", "n4"))}
    item = np.arange(len(wanted))
    shard = lexical_search._Shard(row, wanted, [item], 32, (len(rows), sum(row["lengths"].tolist())))
    opened = []
    finish = np.ix_
    monkeypatch.setattr(lexical_search.np, "ix_", lambda a, b: opened.append(len(a)) or finish(a, b))
    docs, scores = shard.search(item, 10, 1)
    monkeypatch.undo()
    exact = np.zeros(len(rows), np.int64)
    for t in item:
        of, impacts = shard.lists[int(t)]
        exact[of] += shard.weights[t] * impacts
    best = np.sort(exact)[-10:]
    assert sorted(scores.tolist())[-10:] == best.tolist() and (scores == exact[docs]).all()
    assert sum(opened) < len(rows) * 0.6


def test_a_shard_is_a_row_group(spark, monkeypatch):
    """a reader decodes a row group at once, so a task must not put all its shards into one."""
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 20)
    index = lexical_search.stored_index(documents(spark, list(enumerate(["a b a"] * 130))).coalesce(1))
    (file,) = index.inputFiles()
    groups = pq.ParquetFile(unquote(urlparse(file).path)).metadata
    assert [groups.row_group(k).num_rows for k in range(groups.num_row_groups)] == [1] * 7
    assert sum(len(r.doc_ids) for r in index.collect()) == 130


ODD = [(1, None), (2, ""), (3, " .,! "), (4, "Naïve ÀB cafe 12 x"), (4, "Naïve ÀB cafe 12 x"), (None, "cafe cafe"), (5, "À" * 5000 + " cafe"), (6, "\x00naïve\x1fCAFE-12")]


def test_search_of_odd_rows(spark):
    items = [(1, "CAFE"), (1, "x"), (2, None), (3, "!"), (4, "Naïve Àb 12 none")]
    got = found(lexical_search.ranked_search(documents(spark, ODD), spark.createDataFrame(items, "item_id long, text string")))
    assert got == plain_search(ODD, items, 50) and {g[0] for g in got} == {1, 4}


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "cafe")], "item_id long, text string")
    assert found(lexical_search.ranked_search(documents(spark, []), items)) == []
    assert found(lexical_search.ranked_search(documents(spark, ODD[:2]), items)) == []
    assert found(lexical_search.ranked_search(documents(spark, ODD), items.limit(0))) == []


# --- spelling variants


def plain_words(docs, slip, uses):
    totals = Counter()
    for i, text in docs:
        for run, n in Counter(re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))).items():
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            totals[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += n
    return {w: n for w, n in totals.items() if len(w) >= 6 and n >= uses}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_forms(words):
    out, forms = {}, {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 5 * n:
            forms[w] = best
        out[w] = [forms.get(w), None, n, len(near), words[best] if w in forms else None]
    for w in out:
        root = w
        while root in forms:
            root = forms[root]
        out[w][1] = root
    return sorted(((w, *x) for w, x in out.items()), key=str)


def got_forms(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


@pytest.mark.parametrize("tile", [3, 2048])
def test_forms_equal_comparing_all(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    r = random.Random(2)
    words = ["".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(250)]
    docs = [(i, " ".join(words[min(int(r.paretovariate(0.5)) - 1, 249)] for _ in range(200))) for i in range(60)]
    counts = spelling.word_counts(documents(spark, docs), slip=7).where("n >= 5")
    want = plain_words(docs, 7, 5)
    assert {x.word: x.n for x in counts.collect()} == want
    got = got_forms(spelling.spelling_forms(counts))
    assert got == plain_forms(want) and any(x[1] for x in got)


def test_chains_of_any_length(spark):
    """Each word is the form of the one before it."""
    words = [("aaaaaa", 1)] + [("b" * k + "a" * (6 - k), 5**k) for k in range(1, 7)] + [("bbbbbbb", 5**7), ("cccccc", 3)]
    got = got_forms(spelling.spelling_forms(spark.createDataFrame(words, "word string, n long")))
    assert got == plain_forms(dict(words)) and {x[2] for x in got} == {"bbbbbbb", "cccccc"}


def test_edits_at_either_end_and_anagrams(spark):
    words = dict.fromkeys(["abcdef", "xabcdef", "abcdefx", "abxcdef", "bacdef", "abcdeg", "zbcdef", "abcde", "aaaaaa", "aaaaaaa", "a" * 3000, "a" * 3001], 9)
    assert got_forms(spelling.spelling_forms(spark.createDataFrame([*words.items()], "word string, n long"))) == plain_forms(words)


def test_words_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "123 ..."), (4, "ÀÉÎÕÜÿ×÷ß Straßen STRASSEN"), (4, "straßen strassen"), (None, "straßen " * 4), (5, "q" * 70_000 + " straßen straßen")]
    assert {r.word: r.n for r in spelling.word_counts(documents(spark, docs), slip=3).collect()} == plain_words(docs, 3, 1)
    assert spelling.word_counts(documents(spark, [])).count() == 0
    assert got_forms(spelling.spelling_forms(spark.createDataFrame([], "word string, n long"))) == []
    rows = [("straße", 3), ("straße", 2), (None, 4), ("", 4), ("strasse", None), ("strafe", 25)]
    assert got_forms(spelling.spelling_forms(spark.createDataFrame(rows, "word string, n long"))) == [("strafe", None, "strafe", 25, 1, None), ("straße", "strafe", "strafe", 5, 1, 25)]


# --- packing


PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def padding(length, capacity=2048):
    return 0 if length & (length - 1) == 0 else capacity - length


def unpacked(df, capacity=2048):
    """Ids of each document's pieces, after the rules of pieces and sequences have been checked."""
    rows = df.collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()))
    lengths = []
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
        lengths.append(end)
    return docs, lengths


ODD_TEXTS = [
    "Hello, WORLD! It's 3.5 o'clock; don't.",
    None,
    "",
    " \t\n ",
    "Ünïcödé ǅ İstanbul ΣΑΣ Ωμέγα 中文字符没有空格 日本語 é é ẞ ﬁ",
    "a\x1cb\x1fc d e\x85f",
    "<|endoftext|> <|startoftext|>x",
    "x" * 5000,
    "?!... “quoted.” (End.) ...",
    "word " * 9000,
]


def test_pieces_give_back_the_library_ids(spark, library):
    docs, lengths = unpacked(packing.pack(documents(spark, list(enumerate(ODD_TEXTS))).coalesce(1), PATH))
    for i, text in enumerate(ODD_TEXTS):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        got, end = [], 0
        for start, length, total, ids in sorted(docs[i]):
            assert start == end and total == len(want)
            got, end = got + ids, start + length
        assert got == want


def test_every_plain_character_and_space(library):
    units = packing.Units(open(PATH, encoding="utf-8").read())
    for cp in [*range(0x250), 0x1680, *range(0x2000, 0x2030), 0x205F, 0x20AC, 0x3000, 0x345, 0x3A3, 0x1E9E, 0xFB01, 0x1F600]:
        text = f"Ab{chr(cp)}cD {chr(cp)}. e{chr(cp)}"
        assert units.text(text)[0].tolist() == library.encode(text, add_special_tokens=False).ids, hex(cp)


def test_long_texts_are_encoded_in_slices(library, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 40)
    text = " ".join(prose(4, 40, 60, 30))
    units = packing.Units(open(PATH, encoding="utf-8").read())
    assert units.text(text)[0].tolist() == library.encode(text, add_special_tokens=False).ids


def least_cost(places, penalties, capacity, shortest):
    """The cheapest packing by trying every begin of every end."""
    cost = [0.0]
    for j in range(1, len(places)):
        best = float("inf")
        for i in range(j):
            if (length := places[j] - places[i]) <= capacity:
                free = length & (length - 1) == 0 and (length >= shortest or length == capacity)
                best = min(best, cost[i] + (0 if free else capacity - length))
        cost.append(best + penalties[j] + packing.SEQUENCE)
    return cost


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_the_cheapest(seed):
    r = random.Random(seed)
    capacity, shortest = r.choice([16, 64]), r.choice([1, 4])
    places = np.cumsum([0] + [r.randint(1, capacity // r.choice([1, 2, 8])) for _ in range(120)])
    penalties = np.array([r.choice([0, 0, 4, 32]) for _ in places])
    cost, before = packing.choose_cuts(places, penalties, capacity, shortest)
    assert cost == least_cost(places.tolist(), penalties.tolist(), capacity, shortest)
    end, total = len(places) - 1, 0
    while end > 0:
        length = int(places[end] - places[before[end]])
        assert length <= capacity
        total += (0 if length & (length - 1) == 0 and length >= shortest else capacity - length) + int(penalties[end]) + packing.SEQUENCE
        end = before[end]
    assert total == cost[-1]


def test_little_padding_and_order(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 1 << 14)
    texts = [(i, t.replace(" ab", ". Ab")) for i, t in enumerate(prose(9, 1500, 400, 150))]
    df = packing.pack(documents(spark, texts).coalesce(2), PATH)
    docs, lengths = unpacked(df)
    assert len(docs) == 1500 and sum(map(padding, lengths)) < 0.02 * sum(lengths)
    rows = sorted(df.collect(), key=lambda r: (r.sequence_id, r.offset))
    inner = [r.doc_id for r in rows if r.sequence_id >> 33 == 0]
    assert inner == sorted(inner)
    split = sum(len(x) > 1 for x in docs.values())
    assert split < 0.5 * len(docs)


def test_packing_of_repeats_and_empty_tables(spark):
    rows = [(7, "same text"), (7, "same text"), (None, "no id"), (None, None)]
    out = packing.pack(documents(spark, rows).coalesce(1), PATH).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in out if r.start == 0) == [(False, 3), (False, 3), (True, 1), (True, 3)]
    assert packing.pack(documents(spark, []), PATH).count() == 0
    assert packing.pack(documents(spark, [(1, None)]), PATH).collect()[0].ids == b"\x01\0\0\0"
