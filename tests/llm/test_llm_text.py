"""Operators that work on one text or one row at a time: chat format, URL rules, BPE, language, quality, suffix tree."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from strideframe.llm import byte_bpe, chat_format, language_id, quality, suffix_lm, url_filter
from strideframe.llm.common import Store, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, word string"


def documents(spark, rows):
    """Rows of (doc_id, text, lang), with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), True, "x") for i, t, lang in rows], DOCS)


def prose(seed, n, stems):
    r = random.Random(seed)
    return " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 3))) for _ in range(n))


EN, FR = ["the", "er", "ing", "of", "and", "tion"], ["eau", "oi", "ré", "queu", "ê", "ment"]
ODD = [
    (1, "Hello world, hello!", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "  two  spaces\n\n and\ttabs   nbsp ", "en"),
    (5, "don't we'll I'm ÉÀ ßtraße 12345 $%^ \U0001f600\U0001f600", "fr"),
    (5, "don't we'll I'm ÉÀ ßtraße 12345 $%^ \U0001f600\U0001f600", "fr"),
    (None, "no id", "de"),
    (6, "x" * 3000, "en"),
    (7, " leading", "en"),
    (8, "trailing ", "en"),
    (9, "\n", "en"),
    (10, prose(3, 4000, EN + FR), "en"),
]


# --- byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("size", [0, 3, 1 << 15])
def test_bpe_equals_library_whatever_the_dictionary(spark, bpe, monkeypatch, size):
    ranks, enc = bpe
    monkeypatch.setattr(byte_bpe, "DICTIONARY", size)
    got = byte_bpe.encode(documents(spark, ODD), ranks, public_tokenizers.PATTERN, digests=False).collect()
    assert len(got) == len(ODD)
    want = Counter((i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in ODD)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_bpe_digests_and_empty_table(spark, bpe):
    ranks, enc = bpe
    got = {r.doc_id: r for r in byte_bpe.public_encoding(documents(spark, ODD[:3])).collect()}
    ids = np.array(enc.encode_ordinary(ODD[0][1]), "<u4").tobytes()
    assert got[1].ids_sha256 == hashlib.sha256(ids).hexdigest() and got[1].decoded_sha256 == hashlib.sha256(ODD[0][1].encode()).hexdigest()
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest() == got[3].decoded_sha256
    assert byte_bpe.public_encoding(documents(spark, [])).count() == 0


def test_fold_in_spark_equals_fold_of_one_word(spark, bpe):
    ranks, enc = bpe
    found = [w.encode() for w in {m for _, t, _ in ODD for m in (t or "x").split()} if len(w) < 60] + [b" the", b"\xff\xfe"]
    df = spark.createDataFrame([(bytearray(w),) for w in found], "word binary")
    table = byte_bpe.rank_literal(ranks)
    for w, ids in df.select("word", byte_bpe.fold_merges(df["word"], table)).collect():
        assert ids == byte_bpe.merge_word(bytes(w), ranks)


# --- chat format


def test_escape_round_trip_and_no_control_left():
    r = random.Random(5)
    parts = [*chat_format.CONTROLS, "\\", "<", "|", ">", "[", "/", "a", "é", "\n", "turn|>", "<\\|turn|>"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        escaped = chat_format.escape(text)
        assert chat_format.unescape(escaped) == text
        assert not any(c in escaped for c in chat_format.CONTROLS)


CHAT = [
    (1, 1, "assistant", "answer <|end|> é\U0001f600"),
    (1, 0, "user", " question\n"),
    (1, 2, "assistant", "  spaced  \n"),
    (2, 0, "user", None),
    (2, 1, None, "x"),
    (2, 1, "assistant", ""),
    (3, 0, "assistant", "</s>[INST] ok [/INST]\\"),
    (3, 0, "assistant", "</s>[INST] ok [/INST]\\"),
    (None, 0, "assistant", "no id"),
    (4, None, "assistant", "no turn"),
]


@pytest.mark.parametrize("window", [1, 4_000_000])
def test_chat_digests_against_plain_python(spark, monkeypatch, window):
    monkeypatch.setattr(chat_format, "WINDOW", window)
    df = spark.createDataFrame([(*r, "clash") for r in CHAT], "conv_id long, turn int, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.format_conversations(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        turns = sorted((x for x in CHAT if x[0] == conv), key=lambda x: tuple((v is not None, v or 0) if k < 1 else (v is not None, v or "") for k, v in enumerate(x[1:])))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_outputs_mask_only_trained_text(spark):
    df = spark.createDataFrame(CHAT[:3], "conv_id long, turn int, role string, text string")
    (row,) = chat_format.format_conversations(df, public_tokenizers.path("byte_bpe_50k.json"), outputs=True).collect()
    encoder = chat_format.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    coded = encoder.encode(row.formatted, add_special_tokens=False)
    assert coded.ids == row.ids
    under = sorted({c for (a, b), on in zip(coded.offsets, row.loss_mask, strict=True) if on for c in range(a, b)})
    assert chat_format.unescape("".join(row.formatted[c] for c in under)) == CHAT[0][3] + CHAT[2][3]
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat_format.format_conversations(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# --- URL rules

URLS = [
    "https://www.example.com/en/1", "http://a.example.com/en/2?x=://", "HTTP://Example.COM/EN/", "https://example.com", "https://example.com/en", "https://example.net/es/9#t",
    "ftp://net/fr/", "x.org/en/", None, "", "://com/", "https://com/x", "https://notcom/x", "https://www.example.com.net/es/", "https://a..com/b", "https://é.com/é?é", "https://com#/x", "https://com?/x",
]


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("rules", [url_filter.RULES, url_filter.RULES[:1], [*url_filter.RULES, ("block", "é.com", "/é"), ("block", "example.com", "")]])
def test_urls_against_plain_python(spark, rules):
    pages = spark.createDataFrame([(k % 15, u, "h", "r") for k, u in enumerate(URLS + URLS[:4] + URLS[:1] * 3)], "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))
    want = Counter((r.page_id, *plain_verdict(r.url, rules)) for r in pages.collect())
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == want


def test_urls_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert {(r.rule, r.verdict) for r in url_filter.judge_urls(pages, none).collect()} == {(None, "allow")}
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0


# --- language


def test_language_held_out_accuracy_and_undecided(spark):
    rows = [(k, prose(k, 60, EN if k % 3 else FR), "en" if k % 3 else "fr") for k in range(300)]
    docs = documents(spark, rows)
    known = language_id.dictionaries(docs.where("doc_id % 5 <> 0"))
    assert list(known) == ["en", "fr"] and all(len(x.decode()) <= language_id.SLOTS * (language_id.SLICE + 1) for x in known.values())
    got = {r.doc_id: r for r in language_id.identify(docs.where("doc_id % 5 = 0"), known).collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in rows if k % 5 == 0) / len(got) > 0.98
    odd = documents(spark, [(1, None, "en"), (2, "", None), (3, "12 !?", "en"), (None, rows[1][1], None), (4, rows[3][1] * 50, None), (4, rows[3][1] * 50, None)])
    found = sorted((str(r.doc_id), r.lang_pred, r.score, r.accepted) for r in language_id.identify(odd, known).collect())
    assert [x[1] for x in found] == ["und", "und", "und", "fr", "fr", "en"]
    assert all(0 <= x[2] <= 1 for x in found) and not any(x[3] for x in found[:3])


def test_language_without_training_text(spark):
    docs = documents(spark, [(1, "text", None), (2, None, "en")])
    assert language_id.dictionaries(docs) == {}
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_merges_are_those_of_tiktoken():
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    r, pairs = random.Random(3), byte_bpe.byte_pairs(ranks)
    whole = tiktoken.Encoding("x", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    for word in [b"a", b"aa" * 40, *(" ".join(prose(k, 3, EN + FR).split()).encode() for k in range(200)), *(bytes(r.randrange(256) for _ in range(r.randrange(1, 25))) for _ in range(300))]:
        got = byte_bpe.merge_word(word, ranks, pairs)
        assert got == byte_bpe.merge_word(word, ranks) and byte_bpe.packed(got) == np.array(got, "<u4").tobytes()
        assert got == whole._core_bpe.encode_single_piece(word)


# --- quality


def test_kneser_ney_is_a_distribution(spark):
    from strideframe.llm.common import Store

    sample = spark.createDataFrame([("en", prose(1, 400, EN)), ("fr", prose(2, 300, FR)), ("tiny", "ab")], "lang string, text string")
    rows = quality.kneser_ney(quality.gram_counts(sample), Store(spark)).collect()
    for lang in ("en", "fr", "tiny"):
        p = {(r.ctx, r.sym): math.log(r.p) for r in rows if r.lang == lang}
        gamma = {r.ctx: math.log(r.gamma) for r in rows if r.lang == lang}
        flat = {c + s: v for (c, s), v in p.items()}
        symbols = {s for c, s in p if c == ""}
        unseen = -math.log(1 + len(symbols))
        for ctx in gamma:
            total = 0.0
            for s in [*symbols, "\x05"]:  # \x05 stands for all symbols never seen
                low, add = ctx, 0.0
                while True:
                    if low + s in flat:
                        total += math.exp(add + flat[low + s])
                        break
                    add += gamma.get(low, 0.0)
                    if not low:
                        total += math.exp(add + unseen)
                        break
                    low = low[1:]
            assert total == pytest.approx(1.0, abs=1e-6)


def plain_kneser_ney(texts):
    """Score function of the interpolated modified Kneser-Ney model of ``texts``, by recursion over plain dicts."""
    n = quality.ORDER
    levels = {n - 1: Counter()}
    for text in texts:
        t = "\x02" * (n - 1) + text + "\x03"
        for i in range(n - 1, len(t)):
            levels[n - 1][t[i - n + 1 : i], t[i]] += 1
    for size in range(n - 2, -1, -1):
        levels[size] = Counter((ctx[1:], sym) for ctx, sym in levels[size + 1])
    symbols = {s for _, s in levels[0]}

    def discounts(counts):
        t = Counter(counts.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + t[2] else None
        return [0.5 * k if y is None or not t[k] else max(0.05, min(k - (k + 1) * y * t[k + 1] / t[k], k - 0.05)) for k in (1, 2, 3)]

    off = {size: discounts(c) for size, c in levels.items()}
    under = {size: {} for size in levels}
    for size, counts in levels.items():
        for (ctx, sym), c in counts.items():
            under[size].setdefault(ctx, {})[sym] = c

    def prob(ctx, sym):
        below = prob(ctx[1:], sym) if ctx else 1 / (1 + len(symbols))
        seen = under[len(ctx)].get(ctx)
        if not seen:
            return below
        take = {s: min(off[len(ctx)][min(c, 3) - 1], c) for s, c in seen.items()}
        return (seen.get(sym, 0) - take.get(sym, 0) + sum(take.values()) * below) / sum(seen.values())

    def perplexity(text):
        t = "\x02" * (n - 1) + " ".join(text.split()) + "\x03"
        return math.exp(-sum(math.log(prob(t[i - n + 1 : i], t[i])) for i in range(n - 1, len(t))) / (len(t) - n + 1))

    return perplexity


def test_perplexity_equals_plain_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(quality, "WINDOW", 700)
    known = {"en": [prose(k, 60, EN) for k in range(5)], "fr": [prose(k, 50, FR) for k in range(4)]}
    sample = spark.createDataFrame([(x, t) for x, ts in known.items() for t in ts], "lang string, text string")
    plain = {x: plain_kneser_ney(ts) for x, ts in known.items()}
    texts = [prose(20, 30, EN), prose(21, 400, EN), prose(22, 40, FR), "zq\u4e2d\U0001f600 the", "a", "For For\n\tFor  For"]
    rows = [(i, t, x) for i, (t, x) in enumerate((t, x) for t in texts for x in known)]
    got = {r.doc_id: r for r in quality.perplexities(documents(spark, rows), sample).collect()}
    for i, t, x in rows:
        assert got[i].perplexity == pytest.approx(plain[x](t), rel=1e-5)
        assert got[i].n_units == len(" ".join(t.split())) + 1


def test_quality_keeps_prose_and_drops_noise(spark):
    r = random.Random(9)
    noise = lambda k: " ".join("".join(r.choice("xqzj#$%&") for _ in range(7)) for _ in range(40))
    rows = [(k, prose(k, 80, EN if k % 2 else FR), "en" if k % 2 else "fr") for k in range(200)] + [(k, noise(k), "en") for k in range(200, 220)]
    rows += [(300, None, "en"), (301, "", None), (302, " \n", "en"), (303, prose(5, 40, EN), None), (None, prose(6, 40, EN), "en"), (304, prose(7, 40, EN), "rare"), (5, prose(5, 80, EN), "en")]
    labels = spark.createDataFrame([(k, int(k < 200), 0) for k in range(0, 220, 2)] + [(k, 1, 0) for k in range(1, 100, 2)] + [(1, 0, 0), (3, 1, 1), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify_quality(documents(spark, rows), labels).collect()
    assert len(got) == len(rows)
    assert not any(x.kept for x in got if x.doc_id is not None and 200 <= x.doc_id < 220)
    assert sum(x.kept for x in got if x.doc_id is not None and x.doc_id < 200) >= 198
    assert all(x.kept and x.perplexity is None for x in got if x.doc_id in (300, 301, 302))
    assert {x.model for x in got if x.doc_id in (303, 304)} == {"*"}
    nothing = quality.classify_quality(documents(spark, rows[:3]), labels.limit(0)).collect()
    assert all(x.kept and x.perplexity is None for x in nothing)
    assert quality.classify_quality(documents(spark, []), labels).count() == 0


# --- suffix tree


def test_suffix_tree_base_score_and_gain(spark, monkeypatch):
    r = random.Random(4)
    follow = {w: [f"w{r.randrange(30)}" for _ in range(2)] for w in (f"w{k}" for k in range(30))}

    def chain(n):
        out = ["w0"]
        while len(out) < n:
            out.append(r.choice(follow[out[-1]]))
        return " ".join(out)

    rows = [(k, chain(120).upper() if k % 4 == 0 else chain(120), "en") for k in range(150)]
    rows += [(1000, None, "en"), (1001, "", "en"), (None, "W1 w2\x0bneverseen", "en"), (3, "w1 w1", "en")]
    monkeypatch.setattr(suffix_lm, "BLOCK", 5000)
    got = suffix_lm.suffix_scores(documents(spark, rows)).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [(i, [*words((t or "").encode()), None]) for i, t, _ in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda ws: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(base(ws), 6)) for i, ws in tokens)
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    far = [x for x in got if x.held_out and x.n_tokens > 50]
    assert len(far) > 5 and all(x.score > x.base_score * 0.5 for x in far)  # two followers a word, not thirty
    assert all(x.score < 0 for x in got)


def test_suffix_tree_sums_to_one():
    symbols = suffix_lm.Symbols({b"a": 2, b"b": 3}, np.array([3.0, 4.0, 8.0, 6.0]))
    level1 = {"codes": np.array([2]), "all": np.array([8.0]), "key": np.array([2, 3]), "n": np.array([5, 2]), "node": np.array([0, 0]), "stays": np.array([True])}
    # one context (symbol 2) with followers 2 (5 times) and 3 (2 times), one use unlisted
    level1["weight"] = np.array([(0.5 * 2 + 8 - 7) / 8])
    level1["gain"] = np.array([4.5 / 8, 1.5 / 8])
    p = [suffix_lm.symbol_scores(np.array([2, s]), np.array([0]), symbols, [level1])[1] for s in range(4)]
    assert sum(p) == pytest.approx(1.0)


def test_suffix_tree_without_training_text_and_empty(spark):
    only_held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    (row,) = suffix_lm.suffix_scores(documents(spark, [(only_held, "a b a", "en")])).collect()
    assert (row.n_known, row.train_tokens, row.n_tokens) == (0, 0, 4) and row.base_score == pytest.approx(0.0)
    assert suffix_lm.suffix_scores(documents(spark, [])).count() == 0


def plain_suffix_scores(rows, held):
    """The tree of all contexts in plain Python: score of each row."""
    depth, end = suffix_lm.DEPTH, None
    docs = [(i, [*words((t or "").encode()), end]) for i, t, _ in rows]
    c, n = Counter(), Counter()
    for i, ws in docs:
        full = [end] * depth + ws
        for at in range(depth, len(full) if not held(i) else 0):
            c[full[at]] += 1
            for k in range(1, depth + 1):
                n[tuple(full[at - k : at]), full[at]] += 1
    total, uses, kinds, evidence = sum(c.values()), Counter(), Counter(), Counter()
    for (ctx, _), k in n.items():
        uses[ctx] += k
        kinds[ctx] += 1
    for (ctx, w), k in n.items():
        under = n[ctx[1:], w] / uses[ctx[1:]] if len(ctx) > 1 else c[w] / total
        evidence[ctx] += k * math.log(k / uses[ctx] / under)
    stays = {ctx for ctx in uses if evidence[ctx] >= suffix_lm.EVIDENCE * math.log(total)}
    stays |= {ctx[k:] for ctx in stays for k in range(1, len(ctx))}
    new = min(max(sum(k == 1 for w, k in c.items() if w is not end) / total, 1 / (total + 1)), 0.5)
    out = []
    for i, ws in docs:
        full, s = [end] * depth + ws, 0.0
        for at in range(depth, len(full)):
            w = full[at]
            p = (1 - new) * c[w] / total if c[w] else new
            for k in range(1, depth + 1):
                if (ctx := tuple(full[at - k : at])) in stays:
                    p = max(n[ctx, w] - suffix_lm.DISCOUNT, 0) / uses[ctx] + suffix_lm.DISCOUNT * kinds[ctx] / uses[ctx] * p
            s += math.log10(p)
        out.append((str(i), len(ws), round(s, 6)))
    return sorted(out), {k for ctx in stays for k in [len(ctx)]}


def test_suffix_tree_learns_sequences_of_rare_words(spark, monkeypatch):
    r = random.Random(12)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    free = lambda n: [f"w{int(3000 * r.random() ** 2)}" for _ in range(n)]
    passage = [f"p{k}" for k in range(12)]  # each word is under one token in a thousand
    rows = [(k, " ".join([*free(60), *(passage if k % 8 == 0 or k == 2000 else []), *free(60)]), "en") for k in range(240)]
    target = next(k for k in range(2000, 2100) if held(k))
    rows += [(target, " ".join(passage), "en"), (3000, "", "en"), (None, "unseen w1 w2", "en"), (3001, None, "en")]
    monkeypatch.setattr(suffix_lm, "BLOCK", 9000)
    monkeypatch.setattr(suffix_lm, "BUCKET", 5000)
    got = suffix_lm.suffix_scores(documents(spark, rows)).collect()
    want, sizes = plain_suffix_scores(rows, held)
    assert sizes >= {1, 2}
    assert sorted((str(x.doc_id), x.n_tokens, round(x.score, 6)) for x in got) == want
    (row,) = [x for x in got if x.doc_id == target]
    assert row.score > 0.3 * row.base_score


def test_quality_learns_from_every_trusted_text(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 3000)
    monkeypatch.setattr(quality, "BUCKET", 4000)
    rows = [(k, prose(k, 30, EN if k % 3 else FR), "en" if k % 3 else "fr" if k % 2 else None) for k in range(420)]
    rows += [(420, "".join(chr(0x4E00 + (k * k) % 1500) for k in range(3000)), "zh"), (421, "一丁 the", "zh"), (422, None, "zh"), (423, "", "nothing")]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(424) if k != 421], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify_quality(documents(spark, rows), labels).collect()}
    known = {x: [t for i, t, lang in rows if t and i != 421 and x in (lang, "*")] for x in ("en", "fr", "zh", "*")}
    plain = {x: plain_kneser_ney(ts) for x, ts in known.items()}  # 280 texts of "en": more than any bounded sample had
    for i, t, lang in rows[:40] + rows[-4:-2]:
        assert got[i].model == (lang or "*") and got[i].perplexity == pytest.approx(plain[lang or "*"](t), rel=1e-5)
    assert got[422].perplexity is None and got[423].model == "*" and len(got) == len(rows)


def test_stored_jobs_leave_no_shuffle_files_and_no_long_plans(spark):
    """Each job's shuffle files go with it; an operator of many steps otherwise keeps those of all. Settings come back."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    names = ["spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.maxPlanStringLength"]
    before, at_first = files(), [spark.conf.get(x) for x in names]
    store = Store(spark)
    df = spark.range(1000).repartition(3, "id").groupBy("id").count().repartition(2)
    store.put("plain", df)
    by = store.put_by("by", df, "id")
    assert not {x for x in files() - before if x.startswith("shuffle")}
    assert by.count() == 1000 and [spark.conf.get(x) for x in names] == at_first
    store.release("plain", "by")



def test_suffix_tree_shuffles_no_stored_block(spark, monkeypatch):
    """Blocks meet what comes back to them where they lie; all that is left at the end is the result."""
    stored = {}
    put = Store.put
    monkeypatch.setattr(Store, "put", lambda self, name, df: (stored.update({name: df._jdf.queryExecution().executedPlan().toString()}), put(self, name, df))[1])
    scored = suffix_lm.suffix_scores(documents(spark, [(i, f"a b c {i}", "en") for i in range(50)]))
    assert scored.count() == 50
    for name in ("step0", "scored"):
        assert "hashpartitioning(block" not in stored[name]
