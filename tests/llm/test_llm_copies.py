"""Operators on copies and passages, and the pipeline."""

import hashlib
import math
import random

import numpy as np
import pytest

from strideframe.llm import decontaminate, exact_dedup, near_dedup, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component long, words long, _row_ string"


def documents(spark, rows):
    """Rows of (doc_id, text), with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), True, 1, 2, "r") for i, t in rows], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    stems = ["the", "er", "ing", "of", "and", "tion", "ha", "wh", "st", "nd", "re", "ed"]
    return " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 4))) for _ in range(n))


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- exact copies

EXACT = [(1, "Same"), (2, "same"), (3, "SAME"), (4, None), (5, ""), (6, "É"), (7, "é"), (7, "é"), (None, "same"), (None, "alone"), (8, "İstanbul"), (9, "x" * 100_000), (10, "X" * 100_000)]
EXACT += [(100 + k, "hot text") for k in range(400)] + [(600 + k, f"Common beginning of many texts that goes on and on and on {k}") for k in range(50)]


def plain_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[low(t)]
        top = max((x for x in g if x is not None), default=None)
        out.append((str(i), str(top), len(g), i == top, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_exact_groups_against_plain_python(spark, partitions):
    got = exact_dedup.exact_groups(documents(spark, EXACT).repartition(7), partitions=partitions).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == plain_groups(EXACT)


def test_exact_copies_leave_one_row_of_each_group(spark):
    docs = documents(spark, EXACT)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert sorted(low(r.text) for r in rows) == sorted({low(t) for _, t in EXACT})
    best = {low(t): max((j for j, u in EXACT if low(u) == low(t) and j is not None), default=None) for _, t in EXACT}
    assert all(r.doc_id == best[low(r.text)] for r in rows)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0 == exact_dedup.drop_copies(docs.limit(0)).count()


# --- near copies


def near_rows():
    r, rows = random.Random(2), []
    base = prose(1, 300).split()
    for k in range(60):  # copies at all distances from the base and from each other
        copy = list(base)
        for _ in range(r.randrange(0, 24)):
            copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    line = prose(7, 9)
    rows += [(100 + k, f"{line} {prose(100 + k, 6)}") for k in range(40)]  # short texts that share a line
    rows += [(200 + k, prose(200 + k, 50)) for k in range(30)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "One"), (305, "one two"), (306, "ONE two"), (307, "one two three"), (None, "one"), (230, rows[-1][1]), (231, rows[5][1].upper()), (231, "one two")]
    chain = prose(9, 60).split()
    for k in range(12):  # each like the one before, the ends unlike
        chain[4 * k] = f"link{k}"
        rows.append((400 + k, " ".join(chain)))
    return rows


def plain_components(rows, percent=85):
    sets = []
    for _, t in rows:
        w = tuple(low(t).split())
        sets.append({w[k : k + 3] for k in range(len(w) - 2)} if len(w) >= 3 else {w} if w else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(find(i) if i is not None else None), i is None or find(i) == i) for (i, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("piece", [3, 1000])
def test_near_groups_against_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(near_dedup, "PIECE", piece)
    rows = near_rows()
    got = near_dedup.near_groups(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == plain_components(rows)


def test_near_groups_of_nothing(spark):
    assert near_dedup.near_groups(documents(spark, [])).count() == 0
    (row,) = near_dedup.near_groups(documents(spark, [(5, None)])).collect()
    assert (row.n_shingles, row.component_id, row.kept) == (0, 5, True)


def test_registers_keep_zeros_and_mantissa():
    r = random.Random(1)
    s = np.unique(np.array([r.getrandbits(64) for _ in range(3000)] + [1, 2, 3, 1 << 57], np.uint64))
    got = near_dedup.registers(s)
    for bucket in range(near_dedup.REGISTERS):
        rest = [(int(x) << 7) & (2**64 - 1) for x in s if int(x) >> 57 == bucket]
        if not rest:
            assert got[bucket] == 0
            continue
        bits = f"{min(rest):064b}"
        zeros = bits.find("1") if "1" in bits else 64
        if zeros < 53:
            assert got[bucket] == (zeros + 1 << near_dedup.MANTISSA | int((bits + "0" * 80)[zeros + 1 :][: near_dedup.MANTISSA], 2))


def test_estimate_is_near_the_truth():
    r = random.Random(3)
    both, a, b = ([r.getrandbits(64) for _ in range(n)] for n in (1700, 150, 150))
    x, y = (near_dedup.registers(np.unique(np.array(both + z, np.uint64))) for z in (a, b))
    assert near_dedup.estimate(x, y) == pytest.approx(0.85, abs=0.13)
    assert near_dedup.hopeful(x, y, 0.85)


def test_pairs_five_standard_errors_under_the_limit_are_compared():
    x = np.arange(1, near_dedup.REGISTERS + 1).astype(np.uint16)
    y = x.copy()
    y[: round(near_dedup.REGISTERS * (0.15 + 5 * math.sqrt(0.85 * 0.15 / near_dedup.REGISTERS)))] += 1000
    assert near_dedup.hopeful(x, y, 0.85)
    y[:] = x + 1000
    assert not near_dedup.hopeful(x, y, 0.85)


# --- decontamination

ITEM = "In March the farmer Johnson sold 12 apples for 30 dollars and then Johnson bought 12 pears for the neighbour Smith who lived 5 km away."


def test_leaks_verbatim_and_with_other_parameters(spark):
    again = ITEM.replace("12", "47").replace("30", "99").replace("Johnson", "Miller").replace("Smith", "Baker").replace("5 km", "9 miles")
    broken = ITEM.replace("sold 12", "sold 47").replace("farmer Johnson", "farmer Miller").replace("30", "99")
    rows = [(1, f"{prose(1, 40)} {ITEM} {prose(2, 40)}"), (2, again.upper() and again), (3, broken), (4, prose(3, 200)), (5, None), (6, ""), (None, ITEM), (7, ITEM[:30]), (8, prose(5, 30) + " " + prose(6, 30))]
    rows += [(9, "\n".join([prose(11, 20000), ITEM])), (1, rows[0][1])]
    bench = spark.createDataFrame([(10, ITEM, "k"), (11, None, "k"), (12, "too short", "k"), (13, prose(6, 30), "k"), (14, "one five word item here", "k")], "item_id long, text string, key string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (9, 10), (8, 13)}
    assert got[1, 10].n_changed == 0 and got[2, 10].n_changed > 0 and got[2, 10].coverage == 1


def test_leaks_with_tokens_added_or_dropped(spark):
    plain = [f"{prose(70, 38)} end".split()[k] for k in range(38)]
    changed = [plain[:19] + ["added"] + plain[19:], plain[:19] + plain[20:], plain[:12] + ["added"] + plain[12:25] + ["more"] + plain[25:], plain[:12] + plain[13:25] + ["more"] + plain[25:]]
    short = "what did the old farmer Ann sell to Bob for 12 coins"
    named = "what did the old farmer Mary Ann Lee sell to Tom Ray for 1 200 coins"
    mixed = "the man Ann met the man Ann at the old mill and the man Ann ran to the man Ann"
    broken = "the man Mary Lee met the man Tom at the old mill and the man Jim Ray ran to the man Bob"
    rows = [(k, f"{prose(80 + k, 30)} {' '.join(t)} {prose(90 + k, 30)}") for k, t in enumerate(changed)]
    rows += [(10, f"{prose(60, 30)} {named} {prose(61, 30)}"), (11, f"{prose(62, 30)} {broken} {prose(63, 30)}"), (12, prose(64, 200)), (13, "so who is Tom Ray today"), (14, "Tom Ray today")]
    bench = spark.createDataFrame([(1, " ".join(plain)), (2, short), (3, mixed), (4, "so who is Ann Lee today")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert set(got) == {*((k, 1) for k in range(4)), (10, 2), (13, 4)}
    assert got[10, 2].n_changed == 3 and got[10, 2].coverage == 1 and all(got[k, 1].coverage > 0.5 for k in range(4))


def test_leaks_of_nothing(spark):
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    assert decontaminate.contaminated(documents(spark, []), bench).count() == 0
    assert decontaminate.contaminated(documents(spark, [(1, ITEM)]), bench.limit(0)).count() == 0


# --- repeated passages


def test_chunks_tile_the_text_and_resist_insertions():
    text = prose(1, 3000).encode()
    chunks = substring_dedup.cut(text)
    assert chunks[0][0] == 0 and all(a[1] == b[0] for a, b in zip(chunks, chunks[1:], strict=False)) and chunks[-1][1] == len(text)
    assert sum(c[2] for c in chunks) == 3000 and max(c[2] for c in chunks) <= substring_dedup.MOST
    moved = substring_dedup.cut(b"a few more words here " + text)
    old, new = ({text_[a:b].strip() for a, b, _ in c} for text_, c in ((text, chunks), (b"a few more words here " + text, moved)))
    assert len(old & new) > 0.97 * len(old)
    assert substring_dedup.cut(b"") == substring_dedup.cut(b" \n ") == []


def test_gear_hash_against_its_definition():
    data = np.frombuffer(prose(4, 50).encode(), np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(substring_dedup._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert substring_dedup.gear(data).tolist() == want


def test_passages_of_many_lengths(spark):
    r, rows = random.Random(1), []
    shared = [prose(1000 + k, 60) for k in range(60)]
    for k, p in enumerate(shared):
        rows.append((2 * k, f"{prose(k, r.randrange(5, 80))} {p} {prose(3000 + k, 30)}"))
        rows.append((2 * k + 1, f"{prose(5000 + k, r.randrange(5, 80))} {p} {prose(7000 + k, 30)}"))
    clean = [(1000 + k, prose(9000 + k, 150)) for k in range(60)]
    line = prose(1, 9)
    clean = [(i, f"{line}\n{t}") for i, t in clean]
    odd = [(2000, None), (2001, ""), (None, shared[0]), (2002, "again and again this one line says it\n" * 40), (2003, clean[0][1][:40])]
    docs = documents(spark, rows + clean + odd)
    got = substring_dedup.repeated_passages(docs).collect()
    assert len({r.doc_id for r in got}) >= 59 and {r.doc_id for r in got} <= {2 * k + 1 for k in range(60)}
    texts = dict(rows)
    assert all(r.first_doc_id == r.doc_id - 1 and texts[r.doc_id].encode()[r.start : r.end].decode().strip() in shared[r.doc_id // 2] for r in got)
    left = {r.doc_id: r.text for r in substring_dedup.cut_passages(docs, substring_dedup.repeated_passages(docs)).collect()}
    assert len(left) == len(rows) + len(clean) + len(odd) and all(left[i] == t for i, t in clean)
    assert all(len(left[r.doc_id].encode()) == len(texts[r.doc_id].encode()) - sum(x.end - x.start for x in got if x.doc_id == r.doc_id) for r in got)
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


# --- pipeline


def test_pipeline_stages_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    rows = [(k, prose(k, 120)) for k in range(80)]
    noise = [(100 + k, " ".join("".join(r.choice("xqzj#$%&") for _ in range(7)) for _ in range(40))) for k in range(5)]
    exact = [(200 + k, rows[k][1]) for k in range(5)]
    near = [(300 + k, " ".join(["changed", *rows[10 + k][1].split()[1:]])) for k in range(5)]
    leak = [(400 + k, f"{prose(900 + k, 50)} {ITEM}") for k in range(3)]
    odd = [(500, None), (501, ""), (None, prose(77, 50))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + noise + exact + near + leak + odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(k, 0, 0) for k in range(100, 105)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_copies", "near_copies", "leaks", "tokens"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    got = {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = {i for i, _ in noise} | set(range(5)) | {i for i, _ in near} | {i for i, _ in leak}
    assert not got & gone
    assert {k for k in range(5, 80)} <= got and {200 + k for k in range(5)} <= got
    assert None in got and len(got & {500, 501}) == 1


def test_pipeline_near_copies_between_80_and_85_percent(spark):
    import corpus_pipeline

    sets = lambda t, k: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    alike = lambda a, b, k: len(sets(a, k) & sets(b, k)) / len(sets(a, k) | sets(b, k))
    rows, pairs = [], {}
    for n in range(24):
        a = [f"d{n}w{i}" for i in range(300)]
        b = [*a, *(f"e{n}w{i}" for i in range(66))] if n % 2 else [x if i % 40 else f"e{n}w{i}" for i, x in enumerate(a)]
        rows += [(2 * n, " ".join(a)), (2 * n + 1, " ".join(b))]
        pairs[2 * n + 1] = alike(a, b, 5) >= 0.8
        assert (alike(a, b, 3) >= 0.85) != pairs[2 * n + 1]
    left = {x.doc_id for x in corpus_pipeline.near_copies(spark, documents(spark, rows), "").collect()}
    assert {i for i, _ in rows} - left == {i for i, same in pairs.items() if same}
