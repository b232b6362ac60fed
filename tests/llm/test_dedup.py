"""Operators 3, 5, 6, 7, 8 against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, decontamination, exact_dedup, line_dedup, similar, simhash, suffix_dedup, wordhash
from tests.llm import cases


def test_exact_groups(spark):
    docs, rows = cases.documents(spark)
    plain = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    want = []
    for i, p in plain:
        ids = [k for k, q in plain if q == p]
        keep = min((k for k in ids if k is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(p.encode()).hexdigest()))
    for most in (2_000_000, 0):  # broadcast and shuffled suspects
        assert cases.order(map(tuple, exact_dedup.exact_groups(docs, most_broadcast=most).collect())) == cases.order(want)
    assert exact_dedup.exact_groups(cases.empty(spark)).count() == 0


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, span in ((1, 10), (5, 1 << 40), (1000, 1 << 20), (300, 1 << 63), (0, 100)):
        values = np.unique(rng.integers(0, span, n, dtype=np.uint64))
        bits = exact_dedup.rice_bits(len(values), span)
        if len(values):
            assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values, bits), len(values), bits) == values).all()


def brute_components(rows, width=3):
    fps = []
    for _, t in rows:
        w = cases.words(t)
        s = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    smallest = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    return [(rows[k][0], f"{fps[k]:016x}", smallest[group[k]]) for k in range(len(rows))]


def test_simhash_components(spark):
    docs, rows = cases.documents(spark)
    assert cases.order(map(tuple, simhash.simhash_components(docs).collect())) == cases.order(brute_components(rows))
    assert simhash.simhash_components(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("crowd", [64, 1])
def test_links_connect_all_near_fingerprints(spark, crowd):
    rng = random.Random(8)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            x ^= 1 << rng.randrange(64)
            values.add(x - (1 << 64) if x >> 63 else x)
    values = sorted(values)
    near = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(0, v) for v in values], "t int, fp bigint"), crowd).collect()}
    got = {(min(p), max(p)) for p in got}
    assert got <= near
    if crowd == 64:
        assert got == near

    def parts(pairs):
        group = {v: v for v in values}
        for a, b in pairs:
            x, y = group[a], group[b]
            group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
        return group

    assert parts(got) == parts(near)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(None, 5), (7, 7)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    group = {}
    for a, b in pairs:
        if a is None or a == b:
            continue
        x, y = group.setdefault(a, a), group.setdefault(b, b)
        group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    assert got == group
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("bounds", [{}, {"most_bytes": 0}, {"most_broadcast": 0, "most_bytes": 0}])
def test_contamination(spark, bounds):
    docs, rows = cases.documents(spark)
    rng = random.Random(1)
    items = [(1, " ".join(cases.words(rows[10][1])[3:18])), (20, "One, TWO"), (3, None), (4, ""), (5, cases.sentence(rng, 40)), (11, " ".join(cases.words(rows[10][1])[3:18])), (6, "lon")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(cases.UP))
    wins: dict = {}
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - 9)) if w else []:
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for i, t in rows:
        w, hit, found = tokens(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit.update(range(k, k + size))
                    found |= wins[tuple(w[k : k + size])]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert cases.order(map(tuple, decontamination.contamination(docs, bench, **bounds).collect())) == cases.order(want)
    if bounds:
        return
    assert sum(x[-1] for x in want) >= 3
    none = decontamination.contamination(docs, bench.where("false")).where("contaminated")
    assert none.count() == 0 and decontamination.contamination(cases.empty(spark), bench).count() == 0
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and None in [x[0] for x in want]
    assert cases.order((r.doc_id, r.text) for r in kept.collect()) == cases.order(r for r, x in zip(rows, want, strict=True) if not x[-1])
    contaminated = docs.selectExpr("cast(null as bigint) as doc_id", f"'{cases.sentence(random.Random(1), 30)}' as text").limit(2)
    bench = contaminated.selectExpr("1 as item_id", "text").limit(1)
    assert decontamination.drop_contaminated(contaminated, bench).count() == 0  # rows without a doc_id too


@pytest.mark.parametrize("crowd", [1000, 2])
def test_suffix_dedup(spark, crowd):
    docs, rows = cases.documents(spark)
    assert cases.order(map(tuple, suffix_dedup.dedup(docs, crowd=crowd).collect())) == cases.order(cases.removed_bytes(rows))


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.dedup(cases.empty(spark)).count() == 0


def test_anchors_of_many_texts_at_once():
    """The runs of each text are those that it has alone, and cover its windows; windows across texts have none."""
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab cd") for _ in range(n)) for n in (0, 49, 50, 51, 400, 0, 3, 3000, 20, 50)]
    owner, starts, ends, h = suffix_dedup.anchors(texts, 50)
    for i, text in enumerate(texts):
        none, a, b, own = suffix_dedup.anchors([text], 50)
        at = owner == i
        assert not none.any() and (starts[at] == a).all() and (ends[at] == b).all() and (h[at] == own).all()
        assert [w for x, y in zip(a.tolist(), b.tolist(), strict=True) for w in range(x, y)] == list(range(len(text) - 49))
    whole = np.frombuffer(bytes(rng.randrange(256) for _ in range(1000)) * 600, np.uint8)
    found = suffix_dedup.window_hashes(whole, 20)  # in blocks
    assert len(found) == len(whole) - 19 and len(np.unique(found)) == 1000 and (found[1000:] == found[:-1000]).all()


def test_suffix_order():
    rng = random.Random(7)
    for _ in range(200):
        alphabet = rng.choice([2, 3, 20])
        x = bytes(rng.randint(1, alphabet) for _ in range(rng.randint(1, 100))) * rng.choice([1, 2]) + b"\0"
        found = suffix_dedup.suffix_order(np.frombuffer(x, np.uint8), 50).tolist()
        assert sorted(found) == list(range(len(x)))
        assert [x[i : i + 50] for i in found] == sorted(x[i : i + 50] for i in range(len(x)))


def similarity(a: list[str], b: list[str]) -> float:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def normal(line: str) -> bytes:
    return b" ".join(line.encode().translate(line_dedup.NORMAL).split())


def lettered(line: str) -> bool:
    return any(97 <= c <= 122 or c >= 128 for c in normal(line))


def alike(a: bytes, b: bytes) -> bool:
    """The links of the operator's docstring."""
    signs = lambda x: [w for w in x.split() if re.search(rb"[^a-z\x80-\xff]", w)]
    x, y = a.split(), b.split()
    if signs(a) != signs(b) or (len(x) < 10) != (len(y) < 10):
        return False
    if len(x) >= 10:
        return similarity(x, y) >= 0.9 - 1e-9
    return min(len(a), len(b)) >= 20 and similarity(a.decode(), b.decode()) >= 0.9 - 1e-9


def brute_lines(rows) -> dict:
    """(doc_id, text) -> the text that stays."""
    firsts: dict[bytes, tuple] = {}
    for i, t in sorted({(r, t) for r, t in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0)):
        for k, x in enumerate(t.split("\n")):
            if lettered(x):
                firsts.setdefault(normal(x), (i is None, i or 0, k))
    group = {x: x for x in firsts}
    every = list(firsts)
    for a, x in enumerate(every):
        for y in every[a + 1 :]:
            if group[x] != group[y] and alike(x, y):
                old, new = group[y], group[x]
                group = {k: new if g == old else g for k, g in group.items()}
    kept: dict[bytes, tuple] = {}
    for x, g in group.items():
        kept[g] = min(kept.get(g, firsts[x]), firsts[x])
    out = {}
    for i, t in rows:
        if t is not None:
            out[i, t] = "\n".join(x for k, x in enumerate(t.split("\n")) if not lettered(x) or kept[group[normal(x)]] == (i is None, i or 0, k))
    return out


@pytest.mark.parametrize("crowd", [2])
def test_line_dedup(spark, crowd):
    docs, rows = cases.documents(spark)
    out = line_dedup.dedup_lines(docs, crowd=crowd)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == len(rows)
    wanted = brute_lines(rows)
    for r in out.collect():
        before = [t for i, t in rows if i == r.doc_id]
        if before == [None]:
            assert r.text is None
            continue
        text = next(t for t in before if t is not None)
        assert r.text == wanted[r.doc_id, text]
        assert r.n_lines == text.count("\n") + 1
        assert r.n_lines - r.n_removed == (r.text.count("\n") + 1 if r.n_lines > r.n_removed else 0)
    assert line_dedup.dedup_lines(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("crowd", [4])
def test_fuzzy_lines_against_brute_force(spark, crowd):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        words = [f"{cases.sentence(rng, 1)}{rng.randrange(26**3)}".translate(str.maketrans("0123456789", "qwertzuiop")) for _ in range(rng.choice([11, 14, 19, 20, 25, 33, 48, 70]))]
        rows.append(" ".join(words))
        for _ in range(rng.choice([1, 2, 12])):
            copy = [*words]
            for _ in range(rng.randint(1, max(1, len(words) // 12))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([["changed"], [], [copy[at], "added"]])
            rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    found = {(r.doc_id, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), crowd=crowd).collect()}
    gone = {i for i, n in found if n}
    wanted = {i for (i, t), left in brute_lines(rows).items() if not left}
    assert gone <= wanted and len(gone) >= 0.97 * len(wanted) > 100


def test_lines_that_differ_in_signs_stay_and_short_ones_link(spark):
    texts = ["Revenue 2019: 5 units", "Revenue 2020: 7 units", "x = a + b", "x = a - b", "The total revenue of the year 2019 was five million units", "The total revenue of the year 2020 was five million units"]
    texts += ["subscribe to our free newsletter today", "Subscribe to our free newsletter, todai!", "total: 12", "Total 12.", "the", "a\n---\n---\n12"]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [i for i in out if out[i] != texts[i]] == [7, 9]
    assert out[7] == out[9] == ""


@pytest.mark.parametrize("crowd", [1000, 8])
def test_crowded_lines_are_all_tried(spark, crowd):
    rng = random.Random(14)
    slots = [f"{a}{b}" for a in "abcdef" for b in "klmno"]
    rows = []
    for i in range(100):  # 5 of 60 words changed each: like the original, but not like each other
        words = [*slots]
        for at in rng.sample(range(30), 5):
            words[at] = "x" + "".join(rng.choice("abcdefgh") for _ in range(8))
        rows.append((i, " lorem ".join([*words, ""])))
    rows.append((100, " lorem ".join([*slots, ""])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs, crowd=crowd).collect()}
    left = [i for i, n in out.items() if n == 0]
    assert left[0] == 0 and len(left) <= 3  # blocks are sampled


def test_rounds_end_when_all_heads_are_tried(spark, monkeypatch):
    calls, sized = [], similar.sized

    def counted(df, **sums):
        out, seen = sized(df, **sums)
        calls.append(seen)
        return out, seen

    monkeypatch.setattr(similar, "sized", counted)
    slots = [f"{a}{b}" for a in "abcdef" for b in "klmno"]
    lines = [" ".join([*slots[:15], *(f"{x}{y}" for y in slots[15:])]) for x in "pqrstu"]  # one start, otherwise unlike
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string"))
    assert [r.n_removed for r in out.collect()] == [0] * 6
    # after the sizes of the untried: heads, links found, and no further round
    assert "over" in calls[-3] and calls[-3]["over"] == 0


def test_similar_lines_by_characters(spark):
    rng = random.Random(21)
    # a script without spaces, letters of two bytes and of one, and short sentences
    scripts = [("的一是不了在人有我他这中大来上个国到说们", 12, 60), ("абвгдежзиклмнопрст", 22, 50), ("abcdefghijklmnopqrst", 22, 45), ("", 0, 0)]
    rows = []
    for i in range(80):
        letters, least, most = scripts[i % 4]
        line = [rng.choice(letters) for _ in range(rng.randint(least, most))] if letters else list(cases.sentence(rng, rng.randint(6, 9)))
        rows.append("".join(line))
        for _ in range(rng.choice([1, 2, 6])):
            copy = [*line]
            for _ in range(rng.randint(1, max(1, len(line) // 20))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([["ж" if letters else "x"], [], [copy[at], "z"], [copy[at], " "]])
            rows.append("".join(copy))
    # the same characters as ten words or more, and words with different signs, are no links
    spaced = " ".join(rows[0])
    rows += [spaced, "значениепараметра=" + "б" * 20, "значениепараметра=" + "б" * 19 + "в"]
    rows = list(enumerate(rows))
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    gone = {r.doc_id for r in out.collect() if r.n_removed}
    wanted = {i for (i, t), left in brute_lines(rows).items() if not left}
    assert gone <= wanted and len(gone) >= 0.97 * len(wanted) > 150
    assert all(i not in gone for i, t in rows if t == spaced or "=" in t)


def test_marks_bound_edits_of_characters():
    rng = random.Random(8)
    for _ in range(300):
        line = list("".join(rng.choice("abcdeé漢ж ") for _ in range(40)).strip())
        copy, edits = [*line], rng.randint(1, 6)
        for _ in range(edits):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([["x"], [], [copy[at], "水"], [copy[at], " "]])
        texts = [" ".join("".join(x).split()) for x in (line, copy)]
        if any(len(x.split()) >= line_dedup.LONG for x in texts):
            continue
        found = [line_dedup.Lines(np.frombuffer(x.encode(), np.uint8)) for x in texts]
        chars = [line_dedup.Characters(x) for x in found]
        assert [int(c.n[0] + x.n[0] - 1) for c, x in zip(chars, found, strict=True)] == [len(x) for x in texts]
        one, two = (line_dedup.marks(c.h, c.first) for c in chars)
        apart = sum(bin(int(p[0] ^ q[0]) & (2**64 - 1)).count("1") for p, q in zip(one, two, strict=True))
        # white space that meets at an end or other white space goes too
        far = round((1 - similarity(*texts)) * max(map(len, texts)))
        assert apart <= 2 * far - abs(len(texts[0]) - len(texts[1]))


def test_long_lines_and_texts(spark):
    line = "word " * 1_200_000
    rows = [(1, line), (2, "first\n" + line + "\nlast one"), (3, "first\n" * 900_000 + "only here"), (4, "last one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    assert out[1] == (0, line) and out[2] == (1, "first\nlast one") and out[3] == (900_000, "only here") and out[4] == (1, "")


def test_near_duplicates(spark):
    rng = random.Random(10)
    base = [cases.sentence(rng, 150).split() for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for k, b in enumerate(base[:6]):
        changed = [*b]
        changed[70] = "other"
        rows.append((100 + k, " ".join(changed)))
        rows.append((200 + k, " ".join(b).upper()))
    rows += [(300, None), (301, ""), (None, " ".join(base[11]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()]
    assert set(range(12)) <= set(kept)  # clean ones and originals stay
    assert not {200, 201, 202, 203, 204, 205, 301, None} & set(kept)
    assert sum(i in kept for i in range(100, 106)) <= 1
    assert simhash.drop_near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize(("crowd", "original"), [(1000, 0), (8, 150), (4, 10_000)])
def test_near_copies_of_one_original_are_all_tried(spark, crowd, original):
    rng = random.Random(12)
    text = cases.sentence(rng, 330).split()
    rows = [(original, " ".join(text))]
    for i in range(1, 201):
        copy = [*text]
        for at in range(rng.randrange(60), len(copy), 60):
            copy[at] = f"other{rng.randrange(10**6)}"
        rows.append((i + 1000 if i == original else i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    gone = {r.key for r in simhash.near_duplicate_rows(docs, crowd=crowd).collect()}
    assert {i for i, _ in rows} - gone == {min(i for i, _ in rows)}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for i in range(40):
        text = [f"{cases.sentence(rng, 1)}{'abcdefghij'[rng.randrange(10)]}" for _ in range(rng.choice([60, 150, 400, 900]))]
        rows.append(" ".join(text))
        for share in (0.005, 0.015, 0.02, 0.04, 0.08):
            rows.append(" ".join(w if rng.random() > share else f"other{rng.randrange(10**6)}" for w in text))
    rows = list(enumerate(rows))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    group = {i: i for i, _ in rows}
    for a in group:
        for b in group:
            if a < b and group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    gone = {r.key for r in simhash.near_duplicate_rows(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    wanted = {i for i, g in group.items() if i != g}
    assert gone <= wanted and len(gone) >= 0.95 * len(wanted) > 80


def test_near_duplicates_of_long_and_repetitive_texts(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(5000)}" for _ in range(100_000)]
    changed = [*long]
    for at in range(0, len(changed), 90):
        changed[at] = f"other{at}"
    rows = [(1, " ".join(long)), (2, " ".join(changed)), (3, "a " * 200_000), (4, "a " * 200_001), (5, "b " * 10), (6, "x" * 1_500_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.key for r in simhash.near_duplicate_rows(docs).collect()} == {2, 4}


def test_votes_and_word_hashes():
    rng = random.Random(5)
    texts = [cases.sentence(rng, n).encode() for n in (0, 1, 3, 700, 0, 40)] + [b" Aa\tb\x0b\xc3\xa9 ", b"", b"x" * 700_000 + b" y"]
    h, n = wordhash.words_of(texts)
    words = [t.lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in words]
    number: dict = {}
    assert all(number.setdefault(w, x) == x for w, x in zip([w for ws in words for w in ws], h.tolist(), strict=True)) and len(set(number.values())) == len(number)
    owner = np.repeat(np.arange(len(n)), n)
    one = wordhash.votes(h, owner, len(n), 2, block=64)
    assert (one == wordhash.votes(h, owner, len(n), 2)).all() and one.max() > 255
    single = np.stack([wordhash.votes(h[i : i + 1], np.zeros(1, int), 1, 2)[0] for i in range(len(h))])
    assert all((single[owner == i].sum(axis=0) == one[i]).all() for i in range(len(n)))


def test_native_plan_of_decontamination(spark):
    docs, _ = cases.documents(spark)
    bench = spark.createDataFrame([(1, cases.sentence(random.Random(1), 30))], "item_id bigint, text string")
    plan = decontamination.contamination(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan) and F is not None


def test_texts_of_a_regular_build_have_hashes_of_their_own(spark):
    """Thue-Morse words and their complements, of letters and of words: sums of powers modulo 2^64 can't tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    words = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    lines = [" ".join(("left", "right")[b ^ flip] for b in bits) for flip in (0, 1)]
    h, n = wordhash.words_of([w.encode() for w in words])
    assert h[0] != h[1] and n.tolist() == [1, 1]
    h, n = wordhash.words_of([x.encode() for x in lines])
    assert simhash.whole_hashes(h, n)[0] != simhash.whole_hashes(h, n)[1]
    found = line_dedup.Lines(np.frombuffer("\n".join(lines).encode(), np.uint8))
    assert len(set(found.line_hash().tolist())) == 2
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string")
    assert [r.n_removed for r in line_dedup.dedup_lines(docs).collect()] == [0, 0]
