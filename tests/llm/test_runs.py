"""Operators 12 and 13 against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, periodic_runs
from tests.llm import cases


def brute_runs(words, min_length=6, min_exponent=4):
    """All periods tried one by one."""
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            whole = words[start : start + length]
            if length >= max(min_length, min_exponent * q) and not any(whole[d:] == whole[:-d] for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("min_length", "min_exponent"), [(6, 4), (4, 2), (1, 3)])
def test_runs_of_random_words(min_length, min_exponent):
    rng = random.Random(4)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(0, 5)):
            words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 60))]
            if len(words) > 10 and rng.random() < 0.5:
                a, p = rng.randrange(len(words)), rng.randint(1, 5)
                words = [words[i] if i < a or a + p > len(words) else words[a + (i - a) % p] for i in range(len(words))]
            texts.append(words)
        assert periodic_runs.runs_of_texts(texts, min_length, min_exponent) == [brute_runs(w, min_length, min_exponent) for w in texts]


def test_long_texts_take_no_quadratic_time():
    """A run over a whole text, and a text without any whose stretches all repeat."""
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 100_000:
        a, b = b, b + a
    assert periodic_runs.runs_of_texts([[b"x"] * 300_000, b], 6, 4) == [[(0, 300_000, 1)], []]


def test_ordered_positions():
    rng = random.Random(2)
    values = rng.sample(range(10**6), 5000)
    held = periodic_runs.Positions(values[0])
    for k, x in enumerate(values[1:], 1):
        if k % 97 == 0:
            done = values[:k]
            assert held.around(x) == (max((v for v in done if v < x), default=None), min((v for v in done if v > x), default=None))
        held.add(x)
    assert list(held) == sorted(values) and held.n == 5000


def digest(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        a, p = h // 10 % n, 0
        if h % 10 == 0:
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs, best = brute_runs(words), None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    sha = [hashlib.sha256(x).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in runs).encode(), b" ".join(kept))]
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha)


def test_periodic_runs_query(spark, tmp_path):
    texts = [t for t in cases.texts() if len(t or "") < 20_000] + ["na " * 50 + "x", "a b a b a b a b c c c c c c", "é " * 6, "x\ty\x0bx y x\ny x y"]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "u v " * 9), (0, texts[0])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic_runs.op12_periodic_runs(spark, str(tmp_path))
    assert cases.order(map(tuple, got.collect())) == cases.order(digest(*r) for r in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in rows)


def test_periodic_runs_keep_all_columns(spark):
    docs, rows = cases.documents(spark)
    out = periodic_runs.periodic_runs(docs)
    assert out.columns == [*docs.columns, "runs", "collapsed"]
    assert cases.order((r.doc_id, r.text) for r in out.collect()) == cases.order(rows)
    assert periodic_runs.periodic_runs(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError, match="columns"):
        periodic_runs.periodic_runs(docs.withColumn("Runs", F.lit(1)))


def brute_negatives(rows, anchors, positives=5, negatives=5):
    good = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda p, q: sum(a * b for a, b in zip(p, q, strict=False))
    out = []
    for anchor, label, v in {i: (i, lab, v) for i, lab, v in reversed(good) if i in anchors}.values():
        ranked = sorted(((-score(v, w), i, lab) for i, lab, w in good), key=lambda r: r[:2])
        for s, i, _ in [r for r in ranked if r[2] == label and r[1] != anchor][:positives]:
            fits = [(-t, k) for t, k, lab in ranked if lab != label and 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(anchor, i, n + 1, k, -s, t) for n, (t, k) in enumerate(fits)]
    return out


@pytest.mark.parametrize("sent_bytes", [64 << 20, 2000])
def test_hard_negatives(spark, sent_bytes):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(3, 24)) / 5
    rows = [(i, int(k), [float(np.float32(x)) for x in centres[k] + rng.normal(size=24) / 20]) for i, k in enumerate(rng.integers(0, 3, 220))]
    rows += [(220, 0, rows[3][2]), (221, 1, rows[3][2]), (3, 0, rows[3][2])]  # ties, a repeated key
    rows += [(222, None, rows[0][2]), (None, 1, rows[0][2]), (223, 1, None), (224, 1, [0.5] * 23 + [float("nan")]), (225, 1, [0.5] * 23 + [None]), (226, 1, [0.5] * 23 + [float("-inf")])]
    rows += [(227, 0, [0.5] * 7), (230, 1, []), (231, 2, [-x for x in rows[0][2]])]  # other lengths
    full = [(*r, "x", 1, 2) for r in rows]
    frame = spark.createDataFrame(full, "vec_id bigint, label int, embedding array<float>, id string, place int, score int").repartition(3)
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, sent_bytes=sent_bytes)
    want = brute_negatives(rows, {i for i in range(0, 240, 10)})
    assert cases.order(map(tuple, got.collect())) == cases.order(want) and len(want) > 100
    assert hard_negatives.hard_negatives(frame.limit(0), F.lit(True)).count() == 0


def test_summaries_bound_scores():
    rng = np.random.default_rng(3)
    x, y = np.floor(rng.normal(size=(40, 50)) * 256), np.floor(rng.normal(size=(60, 50)) * 256)
    one, two = (hard_negatives.Block(np.arange(len(v)), np.zeros(len(v)), v, hard_negatives.summaries(v)) for v in (x, y))
    reach = []
    for level in range(len(hard_negatives.LEVELS)):
        low, up = hard_negatives.bounds(one, two, level)
        assert (low <= x @ y.T).all() and (x @ y.T <= up).all()
        reach.append((up - low).mean())
    assert reach[0] > reach[1]  # narrower segments bound better
    # components whose products are not exact in double
    huge = hard_negatives.Block(np.arange(2), np.zeros(2), np.array([[3.0 * 2**27, 1.0], [1.0, 2.0**27]]), np.zeros((2, 8)))
    assert hard_negatives.scores(huge, huge, np.array([[True, False], [False, False]]))[0, 0] == 9 * 2**54 + 1
