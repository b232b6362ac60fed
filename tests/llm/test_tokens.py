"""Operators 1 and 9 against the tokenizers library, and the packing's parts."""

from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import encoding, packing
from tessera.llm.token_counts import count_tokens
from tests.llm import cases


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.byte_bpe_path())


def test_counts(spark, library):
    docs, rows = cases.documents(spark)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows]
    for size in (1 << 16, 50):
        assert cases.order(map(tuple, count_tokens(docs, piece_chars=size).collect())) == cases.order(want)
    assert count_tokens(cases.empty(spark)).count() == 0


def test_sentencepiece_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs, rows = cases.documents(spark)
    got = count_tokens(docs, tokenizer=path).select("doc_id", "n_tokens").collect()
    assert cases.order(map(tuple, got)) == cases.order((i, len(model.encode(t or ""))) for i, t in rows)


def test_both_libraries_agree(library):
    rng = random.Random(2)
    enc = encoding.encoder(encoding.byte_bpe_path())
    alphabet = "aB é’'\t\n\r 0³ßſ\x00\x85\xa0<|>.,ll've" + "ĀɎ漢α"
    for _ in range(2000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert enc.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def check_packing(out, rows, library, capacity):
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        copies = sum(1 for k, _ in rows if k == i)
        assert sum(r.length for r in pieces) == len(ids) * copies
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
        assert all(r.length == capacity for r in pieces if r.piece > 0)
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, library):
    docs, rows = cases.documents(spark)
    for capacity in (1024, 37):
        out = packing.pack_documents(docs, capacity).collect()
        n = check_packing(out, rows, library, capacity)
        assert n <= math.ceil(sum(r.length for r in out) / capacity) + 2
    assert packing.pack_documents(cases.empty(spark)).count() == 0


def fewest(items: list[int], capacity: int) -> int:
    best = len(items)

    def place(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            place(i + 1, bins)
            bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_dominance_keeps_an_optimum():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 15, 24])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(items, minlength=capacity + 1)
        fixed = packing.dominance(counts, capacity)
        rest = [s for s in range(capacity, 0, -1) for _ in range(counts[s])]
        assert all(sum(sizes) <= capacity for sizes, _ in fixed)
        assert sorted(rest + [s for sizes, n in fixed for s in sizes * n]) == sorted(items)
        assert sum(n for _, n in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity)


def test_best_fit_places_everything():
    rng = random.Random(6)
    for _ in range(50):
        counts = np.array([0] + [rng.choice([0, 0, 1, 5, 1000]) for _ in range(60)])
        bins = packing.best_fit(counts, 60)
        back = np.zeros_like(counts)
        for sizes, n in bins:
            assert sum(sizes) <= 60
            for s, each in itertools.groupby(sizes):
                back[s] += n * len(list(each))
        assert (back == counts).all()


@pytest.mark.parametrize("run", [" ", "\n", "a", "-", " \n"])
def test_long_runs_are_encoded(run):
    enc = encoding.encoder(encoding.byte_bpe_path())
    text = "x" + run * (2_000_000 // len(run)) + "y"
    ids = enc.ids(text)
    assert enc.counts([text, "x"]) == [len(ids), 1]
    assert enc.slow.decode(ids.tolist()) == text


def test_counts_of_batches_across_arrow_batches(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab 12\n") for _ in range(rng.choice([0, 5, 90, 3000])))) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), batch_bytes=2000, piece_chars=500).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    enc = encoding.encoder(encoding.byte_bpe_path())
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in out) == [(i, len(t), len(enc.slow.encode(t, add_special_tokens=False).ids)) for i, t in rows]
