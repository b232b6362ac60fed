"""Operators 2, 4, 10 and the pipeline."""

from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bloom, html_text, language_id, lm_scoring
from tests.llm import cases


def test_forward_sums_all_segmentations():
    pieces = language_id.vocabulary(language_id.vocabulary_path())
    probs = np.random.default_rng(1).random((len(pieces) + 1, 2)) / 100
    known = {p: i for i, p in enumerate(pieces.pieces)}

    def total(word: str, column: int) -> float:
        if not word:
            return 1.0
        out = 0.0
        for k in range(1, min(len(word), pieces.longest) + 1):
            i = known.get(word[:k], -1)
            if i >= 0 or k == 1:
                out += probs[i, column] * total(word[k:], column)
        return out

    words = ["house", "haus", "ñandú", "x", "straße"]
    got = language_id.word_scores(words, pieces, probs)
    for w, row in zip(words, got, strict=True):
        assert row == pytest.approx([math.log(total("▁" + w, c)) for c in (0, 1)])


def test_long_words_are_scored_whole():
    pieces = language_id.vocabulary(language_id.vocabulary_path())
    probs = np.random.default_rng(1).random((len(pieces) + 1, 2)) / 100
    word = "wonderlichsteinhausesprit"
    assert language_id.long_score("▁" + word, pieces, probs, block=7) == pytest.approx(language_id.word_scores([word], pieces, probs)[0])
    # all segmentations of 90 letters, in exact fractions of the same probabilities
    text, known = "▁" + word * 4, {p: i for i, p in enumerate(pieces.pieces)}
    for c in (0, 1):
        alpha = [Fraction(1)] + [Fraction(0)] * len(text)
        for end in range(1, len(text) + 1):
            for k in range(1, min(end, pieces.longest) + 1):
                i = known.get(text[end - k : end], -1)
                if i >= 0 or k == 1:
                    alpha[end] += alpha[end - k] * Fraction(probs[i, c])
        exact = math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)
        assert language_id.word_scores([text[1:]], pieces, probs)[0, c] == pytest.approx(exact)
    assert np.isfinite(language_id.word_scores(["ab" * 20_000], pieces, probs)).all()


def test_scores_of_texts_in_pieces(monkeypatch):
    pieces = language_id.vocabulary(language_id.vocabulary_path())
    probs = np.random.default_rng(1).random((len(pieces) + 1, 2)) / 100
    texts = ["the house and das haus " * 50, "12 !?", "", "x" * 300, "naïve é"]
    whole = language_id.Scorer(pieces, ["a", "b"], probs)(texts)
    monkeypatch.setattr(language_id, "PIECE", 64)
    assert [list(map(str, x)) for x in language_id.Scorer(pieces, ["a", "b"], probs, 3)(texts)[::3]] == [list(map(str, x)) for x in whole[::3]]
    assert language_id.Scorer(pieces, ["a", "b"], probs, 3)(texts)[2] == pytest.approx(whole[2])


def test_rejects_what_no_language_fits(spark):
    rng = random.Random(3)
    rows = [(i, f"{cases.sentence(rng, 40)}", "aa") for i in range(40)] + [(50, "Ελληνικά κείμενο " * 20, None), (51, "12 34", None), (52, "ок", None), (53, None, None), (54, cases.sentence(rng, 9), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in language_id.drop_unidentified(docs, language_id.train(docs)).collect()}
    assert kept == {*range(40), 52, 54}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.drop_unidentified(unlabelled, language_id.train(unlabelled)).count() == len(rows)


def test_expected_counts_add_up():
    pieces = language_id.vocabulary(language_id.vocabulary_path())
    probs = np.full((len(pieces) + 1, 1), 1e-3)
    got = language_id.expected(["▁the", "▁the"], np.array([2.0, 1.0]), pieces, probs)
    lengths = np.array([len(p) for p in pieces.pieces])
    assert (got * lengths).sum() == pytest.approx(3 * 4)


def test_expected_counts_against_all_segmentations():
    pieces = language_id.vocabulary(language_id.vocabulary_path())
    probs = np.random.default_rng(2).random((len(pieces) + 1, 1)) / 100
    known = {p: i for i, p in enumerate(pieces.pieces)}

    def segmentations(word: str):
        if not word:
            yield []
        for k in range(1, min(len(word), pieces.longest) + 1):
            i = known.get(word[:k], -1)
            if i >= 0 or k == 1:
                yield from ([i, *rest] for rest in segmentations(word[k:]))

    want = np.zeros(len(pieces) + 1)
    for word, n in (("▁hausen", 3.0), ("▁straße", 2.0), ("▁ñx", 1.0)):
        every = [(ids, math.prod(probs[i, 0] for i in ids)) for ids in segmentations(word)]
        for ids, p in every:
            np.add.at(want, ids, n * p / sum(q for _, q in every))
    got = sum(language_id.expected([w], np.array([n]), pieces, probs) for w, n in (("▁hausen", 3.0), ("▁straße", 2.0), ("▁ñx", 1.0)))
    assert got == pytest.approx(want[:-1])


def test_identify_on_given_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_identify_awkward_rows(spark):
    docs, rows = cases.documents(spark)
    out = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for i, t in rows:
        assert (out[i].lang_pred == "und") == (not any(map(str.isalpha, t or "")))
    assert language_id.identify(cases.empty(spark)).count() == 0


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p title=it's>b &lt;c<br/>d</b></html>", "a\nb <c\nd"),
        ("<html><body><nav><a href=x>menu</a></nav><article><h1>T &amp; u</h1><p>First <b>bold</b>\n para.<p>Second.</article><footer>foot</footer>", "T & u\nFirst bold para.\nSecond."),
        ("<body><div class='cookie-notice'>We use cookies, accept them all please.</div><div class=main><p>A long paragraph of the article, with words and words.</p><p>Short.</p><ul><li>one<li>two</ul></div><div id=sidebar>Side words here</div></body>", "A long paragraph of the article, with words and words.\nShort.\none\ntwo"),
        ("<body><script>var t='<p>no</p>';</script><article><p>yes indeed</p><form><input value=x>fill</form><section class='comments'><p>I, a reader, think so</p></section></article></body>", "yes indeed"),
        ("<!-- <p>hidden</p> --><main><p>x &#233; &nbsp; y</p></main>", "x é y"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page or "") == text


def test_extract_rows(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, "v", "<p>" + "x y " * 50000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, text string")
    out = html_text.extract(pages).collect()
    assert cases.order((r.page_id, r.url, r.n_chars) for r in out) == cases.order([(1, "u", 1), (1, "u", 1), (None, None, 0), (2, "v", 199999)])
    assert html_text.extract(pages.where("false")).count() == 0


def tree(rng: random.Random, depth: int) -> tuple:
    """(tag, attributes, children): children are texts and trees."""
    children = []
    for _ in range(rng.randint(1, 4)):
        children.append(tree(rng, depth - 1) if depth and children and rng.random() < 0.6 else cases.sentence(rng, rng.randint(1, 30)))
    return rng.choice(["div", "section", "span", "a", "div", "b"]), rng.choice(["", "", ' class="ad-box"', ' id="text"']), children


def markup(node) -> str:
    return node if isinstance(node, str) else f"<{node[0]}{node[1]}>{'<br>'.join(map(markup, node[2]))}</{node[0]}>"


def brute_densities(body) -> list[tuple[float, float]]:
    """The density of each node and the sum of those of its children, by walking the tree again for each figure."""

    def texts(n, linked):
        for c in n[2]:
            if isinstance(c, str):
                yield len(c), linked or n[0] == "a"
            else:
                yield from texts(c, linked or n[0] == "a")

    def tags(n):
        for c in n[2]:
            if not isinstance(c, str):
                yield c[0]
                yield from tags(c)

    share = sum(k for k, linked in texts(body, False) if linked) / sum(k for k, _ in texts(body, False))

    def density(n, linked):
        c, lc = sum(k for k, _ in texts(n, linked)), sum(k for k, x in texts(n, linked) if x)
        t, lt = max(1, len(list(tags(n)))), max(1, list(tags(n)).count("a"))
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        ratio = c / max(lc, 1) * t / lt
        named = html_text.NAMED if "ad-box" in n[1] else 1.0
        return named * c / t * math.log(ratio) / (math.log(base) or 1.0) if ratio > 1 else 0.0

    def walk(n, linked):
        inner = [c for c in n[2] if not isinstance(c, str)]
        yield density(n, linked), sum(density(c, linked or n[0] == "a") for c in inner)
        for c in inner:
            yield from walk(c, linked or n[0] == "a")

    return list(walk(body, False))


def test_densities_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        node = ("body", "", [tree(rng, 4)])
        page = html_text.Page(markup(node))
        density, total, _ = html_text.densities(page)
        want = brute_densities(node)
        assert [(density[i], total[i]) for i, t in enumerate(page.tag) if t not in ("br", "#page")] == [pytest.approx(w) for w in want]
        # without article, main or dropped tags the largest sum decides
        best = max(range(1, len(total)), key=lambda i: (total[i] * page.weight[i], -i))
        if total[best]:
            root = html_text.article(page)[0]
            assert root <= best < page.end[root]


PROSE = "<p>" + "Some prose that goes on and on, with words and commas, for a while. " * 6 + "</p>"


@pytest.mark.parametrize(
    ("page", "paragraphs"),
    [
        (f'<body><div class="content has-sidebar">{PROSE * 2}</div></body>', 2),
        (f'<body><div id="page-with-ads">{PROSE}</div></body>', 1),
        (f'<article class="social-post">{PROSE}</article>', 1),
        (f"<body><form><div>{PROSE}</div><input></form></body>", 1),
        (f'<article>{PROSE}<p class="no-share">{PROSE[3:-4]}</p>{PROSE}</article>', 3),
        (f'<body><div class="sidebar">{PROSE * 3}</div></body>', 3),
        (f'<body><article>{PROSE * 3}</article><div class="comments">{PROSE * 2}</div></body>', 3),
        (f'<body><article>{PROSE * 3}<section id="comments">{PROSE * 2}</section></article></body>', 3),
        (f'<body><div class="menu"><a href=x>x</a></div><div><div>{PROSE * 3}</div></div><div class="sidebar">{PROSE}</div><div>Copyright notice</div></body>', 3),
        (f"<body><div>{PROSE * 3}</div><form>Sign in here <input></form></body>", 3),
    ],
)
def test_wrappers_names_and_forms(page, paragraphs):
    text = html_text.main_text(page)
    assert text.count("Some prose") == 6 * paragraphs and text.count("\n") == paragraphs - 1


@pytest.mark.parametrize("page", ["<div>", "<!", "<b>", "<ul><li>", "<table><tr><td>", "<a \"'", "<script>"])
def test_pages_that_never_end_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page * 40_000 + ("</i>" * 40_000 if page == "<b>" else ""))
    assert time.process_time() - began < 10


@pytest.mark.parametrize("page", ["<ul><li><ul>" + "<div>" * 20_000 + "<li>x</li>" * 20_000, "<dl><dd><dl>" + "<span>" * 20_000 + "<dd>x</dd>" * 20_000])
def test_items_far_below_what_bounds_them_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 10


def test_filter_never_reads_low():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    levels = rng.integers(1, 9, 3000)
    where = bloom.segment_of(h, 7)
    built = bloom.Filter(7, {s: bloom.build(h[where == s], levels[where == s], 12, 1 << 20) for s in range(7)})
    got = built.level(h, 20)
    assert (got >= levels).all() and (got == levels).mean() > 0.95
    assert built.has(rng.integers(0, 1 << 63, 3000, dtype=np.uint64)).mean() < 0.05


def brute_base(rows):
    held = [zlib.crc32(str(i).encode()) % 10 == 0 if i is not None else False for i, _ in rows]
    counts = Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            counts.update([*cases.words(t), ""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        tokens = [*cases.words(t), ""]
        out.append((i, h, len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_scores_against_brute_force(spark, monkeypatch, small):
    docs, rows = cases.documents(spark)
    if small:  # blocks of a few texts, texts in pieces
        monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 700)
        monkeypatch.setattr(lm_scoring, "PIECE_BYTES", 90)
    out = lm_scoring.score(docs, ~lm_scoring.held_out()).withColumn("held", lm_scoring.held_out()).collect()
    got = cases.order((r.doc_id, r.held, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    want = cases.order((*r[:5], round(r[5], 6)) for r in brute_base(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-6)
    exact = {(i, len(cases.words(t))): s for (i, t), s in zip(rows, brute_scores(rows), strict=True)}
    for r in out:  # the filter may read a pair high, never low
        s = exact[r.doc_id, r.n_tokens - 1]
        assert s - 1e-6 <= r.score <= s + 0.02 * abs(s) + 0.1


def brute_scores(rows):
    """The interpolated model from exact counts, quantised as the filter does."""
    one, two = Counter(), Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            w = ["", *cases.words(t), ""]
            one.update(w[1:])
            two.update(zip(w, w[1:], strict=False))
    z = sum(one.values()) + 0.1 * (len(one) + 1)
    value = lm_scoring.step_values()
    out = []
    for _, t in rows:
        w = ["", *cases.words(t), ""]
        total = 0.0
        for a, b in zip(w, w[1:], strict=False):
            pair = value[int(lm_scoring.step_of(np.array([two[a, b]]))[0])] if two[a, b] else 0.0
            total += math.log10((min(pair, one[a]) + lm_scoring.PRIOR * (one[b] + 0.1) / z) / (one[a] + lm_scoring.PRIOR))
        out.append(total)
    return out


@pytest.mark.parametrize("n", [2_000, 200_000])
def test_filter_keeps_its_error_at_any_size(n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    counts = rng.zipf(1.7, n).clip(1, 10**6)
    bits = bloom.build(h, lm_scoring.step_of(counts), lm_scoring.BITS_EACH, 1 << 62)
    unseen = bloom.Filter(1, {0: bits}).level(rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64), lm_scoring.STEPS)
    assert (unseen > 0).mean() < 0.02


def test_scores_without_rows(spark):
    docs, rows = cases.documents(spark)
    assert lm_scoring.score(cases.empty(spark), F.lit(True)).count() == 0
    out = lm_scoring.score(docs, F.lit(None).cast("boolean")).collect()
    assert len(out) == len(rows) and {r.n_known for r in out} == {0}


def test_model_beats_single_words_on_held_out(spark):
    rng = random.Random(2)
    follow = {w: [rng.choice(cases.WORDS) for _ in range(3)] for w in cases.WORDS}
    rows = []
    for i in range(300):
        w = [rng.choice(cases.WORDS)]
        for _ in range(60):
            w.append(rng.choice(follow[w[-1]]))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = lm_scoring.score(docs, ~lm_scoring.held_out()).where(lm_scoring.held_out()).collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_pipeline_stages(spark, sf):
    docs, rows = cases.documents(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < docs.count() <= before
        if name == "language_id":
            assert cases.order(r.doc_id for r in docs.collect()) == cases.order(i for i, t in rows if any(map(str.isalpha, t or "")))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, cases.empty(spark), sf).count() == 0


def test_pipeline_runs(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_scores_are_the_same_whether_the_filter_is_broadcast(spark):
    docs, _ = cases.documents(spark)
    learn = ~lm_scoring.held_out()
    rows = [cases.order(map(tuple, lm_scoring.score(docs, learn, most_broadcast=most).collect())) for most in (1 << 25, 0)]
    assert rows[0] == rows[1] and len(rows[0]) == docs.count()


def test_learned_pairs_travel_once_a_task_and_owner(spark, monkeypatch):
    """Not once a block: more blocks of text are no more messages."""
    rows = spark.createDataFrame([(i, cases.sentence(random.Random(i), 400)) for i in range(60)], "doc_id bigint, text string").coalesce(2).withColumn("learn", F.lit(True))
    for size in (1 << 23, 4000):
        monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", size)
        sent = lm_scoring.blocks(rows, 8).groupBy("kind").count().collect()
        sent = {r["kind"]: r["count"] for r in sent}
        assert sent[lm_scoring.PAIRS] <= 2 * 8
    assert sent[lm_scoring.TEXTS] > 10


def test_the_language_filter_takes_arrow_arrays(spark):
    """No batch of whole texts becomes Python strings or a pandas series beside its Arrow buffers."""
    from pyspark.util import PythonEvalType

    labelled = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    model = language_id.train(labelled, rounds=1)
    assert language_id.accepter(model, 0.5, -7.0, 50).evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF
    rows = spark.createDataFrame([(1, "the cat", "x"), (2, None, "y"), (3, "12 34", "z"), (4, "☃ 漢字" * 40, "w")], "doc_id long, text string, note string")
    assert [tuple(r) for r in language_id.drop_unidentified(rows, model).collect()] == [(1, "the cat", "x")]
