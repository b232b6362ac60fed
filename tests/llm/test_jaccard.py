"""Operator 11 against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import components, jaccard_join
from tests.llm import cases


def shingles(text, width=3):
    w = cases.words(text)
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, percent=90, width=3):
    sets = [shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
    least = {g: min((k for (k, _), h in zip(rows, group, strict=True) if h == g and k is not None), default=None) for g in group}
    return [(k, len(s), least[g]) for (k, _), s, g in zip(rows, sets, group, strict=True)]


def families(seed, copies):
    """Texts with few and many words changed, a passage in all of one family, sizes around the least that can link."""
    rng = random.Random(seed)
    out = []
    for _ in range(2):
        base = cases.sentence(rng, rng.randint(60, 140)).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5, 9])):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
            out.append(" ".join(own))
    passage = cases.sentence(rng, 40)
    out += [f"{cases.sentence(rng, 60)} {passage}" for _ in range(copies)]
    for n in range(1, 14):
        short = cases.sentence(rng, n)
        out += [short, short.upper() + "\t", short + " more"]
    return out


@pytest.mark.parametrize(("crowd", "most_costly"), [(8, 1 << 24), (2, 1 << 24), (1, 1 << 24), (2, 10), (1000, 1 << 24)])
def test_components(spark, crowd, most_costly):
    rows = [(i * 7 % 211, t) for i, t in enumerate(families(5, 24))] + [(None, "a b c d e f g h i j k l"), (300, "A b c d e f g h i j k l")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = jaccard_join.jaccard_components(frame, crowd=crowd, most_costly=most_costly)
    assert cases.order(map(tuple, got.collect())) == cases.order(brute(rows))


@pytest.mark.parametrize("crowd", [1, 8])
def test_awkward_rows(spark, crowd):
    docs, rows = cases.documents(spark)
    got = jaccard_join.jaccard_components(docs, crowd=crowd)
    assert cases.order(map(tuple, got.collect())) == cases.order(brute(rows))
    assert jaccard_join.jaccard_components(cases.empty(spark)).count() == 0


def test_other_widths_and_similarities(spark):
    rows = [(i, t) for i, t in enumerate(families(9, 10))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for percent, width in ((60, 1), (75, 2), (100, 3)):
        got = jaccard_join.jaccard_components(frame, percent=percent, width=width, crowd=3)
        assert cases.order(map(tuple, got.collect())) == cases.order(brute(rows, percent, width))


def test_prefixes_hold_what_similar_sets_must_share():
    """Whatever is costly: two similar sets share `need` affordable tokens of their prefixes, or both are crowded."""
    rng = np.random.default_rng(2)
    for _ in range(400):
        percent = int(rng.choice([60, 80, 90]))
        n = int(rng.integers(2, 200))
        whole = np.sort(rng.choice(10**6, n, replace=False))
        spare = jaccard_join.spared(n, percent)
        one = np.delete(whole, rng.choice(n, rng.integers(0, spare + 1), replace=False))
        costly = set(whole[rng.random(n) < rng.choice([0, 0.05, 0.3, 0.9])].tolist())
        found = []
        for s in (whole, one):
            head = s[: jaccard_join.head_length(len(s), percent)]
            mark = np.array([x in costly for x in head.tolist()], bool)
            length, matches, need = jaccard_join.chosen_prefix(len(s), mark, percent) or (len(head), 10**9, 1)
            found.append((matches, need, set(head[:length][~mark[:length]].tolist())))
        if 100 * len(one) >= percent * n and min(f[0] for f in found) < 10**9:
            need = min(found)[1] if found[0][0] != found[1][0] else max(f[1] for f in found)
            assert len(found[0][2] & found[1][2]) >= need


def test_block_links():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = ([np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(15)] for _ in range(2))
        i, j = jaccard_join.block_links(a, b, 30)
        want = {(x, y) for x in range(15) for y in range(15) if 100 * len({*a[x]} & {*b[y]}) >= 30 * len({*a[x]} | {*b[y]})}
        assert {*zip(i.tolist(), j.tolist(), strict=True)} == want


def test_components_of_hubs_paths_and_random_links(spark):
    rng = random.Random(3)
    cases_ = [[(9, i) for i in range(9)], [(0, i) for i in range(1, 9)], [(5, i) for i in range(10) if i != 5], [(i, i + 1) for i in range(20)], [(20, 3), (20, 4), (None, 3), (7, 7)]]
    cases_ += [[(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randint(1, 40))] for _ in range(6)]
    for links in cases_:
        group = {x: x for link in links for x in link}
        for a, b in links:
            if None not in (a, b):
                group = {k: group[a] if g == group[b] else g for k, g in group.items()}
        linked = {x for a, b in links if None not in (a, b) and a != b for x in (a, b)}
        want = {x: min(k for k, g in group.items() if g == group[x] and k is not None) for x in linked}
        got = components.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()
        assert len(got) == len(want) and {r.node: r.root for r in got} == want
