"""Operators on small inputs against brute force, and their properties."""

from __future__ import annotations

import json
import math
import random
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import boxes, cells, evaluation, grouping, impacts, labels, patterns, postings, ranking, sampling, scan, suggest, vectors
from tessera.plans import fixtures, queries
from tessera.sources import tables


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    rows = [(label, image, round(rng.random(), 3)) for label in range(8) for image in range(30) if rng.random() < 0.6]
    return spark.createDataFrame(rows, tables.POSTINGS), rows


def brute(rows, clauses):
    by = {(a, i): p for a, i, p in rows}
    out = {}
    for image in range(30):
        s = math.prod(sum(by.get((a, image), 0) for a in set(c)) for c in clauses)
        if s > 0:
            out[image] = s
    return out


def query_rows(spark, clauses):
    return spark.createDataFrame([(1, n, a) for n, c in enumerate(clauses) for a in c], "query_id bigint, clause_no int, label_id bigint")


def test_scores_and_ranks(spark, small):
    df, rows = small
    clauses = [[0, 1, 1], [2, 3]]
    want = brute(rows, clauses)
    ranked = ranking.rank_frames(df, query_rows(spark, clauses)).collect()
    assert {r.image_id: pytest.approx(r.score) for r in ranked} == want
    order = sorted(want, key=lambda i: (-want[i], i))
    assert [r.image_id for r in sorted(ranked, key=lambda r: r.rank)] == order
    again = ranking.rank_frames(df, query_rows(spark, clauses[::-1])).collect()
    assert {(r.image_id, r.rank) for r in again} == {(r.image_id, r.rank) for r in ranked}
    targets = spark.createDataFrame([(1, i) for i in range(30)], "query_id bigint, target_id bigint")
    scored = ranking.scores(df, query_rows(spark, clauses))
    for t in (order[0], order[-1]):
        one = ranking.target_ranks(scored, targets.where(F.col("target_id") == t)).first()
        assert one["rank"] == order.index(t) + 1
    missing = next(i for i in range(31) if i not in want)
    one = ranking.target_ranks(scored, spark.createDataFrame([(1, missing)], "query_id bigint, target_id bigint")).first()
    assert one["rank"] is None


def test_empty_clause_returns_nothing(spark, small):
    q = spark.createDataFrame([(1, 0, 2), (1, 1, None), (2, 0, 2)], "query_id bigint, clause_no int, label_id bigint")
    found = ranking.scores(small[0], q)
    assert {r.query_id for r in found.collect()} == {2}
    status = {r.query_id: r.status for r in ranking.result_status(q, found).collect()}
    assert status == {1: "invalid", 2: "found"}


def test_window_best_is_sliding_max(spark):
    values = {i: (i * 7919) % 101 for i in range(0, 60) if i % 3}
    df = spark.createDataFrame([(1, i, float(v)) for i, v in values.items()], "query_id bigint, image_id bigint, score double")
    got = {r.image_id: r.best for r in ranking.window_best(df.drop("score"), df, 5, ["query_id"]).collect()}
    for i in values:
        assert got[i] == max(values[j] for j in range(i, i + 5) if j in values)


def test_thresholds_independent(spark, small):
    df = small[0]
    assert postings.apply_threshold(df, 0.0).count() == df.count()
    report = {r.threshold: r.entries for r in postings.threshold_report(df, [0.5, 0.0]).collect()}
    assert report[0.0] == df.where("prob >= 0").count() and report[0.5] == df.where("prob >= 0.5").count()
    assert postings.invert(postings.annotations(df)).select("label_id", "image_id", "prob").exceptAll(df).count() == 0


def test_closure_with_cycle_and_shared_nodes(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "parent bigint, child bigint")
    got = {(r.node, r.depth) for r in labels.closure(e, spark.createDataFrame([(1,)], "start_id bigint")).collect()}
    assert got == {(1, 0), (2, 1), (3, 1), (4, 2)}


def test_expand_query_rules(spark):
    rows = [(None, 1, ["all"], [2, 3], [], ""), (0, 2, ["two"], [4], [1], ""), (1, 3, ["three"], [], [1], ""), (2, 4, ["four"], [], [2], "")]
    lab = spark.createDataFrame(rows, "label_id bigint, synset_id bigint, names array<string>, hyponyms array<bigint>, hypernyms array<bigint>, description string")
    parts = spark.createDataFrame([(1, 1, 2, False, True), (1, 2, 2, True, False), (1, 3, 1, False, False)], "query_id bigint, position int, synset_id bigint, is_and boolean, use_children boolean")
    got = {(r.clause_no, r.label_id) for r in labels.expand_query(parts, lab).collect()}
    assert got == {(0, 0), (0, 2), (1, 0), (1, 1), (1, 2)}


def test_labels_round_trip_and_arity(spark):
    line = "H~5~a b#c~6#7~~some text"
    lab = tables.parse_labels(spark.createDataFrame([(line,)], "value string"))
    r = lab.first()
    assert (r.label_id, r.synset_id, r.names, r.hyponyms, r.hypernyms, r.min_words) == (None, 5, ["a b", "c"], [6, 7], [], 1)
    assert tables.format_labels(lab).first().value == line
    with pytest.raises(Exception, match="6 fields"):
        tables.parse_labels(spark.createDataFrame([("1~2~x",)], "value string")).collect()


def test_find_patterns_with_overlaps(spark):
    texts = {1: "ananas anan", 2: "nothing", 3: "an", 4: "é.*éé"}
    pats = ["anan", "an", ".*", "é"]
    df = spark.createDataFrame(list(texts.items()), "text_id bigint, text string")
    got = {(r.text_id, r.pattern, r.start) for r in patterns.find_patterns(df, spark.createDataFrame([(p,) for p in pats], "pattern string")).collect()}
    assert got == {(i, p, s) for i, t in texts.items() for p in pats for s in range(len(t)) if t.startswith(p, s)}


@pytest.mark.parametrize("name,text,want", [("ring", "ring", 10), ("ring, old", "ring", 5), ("rings", "ring", 4), ("rings, old", "ring", 2), ("old ring", "ring", 1), ("string", "ring", 0), ("RING", "ring", 10)])
def test_bonus(spark, name, text, want):
    assert spark.createDataFrame([(name, text)], "n string, t string").select(suggest.bonus(F.col("n"), F.col("t")).alias("b")).first().b == want


def test_suggest_last_term(spark):
    got = spark.createDataFrame([("a + b * cat ",), ("cat+",), ("cat",)], "t string").select(suggest.last_term(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == ["cat", "", "cat"]


def test_rank_curve_ends_at_found_share(spark):
    df = spark.createDataFrame([("c", i, r) for i, r in enumerate([3, 1, None, 7, 3])], "config string, query_id bigint, rank bigint")
    got = [(r["rank"], r.percent) for r in evaluation.rank_curve(df).orderBy("rank").collect()]
    assert got == [(1, 20.0), (3, 60.0), (7, 80.0)]


def test_monotone_average(spark):
    ys = [5.0, 7.0, 3.0, 4.0, 1.0]
    df = spark.createDataFrame([("s", i, y) for i, y in enumerate(ys)], "s string, i int, y double")
    out, left, low = [], 0.0, math.inf
    for y in ys:
        have = y + left
        now = min(have, low)
        left, low = have - now, now
        out.append(now)
    got = [r.smooth for r in evaluation.monotone_average(df, "s", "i", "y").orderBy("i").collect()]
    assert got == pytest.approx([x / sum(out) for x in out])


def test_occupancy_and_suppression(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.uniform(-20, 1200), rng.uniform(-20, 700), 0.0, 0.0, rng.random()) for _ in range(40)]
    rows = [(i, x, y, x + rng.uniform(1, 400), y + rng.uniform(1, 300), s) for i, x, y, _, _, s in rows]
    df = spark.createDataFrame(rows, "image_id bigint, x1 double, y1 double, x2 double, y2 double, score double")
    want: dict = {}
    for i, x1, y1, x2, y2, _ in rows:
        cell = lambda v, size, n: min(n - 1, max(0, math.floor(v / size * n)))
        for row in range(cell(y1, 720, 18), cell(y2, 720, 18) + 1):
            for column in range(cell(x1, 1280, 32), cell(x2, 1280, 32) + 1):
                want[i, row] = want.get((i, row), 0) | 1 << (31 - column)
    assert {(r.image_id, r.word_no): r.bits for r in boxes.occupancy(df).collect()} == want
    df = spark.createDataFrame(rows + rows[:2] + [(1, 5.0, 5.0, 5.0, 5.0, 0.5)] * 2, df.schema)  # equal boxes, and ones without area
    want = []
    for image in range(3):
        kept: list = []
        for b in sorted((r for r in rows + rows[:2] + [(1, 5.0, 5.0, 5.0, 5.0, 0.5)] * 2 if r[0] == image), key=lambda r: (-r[5], *r[1:5])):
            area = lambda q: (q[3] - q[1]) * (q[4] - q[2])
            both = lambda p, q: max(0, min(p[3], q[3]) - max(p[1], q[1])) * max(0, min(p[4], q[4]) - max(p[2], q[2]))
            if all((u := area(k) + area(b) - both(k, b)) <= 0 or both(k, b) <= 0.1 * u for k in kept):
                kept.append(b)
        want += kept
    for most in (1000, 3, 0):  # in one fold, mixed, in rounds
        assert sorted(map(tuple, boxes.non_maximum_suppression(df, 0.1, most).collect())) == sorted(want)


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "image_id bigint, features array<double>")
    q = spark.createDataFrame([(0, 3), (0, 4), (1, 10)], "query_id bigint, image_id bigint")
    targets = spark.createDataFrame([(0, 20), (1, 30)], "query_id bigint, target_id bigint")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ranks, top = vectors.knn_rank(q, df, targets, top=5)
    for qid, images, target in ((0, [3, 4], 20), (1, [10], 30)):
        away = sum(1 - u @ u[i] for i in images)
        order = np.lexsort((np.arange(60), away)).tolist()
        r = ranks.where(F.col("query_id") == qid).first()
        assert r["rank"] == order.index(target) + 1 and r.gap == pytest.approx(away[target] - away.min(), abs=1e-6)
        assert [t.image_id for t in top.where(F.col("query_id") == qid).orderBy("rank").collect()] == order[:5]
    some = df.where("image_id % 20 = 0")
    against = vectors.pairwise_distances(some, "cosine", block=7, others=df).toPandas()
    assert len(against) == 3 * 59
    for a, b, d in against.sample(40, random_state=1).itertuples(index=False):
        assert d == pytest.approx(1 - u[a] @ u[b])
    shares = [0.0, 0.1, 0.37, 0.5, 1.0]
    assert C.exact_quantiles(vectors.pairwise_distances(df, block=7), "distance", shares) == pytest.approx(np.quantile([1 - u[a] @ u[b] for a in range(60) for b in range(a + 1, 60)], shares))
    assert C.exact_quantiles(df.where("false").withColumn("x", F.lit(1)), "x", [0.5]) == [None]
    pairs = vectors.pairwise_distances(df, "euclidean", block=7).toPandas()
    assert len(pairs) == 60 * 59 // 2
    for a, b, d in pairs.sample(50, random_state=1).itertuples(index=False):
        assert a < b and d == pytest.approx(np.linalg.norm(x[a] - x[b]))


@pytest.mark.parametrize("blocks", [64, 2, 0])
def test_queries_in_many_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(vectors, "QUERIES", 3)
    monkeypatch.setattr(vectors, "MOST_BLOCKS", blocks)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "image_id bigint, features array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = df.where("image_id < 10").select(F.col("image_id").alias("query_id"), "image_id")
    got = {(r.query_id, r["rank"]): r.image_id for r in vectors.nearest(q, df, 4).collect()}
    want = {(i, k + 1): j for i in range(10) for k, j in enumerate(np.lexsort((np.arange(50), np.round(1 - u @ u[i], 9)))[:4].tolist())}
    assert got == want
    assert vectors.nearest(q.where("false"), df, 4).count() == 0


def test_clusters_against_numpy(spark, sf):
    """Every class lies with the nearest of the clusters' means, and on the axes of most variance, as the centres do."""
    means = vectors.class_means(fixtures.features(spark, sf))
    x = np.array([r.features for r in means.orderBy("class_id").collect()])
    got, centred = grouping.clusters(means, k=3, seed=42)
    got, centred = got.orderBy("class_id").toPandas(), centred.orderBy("cluster").toPandas()
    labels = got["cluster"].to_numpy()
    assert sorted(set(labels)) == [0, 1, 2]
    centres = np.array([x[labels == c].mean(axis=0) for c in range(3)])
    assert (((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) == labels).all()
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for part, vectors_ in ((got, x), (centred, centres)):
        assert np.abs((vectors_ - x.mean(axis=0)) @ axes[:2].T) == pytest.approx(np.abs(part[["x", "y"]].to_numpy()), abs=1e-6)
    members = grouping.cluster_members(spark.createDataFrame(got)).collect()
    assert sorted(i for r in members for i in r.classes) == sorted(got["class_id"])


def test_seeds_and_rounds(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(size=(40, 3)) / 50 for c in np.eye(3) * 4])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "class_id bigint, features array<double>")
    start = grouping.seeds(rows, 3)
    assert sorted(int(np.argmax(r.centre)) for r in start.collect()) == [0, 1, 2]  # one in each heap
    found, centres = grouping.lloyd(rows, start, 10)
    heaps = {}
    for r in found.collect():
        heaps.setdefault(r["cluster"], set()).add(r["class_id"] // 40)
    assert sorted(map(sorted, heaps.values())) == [[0], [1], [2]]
    # a centre that no row is nearest to stays, and ties go to the smaller number
    two = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0]), (2, [99.0] * 3)], "cluster bigint, centre array<double>")
    found, centres = grouping.lloyd(rows, two, 1)
    at = {r["cluster"]: list(r["centre"]) for r in centres.collect()}
    assert at[1] == [0.0] * 3 and at[2] == [99.0] * 3 and at[0] == pytest.approx(x.mean(axis=0))


def test_gramian_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.random((70, 11))
    rows = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "scores array<double>").repartition(5)
    got = {(r.label_i, r.label_j): r.sum_xy for r in grouping.gramian(rows, tile=4).collect()}
    want = x.T @ x
    assert got == {(i, j): pytest.approx(want[i, j]) for i in range(11) for j in range(i, 11)}


def test_top_page_reads_upper_bands_only(spark, sf, tmp_path):
    """The same rows as from whole lists, of fewer than half of the postings, for one clause; exact for more, with ties and few results."""
    p = fixtures.supplier_postings(spark, sf).persist()
    impacts.write_impacts(p, str(tmp_path), parts=8)
    one = fixtures.supplier_queries(spark, sf)
    weights = postings.idf(postings.label_sums(p))
    two = one.withColumn("clause_no", (F.col("label_id") % 2).cast("int")).unionByName(spark.createDataFrame([(7, 1, 1), (7, 1, 999999), (8, 1, 2), (8, 2, None), (9, 1, 888888)], "query_id bigint, clause_no int, label_id bigint"))
    for asked, k, idf in ((one, 70, weights), (two, 20, None), (two, 3, weights)):
        page, report = impacts.top_page(spark, str(tmp_path), asked, k, idf, parts=8)
        want = ranking.rank_frames(p, asked, idf, top=k)
        values = lambda df: sorted((r.query_id, r["rank"], r.image_id, round(r.score, 9)) for r in df.collect())
        assert values(page) == values(want)
        read, total = report.agg(F.sum("read"), F.sum("total")).first()
        assert read <= total and (asked is not one or 2 * read < total)
    p.unpersist()


def files_of(frame):
    """Files that the scans of a plan that ran have opened."""
    plan, found = frame._jdf.queryExecution().executedPlan(), []
    plan.execute().count()
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numFiles"):
            found.append(metrics.apply("numFiles").value())
    return found


def test_seek_opens_the_labels_folders_only(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 500).alias("label_id"), F.col("id").alias("image_id"), F.lit(0.5).alias("prob"))
    impacts.write_impacts(rows, str(tmp_path), parts=32)
    wanted = spark.createDataFrame([(7, "a"), (9, "b"), (10**9, "c"), (None, "d")], "label_id bigint, note string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = impacts.seek(spark, str(tmp_path), wanted, parts=32)
        assert {(r.label_id, r.note) for r in found.collect()} == {(7, "a"), (9, "b")} and found.count() == 80
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan  # the lists stay where they are
        every = files_of(spark.read.schema(impacts.LISTS).parquet(f"{tmp_path}/lists"))
        some = files_of(found)
        assert max(some) <= 6 < max(every)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_nearest_by_cells_skips_and_is_exact(spark):
    rng = np.random.default_rng(8)
    heaps = rng.normal(size=(12, 16))
    x = np.concatenate([h + rng.normal(size=(60, 16)) / 20 for h in heaps])
    x[5] = x[6] = x[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_id bigint, features array<double>").repartition(4)
    asked = spark.createDataFrame([(q, i) for q in range(0, 700, 50) for i in (q, q + 1)], "query_id bigint, image_id bigint")
    for k in (1, 10, 200):
        page, report = cells.nearest_by_cells(asked, rows, k, cells=24)
        want = vectors.nearest(asked, rows, k)
        values = lambda df: sorted((r.query_id, r["rank"], r.image_id, round(r.distance, 8)) for r in df.collect())
        assert values(page) == values(want)
        if k == 10:
            visited, every = report.agg(F.sum("visited"), F.sum("rows")).first()
            assert visited < 0.4 * every
    page, _ = cells.nearest_by_cells(asked.limit(2), rows.limit(5), 9, cells=3)
    assert page.count() <= 10


def test_automaton_against_search():
    rng = random.Random(2)
    for _ in range(60):
        letters = "abcXÉé漢"[: rng.randint(2, 7)]
        wanted = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))})
        texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 5, 60]))) for _ in range(rng.randint(1, 5))] + ["".join(rng.choice(letters) for _ in range(2 * patterns.STRETCH + 9))]
        for ignore in (False, True):
            codes = [patterns.code_points(t) for t in texts]
            ends = np.cumsum([len(c) for c in codes])
            whole = np.concatenate(codes)
            text, end, which = patterns.Automaton(wanted, ignore).find(patterns.folded(whole) if ignore else whole, ends)
            got = sorted((int(t), wanted[w], int(e - len(wanted[w]) - ends[t] + len(codes[t]))) for t, e, w in zip(text, end, which, strict=True))
            low = str.lower if ignore else str
            assert got == sorted((i, p, s) for i, t in enumerate(texts) for p in wanted for s in range(len(t)) if low(t).startswith(low(p), s))


def test_automaton_with_and_without_table():
    rng = random.Random(3)
    for ignore in (False, True):
        wanted = list({"".join(rng.choice("abcÉ") for _ in range(rng.randint(1, 6))) for _ in range(40)})
        text = "".join(rng.choice("abcABCéÉ漢 ") for _ in range(3 * patterns.STRETCH))
        codes, ends = patterns.code_points(text), np.array([len(text)])
        table, none = patterns.Automaton(wanted, ignore), patterns.Automaton(wanted, ignore, table_bytes=0)
        # the table of small automata, which takes one look-up a character, folds case itself
        assert table.next is not None and none.next is None
        found = [sorted(zip(*(x.tolist() for x in a.find(codes, ends)), strict=True)) for a in (table, none)]
        low = str.lower if ignore else str
        assert found[0] == found[1] == sorted((0, s + len(p), i) for i, p in enumerate(wanted) for s in range(len(text)) if low(text).startswith(low(p), s))
    assert not len(patterns.Automaton([]).find(patterns.code_points("abc"), np.array([3]))[0])


def test_patterns_in_several_automata(spark):
    texts = [(1, "The THE other"), (2, None), (3, ""), (None, "then")]
    frame = spark.createDataFrame(texts, "text_id bigint, text string")
    asked = spark.createDataFrame([("the",), ("he",), ("the",), ("",), (None,), ("Oth",)], "pattern string")
    for most in (8, 1 << 20):
        got = [tuple(r) for r in patterns.find_patterns(frame, asked, ignore_case=True, most_bytes=most).collect()]
        assert sorted(got, key=repr) == sorted([(i, p, s) for i, t in texts if t for p in ("the", "he", "Oth") for s in range(len(t)) if t.lower().startswith(p.lower(), s)], key=repr)
    assert patterns.find_patterns(frame, asked, most_bytes=8).where("pattern = 'the'").count() == 2
    with pytest.raises(Exception, match="no detections|INVALID_ARRAY_INDEX"):
        spark.createDataFrame([('{"a": [["x", 0.5, [1',)], "value string").coalesce(1).write.mode("overwrite").text(f"{patterns_dir(spark)}/bad")
        tables.read_detections(spark, f"{patterns_dir(spark)}/bad").collect()


def patterns_dir(spark):
    from tessera.functions.storage import scratch

    if "dir" not in _HELD:
        _HELD["dir"] = scratch(spark)
    return _HELD["dir"]


_HELD = {}


def test_detections_of_one_line_are_many_tasks(spark, tmp_path):
    want = {f"f{i}.jpg": [[f"l{j}", j / 10, [i, j, 3.5, 4]] for j in range(i % 4)] for i in range(2000)}
    (tmp_path / "one.json").write_text(json.dumps(want))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = tables.read_detections(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 3
        got = sorted((r.file, r.box_no, r.label, r.prob, r.x, r.y, r.w, r.h) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((f, k, b[0], b[1], *map(float, b[2])) for f, own in want.items() for k, b in enumerate(own))


def test_grams_find_what_contains_finds(spark):
    rng = random.Random(4)
    rows = [(i, ["".join(rng.choice("abÉc ") for _ in range(rng.randint(0, 9))) for _ in range(2)], None if i % 9 == 0 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))) for i in range(120)]
    labels_ = spark.createDataFrame(rows, "synset_id bigint, names array<string>, description string")
    terms = ["a", "AB", "abc", "é", "c b", "bcab", "zzz"]
    found = suggest.gram_matches(labels_, spark.createDataFrame([(t,) for t in terms], "wanted string"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.wanted, r.synset_id) for r in found.collect())
    assert got == sorted((t, i) for t in terms for i, names, d in rows if t.lower() in ", ".join(names).lower() or t.lower() in (d or "").lower())


def test_find_patterns_of_repeated_ids(spark):
    texts = spark.createDataFrame([(1, "anananan"), (1, "xan"), (2, "é an")], "text_id bigint, text string")
    got = sorted(map(tuple, patterns.find_patterns(texts, spark.createDataFrame([("anan",), ("an",)], "pattern string")).collect()))
    assert got == sorted([(1, "anan", 0), (1, "anan", 2), (1, "anan", 4), (1, "an", 0), (1, "an", 2), (1, "an", 4), (1, "an", 6), (1, "an", 1), (2, "an", 2)])


def test_pruned_postings(spark, tmp_path):
    rows = spark.range(10_000).select((F.col("id") % 50).alias("label_id"), F.col("id").alias("image_id"), F.lit(0.5).alias("prob"))
    tables.write_postings(rows, f"{tmp_path}/p")
    some = tables.read_postings(spark, f"{tmp_path}/p", [7, 9])
    assert some.count() == 400
    assert "PushedFilters: [In(label_id, [7,9])]" in some._jdf.queryExecution().toString()


def test_feedback_fills_rounds(spark, sf):
    rows = queries.relevance_feedback(spark, sf).toPandas()
    assert (rows.groupby("query_id").size() == 3).all()
    for _, one in rows.sort_values("round").groupby("query_id"):
        stopped = one[one.gap == 0]
        if len(stopped):
            assert one[one["round"] >= stopped["round"].iloc[0]]["rank"].nunique() == 1


def test_dense_ids_and_split(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"), (F.col("id") % 7).alias("c"))
    assert {(r.v, r.n) for r in C.dense_ids(df, "v", name="n").collect()} == {(i, i) for i in range(1000)}
    first = sampling.split_classes(df, "c", "v", 0, 0.3)
    rest = sampling.split_classes(df, "c", "v", 0.3, -1)
    assert first.count() + rest.count() == 1000 and first.intersect(rest).count() == 0


def test_draw_frequencies(spark):
    df = spark.range(4000).select(F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("label_id"), F.lit(p).alias("prob")) for k, p in enumerate([0.6, 0.3, 0.1])])).alias("x"), F.col("id").alias("image_id")).select("x.label_id", "image_id", "x.prob")
    drawn = sampling.draw_labels(df, 1, 3).groupBy("label_id").count().toPandas().set_index("label_id")["count"] / 4000
    assert np.allclose(drawn.sort_index(), [0.6, 0.3, 0.1], atol=0.03)
    two = sampling.draw_labels(df, 5, 3)
    assert two.groupBy("image_id").count().where("count != 3").count() == 0


def test_sharded_and_saved(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("v"))
    out = tables.write_sharded(df, ["v"], 3, f"{tmp_path}/s")
    assert {r.v: r.shard for r in out.collect()} == {i: i // 4 for i in range(10)}
    assert {r.v for r in tables.read_shard(spark, f"{tmp_path}/s", 2).collect()} == {8, 9}
    again = tables.write_sharded(spark.range(3).select(F.col("id").alias("v")), ["v"], 3, f"{tmp_path}/s")
    assert again.count() == 10
    shutil.rmtree(f"{tmp_path}/s/shard=1")
    assert tables.write_sharded(df, ["v"], 3, f"{tmp_path}/s").count() == 10  # a shard is missing: made again
    for config, rank in (("a", 1), ("b", 2), ("a", 3)):
        tables.save_ranks(spark.createDataFrame([(config, 1, rank)], "config string, query_id bigint, rank bigint"), f"{tmp_path}/r")
    assert {(r.config, r["rank"]) for r in tables.restore_ranks(spark, f"{tmp_path}/r").collect()} == {("a", 3), ("b", 2)}


def test_text_files(spark, tmp_path):
    (tmp_path / "log").write_text("217781~9436708:0,15019030:1\n5~7:1\n")
    log = tables.read_query_log(spark, f"{tmp_path}/log").orderBy("query_id").collect()
    assert [(r.query_id, r.target_id, [(t.synset_id, t.use_children) for t in r.terms]) for r in log] == [(0, 217781, [(9436708, False), (15019030, True)]), (1, 5, [(7, True)])]
    (tmp_path / "ids").write_text("n00007846\nnoise\n")
    assert [r.synset_id for r in tables.read_synset_ids(spark, f"{tmp_path}/ids").collect()] == [7846]
    (tmp_path / "map").write_text("kitchen:n03619890\n")
    assert tables.read_category_mapping(spark, f"{tmp_path}/map").first().synset == "n03619890"
    (tmp_path / "curve").write_text("Rank1,Rank2,Percentage\n0.5,1,0.25\n")
    assert tables.read_rank_curves(spark, f"{tmp_path}/curve", 2).first().Percentage == 0.25
    for name in ("b/1.jpg", "a/2.jpg", "a/1.jpg"):
        path = tmp_path / "img" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    files = tables.list_files(spark, f"{tmp_path}/img").orderBy("image_id").collect()
    assert [r.path[-7:] for r in files] == ["a/1.jpg", "a/2.jpg", "b/1.jpg"]
    assert tables.non_empty(spark.createDataFrame([("a", 0), ("b", 3)], "path string, length bigint")).first().path == "b"


def test_model_scan(spark):
    df = spark.range(20).select(F.col("id").alias("image_id"))
    out = scan.score_images(df, lambda: lambda frame: pd.DataFrame({"image_id": frame["image_id"], "twice": frame["image_id"] * 2}), "image_id bigint, twice bigint")
    assert {(r.image_id, r.twice) for r in out.collect()} == {(i, 2 * i) for i in range(20)}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(__import__("tessera.plans.oracles", fromlist=["ORACLES"]).ORACLES)))
def test_queries_without_sql_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_running_sums_of_one_large_key(spark):
    rng = random.Random(6)
    rows = [("big", i, rng.randint(0, 9)) for i in range(3000)] + [(f"k{i}", j, 1) for i in range(20) for j in range(3)]
    rng.shuffle(rows)
    got = C.running_sum(spark.createDataFrame(rows, "k string, o int, v int"), ["k"], "o", "v", "upto")
    want, sofar = [], {}
    for k, o, v in sorted(rows):
        sofar[k] = sofar.get(k, 0) + v
        want.append((k, o, v, sofar[k]))
    assert sorted((r.k, r.o, r.v, r.upto) for r in got.collect()) == want


def test_models_are_loaded_once_a_worker():
    calls = []

    def load():
        calls.append(1)
        return lambda frame: frame.assign(n=len(frame))

    scan.MODELS.clear()
    for _ in range(3):
        assert scan.loaded("a", load)(pd.DataFrame({"x": [1, 2]}))["n"].tolist() == [2, 2]
    for name in "bcd":
        scan.loaded(name, load)
    assert len(calls) == 4 and len(scan.MODELS) == scan.MOST_MODELS


def test_rounded_as_sql_rounds_doubles(spark):
    import duckdb

    values = [2885.5, 6456.5, -2885.5, 138.58, 0.0, 5135.5, -6093.5]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(C.rounded(F.col("v") / 10000, 4).alias("x")).collect()]
    con = duckdb.connect()
    assert got == [con.execute("select round(?::double / 10000, 4)", [v]).fetchone()[0] for v in values]


def test_quantiles_count_and_write_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    values = [*rng.normal(size=700).tolist(), *[0.25] * 90, 1e300, -1e300, 5e-324, math.inf, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    shares = [i / 37 for i in range(38)]

    def place(s):
        q, at = s * (len(values) - 1), sorted(values)
        low = at[int(q)]
        return low + (at[min(int(q) + 1, len(at) - 1)] - low) * (q - int(q))

    monkeypatch.setattr(C, "settled", None)  # no table is written
    for least in (C.LEFT, 3):
        monkeypatch.setattr(C, "LEFT", least)
        got = C.exact_quantiles(df, "x", shares)
        assert [g for g in got[1:-1]] == pytest.approx([place(s) for s in shares][1:-1])
    assert C.exact_quantiles(spark.createDataFrame([(2.0,), (math.nan,)], "x double"), "x", [0.0])[0] == 2.0


def test_pairs_send_blocks_of_queries_only(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "image_id bigint, features array<double>")
    pairs = vectors.pairwise_distances(df.where("image_id < 5"), "euclidean", block=2, others=df)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "BroadcastNestedLoopJoin" in plan and pairs.count() == 5 * 39
    scanned = vectors.nearest(df.where("image_id < 5").select(F.col("image_id").alias("query_id"), "image_id"), df.where("image_id > 0"), 3)
    assert "MapInPandas" not in scanned._jdf.queryExecution().executedPlan().toString() and scanned.count() == 12


@pytest.mark.parametrize("most", [0, 1000])
def test_shared_clauses_expand_once(spark, monkeypatch, most):
    monkeypatch.setattr(labels, "MOST_BROADCAST", most)
    rows = [(None, 1, [10, 11, 12], []), *[(i, i, [], []) for i in (10, 11, 12)], (None, 2, [], [])]
    graph = spark.createDataFrame(rows, "label_id bigint, synset_id bigint, hyponyms array<bigint>, hypernyms array<bigint>")
    parts = [(q, 1, 1, False, True) for q in range(50)] + [(q, 2, 10, False, False) for q in range(50)] + [(50, 1, 2, False, True), (50, 2, 1, True, False), (51, 1, 99, False, True)]
    out = labels.expand_query(spark.createDataFrame(parts, "query_id bigint, position int, synset_id bigint, is_and boolean, use_children boolean"), graph)
    found = sorted((r.query_id, r.clause_no, r.label_id or 0) for r in out.collect())
    assert found == sorted([*[(q, 0, i) for q in range(50) for i in (10, 11, 12)], (50, 0, 0), *[(50, 1, i) for i in (10, 11, 12)], (51, 0, 0)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(line.lstrip(" :+-").startswith("Aggregate [query_id") for line in plan.split("\n"))


def test_configurations_share_a_row(spark, small, monkeypatch):
    df, rows = small
    written = []
    monkeypatch.setattr(evaluation, "settled", lambda x: written.append(x.count()) or x)
    q = spark.createDataFrame([(n, at + 1, (n + at) % 8) for n in range(5) for at in range(3)], "query_id bigint, position int, label_id bigint")
    targets = spark.createDataFrame([(n, 3 * n) for n in range(5)], "query_id bigint, target_id bigint")
    weights = spark.createDataFrame([(a, 1.0 + a) for a in range(8)], "label_id bigint, idf double")
    got = {(r.config, r.query_id): r["rank"] for r in evaluation.rank_targets(df, q, targets, [0.0, 0.5], [1, 3], weights, digits=6).collect()}
    assert len(got) == 40 and len(written) == 1 and written[0] <= 2 * 5 * 30
    for (config, n), rank in got.items():
        kind, t, length = config.split(" ")
        own = [(n + at) % 8 for at in range(int(length[1:]))]
        scores = {}
        for a, i, p in rows:
            if a in own and p >= float(t[1:]):
                scores[i] = scores.get(i, 0) + p * (1 + a if kind == "idf" and len(own) > 1 else 1)
        order = sorted(scores, key=lambda i: (-round(scores[i], 6), i))
        assert rank == (order.index(3 * n) + 1 if 3 * n in scores else None)


def test_pairs_of_labels_in_bounded_tasks(spark, monkeypatch):
    rows = [(i, (i * j) % 7, 1.0 / (1 + j)) for i in range(60) for j in range(1, 4)] + [(1, 1, 0.5), (None, 1, 0.5), (2, None, 0.5)]
    frame = spark.createDataFrame(rows, "image_id bigint, label_id bigint, prob double")
    want = {}
    for i, a, p in rows:
        for k, b, q in rows:
            if i == k and i is not None and a is not None and b is not None and a <= b:
                want[a, b] = want.get((a, b), 0) + p * q
    monkeypatch.setattr(postings, "TASK_ROWS", 20)
    got = postings.cooccurrence(frame)
    # as many tasks as the rows take, whatever the session's number of partitions
    assert got.rdd.getNumPartitions() == -(-len(rows) // 20)
    assert {(r[0], r[1]): round(r[2], 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    sums, n = {}, len({i for i, *_ in rows if i is not None})
    for _, a, p in rows:
        sums[a] = sums.get(a, 0) + p
    for most in (0, 100):
        monkeypatch.setattr(postings, "MOST_BROADCAST", most)
        cov = {(r[0], r[1]): round(r[2], 9) for r in postings.covariance(frame).collect()}
        assert cov == {(a, b): round(v / n - sums[a] / n * sums[b] / n, 9) for (a, b), v in want.items()}


def test_text_sums_of_repeated_ids(spark, tmp_path):
    rows = [(1, "A b  a"), (1, "b c"), (2, None), (3, ""), (None, "a d"), (None, "d"), (4, " e a\n"), (5, "e")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {r[0]: round(r[1], 9) for r in fixtures.text_postings(spark, str(tmp_path)).groupBy("word").sum("prob").collect()}
    sums = fixtures.text_sums(spark, str(tmp_path))
    assert {r[0]: round(r[1], 9) for r in sums.collect()} == want
    assert want["a"] == round(2 / 5 + 1 / 3 + 1 / 2, 9)


def test_detections_are_parsed_once(spark, tmp_path):
    (tmp_path / "few.json").write_text('{"a.jpg": [], "b.jpg": [["x", 1e-3, [1, 2, 3.5, 4]]], "c.jpg": [["y", 0.5, [5, 6, 7, 8]]]}')
    found = tables.read_detections(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("b.jpg", 0, "x", 0.001, 1, 2, 3.5, 4), ("c.jpg", 0, "y", 0.5, 5, 6, 7, 8)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapType(StringType,StringType" not in plan
