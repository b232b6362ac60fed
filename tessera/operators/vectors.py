"""Feature vectors: distances, ranking by similarity, feedback rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.columns import cosine_distance, dense_ids, dot, exact_quantiles
from tessera.functions.storage import discard, settled

#: Queries of a block; those multiplied at once; blocks and bytes that are broadcast at once at most.
QUERIES, ROWS, MOST_BLOCKS, SENT_BYTES = 512, 64, 64, 64 << 20
#: Digits to which distances are compared, so that equal vectors tie whatever the order of sums.
DIGITS = 9


def class_means(vectors: DataFrame) -> DataFrame:
    """class_id, features: mean of each class's vectors (class_id, features), summed by position."""
    each = vectors.select("class_id", F.posexplode("features").alias("pos", "x"))
    means = each.groupBy("class_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("f")).select("class_id", F.transform("f", lambda s: s["x"]).alias("features"))


def query_vectors(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, n, unit: sums of the unit vectors of each query's images (query_id, image_id).

    The sum of cosine distances to n vectors is n less the product with this sum.
    """
    return unit_sums(queries.join(vectors.select("image_id", "features"), "image_id"))


def unit_sums(chosen: DataFrame) -> DataFrame:
    """query_id, n, unit of each query's vectors (query_id, features)."""
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    each = chosen.select("query_id", F.posexplode(F.transform("features", lambda x: x.cast("double"))).alias("pos", "x"), norm.alias("norm"))
    sums = each.groupBy("query_id", "pos").agg(F.sum(F.col("x") / F.col("norm")).alias("x"), F.count("*").alias("n"))
    return sums.groupBy("query_id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("f")).select("query_id", "n", F.transform("f", lambda s: s["x"]).alias("unit"))


def _packed(vectors: DataFrame) -> DataFrame:
    """ids, features (one after the other): a row for each Arrow batch of vectors (image_id, features)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                ids = rows.column(0).cast(pa.int64())
                flat = rows.column(1).flatten().cast(pa.float64())
                yield pa.RecordBatch.from_arrays([_list([0, len(x)], x) for x in (ids, flat)], names=["ids", "features"])

    return vectors.select("image_id", "features").mapInArrow(pack, "ids array<bigint>, features array<double>")


def _list(offsets, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _in_blocks(rows: DataFrame, key: str, flat: str, block: int | None = None) -> tuple[DataFrame, int, int]:
    """(block, arrays of the columns, number of blocks, blocks to broadcast at once) of rows in blocks of QUERIES or so many; the vectors (flat) one after the other."""
    names = [c for c in rows.columns if c != flat]
    size = block or QUERIES
    numbered = dense_ids(rows, key, name="_n").withColumn("block", F.floor(F.col("_n") / size).cast("int"))
    lists = numbered.groupBy("block").agg(F.collect_list(F.struct(*names, flat)).alias("x"))
    blocks = settled(lists.select("block", *[F.col(f"x.{c}").alias(c) for c in names], F.flatten(F.transform("x", lambda r: r[flat].cast("array<double>"))).alias(flat), F.size(F.col("x")[0][flat]).alias("width")))
    count, width = blocks.agg(F.count("*"), F.coalesce(F.max("width"), F.lit(1))).first()
    return blocks, count, max(1, min(MOST_BLOCKS, SENT_BYTES // (16 * size * max(1, width))))


def _met(blocks: DataFrame, count: int, at_once: int, packed: DataFrame, names: list[str]) -> DataFrame:
    """Every row of packed vectors beside every block of a stated query set; each group of blocks, of bounded bytes, takes a scan of the vectors."""
    met = None
    for first in range(0, max(1, count), at_once):
        own = blocks.where(F.col("block").between(first, first + at_once - 1)).select(*names)
        part = packed.crossJoin(F.broadcast(own)).select("ids", "features", *names)
        met = part if met is None else met.unionByName(part)
    return met


def _scan(sums: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, target_id, own, nearer, least, tops: a row for each query and block of vectors.

    sums: query_id, n, unit, target_id, own. Queries are packed into blocks, and
    so are vectors. Blocks of queries are broadcast in groups of SENT_BYTES at
    most, each of which takes a scan of the vectors; vectors are not shuffled. A
    task multiplies ROWS queries and a block of vectors at once, both flat
    arrays of the Arrow batch. tops are the k nearest (distance, image_id) of the block.
    """
    names = ["query_id", "n", "target_id", "own", "unit"]
    met = _met(*_in_blocks(sums.select(*names), "query_id", "unit"), _packed(vectors), names)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in range(rows.num_rows):
                images, flat, ids, n, targets, own, units = (c[r].values for c in rows.columns)
                images = images.to_numpy()
                x = flat.to_numpy().reshape(len(images), -1)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                n, units = n.to_numpy().astype(float), units.to_numpy().reshape(len(ids), -1)
                goals = targets.fill_null(-1).to_numpy()
                held = own.to_numpy(zero_copy_only=False)
                for a in range(0, len(ids), ROWS):
                    part = slice(a, a + ROWS)
                    away = np.round(n[part, None] - units[part] @ x.T, DIGITS)
                    nearer = (away < held[part, None]) | ((away == held[part, None]) & (images[None, :] < goals[part, None]))
                    nearer &= images[None, :] != goals[part, None]
                    order = np.lexsort((np.broadcast_to(images, away.shape), away), axis=1)[:, :k]
                    best = pa.StructArray.from_arrays([pa.array(np.take_along_axis(away, order, axis=1).ravel()), pa.array(images[order].ravel())], names=["distance", "image_id"])
                    tops = _list(np.arange(len(away) + 1) * order.shape[1], best)
                    counts = [pa.array(nearer.sum(axis=1).astype(np.int64)), pa.array(away.min(axis=1))]
                    yield pa.RecordBatch.from_arrays([ids[part], targets[part], own[part], *counts, tops], names=["query_id", "target_id", "own", "nearer", "least", "tops"])

    return met.mapInArrow(multiply, "query_id bigint, target_id bigint, own double, nearer bigint, least double, tops array<struct<distance:double,image_id:bigint>>")


def _first(scanned: DataFrame, k: int) -> DataFrame:
    rows = scanned.select("query_id", F.explode("tops").alias("t")).select("query_id", "t.image_id", "t.distance")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "image_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, image_id, distance, rank: the k images with the smallest sum of cosine distances to each query's vectors.

    A stated query set against all vectors, in blocks; k rows a query and block
    are ranked after a shuffle.
    """
    none = F.lit(None)
    return _first(_scan(query_vectors(queries, vectors).select("query_id", "n", "unit", none.cast("bigint").alias("target_id"), none.cast("double").alias("own")), vectors, k), k)


def knn_rank(queries: DataFrame, vectors: DataFrame, targets: DataFrame, top: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """(query_id, target_id, rank, gap) of the targets, and with top the first rows of each ranking, from one scan of the vectors.

    Ranks are counted: the target's distance goes along with the query, and each
    task returns, for each query, how many of its images are nearer and the
    smallest distance. gap is the target's distance less the smallest.
    """
    return _ranks(query_vectors(queries, vectors), goals(targets, vectors), vectors, top)


def goals(targets: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, target_id, goal (the target's vector) of targets that have one."""
    return targets.select("query_id", "target_id").join(vectors.select(F.col("image_id").alias("target_id"), F.col("features").alias("goal")), "target_id").select("query_id", "target_id", "goal")


def _ranks(sums: DataFrame, wanted: DataFrame, vectors: DataFrame, top: int) -> tuple[DataFrame, DataFrame | None]:
    goal = F.transform("goal", lambda x: x.cast("double"))
    product = dot(F.col("unit"), goal) / F.sqrt(dot(goal, goal))
    own = sums.join(wanted, "query_id").select("query_id", "n", "unit", "target_id", F.round(F.col("n") - product, DIGITS).alias("own"))
    scanned = settled(_scan(own, vectors, top))
    ranks = scanned.groupBy("query_id", "target_id").agg((F.sum("nearer") + 1).alias("rank"), F.greatest(F.lit(0.0), F.round(F.first("own") - F.min("least"), DIGITS - 1)).alias("gap"))
    return ranks, (_first(scanned, top) if top else None)


def closest_shown(ranking: DataFrame, targets: DataFrame, vectors: DataFrame, disp_size: int, n_closest: int) -> DataFrame:
    """query_id, image_id: of the first disp_size images of each ranking the n_closest to the target."""
    return _closest(_shown(ranking, vectors, disp_size), goals(targets, vectors), n_closest).select("query_id", "image_id")


def _shown(ranking: DataFrame, vectors: DataFrame, disp_size: int) -> DataFrame:
    """query_id, image_id, features of what is shown: a bounded number of rows a query, found in one read of the vectors."""
    return ranking.where(F.col("rank") <= disp_size).select("query_id", "image_id").join(vectors.select("image_id", "features"), "image_id")


def _closest(shown: DataFrame, wanted: DataFrame, n_closest: int) -> DataFrame:
    away = shown.join(wanted, "query_id").withColumn("away", F.round(cosine_distance(F.col("features"), F.col("goal")), DIGITS))
    order = F.row_number().over(W.partitionBy("query_id").orderBy("away", "image_id"))
    return away.withColumn("place", order).where(F.col("place") <= n_closest).select("query_id", "image_id", "features")


def relevance_feedback(ranking: DataFrame, targets: DataFrame, vectors: DataFrame, disp_size: int, n_closest: int, rounds: int) -> DataFrame:
    """query_id, target_id, round, rank, gap for rounds 1 to `rounds`.

    All queries go through a round together: choose from what is shown, rank by
    the chosen, keep the first disp_size. A query whose target is as near as the
    best (gap 0) stops, and its last rank fills its later rounds. The targets'
    vectors are taken once; a round looks up the vectors of what is shown and
    scans all of them once. Only disp_size rows a query and one row a target live
    from round to round, written.
    """
    shown, active, out = ranking, settled(goals(targets, vectors)), None
    for at in range(1, rounds + 1):
        chosen = _closest(_shown(shown.join(active.select("query_id"), "query_id", "left_semi"), vectors, disp_size), active, n_closest)
        ranks, first = _ranks(unit_sums(chosen), active, vectors, disp_size)
        ranks, before = settled(ranks.withColumn("round", F.lit(at))), shown
        out = ranks if out is None else out.unionByName(ranks)
        if at < rounds:
            shown = settled(first)
            active = settled(active.join(ranks.where("gap > 0").select("query_id"), "query_id", "left_semi"))
        if 1 < at < rounds:
            discard(before)
    if out is None:
        raise ValueError("rounds must be 1 or more")
    last = out.groupBy("query_id", "target_id").agg(F.max_by(F.struct("rank", "gap"), "round").alias("x"), F.max("round").alias("last"))
    filled = last.where(F.col("last") < rounds).select("query_id", "target_id", F.explode(F.sequence(F.col("last") + 1, F.lit(rounds))).alias("round"), "x.rank", "x.gap")
    return out.select("query_id", "target_id", "round", "rank", "gap").unionByName(filled)


def feedback_grid(ranking: DataFrame, targets: DataFrame, vectors: DataFrame, grid: list[tuple[int, int]], rounds: int) -> DataFrame:
    """config, query_id, round, rank for each (disp_size, n_closest); null ranks for targets without a ranking."""
    found = None
    for disp_size, n_closest in grid:
        one = relevance_feedback(ranking, targets, vectors, disp_size, n_closest, rounds).select(F.format_string(f"{disp_size}:{n_closest} %dx", F.col("round")).alias("config"), "query_id", "round", "rank")
        found = one if found is None else found.unionByName(one)
    spark = targets.sparkSession
    rows = spark.createDataFrame([(f"{d}:{c} {r}x", r) for d, c in grid for r in range(1, rounds + 1)], "config string, round int")
    return targets.select("query_id").crossJoin(F.broadcast(rows)).join(found, ["config", "query_id", "round"], "left")


def pairwise_distances(vectors: DataFrame, metric: str = "cosine", block: int | None = None, others: DataFrame | None = None) -> DataFrame:
    """a, b, distance of all pairs a < b of a sample of vectors (image_id, features), or with others of all pairs a in the sample, b in others, a <> b.

    A stated set against all rows, or quadratic in the sample, by definition: its
    blocks are broadcast in groups of SENT_BYTES at most, and all rows, dealt by
    their ids and packed, meet them where they are; pairs are not shuffled. The
    distances are the same in every pass: rows are multiplied in the order of their ids.
    """
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (vectors if others is None else others).select("image_id", "features").repartition(n, "image_id").sortWithinPartitions("image_id")
    sample = vectors.select(F.col("image_id").cast("bigint").alias("a"), F.col("features").alias("x"))
    met = _met(*_in_blocks(sample, "a", "x", block), _packed(rows), ["a", "x"])
    every = others is not None

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in range(rows.num_rows):
                b, y, a, x = (c[r].values.to_numpy() for c in rows.columns)
                x, y = x.reshape(len(a), -1), y.reshape(len(b), -1)
                for first in range(0, len(a), ROWS):
                    part = slice(first, first + ROWS)
                    if metric == "cosine":
                        d = 1 - (x[part] @ y.T) / np.linalg.norm(x[part], axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :]
                    else:
                        d = np.sqrt(np.maximum((x[part] ** 2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x[part] @ y.T, 0))
                    kept = (a[part, None] != b[None, :] if every else a[part, None] < b[None, :]).ravel()
                    out = [np.repeat(a[part], len(b)), np.tile(b, len(d)), d.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(v if kept.all() else v[kept]) for v in out], names=["a", "b", "distance"])

    return met.mapInArrow(multiply, "a bigint, b bigint, distance double")


def distance_summary(distances: DataFrame) -> DataFrame:
    return distances.agg(F.min("distance").alias("least"), F.max("distance").alias("most"), F.count("*").alias("pairs"))


def quantiles(distances: DataFrame, steps: int = 100) -> DataFrame:
    """share, distance: the empirical distribution at equal steps, read off counts of ever smaller ranges."""
    shares = [i / steps for i in range(steps + 1)]
    return distances.sparkSession.createDataFrame(list(zip(shares, exact_quantiles(distances, "distance", shares), strict=True)), "share double, distance double")


def sketched_quantiles(distances: DataFrame, steps: int = 100, k: int = 400) -> DataFrame:
    """share, distance: as quantiles(), from one mergeable sketch of bounded size (KLL) instead of an order of all rows.

    Every task makes a sketch and sends only that. A value's rank is off by less
    than 3 / k of the rows (k = 400: 0.75 %) with a probability of over 0.99.
    """
    shares = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    sketch = distances.where(F.col("distance").isNotNull()).agg(F.kll_sketch_agg_double(F.col("distance").cast("double"), F.lit(k)).alias("s"), F.count("*").alias("n"))
    found = sketch.where("n > 0").select(F.posexplode(F.kll_sketch_get_quantile_double("s", shares)).alias("i", "distance"))
    return found.select((F.col("i") / steps).alias("share"), "distance")


def histogram(values: DataFrame, column: str, bins: int = 200) -> DataFrame:
    """bin, low, n, density over equal widths from the smallest to the largest value."""
    ends = values.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"), F.count(column).alias("all"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / width)).cast("int")
    rows = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", F.when(width > 0, place).otherwise(0)).withColumn("width", width)
    counts = rows.groupBy("bin", "lo", "width", "all").agg(F.count("*").alias("n"))
    return counts.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), "n", F.when(F.col("width") > 0, F.col("n") / (F.col("all") * F.col("width"))).alias("density"))

