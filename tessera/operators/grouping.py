"""Grouping class vectors: co-occurrence of dense scores, k-means, principal axes; sums are made by block on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import uniform
from tessera.functions.storage import discard, settled

#: Side of a block of the product; tasks whose partial blocks are summed first.
TILE, BRANCHES = 256, 32
#: Digits to which squared distances are compared, so that ties are the same whatever the order of sums.
DIGITS = 9


def gramian(vectors: DataFrame, column: str = "scores", tile: int = TILE) -> DataFrame:
    """label_i <= label_j, sum_xy: products of the entries of dense vectors of one length, summed over all rows.

    A task multiplies its batches as matrices, block by block of the upper
    triangle, and returns each block once; partial blocks are summed by (block,
    branch) and then by block. No task and not the driver holds more than its
    blocks. Null entries count as 0, null vectors not at all.
    """

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for frame in frames:
            if not len(frame):
                continue
            x = np.nan_to_num(np.array(frame[column].tolist(), float))
            for i in range(0, x.shape[1], tile):
                for j in range(i, x.shape[1], tile):
                    part = x[:, i : i + tile].T @ x[:, j : j + tile]
                    held[i, j] = held[i, j] + part if (i, j) in held else part
        for (i, j), part in held.items():
            yield pd.DataFrame({"i": [i], "j": [j], "width": [part.shape[1]], "sums": [part.ravel()]})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": rows["i"].iloc[:1], "j": rows["j"].iloc[:1], "width": rows["width"].iloc[:1], "sums": [np.sum(np.stack(rows["sums"].to_numpy()), axis=0)]})

    kind = "i int, j int, width int, sums array<double>"
    parts = vectors.where(F.col(column).isNotNull()).select(column).mapInPandas(multiply, kind).withColumn("branch", F.spark_partition_id() % BRANCHES)
    some = parts.groupBy("i", "j", "branch").applyInPandas(added, kind)
    whole = some.groupBy("i", "j").applyInPandas(added, kind)
    cells = whole.select("i", "j", "width", F.posexplode("sums").alias("at", "sum_xy"))
    out = cells.select((F.col("i") + F.floor(F.col("at") / F.col("width"))).cast("bigint").alias("label_i"), (F.col("j") + F.col("at") % F.col("width")).cast("bigint").alias("label_j"), "sum_xy")
    return out.where("label_i <= label_j")


def squared(x: Column, y: Column) -> Column:
    return F.round(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v), DIGITS)


def points(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("features").isNotNull()).select(key, F.transform("features", lambda x: x.cast("double")).alias("features"))


def assigned(rows: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """key, features, cluster, away: the nearest of the centres (cluster, centre), ties to the smaller number. Centres are a stated number."""
    every = F.broadcast(centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("centres")))
    near = F.array_min(F.transform("centres", lambda c: F.struct(squared(F.col("features"), c["centre"]).alias("away"), c["cluster"].alias("cluster"))))
    return rows.crossJoin(every).select(key, "features", near.alias("x")).select(key, "features", "x.cluster", "x.away")


def means(rows: DataFrame) -> DataFrame:
    """cluster, centre: means of the features, by position."""
    each = rows.select("cluster", F.posexplode("features").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x"))
    return each.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("f")).select("cluster", F.transform("f", lambda s: s["x"]).alias("centre"))


def lloyd(rows: DataFrame, centres: DataFrame, rounds: int, key: str = "class_id") -> tuple[DataFrame, DataFrame]:
    """(key, cluster) and (cluster, centre) after `rounds` rounds, or when no centre moves any more.

    A round is one aggregation with the centres broadcast; a cluster that loses
    all its rows keeps its centre.
    """
    own = points(rows, key)
    for _ in range(rounds):
        moved = means(assigned(own, centres, key)).withColumnRenamed("centre", "moved")
        both = settled(centres.join(moved, "cluster", "left").select("cluster", F.coalesce("moved", "centre").alias("centre"), (squared(F.coalesce("moved", "centre"), F.col("centre")) > 0).alias("changed")))
        still = both.where("changed").isEmpty()
        centres = both.select("cluster", "centre")
        if still:
            break
    return assigned(own, centres, key).select(key, "cluster"), centres


def seeds(rows: DataFrame, k: int, seed: int = 42, rounds: int = 5, factor: float = 2.0, key: str = "class_id") -> DataFrame:
    """cluster, centre: k starting centres by k-means||, with uniforms hashed from the keys.

    In each round a row is drawn with a probability in proportion to its squared
    distance from what is drawn already, about factor * k rows a round. Rows near
    a candidate are its weight; of the candidates, whose number is stated, k are
    chosen one after the other by the largest weight times squared distance.
    """
    own = settled(points(rows, key))
    u = lambda r: uniform(F.col(key), f"{seed}-{r}")
    drawn = settled(own.orderBy(u(0), key).limit(1).select(F.col(key).alias("cluster"), F.col("features").alias("centre")))
    for r in range(1, rounds + 1):
        away = settled(assigned(own, drawn, key))
        total = away.agg(F.sum("away").alias("total"))
        more = away.crossJoin(F.broadcast(total)).where((F.col("away") > 0) & (u(r) < F.lit(factor * k) * F.col("away") / F.col("total")))
        drawn = settled(drawn.unionByName(more.select(F.col(key).alias("cluster"), F.col("features").alias("centre"))))
        discard(away)
    weights = assigned(own, drawn, key).groupBy("cluster").agg(F.count("*").alias("weight"))
    found = drawn.join(weights, "cluster").orderBy(F.desc("weight"), "cluster").collect()  # about 1 + factor * k * rounds rows
    x, w = np.array([r["centre"] for r in found], float), np.array([r["weight"] for r in found], float)
    chosen = [0] if len(found) else []
    while len(chosen) < min(k, len(found)):
        near = np.min(((x[:, None, :] - x[None, chosen, :]) ** 2).sum(axis=2), axis=1)
        chosen.append(int(np.argmax(np.round(w * near, DIGITS))))
    return rows.sparkSession.createDataFrame([(i, x[c].tolist()) for i, c in enumerate(chosen)], "cluster bigint, centre array<double>")


def principal_axes(rows: DataFrame, axes: int = 2, rounds: int = 200, key: str = "class_id") -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes as rows): the directions of most variance, by orthogonal iteration on the covariance.

    Sums and products are aggregated on executors (gramian); the driver iterates
    over one matrix of the vectors' length. Iteration starts at axes of 1 where the place is
    a multiple of the axis' number (1, 2, ...) and -1 elsewhere; the entry of largest size of each axis, the first of equal ones,
    is positive.
    """
    own = settled(points(rows, key))
    n = own.count()
    totals = {r["pos"]: r["s"] for r in own.select(F.posexplode("features").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("s")).collect()}
    mean = np.array([totals[p] for p in sorted(totals)]) / max(n, 1)
    cov = np.zeros((len(mean), len(mean)))
    for r in gramian(own, "features").collect():
        cov[r["label_i"], r["label_j"]] = cov[r["label_j"], r["label_i"]] = r["sum_xy"] / n
    cov -= np.outer(mean, mean)
    place = np.arange(len(mean))
    v = np.array([np.where(place % (a + 1) == 0, 1.0, -1.0) for a in range(axes)])
    for _ in range(rounds):
        w = v @ cov
        for a in range(axes):
            for b in range(a):
                w[a] -= (w[a] @ w[b]) * w[b]
            length = np.linalg.norm(w[a])
            w[a] = w[a] / length if length > 0 else w[a]
        v, before = w, v
        if np.abs(v - before).max(initial=0) < 1e-13:
            break
    sign = np.sign(v[np.arange(axes), np.argmax(np.round(np.abs(v), DIGITS), axis=1)])
    return mean, v * np.where(sign == 0, 1, sign)[:, None]


def projected(rows: DataFrame, column: str, mean: np.ndarray, axes: np.ndarray, names: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """rows with the places of a vector column on the axes, centred."""
    array = lambda v: F.array(*[F.lit(float(x)) for x in v])
    centred = F.zip_with(F.transform(column, lambda x: x.cast("double")), array(mean), lambda x, m: x - m)
    on = lambda axis: F.aggregate(F.zip_with(centred, array(axis), lambda x, a: x * a), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumns({n: on(a) for n, a in zip(names, axes, strict=True)})


def clusters(class_means: DataFrame, k: int = 50, seed: int = 42, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(class_id, cluster, x, y) and (cluster, x, y): k-means of the classes' vectors, and both classes and centres on the first two principal axes."""
    own = settled(class_means)
    member, centres = lloyd(own, seeds(own, k, seed), rounds)
    mean, axes = principal_axes(own)
    flat = projected(own.join(member, "class_id"), "features", mean, axes)
    return flat.select("class_id", "cluster", "x", "y"), projected(centres, "centre", mean, axes).select("cluster", "x", "y")


def cluster_members(clustered: DataFrame, key: str = "class_id") -> DataFrame:
    """cluster, classes (sorted)."""
    return clustered.groupBy("cluster").agg(F.array_sort(F.collect_list(key)).alias("classes"))
