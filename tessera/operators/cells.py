"""Exact nearest rows by cells: vectors lie with the nearest of some centres, and a cell's centre and radius rule it out.

On unit vectors the cosine distance is half the squared distance, so the triangle
inequality holds: a row of a cell is no nearer to a query than the centre less the
cell's radius. Each query visits the cells that look nearest until they hold k rows, takes the k-th
distance found there as its bound, and then visits the cells that may hold less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.columns import uniform
from tessera.functions.storage import settled
from tessera.operators.vectors import DIGITS, query_vectors

#: Vectors packed together; bytes of centres at most, which are broadcast.
ROWS, CENTRE_BYTES = 1024, 64 << 20
FOUND_SQL = "query_id bigint, image_id bigint, distance double"


def unit_rows(flat: np.ndarray, rows: int) -> np.ndarray:
    x = flat.reshape(rows, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def in_cells(vectors: DataFrame, cells: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(cell, ids, units packed by cell) and (cell, centre, radius, n) of vectors (image_id, features).

    Centres are `cells` vectors drawn by the hash of their ids, so their number is
    stated and not the data's; every vector goes to the nearest one, ties to the
    one of the smaller number. A cell of any size is many packed rows.
    """
    drawn = vectors.orderBy(uniform(F.col("image_id"), seed), "image_id").limit(cells).select("features").collect()
    centres = np.array([r[0] for r in drawn], float)
    if centres.nbytes > CENTRE_BYTES:
        raise ValueError("too many cells to broadcast their centres")
    centres = centres / np.linalg.norm(centres, axis=1, keepdims=True) if len(centres) else centres
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            ids = frame["image_id"].to_numpy()
            x = unit_rows(np.concatenate(frame["features"].to_numpy()).astype(float), len(frame))
            near = np.argmax(np.round(x @ shared.value.T, DIGITS), axis=1)
            away = np.linalg.norm(x - shared.value[near], axis=1)
            for cell in np.unique(near):
                own = np.flatnonzero(near == cell)
                for a in range(0, len(own), ROWS):
                    at = own[a : a + ROWS]
                    yield pd.DataFrame({"cell": [cell], "ids": [ids[at]], "units": [x[at].ravel()], "radius": [away[at].max()]})

    packed = settled(vectors.select("image_id", "features").mapInPandas(assign, "cell int, ids array<bigint>, units array<double>, radius double"))
    sizes = packed.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum(F.size("ids")).alias("n"))
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    return packed, settled(sizes.join(F.broadcast(vectors.sparkSession.createDataFrame(rows, "cell int, centre array<double>")), "cell"))


def _visits(packed: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """query_id, image_id, distance: the k nearest of each packed row of a cell to the queries that visit it (cell, query_id, n, unit)."""
    groups = visits.groupBy("cell", F.floor(F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)) / (1 << 14)).alias("share")).agg(F.collect_list(F.struct("query_id", "n", "unit")).alias("queries"))

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids, flat, queries in zip(frame["ids"], frame["units"], frame["queries"], strict=True):
                x = flat.reshape(len(ids), -1)
                away = np.round(np.array([q["n"] for q in queries], float)[:, None] - np.array([q["unit"] for q in queries], float) @ x.T, DIGITS)
                order = np.lexsort((np.broadcast_to(ids, away.shape), away), axis=1)[:, :k]
                names = np.repeat([q["query_id"] for q in queries], order.shape[1])
                yield pd.DataFrame({"query_id": names, "image_id": ids[order].ravel(), "distance": np.take_along_axis(away, order, axis=1).ravel()})

    return packed.join(groups, "cell").select("ids", "units", "queries").mapInPandas(multiply, FOUND_SQL)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "image_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_by_cells(queries: DataFrame, vectors: DataFrame, k: int, cells: int = 64, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(query_id, image_id, distance, rank) as by vectors.nearest, and (query_id, visited, rows): how many of all vectors each query met.

    queries (query_id, image_id) are a stated set; a query of several images ranks
    by the sum of the distances. Exact, whatever the cells; the bound is worth more
    the more the vectors cluster.
    """
    sums = query_vectors(queries, vectors).withColumn("length", F.sqrt(F.aggregate("unit", F.lit(0.0), lambda s, x: s + x * x)))
    packed, about = in_cells(vectors, cells, seed)
    product = F.aggregate(F.zip_with("unit", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # every query with every cell: a stated number of cells
    met = sums.crossJoin(F.broadcast(about.withColumnRenamed("n", "held")))
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * product / F.col("length")))
    least = F.when(F.col("length") > 0, F.col("n") - F.col("length") * (1 - F.pow(F.greatest(F.lit(0.0), apart - F.col("radius") - 1e-7), 2) / 2)).otherwise(F.col("n").cast("double"))
    met = settled(met.select("query_id", "n", "unit", "cell", "held", (least - 1e-8).alias("least")))
    before = F.coalesce(F.sum("held").over(W.partitionBy("query_id").orderBy("least", "cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = settled(met.withColumn("before", before))
    first = placed.where(F.col("before") < k)
    found = settled(_visits(packed, first.select("cell", "query_id", "n", "unit"), k))
    bound = _ranked(found, k).where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
    more = settled(placed.where(F.col("before") >= k).join(bound, "query_id").where("least <= bound"))
    page = _ranked(found.unionByName(_visits(packed, more.select("cell", "query_id", "n", "unit"), k)), k)
    visited = first.select("query_id", "held").unionByName(more.select("query_id", "held")).groupBy("query_id").agg(F.sum("held").alias("visited"))
    return page, visited.crossJoin(F.broadcast(about.agg(F.sum("n").alias("rows"))))
