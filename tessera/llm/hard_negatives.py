"""Hard-negative mining (operator 13) by summaries of vector segments.

A vector is cut into segments, and each segment's mean and deviation are stored.
Over a segment of n components the inner product of x and y is n * mean(x) *
mean(y) plus the product of what is left of both, which is n * deviation(x) *
deviation(y) at most, either way. So the summaries bound every score from both
sides. Pairs are ruled out by a few wide segments first, those left by narrower
ones, and only what is left then is scored exactly.

Anchors are a stated query set: blocks of them, bounded in bytes, go to all rows.
Rows are read once for the positives and once for the negatives, whatever the
labels' sizes; a task keeps the best of what it has seen and returns a few rows an
anchor. Nothing is dealt by label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import batch, stored, table

#: Segments of a vector, coarse to fine.
LEVELS = (4, 16)
#: Rows and anchors that are packed together; bytes of anchors that are sent to all tasks at once.
ROWS, ANCHORS, SENT_BYTES = 4096, 256, 64 << 20
#: Pairs are scored one by one if fewer than one in so many is left, else as a product of matrices.
SPARSE = 50
#: A score that is no score, below all others.
NONE = -(1 << 62)
#: Sums of products below this are exact in double.
EXACT = float(1 << 53)
PACKED = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("summaries", pa.list_(pa.float64())), ("goals", pa.list_(pa.int64()))])
PACKED_SQL = "ids array<bigint>, labels array<bigint>, values array<double>, summaries array<double>, goals array<bigint>"
FOUND = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "anchor_id bigint, place int, id bigint, score bigint"


def segments(width: int, level: int) -> np.ndarray:
    """Bounds of the segments of a level."""
    n = max(1, min(width, level))
    return np.arange(n + 1) * width // n


def summaries(x: np.ndarray) -> np.ndarray:
    """Of each row of x, for each level and segment: mean and deviation, both times the root of the segment's length."""
    found = []
    for level in LEVELS:
        bounds = segments(x.shape[1], level)
        sizes = np.diff(bounds).astype(float)
        means = np.add.reduceat(x, bounds[:-1], axis=1) / sizes
        rest = x - np.repeat(means, np.diff(bounds), axis=1)
        found += [means * np.sqrt(sizes), np.sqrt(np.add.reduceat(rest * rest, bounds[:-1], axis=1))]
    return np.concatenate(found, axis=1)


def split(flat: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(means, deviations) of each level."""
    out, at = [], 0
    for level in LEVELS:
        n = len(segments(width, level)) - 1
        out.append((flat[:, at : at + n], flat[:, at + n : at + 2 * n]))
        at += 2 * n
    return out


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, label, vector, goals) with `size` vectors of one length each, and their summaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids, labels, vectors, goals = part.columns
            lengths = np.diff(vectors.offsets.to_numpy())
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                for a in range(0, len(own), size):
                    at = pa.array(own[a : a + size])
                    x = vectors.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), length)
                    summary = summaries(x) if length else np.zeros((len(at), 0))
                    yield batch(PACKED, {"ids": [ids.take(at)], "labels": [labels.take(at)], "values": [x.ravel()], "summaries": [summary.ravel()], "goals": [goals.take(at).flatten()]})

    return rows.select("vec_id", "label", "vector", "goals").mapInArrow(run, PACKED_SQL)


class Block:
    """Packed vectors as arrays; goals: `wanted` numbers a row."""

    def __init__(self, ids, labels, values, summary, goals=None, wanted: int = 0):
        self.ids, self.labels = ids, labels
        self.x = values.reshape(len(ids), -1)
        self.width = self.x.shape[1]
        self.levels = split(summary.reshape(len(ids), -1), self.width) if self.width else []
        self.goals = goals.reshape(len(ids), wanted) if wanted else None
        self.most = float(np.abs(self.x).max(initial=0))

    @staticmethod
    def read(rows: pa.RecordBatch, i: int, prefix: str, wanted: int = 0) -> Block:
        fields = [rows.column(f"{prefix}{c}")[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "labels", "values", "summaries", "goals")]
        return Block(*fields, wanted=wanted)


def bounds(one: Block, two: Block, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all pairs of two blocks."""
    if not one.width or one.width != two.width:  # other lengths: no summary fits, everything is scored
        shape = (len(one.ids), len(two.ids))
        return np.full(shape, -np.inf), np.full(shape, np.inf)
    (m, d), (n, e) = one.levels[level], two.levels[level]
    middle, reach = m @ n.T, d @ e.T
    reach *= 1 + 1e-9  # of the rounding
    reach += 1e-9 * one.most * two.most * one.width + 1e-6
    return middle - reach, middle + reach


def scores(one: Block, two: Block, wanted: np.ndarray) -> np.ndarray:
    """Exact inner products of the wanted pairs, NONE elsewhere; components that one vector lacks count as zero."""
    width = min(one.width, two.width)
    x, y = one.x[:, :width], two.x[:, :width]
    out = np.full(wanted.shape, NONE, np.int64)
    i, j = np.nonzero(wanted)
    if one.most * two.most * width >= EXACT:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            out[a, b] = sum(int(p) * int(q) for p, q in zip(x[a], y[b], strict=True))
    elif len(i) * SPARSE > out.size:
        np.copyto(out, x @ y.T, where=wanted, casting="unsafe")
    else:
        out[i, j] = np.einsum("ij,ij->i", x[i], y[j])
    return out


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; the smallest where there are fewer columns."""
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), NONE if values.dtype.kind == "i" else -np.inf)


class Best:
    """The k best (score, id) of each of n rows so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), NONE, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def least(self) -> np.ndarray:
        """What a further score must reach."""
        return self.score[:, -1]

    def add(self, ids: np.ndarray, found: np.ndarray) -> None:
        """found: a score for each row and id, or NONE."""
        k = self.score.shape[1]
        row, j = np.nonzero((found > NONE) & (found >= np.maximum(kth_largest(found, k), self.least())[:, None]))
        ids, found = ids[j], found[row, j]
        touched = np.unique(row)
        row, ids, found = np.concatenate([np.repeat(touched, k), row]), np.concatenate([self.id[touched].ravel(), ids]), np.concatenate([self.score[touched].ravel(), found])
        order = np.lexsort((ids, -found, row))
        row, ids, found = row[order], ids[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < k
        self.score[row[first], place[first]], self.id[row[first], place[first]] = found[first], ids[first]


def refined(one: Block, two: Block, may: np.ndarray, best: list[Best], k: int, floors: list[np.ndarray], ceilings: list[np.ndarray]) -> None:
    """Adds to each of best the rows' k best scores in [floor, ceiling], of the pairs that may be.

    A pair is scored if the bounds leave one place it can take: in the place's
    range, and not behind k others that are in the range for certain and better for
    certain. The finest segments come last.
    """
    masks = [may & (f <= c)[:, None] for f, c in zip(floors, ceilings, strict=True)]
    for level in range(len(LEVELS)):
        low, up = bounds(one, two, level)
        for p, (state, floor, ceiling) in enumerate(zip(best, floors, ceilings, strict=True)):
            masks[p] &= (up >= np.maximum(floor, state.least())[:, None]) & (low <= ceiling[:, None])
            if level + 1 == len(LEVELS):
                sure = masks[p] & (low >= floor[:, None]) & (up <= ceiling[:, None])
                if sure.any():
                    masks[p] &= up >= kth_largest(np.where(sure, low, -np.inf), k)[:, None]
    found = scores(one, two, np.logical_or.reduce(masks))
    for mask, state, floor, ceiling in zip(masks, best, floors, ceilings, strict=True):
        state.add(two.ids, np.where(mask & (found >= floor[:, None]) & (found <= ceiling[:, None]), found, NONE))


def positives_of(anchors: Block, rows: Block, best: list[Best], k: int) -> None:
    same = (anchors.labels[:, None] == rows.labels[None, :]) & (anchors.ids[:, None] != rows.ids[None, :])
    every = np.full(len(anchors.ids), np.inf)
    refined(anchors, rows, same, best, k, [-every], [every])


def negatives_of(anchors: Block, rows: Block, best: list[Best], k: int, least: int, most: int) -> None:
    other = anchors.labels[:, None] != rows.labels[None, :]
    goals = [anchors.goals[:, place] for place in range(len(best))]
    # the whole numbers s with least * goal <= 100 * s <= most * goal; none without a goal
    floors = [np.where(g == NONE, 1, -(-least * g // 100)) for g in goals]
    ceilings = [np.where(g == NONE, 0, most * g // 100) for g in goals]
    refined(anchors, rows, other, best, k, floors, ceilings)


def scanned(rows: DataFrame, anchors: DataFrame, places: int, k: int, wanted: int, work: Callable[[Block, Block, list[Best]], None]) -> DataFrame:
    """anchor_id, place, id, score: the k best rows that work finds for each anchor and place, of each task's rows."""
    blocks = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], F.monotonically_increasing_id().alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Block, list[Best]]] = {}
        for part in batches:
            for n in range(part.num_rows):
                number = part.column("block")[n].as_py()
                if number not in held:
                    block = Block.read(part, n, "a_", wanted)
                    held[number] = block, [Best(len(block.ids), k) for _ in range(places)]
                block, best = held[number]
                work(block, Block.read(part, n, ""), best)
        for block, best in held.values():
            for place, state in enumerate(best):
                i, c = np.nonzero(state.score > NONE)
                yield batch(FOUND, {"anchor_id": block.ids[i], "place": np.full(len(i), place), "id": state.id[i, c], "score": state.score[i, c]})

    # a stated query set against all rows, in blocks of bounded size
    return rows.crossJoin(F.broadcast(blocks)).mapInArrow(run, FOUND_SQL)


def first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def usable(vectors: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """vec_id, label, vector (whole numbers, as doubles) of the rows that take part."""
    v = F.col(vector)
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull()).where(plain)
    return rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = 256, key: str = "vec_id", label: str = "label", vector: str = "embedding", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are scaled and rounded down to whole numbers; scores are inner
    products, which must fit a long. For each anchor (is_anchor, over key) its
    `positives` best other rows of the same label are its positives, and for each
    of these the first `negatives` rows of other labels with least * positive
    score <= 100 * score <= most * positive score are returned, higher scores
    first, then smaller ids. Rows without a key, label or vector, or with a null
    or non-finite component, take no part. Rows that repeat a key are rows of
    their own, none of them a positive of that key; an anchor that is repeated
    counts once. Vectors of other lengths lack components, which count as zero.
    Empty tables give no rows; further columns are not read.
    """
    rows = usable(vectors, key, label, vector, scale)
    none = F.array().cast("array<bigint>")
    held = stored(packed(rows.withColumn("goals", none), ROWS))
    anchors = stored(rows.where(is_anchor).dropDuplicates(["vec_id"]))
    size = anchors.agg(F.sum(16.0 * F.size("vector") + 200)).first()[0] or 0
    groups = max(1, -(-int(size) // sent_bytes))
    out = None
    for g in range(groups):
        own = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g)
        seen = scanned(held, packed(own.withColumn("goals", none), ANCHORS), 1, positives, 0, lambda a, r, best: positives_of(a, r, best, positives))
        near = stored(first(seen, positives).select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
        goals = near.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "positive_score"))).alias("by_place"))
        goals = goals.select(F.col("anchor_id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda p: F.coalesce(F.try_element_at("by_place", p), F.lit(NONE))).alias("goals"))
        seen = scanned(held, packed(own.join(goals, "vec_id"), ANCHORS), positives, negatives, positives, lambda a, r, best: negatives_of(a, r, best, negatives, least, most))
        found = first(seen, negatives).join(near, ["anchor_id", "place"])
        found = found.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = found if out is None else out.unionByName(found)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {
    "op13_hard_negatives": """WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS f FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.f, b.f) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS i FROM s WHERE same) WHERE i <= 5),
    n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
