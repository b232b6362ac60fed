"""Sampling that any run repeats: uniforms come from a hash of id and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.columns import dense_ids, uniform
from tessera.functions.storage import settled


def sample_ids(images: DataFrame, n: int, seed: int, window: int | None = None) -> DataFrame:
    """query_id, image_id (and second_id): n images drawn with replacement.

    With window, second_id is 0 to window - 1 places later, at most the last.
    """
    numbered = dense_ids(images.select("image_id").distinct(), "image_id", name="place")
    total = numbered.count()
    q = F.col("query_id")
    drawn = images.sparkSession.range(n).withColumnRenamed("id", "query_id").withColumn("place", F.floor(uniform(q, f"{seed}a") * total).cast("bigint"))
    out = drawn.join(numbered, "place")
    if window is None:
        return out.select("query_id", "image_id")
    later = F.least(F.col("place") + F.floor(uniform(q, f"{seed}b") * window).cast("bigint"), F.lit(total - 1))
    second = numbered.select(F.col("place").alias("later"), F.col("image_id").alias("second_id"))
    return out.withColumn("later", later).join(second, "later").select("query_id", "image_id", "second_id")


def weighted_key(weight: Column, key: Column, seed: int | str) -> Column:
    """The k largest of these keys are a draw of k without replacement, by weight."""
    return F.log(uniform(key, seed) + 1e-12) / weight


def draw_labels(postings: DataFrame, k: int, seed: int) -> DataFrame:
    """image_id, draw (1 to k), label_id: k different labels of each image, by prob; fewer where it has fewer."""
    key = weighted_key(F.col("prob"), F.concat_ws(":", "image_id", "label_id"), seed)
    order = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("key"), "label_id"))
    return postings.where("prob > 0").withColumn("key", key).withColumn("draw", order).where(F.col("draw") <= k).select("image_id", "draw", "label_id")


def draw_positions(postings: DataFrame, distribution: DataFrame, k: int, seed: int) -> DataFrame:
    """image_id, draw, label_id: labels at k different positions drawn from distribution (position, share).

    Positions that an image does not have are not drawn for it.
    """
    placed = postings.withColumn("position", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("prob"), "label_id")))
    weighted = placed.join(distribution.where("share > 0"), "position")
    key = weighted_key(F.col("share"), F.concat_ws(":", "image_id", "position"), seed)
    order = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("key"), "label_id"))
    return weighted.withColumn("key", key).withColumn("draw", order).where(F.col("draw") <= k).select("image_id", "draw", "label_id")


def draw_mixed(postings: DataFrame, distribution: DataFrame, k: int, seed: int) -> DataFrame:
    """Each image by labels or by positions, one half each."""
    heads = uniform(F.col("image_id"), f"{seed}m") < 0.5
    return draw_labels(postings.where(heads), k, seed).unionByName(draw_positions(postings.where(~heads), distribution, k, seed))


def prefixes(drawn: DataFrame, lengths: list[int]) -> DataFrame:
    """drawn with length: the first n labels for each n."""
    return drawn.withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).where(F.col("draw") <= F.col("length"))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows with place, their number (from 0) in an order that depends on key and seed only."""
    return dense_ids(rows.withColumn("_u", uniform(F.col(key), seed)), "_u", key, name="place").drop("_u")


def first_per_class(rows: DataFrame, class_column: str, order: str, n: int) -> DataFrame:
    """The first n rows of each class; a task passes on n rows a class at most (the window's group limit)."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(class_column).orderBy(order))).where(F.col("_rn") <= n).drop("_rn")


def split_classes(rows: DataFrame, class_column: str, order: str, skip: float, take: float) -> DataFrame:
    """Of each class the rows after `skip` of them, `take` many (0 or less: all the rest).

    Numbers under 1 are shares of the class, others are counts. Rows are numbered
    over ranges of (class, order); a row's number in its class is its own less the
    class's first, so that a class of any size is many tasks'.
    """
    numbered = settled(dense_ids(rows, class_column, order, name="_n"))
    sizes = numbered.groupBy(F.col(class_column).alias("_class")).agg(F.min("_n").alias("_first"), F.count("*").alias("_size"))
    placed = numbered.join(sizes, F.col(class_column).eqNullSafe(F.col("_class")))
    n, rn = F.col("_size"), F.col("_n") - F.col("_first") + 1
    skipped = F.round(n * skip) if 0 < skip < 1 else F.lit(float(skip))
    taken = F.round(n * take) if 0 < take < 1 else F.lit(float(take)) if take > 0 else n
    return placed.where((rn > skipped) & (rn <= skipped + taken)).select(*[F.col(f"`{c}`") for c in rows.columns])
