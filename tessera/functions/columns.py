"""Column functions that several operators use."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.storage import settled

#: Ranges that exact quantiles are first looked for in, ranges that each of these is cut into, and values that are ordered in the end.
SPLIT, NARROW, LEFT = 4096, 64, 1_000_000


def uniform(key: Column, seed: int | str) -> Column:
    """A number in [0, 1) from the first 8 hex digits of md5(key-seed): the same on every engine and run."""
    digest = F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed)))), 1, 8)
    return F.conv(digest, 16, 10).cast("bigint") / F.lit(4294967296.0)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - <a,b> / sqrt(<a,a><b,b>)."""
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits in binary arithmetic, as SQL engines round doubles: the scaled value is rounded, halves away from zero.

    F.round rounds the shortest decimal, so that 0.28855, which is a little less as a double, goes up.
    """
    scale = F.lit(10.0**digits)
    return F.round(x * scale, 0) / scale


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def file_name(image_id: Column) -> Column:
    """Zero-padded id as a picture's file name."""
    return F.concat(F.lpad(image_id.cast("string"), 7, "0"), F.lit(".jpg"))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """The values at these shares of the sorted column, between two neighbours in proportion; None without values.

    Passes over df count the values in ever smaller ranges, those that hold wanted
    places, until at most LEFT values are in them; only these are shuffled, and
    nothing is written. A pass sends the counts of at most SPLIT ranges to the
    driver, or of NARROW in each range that holds a wanted place; df must give the
    same values every time it is run. NaN is the largest value.
    """
    spark = df.sparkSession
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"), F.lit(0).cast("bigint").alias("_bin"))
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    total, low, high = values.agg(F.count("*"), F.min(finite), F.max(finite)).first()
    if not total:
        return [None] * len(shares)
    ranks = sorted({int(q) + up for q in (s * (total - 1) for s in shares) for up in (0, 1) if int(q) + up < total})
    found: dict[int, float] = {}
    ranges, parts = {0: (low or 0.0, high or 0.0, 0, total)}, SPLIT  # bin: smallest, largest, values before it, values in it

    def inside() -> DataFrame:
        rows = spark.createDataFrame([(i, r[0], r[1]) for i, r in ranges.items()], "_bin bigint, _low double, _high double")
        return values.join(F.broadcast(rows), "_bin")

    while ranges:
        if parts != SPLIT and sum(r[3] for r in ranges.values()) <= LEFT:
            counts = inside().groupBy("_bin", "v").agg(F.count("*").alias("n"))
            upto = F.sum("n").over(W.partitionBy("_bin").orderBy("v"))
            wanted = [(i, k, k - r[2]) for i, r in ranges.items() for k in ranks if r[2] <= k < r[2] + r[3]]
            places = spark.createDataFrame(wanted, "_bin bigint, _rank bigint, _place bigint")
            at = counts.withColumn("upto", upto).join(F.broadcast(places), "_bin").groupBy("_rank").agg(F.coalesce(F.min(F.when(F.col("upto") > F.col("_place"), F.col("v"))), F.max("v")).alias("v"))
            found |= {r["_rank"]: r["v"] for r in at.collect()}  # two a share
            break
        width = F.col("_high") / 2 - F.col("_low") / 2  # halves: no sum of doubles is too large
        place = F.floor((F.col("v") / 2 - F.col("_low") / 2) / width * parts)
        place = F.when(F.isnan("v"), parts + 1).when(F.col("v") == float("inf"), parts).when(F.col("v") == float("-inf"), -1).when(width > 0, F.greatest(F.lit(0), F.least(F.lit(parts - 1), place))).otherwise(0)
        values = inside().select("v", (F.col("_bin") * (parts + 3) + place + 1).cast("bigint").alias("_bin"))
        counted = sorted(tuple(r) for r in values.groupBy("_bin").agg(F.count("*"), F.min("v"), F.max("v")).collect())
        smaller, before = {}, {i: r[2] for i, r in ranges.items()}
        for i, n, least, most in counted:
            start = before[i // (parts + 3)]
            before[i // (parts + 3)] += n
            here = ranks[bisect_left(ranks, start) : bisect_left(ranks, start + n)]
            if here and (least == most or most != most):
                found |= dict.fromkeys(here, most)
            elif here:
                smaller[i] = (least, most, start, n)
        ranges, parts = smaller, NARROW
    out = []
    for q in (s * (total - 1) for s in shares):
        first = found[int(q)]
        out.append(first if q == int(q) else first + (found.get(int(q) + 1, first) - first) * (q - int(q)))
    return out


def percentile_clip(df: DataFrame, column: str, percent: float = 99.0) -> DataFrame:
    """column divided by its exact percentile and clipped to [0, 1]."""
    top = exact_quantiles(df, column, [percent / 100])[0]
    return df.withColumn(column, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(column) / F.lit(top))))


def dense_ids(df: DataFrame, *order: str | Column, name: str = "dense_id", start: int = 0) -> DataFrame:
    """df with consecutive numbers in the given order, without a window over all rows.

    Rows are dealt by range; each partition's first number is the count of the
    rows before it (one number a partition goes through the driver).
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = settled(placed.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    total, before = start, []
    for r in placed.groupBy("_pid").count().orderBy("_pid").collect():
        before.append((r["_pid"], total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "_pid int, _before bigint")
    return placed.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_before") + F.col("_at")).drop("_pid", "_at", "_before")


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """df with name: the sum of value over the rows of the same keys up to this one, in the order of a column without ties.

    Rows are dealt by ranges of (keys, order) and summed there; what earlier ranges
    hold of the same keys is added, so that a key of very many rows is many tasks'.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(df.repartitionByRange(n, *keys, order).withColumn("_pid", F.spark_partition_id()))
    held = placed.groupBy(*keys, "_pid").agg(F.sum(value).alias("_held"))
    earlier = F.sum("_held").over(W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1))
    before = held.select(*keys, "_pid", F.coalesce(earlier, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(W.partitionBy("_pid", *keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn(name, inside).join(before, [*keys, "_pid"]).withColumn(name, F.col(name) + F.col("_before")).drop("_pid", "_before")
