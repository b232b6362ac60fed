"""Detection boxes: decoding, filtering, non-maximum suppression, occupancy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import sigmoid
from tessera.functions.storage import discard, settled


def filter_boxes(raw: DataFrame, least: float, ignored: DataFrame | None = None) -> DataFrame:
    """raw (scale, template, score, ...) whose sigmoid score is over `least`, without ignored (scale, template) pairs."""
    kept = raw.where(sigmoid(F.col("score")) > least)
    return kept if ignored is None else kept.join(ignored, ["scale", "template"], "left_anti")


def ignored_templates(every: DataFrame, allowed: DataFrame) -> DataFrame:
    """(scale, template) pairs that are not allowed."""
    return every.join(allowed, ["scale", "template"], "left_anti").distinct()


def decode_boxes(raw: DataFrame, stride: float = 8.0, offset: float = -1.0) -> DataFrame:
    """x1, y1, x2, y2 of cells: the template's centre and size, moved by (tx, ty), stretched by exp(tw, th), divided by the scale.

    raw has image_id, fx, fy (cell), cw, ch (template size), tx, ty, tw, th, scale, score.
    """
    cx = F.col("fx") * stride + offset + F.col("cw") * F.col("tx")
    cy = F.col("fy") * stride + offset + F.col("ch") * F.col("ty")
    w, h = F.col("cw") * F.exp("tw"), F.col("ch") * F.exp("th")
    s = F.col("scale")
    return raw.select("image_id", ((cx - w / 2) / s).alias("x1"), ((cy - h / 2) / s).alias("y1"), ((cx + w / 2) / s).alias("x2"), ((cy + h / 2) / s).alias("y2"), "score")


def to_corners(boxes: DataFrame) -> DataFrame:
    """boxes with x1, y1, x2, y2 from centre and size (x, y, w, h)."""
    return boxes.withColumns({"x1": F.col("x") - F.col("w") / 2, "y1": F.col("y") - F.col("h") / 2, "x2": F.col("x") + F.col("w") / 2, "y2": F.col("y") + F.col("h") / 2})


def _overlaps(a, b, overlap: float):
    """Whether two boxes (structs or aliases) share more than `overlap` of their union."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    both = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - w * h
    return (both > 0) & (w * h > both * overlap)


def _overlapping_pairs(boxes: DataFrame, overlap: float) -> DataFrame:
    """better, worse (id) of overlapping boxes of an image: boxes meet in cells of the larger one's size."""
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1.0))
    sized = settled(boxes.withColumn("own", F.ceil(F.log2(side)).cast("int")))
    levels = F.broadcast(sized.select(F.col("own").alias("level")).distinct())  # powers of two between the smallest and the largest side

    def cells(rows: DataFrame) -> DataFrame:
        cell = F.pow(F.lit(2.0), F.col("level"))
        spread = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
        return rows.withColumn("cx", spread("x1", "x2")).withColumn("cy", spread("y1", "y2"))

    coarse = cells(sized.withColumn("level", F.col("own"))).alias("x")
    fine = cells(sized.join(levels, F.col("own") <= F.col("level"))).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("image_id", "level", "cx", "cy")]
    x, y = ({c: F.col(f"{t}.{c}") for c in ("x1", "y1", "x2", "y2")} for t in "xy")
    met = coarse.join(fine, same[0] & same[1] & same[2] & same[3] & (F.col("x.id") != F.col("y.id")) & _overlaps(x, y, overlap))
    order = lambda t: F.struct(-F.col(f"{t}.score"), *[F.col(f"{t}.{c}") for c in ("x1", "y1", "x2", "y2", "id")])
    first = order("x") < order("y")
    return met.select(F.when(first, F.col("x.id")).otherwise(F.col("y.id")).alias("better"), F.when(first, F.col("y.id")).otherwise(F.col("x.id")).alias("worse")).distinct()


def _suppress_in_rounds(boxes: DataFrame, overlap: float) -> DataFrame:
    """The same boxes as one after another: in each round those stay that no undecided better one overlaps, and what they overlap goes."""
    boxes = settled(boxes.withColumn("id", F.monotonically_increasing_id()))
    pairs = settled(_overlapping_pairs(boxes, overlap))
    gone = None
    while not pairs.isEmpty():
        kept = pairs.select(F.col("better").alias("id")).distinct().join(pairs.select(F.col("worse").alias("id")), "id", "left_anti")
        lost = settled(pairs.join(kept.withColumnRenamed("id", "better"), "better", "left_semi").select(F.col("worse").alias("id")).distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        pairs, before = settled(pairs.join(lost.withColumnRenamed("id", "worse"), "worse", "left_anti").join(lost.withColumnRenamed("id", "better"), "better", "left_anti")), pairs
        discard(before)
    return boxes.drop("id") if gone is None else boxes.join(gone, "id", "left_anti").drop("id")


def non_maximum_suppression(boxes: DataFrame, overlap: float = 0.1, most: int = 1000) -> DataFrame:
    """image_id, x1, y1, x2, y2, score of the boxes kept, greedily by score (ties by place).

    An image of up to `most` boxes is decided in one fold over its sorted boxes.
    In larger ones boxes meet by grid cells, and all of them go through rounds
    together. Both keep the same boxes.
    """
    names = ("x1", "y1", "x2", "y2", "score")
    rows = boxes.select("image_id", *names)
    large = settled(rows.groupBy("image_id").count().where(F.col("count") > most).select("image_id"))
    some = not large.isEmpty()
    small = rows.join(large, "image_id", "left_anti") if some else rows
    sorted_ = small.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), *names))).alias("all"))
    fold = F.aggregate("all", F.slice("all", 1, 0), lambda kept, b: F.when(F.exists(kept, lambda a: _overlaps(a, b, overlap)), kept).otherwise(F.concat(kept, F.array(b))))
    out = sorted_.select("image_id", F.explode(fold).alias("b")).select("image_id", *[F.col(f"b.{c}").alias(c) for c in names])
    return out.unionByName(_suppress_in_rounds(rows.join(large, "image_id", "left_semi"), overlap)) if some else out


def occupancy(boxes: DataFrame, width: float = 1280.0, height: float = 720.0, columns: int = 32, rows: int = 18) -> DataFrame:
    """image_id, word_no, bits: grid cells that any box covers, row by row in 32-bit words, first cell in the highest bit.

    Cells of boxes at or beyond the border are clamped to the grid.
    """
    def cell(c: str, size: float, n: int):
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.col(c) / size * n))).cast("int")

    bars = boxes.select(
        "image_id",
        F.explode(F.sequence(cell("y1", height, rows), cell("y2", height, rows))).alias("row"),
        cell("x1", width, columns).alias("from"), cell("x2", width, columns).alias("to"),
    ).select("image_id", (F.col("row") * columns + F.col("from")).alias("a"), (F.col("row") * columns + F.col("to")).alias("b"))
    # a bar of cells is one mask in each word that it reaches
    words = bars.select("*", F.explode(F.sequence(F.floor(F.col("a") / 32).cast("int"), F.floor(F.col("b") / 32).cast("int"))).alias("word_no"))
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))
    first, last = F.greatest(F.col("a") - F.col("word_no") * 32, F.lit(0)), F.least(F.col("b") - F.col("word_no") * 32, F.lit(31))
    masked = words.select("image_id", "word_no", (power(32 - first) - power(31 - last)).alias("mask"))
    return masked.groupBy("image_id", "word_no").agg(F.bit_or("mask").alias("bits"))
