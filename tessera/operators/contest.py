"""Competition scores and colour-sketch scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def known_item_scores(submissions: DataFrame, limit: float) -> DataFrame:
    """team, task, score: max(0, 50 + 50 (limit - t) / limit - 10 wrong) at the first correct submission, else 0.

    submissions: team, task, t (seconds), correct. Wrong ones before it count.
    """
    first = submissions.where("correct").groupBy("team", "task").agg(F.min("t").alias("found"))
    rows = submissions.join(first, ["team", "task"], "left")
    per = rows.groupBy("team", "task").agg(F.first("found").alias("found"), F.count_if(~F.col("correct") & (F.col("t") < F.col("found"))).alias("wrong"))
    points = F.greatest(F.lit(0.0), 50 + 50 * (limit - F.col("found")) / limit - 10 * F.col("wrong"))
    return per.select("team", "task", F.coalesce(points, F.lit(0.0)).alias("score"))


def ad_hoc_scores(submissions: DataFrame) -> DataFrame:
    """team, task, score: C / (C + I / 2) times the team's share of all correct scene clusters.

    submissions: team, task, cluster, correct. C and I count correct and wrong
    submissions; shares are of the clusters any team found.
    """
    per = submissions.groupBy("team", "task").agg(F.count_if("correct").alias("c"), F.count_if(~F.col("correct")).alias("i"), F.count_distinct(F.when(F.col("correct"), F.col("cluster"))).alias("own"))
    pool = submissions.where("correct").groupBy("task").agg(F.count_distinct("cluster").alias("pool"))
    score = F.col("c") / (F.col("c") + F.col("i") / 2) * F.col("own") / F.col("pool")
    return per.join(pool, "task", "left").select("team", "task", F.coalesce(F.when(F.col("c") > 0, score), F.lit(0.0)).alias("score"))


def overall_scores(rounds: DataFrame) -> DataFrame:
    """team, score: each round (round, team, score) scaled so that its winner has 100, then averaged."""
    best = F.max("score").over(W.partitionBy("round"))
    scaled = rounds.withColumn("scaled", F.when(best > 0, F.col("score") / best * 100).otherwise(0.0))
    return scaled.groupBy("team").agg(F.avg("scaled").alias("score"))


def sketch_scores(points: DataFrame, regions: DataFrame) -> DataFrame:
    """query_id, image_id, score: minus the sum over ellipses of the smallest (any) or mean (all) colour distance in them.

    points: image_id, px, py, l, a, b. regions: query_id, region_no, cx, cy, rx,
    ry, l, a, b, mode ('any' or 'all'). Regions are the stated query set.
    """
    inside = F.pow((F.col("p.px") - F.col("r.cx")) / F.col("r.rx"), F.lit(2.0)) + F.pow((F.col("p.py") - F.col("r.cy")) / F.col("r.ry"), F.lit(2.0)) <= 1
    away = F.sqrt(sum(F.pow(F.col(f"p.{c}") - F.col(f"r.{c}"), F.lit(2.0)) for c in ("l", "a", "b")))
    met = points.alias("p").join(regions.alias("r"), inside).select("r.query_id", "r.region_no", "r.mode", "p.image_id", away.alias("away"))
    each = met.groupBy("query_id", "region_no", "mode", "image_id").agg(F.min("away").alias("least"), F.avg("away").alias("mean"))
    return each.groupBy("query_id", "image_id").agg((-F.sum(F.when(F.col("mode") == "any", F.col("least")).otherwise(F.col("mean")))).alias("score"))
