"""Known-item evaluation: ranks by configuration, curves, histograms, accuracy, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.columns import running_sum
from tessera.functions.storage import settled
from tessera.operators.postings import label_positions
from tessera.operators.ranking import target_ranks, two_image_scores


def _sized(queries: DataFrame, lengths: list[int]) -> DataFrame:
    """query_id, length, label_id, labels (their number): the queries cut to each length."""
    rows = queries.withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).where("position <= length").select("query_id", "length", "label_id").distinct()
    return rows.withColumn("labels", F.count("*").over(W.partitionBy("query_id", "length")))


def _config(kind: Column, threshold: Column, length: Column) -> Column:
    return F.concat_ws(" ", kind, F.concat(F.lit("t"), threshold.cast("string")), F.concat(F.lit("n"), length.cast("string")))


def rank_targets(postings: DataFrame, queries: DataFrame, targets: DataFrame, thresholds: list[float], lengths: list[int], weights: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """config, query_id, target_id, rank: one rank for every threshold, query length and, with weights (label_id, idf), both weightings; null if the target has no score.

    queries are rows (query_id, position, label_id) of one clause each; a length
    keeps positions up to it. Weights apply to queries of more than one label.

    With digits, scores are compared to so many digits, so that equal sums tie
    whatever their order. Thresholds and weightings are columns of one row, which
    is shuffled and written once for all.
    """
    kinds = ["plain"] + (["idf"] if weights is not None else [])
    sized = _sized(queries, lengths)
    rows = postings.join(sized, "label_id")
    value = {"plain": F.col("prob")}
    if weights is not None:
        rows = rows.join(weights, "label_id")
        value["idf"] = F.when(F.col("labels") > 1, F.col("prob") * F.col("idf")).otherwise(F.col("prob"))
    # a row for each length, query and image, with a column for each threshold and weighting; null without a score
    names = [(k, float(t)) for k in kinds for t in thresholds]
    sums = [F.sum(F.when(F.col("prob") >= t, value[k])) for k, t in names]
    found = settled(rows.groupBy("length", "query_id", "image_id").agg(*[(x if digits is None else F.round(x, digits)).alias(f"s{i}") for i, x in enumerate(sums)]))
    wanted = targets.select("query_id", "target_id").withColumn("length", F.explode(F.array(*map(F.lit, lengths))))
    held = found.withColumnsRenamed({"image_id": "target_id", **{f"s{i}": f"own{i}" for i in range(len(names))}})
    own = wanted.join(held, ["length", "query_id", "target_id"])

    def better(i: int) -> Column:
        return F.count_if((F.col(f"s{i}") > F.col(f"own{i}")) | ((F.col(f"s{i}") == F.col(f"own{i}")) & (F.col("image_id") < F.col("target_id"))))

    counted = [F.when(F.first(f"own{i}").isNotNull(), better(i) + 1).alias(f"rank{i}") for i in range(len(names))]
    ranks = wanted.join(found.join(own, ["length", "query_id"]).groupBy("length", "query_id", "target_id").agg(*counted), ["length", "query_id", "target_id"], "left")
    each = [F.struct(_config(F.lit(k), F.lit(t), F.col("length")).alias("config"), F.col(f"rank{i}").alias("rank")) for i, (k, t) in enumerate(names)]
    return ranks.select("query_id", "target_id", F.explode(F.array(*each)).alias("x")).select("x.config", "query_id", "target_id", "x.rank")


def rank_two_images(first: DataFrame, second: DataFrame, targets: DataFrame, width: int, partition_by: str | None = None, digits: int | None = None) -> DataFrame:
    """query_id, target_id, rank of the first image under the two-image score, compared to so many digits if given."""
    return target_ranks(_rounded(two_image_scores(first, second, width, partition_by), digits), targets)


def _rounded(scores: DataFrame, digits: int | None) -> DataFrame:
    """Scores written once, for the target's score and the count of better ones."""
    return settled(scores if digits is None else scores.withColumn("score", F.round("score", digits)))


def rank_curve(ranks: DataFrame) -> DataFrame:
    """config, rank, percent: share of all queries ranked at or above; null ranks count in the total only."""
    totals = ranks.groupBy("config").agg(F.count("*").alias("total"))
    per = ranks.where("rank is not null").groupBy("config", "rank").agg(F.count("*").alias("n"))
    sofar = running_sum(per, ["config"], "rank", "n", "sofar")
    return sofar.join(totals, "config").select("config", "rank", (F.col("sofar") / F.col("total") * 100).alias("percent"))


def chosen_positions(postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """image_id, label_id, position of the labels chosen (image_id, label_id) for an image."""
    return label_positions(postings).join(chosen.distinct(), ["image_id", "label_id"], "left_semi").select("image_id", "label_id", "position")


def position_distribution(positions: DataFrame) -> DataFrame:
    """position, n, share."""
    total = positions.agg(F.count("*").alias("total"))
    counts = positions.groupBy("position").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("position", "n", (F.col("n") / F.col("total")).alias("share"))


def hit_histograms(positions: DataFrame, drawn: DataFrame | None = None) -> DataFrame:
    """position, hits, top_hits: all chosen labels, and each image's best; with drawn positions (image_id, position) also hits_rand and top_hits_rand."""

    def counts(rows: DataFrame, hits: str, top: str) -> DataFrame:
        best = rows.groupBy("image_id").agg(F.min("position").alias("position")).select("position", F.lit(0).alias("h"), F.lit(1).alias("t"))
        both = rows.select("position", F.lit(1).alias("h"), F.lit(0).alias("t")).unionByName(best)
        return both.groupBy("position").agg(F.sum("h").alias(hits), F.sum("t").alias(top))

    out = counts(positions, "hits", "top_hits")
    if drawn is None:
        return out
    return out.join(counts(drawn, "hits_rand", "top_hits_rand"), "position", "full").na.fill(0, ["hits", "top_hits", "hits_rand", "top_hits_rand"])


def exponential_fit(ranks: DataFrame) -> DataFrame:
    """config, rate: number of ranks over their sum."""
    return ranks.where("rank is not null").groupBy("config").agg((F.count("*") / F.sum("rank")).alias("rate"))


def truth_ranks(postings: DataFrame, truth: DataFrame) -> DataFrame:
    """image_id, position of the true label (image_id, label_id); counted, null without a score."""
    own = truth.join(postings, ["image_id", "label_id"]).select("image_id", F.col("label_id").alias("true_id"), F.col("prob").alias("own"))
    better = (F.col("prob") > F.col("own")) | ((F.col("prob") == F.col("own")) & (F.col("label_id") < F.col("true_id")))
    found = postings.join(own, "image_id").groupBy("image_id").agg((F.count_if(better) + 1).alias("position"))
    return truth.select("image_id").join(found, "image_id", "left")


def accuracy(positions: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """k, percent of images whose truth is among the first k."""
    rows = positions.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return rows.groupBy("k").agg((F.avg(F.coalesce((F.col("position") <= F.col("k")).cast("double"), F.lit(0.0))) * 100).alias("percent"))


def average_patches(patches: DataFrame) -> DataFrame:
    """Postings with the mean over an image's patches (image_id, patch, label_id, prob); absent labels count as 0."""
    n = patches.groupBy("image_id").agg(F.count_distinct("patch").alias("n"))
    return patches.groupBy("image_id", "label_id").agg(F.sum("prob").alias("s")).join(n, "image_id").select("label_id", "image_id", (F.col("s") / F.col("n")).alias("prob"))


def group_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def _series(rows: DataFrame, series: str, order: str, value: str, step) -> DataFrame:
    """Each series' values, in order, through a fold; series are short (steps of a training, bins of a histogram)."""
    packed = rows.groupBy(series).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("y")))).alias("points"))
    return packed.select(series, F.explode(step(F.col("points"))).alias("p")).select(series, F.col("p.at").alias(order), F.col("p.y").alias("smooth"))


def exponential_average(rows: DataFrame, series: str, order: str, value: str, weight: float) -> DataFrame:
    """s(i) = weight * s(i - 1) + (1 - weight) * y(i), from s(1) = y(1)."""

    def step(points):
        def add(state, p):
            y = F.when(F.size(state) == 0, p["y"]).otherwise(F.element_at(state, -1)["y"] * weight + p["y"] * (1 - weight))
            return F.concat(state, F.array(F.struct(p["at"].alias("at"), y.alias("y"))))

        return F.aggregate(points, F.slice(points, 1, 0), add)

    return _series(rows, series, order, value, step)


def box_average(rows: DataFrame, series: str, order: str, value: str, before: int = 10, after: int = 9) -> DataFrame:
    over = W.partitionBy(series).orderBy(order).rowsBetween(-before, after)
    return rows.select(series, order, F.avg(value).over(over).alias("smooth"))


def monotone_average(rows: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """Never rising: what a value has above the one before it is carried on to the next; then shares of the sum.

    Equal to the running minimum of means only where nothing is left at the end;
    what is left after the last value is dropped, as the sum is scaled to 1.
    """

    def step(points):
        start = F.struct(F.slice(points, 1, 0).alias("out"), F.lit(0.0).alias("left"))

        def add(state, p):
            have = p["y"] + state["left"]
            y = F.when(F.size(state["out"]) == 0, have).otherwise(F.least(have, F.element_at(state["out"], -1)["y"]))
            return F.struct(F.concat(state["out"], F.array(F.struct(p["at"].alias("at"), y.alias("y")))).alias("out"), (have - y).alias("left"))

        out = F.aggregate(points, start, add, lambda s: s["out"])
        total = F.aggregate(out, F.lit(0.0), lambda s, p: s + p["y"])
        return F.transform(out, lambda p: F.struct(p["at"].alias("at"), (p["y"] / total).alias("y")))

    return _series(rows, series, order, value, step)
