"""Postings (label_id, image_id, prob): thresholds, inversion, sums and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.storage import settled

#: Postings of a task that pairs them; hash parts of the images in it, in each of which pairs are summed; labels up to which their sums are broadcast.
TASK_ROWS, TASK_PARTS, MOST_BROADCAST = 250_000, 16, 100_000


def threshold_scores(scores: DataFrame, mu: float = 0.001) -> DataFrame:
    """image_id, label_id, prob of dense vectors (image_id, scores): entries from mu on."""
    return scores.select("image_id", F.posexplode("scores").alias("label_id", "prob")).where(F.col("prob") >= mu).select("image_id", F.col("label_id").cast("bigint"), F.col("prob").cast("double"))


def apply_threshold(postings: DataFrame, mu: float | None) -> DataFrame:
    """Entries from mu on; each threshold is a filter of its own."""
    return postings if mu is None else postings.where(F.col("prob") >= mu)


def threshold_report(postings: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, entries, images, mean_labels: mean labels left of the images that have any, one pass for all."""
    rows = postings.select("image_id", "label_id", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"), "prob").where("prob >= threshold")
    per_image = rows.groupBy("threshold", "image_id").agg(F.count("*").alias("n"))
    return per_image.groupBy("threshold").agg(F.sum("n").alias("entries"), F.count("*").alias("images"), F.avg("n").alias("mean_labels"))


def quantize(postings: DataFrame, steps: int = 255, mu: float = 0.0) -> DataFrame:
    """prob in steps, half to even; entries under mu (in the same steps) and zeros go."""
    return postings.withColumn("prob", F.bround(F.col("prob") * steps)).where((F.col("prob") > 0) & (F.col("prob") >= mu * steps))


def annotations(postings: DataFrame) -> DataFrame:
    """image_id, labels (structs of label_id, prob, by label): one row an image."""
    return postings.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("label_id", "prob"))).alias("labels"))


def invert(annotated: DataFrame) -> DataFrame:
    """Postings of rows (image_id, labels)."""
    return annotated.select("image_id", F.explode("labels").alias("x")).select("x.label_id", "image_id", "x.prob")


def list_lengths(postings: DataFrame) -> DataFrame:
    """label_id, n: images in each label's list."""
    return postings.groupBy("label_id").agg(F.count("*").alias("n"))


def label_sums(postings: DataFrame) -> DataFrame:
    """label_id, sum_prob."""
    return postings.groupBy("label_id").agg(F.sum("prob").alias("sum_prob"))


def _pairs(own: DataFrame) -> DataFrame:
    """The sums of cooccurrence, of settled postings.

    The postings are dealt in tasks of about TASK_ROWS by hash parts of the images,
    and so are the pairs, which are summed within each part before they are
    shuffled: what a task holds does not grow with the input.
    """
    n = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // TASK_ROWS))
    part = F.pmod(F.xxhash64("image_id"), F.lit(TASK_PARTS * n)).alias("part")
    dealt = own.where("image_id is not null and label_id is not null").select(part, "image_id", F.struct("label_id", "prob").alias("x")).repartition(n, "part")
    lists = dealt.groupBy("part", "image_id").agg(F.collect_list("x").alias("xs"))
    pairs = lists.select("part", "xs", F.explode("xs").alias("x")).select("part", "x", F.explode(F.filter("xs", lambda y: y["label_id"] >= F.col("x.label_id"))).alias("y"))
    pairs = pairs.select("part", F.col("x.label_id").alias("label_i"), F.col("y.label_id").alias("label_j"), (F.col("x.prob") * F.col("y.prob")).alias("xy"))
    some = pairs.groupBy("part", "label_i", "label_j").agg(F.sum("xy").alias("xy"))
    return some.repartition(n, "label_i", "label_j").groupBy("label_i", "label_j").agg(F.sum("xy").alias("sum_xy"))


def cooccurrence(postings: DataFrame) -> DataFrame:
    """label_i <= label_j, sum_xy: products of scores summed over images.

    The pairs are made from each image's list, whose labels are few after the
    threshold, and are summed before their shuffle. Nulls have no pairs.
    """
    return _pairs(settled(postings.select("image_id", "label_id", "prob")))


def covariance(postings: DataFrame) -> DataFrame:
    """label_i, label_j, cov = E[XY] - E[X]E[Y] over the images with postings."""
    own = settled(postings.select("image_id", "label_id", "prob"))
    n = own.select(F.count_distinct("image_id").alias("n"))
    sums = settled(label_sums(own))
    # a hash table of the sums, so that the pairs need not be sorted
    how = "broadcast" if sums.count() <= MOST_BROADCAST else "shuffle_hash"
    side = lambda label, s: sums.withColumnsRenamed({"label_id": label, "sum_prob": s}).hint(how)
    pairs = _pairs(own).join(side("label_i", "si"), "label_i").join(side("label_j", "sj"), "label_j")
    mean = lambda c: F.col(c) / F.col("n")
    return pairs.crossJoin(F.broadcast(n)).select("label_i", "label_j", (mean("sum_xy") - mean("si") * mean("sj")).alias("cov"))


def idf(sums: DataFrame, mode: str = "paper") -> DataFrame:
    """label_id, idf. Modes: app ln(max/c)+1; smoothed ln(max/(c+1e-5)+1); paper ln(max/c+1)."""
    top = sums.agg(F.max("sum_prob").alias("top"))
    c = F.col("sum_prob")
    how: dict[str, Column] = {"app": F.log(F.col("top") / c) + 1, "smoothed": F.log(F.col("top") / (c + 1e-5) + 1), "paper": F.log(F.col("top") / c + 1)}
    return sums.crossJoin(F.broadcast(top)).select("label_id", how[mode].alias("idf"))


def image_distribution(postings: DataFrame) -> DataFrame:
    """postings with prob divided by the image's sum."""
    total = F.sum("prob").over(W.partitionBy("image_id"))
    return postings.withColumn("prob", F.col("prob") / total)


def label_positions(postings: DataFrame) -> DataFrame:
    """postings with position: 1 for the image's best label, ties by label_id."""
    return postings.withColumn("position", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("prob"), "label_id")))


def top_labels(postings: DataFrame, k: int) -> DataFrame:
    """The k best labels of each image."""
    return label_positions(postings).where(F.col("position") <= k)


def best_label(postings: DataFrame) -> DataFrame:
    """image_id, label_id, prob of each image's best label, by partial aggregation and not by sorting."""
    best = postings.groupBy("image_id").agg(F.max(F.struct("prob", (-F.col("label_id")).alias("neg"))).alias("x"))
    return best.select("image_id", (-F.col("x.neg")).alias("label_id"), "x.prob")
