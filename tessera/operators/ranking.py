"""Ranking for many AND-of-OR queries at once.

Queries are rows (query_id, clause_no, label_id): labels of a clause are summed,
clauses multiplied, and an image that misses a clause drops out. A query with an
empty clause (a row with a null label_id) returns nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def valid_queries(queries: DataFrame) -> DataFrame:
    """Distinct rows of the queries without an empty clause, with n_clauses and n_labels."""
    per = queries.groupBy("query_id").agg(F.count_distinct("clause_no").alias("n_clauses"), F.count_distinct("clause_no", "label_id").alias("n_labels"), F.count_if(F.col("label_id").isNull()).alias("gaps"))
    return queries.distinct().join(per.where("gaps = 0").drop("gaps"), "query_id")


def clause_keys(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clauses scored once however many queries share them.

    Returns (clause_key, label_id) of different clauses, and (query_id, clause_no,
    clause_key, n_clauses, weighted flag) of their uses.
    """
    valid = valid_queries(queries)
    keyed = valid.groupBy("query_id", "clause_no").agg(F.array_sort(F.collect_set("label_id")).alias("labels"), F.first("n_clauses").alias("n_clauses"), F.first("n_labels").alias("n_labels"))
    keyed = keyed.withColumn("clause_key", F.md5(F.concat_ws(",", F.transform("labels", lambda x: x.cast("string")))))
    clauses = keyed.groupBy("clause_key").agg(F.first("labels").alias("labels")).select("clause_key", F.explode("labels").alias("label_id"))
    return clauses, keyed.drop("labels")


def scores(postings: DataFrame, queries: DataFrame, idf: DataFrame | None = None, idf_min_labels: int = 1) -> DataFrame:
    """query_id, image_id, score of every image that meets all clauses.

    One equi-join of the different clauses' labels with the postings, one
    aggregation by (clause, image), one by (query, image). idf (label_id, idf)
    weighs the queries that have at least idf_min_labels labels.
    """
    clauses, uses = clause_keys(queries)
    found = postings.join(clauses, "label_id")
    if idf is None:
        found = found.withColumn("weighted", F.col("prob"))
    else:
        found = found.join(idf, "label_id").withColumn("weighted", F.col("prob") * F.col("idf"))
    sums = found.groupBy("clause_key", "image_id").agg(F.sum("prob").alias("plain"), F.sum("weighted").alias("weighted"))
    each = sums.join(uses, "clause_key").withColumn("part", F.when(F.col("n_labels") >= idf_min_labels, F.col("weighted")).otherwise(F.col("plain")))
    out = each.groupBy("query_id", "image_id").agg(F.product("part").alias("score"), F.count("*").alias("met"), F.first("n_clauses").alias("n_clauses"))
    return out.where("met = n_clauses and score > 0").select("query_id", "image_id", "score")


def rank_frames(postings: DataFrame, queries: DataFrame, idf: DataFrame | None = None, top: int | None = None, idf_min_labels: int = 1) -> DataFrame:
    """query_id, image_id, score, rank (1 is best; ties by image_id).

    With top, the window keeps a group limit below its shuffle, so that only the
    best rows of each task are dealt out.
    """
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "image_id"))
    ranked = scores(postings, queries, idf, idf_min_labels).withColumn("rank", rank)
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def rank_page(scored: DataFrame, size: int = 70) -> DataFrame:
    """The first images of one query's scores."""
    return scored.orderBy(F.desc("score"), "image_id").limit(size)


def target_ranks(scored: DataFrame, targets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys and rank of each target (keys, target_id), null if it has no score.

    Counted, not sorted: one more than the images with a larger score, or an
    equal one and a smaller id.
    """
    keys = keys or ["query_id"]
    own = targets.join(scored.withColumnRenamed("image_id", "target_id"), [*keys, "target_id"]).withColumnRenamed("score", "own")
    better = (F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("image_id") < F.col("target_id")))
    ranks = scored.join(own, keys).groupBy(*keys).agg((F.count_if(better) + 1).alias("rank"))
    return targets.join(ranks, keys, "left").select(*keys, "target_id", "rank")


def result_status(queries: DataFrame, scored: DataFrame) -> DataFrame:
    """query_id, results, status: 'invalid' with an empty clause, 'empty' or 'found'."""
    per = queries.groupBy("query_id").agg(F.count_if(F.col("label_id").isNull()).alias("gaps"))
    counts = scored.groupBy("query_id").agg(F.count("*").alias("results"))
    status = F.when(F.col("gaps") > 0, "invalid").when(F.col("results").isNull(), "empty").otherwise("found")
    return per.join(counts, "query_id", "left").select("query_id", F.coalesce("results", F.lit(0)).alias("results"), status.alias("status"))


def window_best(first: DataFrame, second: DataFrame, width: int, keys: list[str], partition_by: str | None = None) -> DataFrame:
    """first (keys, image_id, ...) with best: the largest second score among images image_id to image_id + width - 1; rows without any go.

    Images are cut into blocks of `width`. A window that begins in a block ends in
    it or the next, so its best is the larger of a maximum over the rest of its
    block and one over the beginning of the next. A score goes to both blocks,
    whatever the width, and no window runs over more than a block. With
    partition_by, runs of images end with its value (a video).
    """
    keys = [*keys, *([partition_by] if partition_by else [])]
    block = F.floor(F.col("image_id") / width)
    own = first.select(*keys, F.struct(*[F.col(c) for c in first.columns]).alias("row"), block.alias("block"), F.col("image_id").alias("at"), F.lit(None).cast("double").alias("after"), F.lit(None).cast("double").alias("before"))
    none, score = F.lit(None).cast("double"), F.col("score").cast("double")
    seen = second.where("score is not null").select(*keys, "image_id", F.explode(F.array(F.struct(block.alias("block"), F.col("image_id").alias("at"), score.alias("after"), none.alias("before")), F.struct((block - 1).alias("block"), (F.col("image_id") - (width - 1)).alias("at"), none.alias("after"), score.alias("before")))).alias("x"))
    rows = own.unionByName(seen.select(*keys, "x.*"), allowMissingColumns=True)
    by = W.partitionBy(*keys, "block")
    after = F.max("after").over(by.orderBy(F.desc("at")).rangeBetween(W.unboundedPreceding, 0))
    before = F.max("before").over(by.orderBy("at").rangeBetween(W.unboundedPreceding, 0))
    return rows.withColumn("best", F.greatest(after, before)).where("row is not null and best is not null").select("row.*", "best")


def two_image_scores(first: DataFrame, second: DataFrame, width: int, partition_by: str | None = None) -> DataFrame:
    """query_id, image_id, score: an image's score times the best second score in its window."""
    best = window_best(first, second, width, ["query_id"], partition_by)
    return best.select("query_id", "image_id", (F.col("score") * F.col("best")).alias("score")).where("score > 0")


def sliding_max(values: DataFrame, width: int, partition_by: list[str], order: str, value: str) -> DataFrame:
    """values with forward_max over the row and the width - 1 rows after it in its partition."""
    over = W.partitionBy(*partition_by).orderBy(order).rowsBetween(0, width - 1)
    return values.withColumn("forward_max", F.max(value).over(over))


def fuse(modalities: DataFrame) -> DataFrame:
    """query_id, image_id, score: scores (query_id, modality, image_id, score) scaled to [0, 1] by modality and summed."""
    ends = modalities.groupBy("query_id", "modality").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0))
    return modalities.join(ends, ["query_id", "modality"]).groupBy("query_id", "image_id").agg(F.sum(scaled).alias("score"))


def filter_by_model(scored: DataFrame, model: DataFrame, least: float) -> DataFrame:
    """Scores of the images that another model scores from `least` on."""
    return scored.join(model.where(F.col("score") >= least).select("query_id", "image_id").distinct(), ["query_id", "image_id"], "left_semi")


def route(queries: DataFrame, sources: dict[str, DataFrame], **options) -> DataFrame:
    """source_name, query_id, image_id, score, rank: queries (with source_name) on the postings of their source."""
    out = None
    for name, postings in sources.items():
        part = rank_frames(postings, queries.where(F.col("source_name") == name).drop("source_name"), **options).select(F.lit(name).alias("source_name"), "query_id", "image_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out
