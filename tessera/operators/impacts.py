"""Postings in bands of falling impact, by parts of the labels: seeking lists by label, and the best images without reading whole lists.

On disk, under one path:
  lists/part=p/    label_id, band, image_id, prob of the labels with hash part p, by label, the most probable first
  images/slice=s/  image_id, labels (structs of label_id, prob): the same postings by image
  bands/           label_id, band, n, top: size and largest prob of each band of each list
A band holds the probs of a quarter of an octave, so that its number bounds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.storage import settled
from tessera.operators.ranking import valid_queries

LISTS = "label_id bigint, band int, image_id bigint, prob double, part int"
IMAGES = "image_id bigint, labels array<struct<label_id:bigint,prob:double>>, slice int"
BANDS = "label_id bigint, band int, n bigint, top double"
#: Bands an octave; parts of the labels and slices of the images (folders); labels up to which a table of them is broadcast.
STEPS, PARTS, MOST_BROADCAST = 4, 64, 1_000_000


def band_of(prob: Column) -> Column:
    """Smaller for larger probs, which must be positive."""
    return F.floor(F.log2(prob) * -STEPS).cast("int")


def part_of(number: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(number.cast("bigint")), F.lit(parts)).cast("int")


def write_impacts(postings: DataFrame, path: str, parts: int = PARTS) -> None:
    """Writes postings (label_id, image_id, prob); those with prob 0 or less have no impact and are left out.

    Ranges are over (part, label, prob), so that a label that a third of all rows
    have is many tasks' and many files'.
    """
    rows = settled(postings.where("prob > 0").select(F.col("label_id").cast("bigint"), band_of(F.col("prob")).alias("band"), F.col("image_id").cast("bigint"), F.col("prob").cast("double")))
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["part", "label_id", F.desc("prob"), "image_id"]
    lists = rows.withColumn("part", part_of(F.col("label_id"), parts)).repartitionByRange(n, *order).sortWithinPartitions(*order)
    lists.write.partitionBy("part").mode("overwrite").parquet(f"{path}/lists")
    images = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("label_id", "prob"))).alias("labels")).withColumn("slice", part_of(F.col("image_id"), parts))
    images.repartitionByRange(n, "slice", "image_id").sortWithinPartitions("slice", "image_id").write.partitionBy("slice").mode("overwrite").parquet(f"{path}/images")
    rows.groupBy("label_id", "band").agg(F.count("*").alias("n"), F.max("prob").alias("top")).write.mode("overwrite").parquet(f"{path}/bands")


def _folders(rows: DataFrame, wanted: DataFrame, key: str, folder: str, parts: int) -> DataFrame:
    """rows of the folders that the wanted keys are in: at most `parts` numbers come to the driver, the scan lists no other folder."""
    found = [r[0] for r in wanted.select(part_of(F.col(key), parts).alias("p")).distinct().collect()]
    return rows.where(F.col(folder).isin(found))


def seek(spark: SparkSession, path: str, labels: DataFrame, parts: int = PARTS) -> DataFrame:
    """label_id, band, image_id, prob and the further columns of labels (label_id, ...): only the lists of these labels.

    Folders of other parts are not opened. The labels' table is broadcast up to
    MOST_BROADCAST rows, so that the lists are not shuffled. Unknown labels have
    no list.
    """
    wanted = labels.where("label_id is not null")
    lists = _folders(spark.read.schema(LISTS).parquet(f"{path}/lists"), wanted, "label_id", "part", parts)
    small = wanted.count() <= MOST_BROADCAST
    return lists.drop("part").join(F.broadcast(wanted) if small else wanted, "label_id")


def _exact(spark: SparkSession, path: str, seen: DataFrame, terms: DataFrame, parts: int) -> DataFrame:
    """query_id, image_id, score of the seen (query_id, image_id) that meet all clauses, from the images' own labels."""
    images = _folders(spark.read.schema(IMAGES).parquet(f"{path}/images"), seen, "image_id", "slice", parts)
    small = seen.count() <= MOST_BROADCAST
    own = images.join(F.broadcast(seen) if small else seen, "image_id").select("query_id", "image_id", F.explode("labels").alias("x")).select("query_id", "image_id", "x.label_id", "x.prob")
    sums = own.join(terms, ["query_id", "label_id"]).groupBy("query_id", "image_id", "clause_no", "n_clauses").agg(F.sum(F.col("prob") * F.col("weight")).alias("part"))
    every = sums.groupBy("query_id", "image_id", "n_clauses").agg(F.product("part").alias("score"), F.count("*").alias("met"))
    return every.where("met = n_clauses").select("query_id", "image_id", "score")


def _page(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "image_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def top_page(spark: SparkSession, path: str, queries: DataFrame, k: int = 70, idf: DataFrame | None = None, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """(query_id, image_id, score, rank) of the k best images of each query, and (query_id, read, total): postings read of those in its lists.

    The threshold algorithm, in two waves for all queries together. The first
    reads each query's upper bands, until they hold 2 * k postings, and scores
    the images seen there exactly, by their own labels; the k-th best is the
    query's threshold. An image unseen below a cut scores at most the product over
    clauses of the sums of what is largest below it in the clause's lists; the
    second wave reads down to the first cut where this is less than the threshold.
    Nothing further down can enter the page. Queries are AND-of-OR rows
    (query_id, clause_no, label_id), as for rank_frames; one with an empty clause
    returns nothing; idf (label_id, idf) weighs labels, with idf > 0.
    """
    terms = valid_queries(queries).select("query_id", "clause_no", "label_id", "n_clauses")
    weight = terms.withColumn("weight", F.lit(1.0)) if idf is None else terms.join(idf, "label_id").withColumnRenamed("idf", "weight")
    terms = settled(weight.select("query_id", "clause_no", "label_id", "n_clauses", "weight"))
    bands = settled(terms.join(spark.read.schema(BANDS).parquet(f"{path}/bands"), "label_id"))
    held = bands.dropDuplicates(["query_id", "label_id", "band"]).groupBy("query_id", "band").agg(F.sum("n").alias("n"))
    over = W.partitionBy("query_id").orderBy("band")
    sofar = settled(held.withColumn("upto", F.sum("n").over(over)))
    total = sofar.groupBy("query_id").agg(F.max("upto").alias("total"), F.max("band").alias("last"))
    first = sofar.where(F.col("upto") >= 2 * k).groupBy("query_id").agg(F.min("band").alias("first"))
    cuts = settled(total.join(first, "query_id", "left").select("query_id", "total", "last", F.coalesce("first", "last").alias("first")))

    labels = terms.select("query_id", "label_id").distinct()
    one = seek(spark, path, labels.join(cuts, "query_id").select("label_id", "query_id", "first"), parts).where("band <= first")
    one = settled(one.groupBy("query_id", "image_id").agg(F.count("*").alias("read")))
    scored = settled(_exact(spark, path, one.select("query_id", "image_id"), terms, parts))
    least = _page(scored, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))

    # what is largest below each cut, by label, clause and query
    at = sofar.select("query_id", F.col("band").alias("cut"))
    below = at.join(bands, "query_id").where("band > cut").groupBy("query_id", "cut", "clause_no", "n_clauses", "label_id", "weight").agg(F.max("top").alias("top"))
    clause = below.groupBy("query_id", "cut", "clause_no", "n_clauses").agg(F.sum(F.col("top") * F.col("weight")).alias("most"))
    # sums in another order may differ in the last bits
    unseen = clause.groupBy("query_id", "cut", "n_clauses").agg((F.product("most") * (1 + 1e-9)).alias("most"), F.count("*").alias("open"))
    unseen = at.join(unseen, ["query_id", "cut"], "left").select("query_id", "cut", F.when(F.col("open") == F.col("n_clauses"), F.col("most")).otherwise(0.0).alias("most"))
    enough = unseen.join(least, "query_id").where("most < least").groupBy("query_id").agg(F.min("cut").alias("enough"))
    second = settled(cuts.join(enough, "query_id", "left").select("query_id", "total", "first", F.greatest("first", F.coalesce("enough", "last")).alias("second")))

    two = seek(spark, path, labels.join(second.where("second > first"), "query_id").select("label_id", "query_id", "first", "second"), parts).where("band > first and band <= second")
    two = settled(two.groupBy("query_id", "image_id").agg(F.count("*").alias("read")))
    new = settled(two.select("query_id", "image_id").join(one.select("query_id", "image_id"), ["query_id", "image_id"], "left_anti"))
    page = _page(scored.unionByName(_exact(spark, path, new, terms, parts)), k)
    read = one.unionByName(two).groupBy("query_id").agg(F.sum("read").alias("read"))
    return page, second.select("query_id", "total").join(read, "query_id", "left").select("query_id", F.coalesce("read", F.lit(0)).alias("read"), "total")
