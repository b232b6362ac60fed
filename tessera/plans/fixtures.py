"""Retrieval tables derived from the given business and vector tables, whole tables each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.storage import settled

#: Searches take as queries the rows whose id this divides, against all rows.
EVERY = 100


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an image, its parts are labels, their share of the quantity is the score."""
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return items.select(F.col("l_partkey").alias("label_id"), F.col("l_orderkey").alias("image_id"), (F.col("q") / F.sum("q").over(W.partitionBy("l_orderkey"))).alias("prob"))


def text_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is an image, its words are labels (as text), their share is the score."""
    return _shares(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), "text"))


def _shares(docs: DataFrame) -> DataFrame:
    words = docs.select("image_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word != ''")
    counts = words.groupBy("image_id", "word").agg(F.count("*").alias("n"))
    return counts.select("word", "image_id", (F.col("n") / F.sum("n").over(W.partitionBy("image_id"))).alias("prob"))


def text_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, sum_prob: text_postings summed by word, which alone are shuffled.

    A word of a document has a share of one by the document's number of words. Only
    rows whose doc_id others have too are brought together.
    """
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), "text")
    again = settled(docs.groupBy("image_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("image_id").alias("again"), F.lit(True).alias("repeated")))
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    rows = docs.join(again, F.col("image_id").eqNullSafe(F.col("again")), "left").where("repeated is null")
    once = rows.select(words.alias("words")).select(F.explode("words").alias("word"), (1 / F.size("words")).alias("prob"))
    both = docs.join(again, F.col("image_id").eqNullSafe(F.col("again"))).select("image_id", "text")
    return once.unionByName(_shares(both).select("word", "prob")).groupBy("word").agg(F.sum("prob").alias("sum_prob"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, target_id, clause_no, label_id: an order is its own query; clause 1 has its odd lines' parts, clause 2 the even ones'."""
    items = read(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % EVERY == 0)
    return items.select(F.col("l_orderkey").alias("query_id"), F.col("l_orderkey").alias("target_id"), (2 - F.col("l_linenumber") % 2).alias("clause_no"), F.col("l_partkey").alias("label_id")).distinct()


def one_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, position, label_id: the parts of the queries' orders, the largest share first."""
    own = postings(spark, sf_dir).where(F.col("image_id") % EVERY == 0)
    return own.select(F.col("image_id").alias("query_id"), F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("prob"), "label_id")).alias("position"), "label_id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are leaves, below their brand and their type, which are below one root: a graph with shared nodes.

    Synset ids: parts from 1,000,000 on, brands from 2,000, types from 3,000 on
    (by the rank of their name), the root 1.
    """
    part = read(spark, sf_dir, "part")
    brand = part.select("p_brand").distinct().withColumn("brand_id", F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint") + 2000)
    kind = part.select("p_type").distinct().withColumn("type_id", F.row_number().over(W.orderBy("p_type")) + 3000)  # a handful of types
    rows = part.join(F.broadcast(brand), "p_brand").join(F.broadcast(kind), "p_type")
    none = F.array().cast("array<bigint>")
    leaves = rows.select(F.col("p_partkey").cast("bigint").alias("label_id"), (F.col("p_partkey") + 1_000_000).alias("synset_id"), F.array("p_name").alias("names"), none.alias("hyponyms"), F.array_sort(F.array("brand_id", F.col("type_id").cast("bigint"))).alias("hypernyms"), F.col("p_type").alias("description"))
    groups = rows.select(F.explode(F.array(F.struct(F.col("brand_id").alias("synset_id"), F.col("p_brand").alias("name")), F.struct(F.col("type_id").cast("bigint").alias("synset_id"), F.col("p_type").alias("name")))).alias("g")).distinct()
    # the lists of a group's parts would grow with the table; the leaves' hypernyms hold the same edges
    groups = groups.select(F.lit(None).cast("bigint").alias("label_id"), "g.synset_id", F.array("g.name").alias("names"), none.alias("hyponyms"), F.array(F.lit(1).cast("bigint")).alias("hypernyms"), F.lit("").alias("description"))
    root = groups.agg(F.array_sort(F.collect_list("synset_id")).alias("hyponyms")).select(F.lit(None).cast("bigint").alias("label_id"), F.lit(1).cast("bigint").alias("synset_id"), F.array(F.lit("everything")).alias("names"), "hyponyms", none.alias("hypernyms"), F.lit("").alias("description"))
    return leaves.unionByName(groups).unionByName(root)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, child of the same graph, row by row."""
    part = read(spark, sf_dir, "part")
    kind = part.select("p_type").distinct().withColumn("type_id", F.row_number().over(W.orderBy("p_type")).cast("bigint") + 3000)
    rows = part.join(F.broadcast(kind), "p_type").withColumn("brand_id", F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint") + 2000)
    child = F.col("p_partkey") + 1_000_000
    down = rows.select(F.col("brand_id").alias("parent"), child.alias("child")).unionByName(rows.select(F.col("type_id").alias("parent"), child.alias("child")))
    top = rows.select(F.lit(1).cast("bigint").alias("parent"), F.explode(F.array("brand_id", "type_id")).alias("child")).distinct()
    return down.unionByName(top)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").cast("bigint").alias("class_id"), F.col("embedding").alias("features"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a box of its order: place and size from its keys and amounts, score from its discount."""
    items = read(spark, sf_dir, "lineitem")
    x1 = (F.col("l_partkey") * 37 % 1200).cast("double")
    y1 = (F.col("l_suppkey") * 53 % 680).cast("double")
    return items.select(F.col("l_orderkey").alias("image_id"), x1.alias("x1"), y1.alias("y1"), (x1 + F.col("l_quantity") * 6).alias("x2"), (y1 + F.col("l_quantity") * 3).alias("y2"), (F.col("l_extendedprice") / 10000 - F.col("l_discount") * 20).alias("score"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a submission: a user's team, the day's task, the second of the day, correct if it is a purchase."""
    e = read(spark, sf_dir, "events")
    ts = F.col("ts")
    return e.select((F.col("user_id") % 7).alias("team"), F.datediff(ts, F.lit("2024-01-01").cast("date")).alias("task"), (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("double").alias("t"), (F.col("event_id") % 40).alias("cluster"), (F.col("event_type") == "purchase").alias("correct"))


def supplier_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an image, its suppliers are labels with long lists, their share of the quantity is the score."""
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return items.select(F.col("l_suppkey").alias("label_id"), F.col("l_orderkey").alias("image_id"), (F.col("q") / F.sum("q").over(W.partitionBy("l_orderkey"))).alias("prob"))


def supplier_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, clause_no, label_id: for each order whose id EVERY divides, its first two lines' suppliers as one clause."""
    items = read(spark, sf_dir, "lineitem").where((F.col("l_orderkey") % EVERY == 0) & (F.col("l_linenumber") <= 2))
    return items.select(F.col("l_orderkey").alias("query_id"), F.lit(1).alias("clause_no"), F.col("l_suppkey").alias("label_id")).distinct()
