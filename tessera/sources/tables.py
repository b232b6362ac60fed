"""Readers and writers of the collection's tables and text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import dense_ids

POSTINGS = "label_id bigint, image_id bigint, prob double"
ANNOTATIONS = "image_id bigint, labels array<struct<label_id:int,prob:float>>"
SCORES = "image_id bigint, scores array<float>"
FEATURES = "image_id bigint, features array<float>"
LABEL_SUMS = "label_id bigint, sum_prob double"
COOCCURRENCE = "label_i bigint, label_j bigint, sum_xy double"
#: Separator of a label line's fields and of its lists, and the mark of a label without a model class.
FIELD, ITEM, HYPERNYM_ONLY = "~", "#", "H"
#: Where the boxes of one file end in detections.
DETECTIONS_END = "]]]"


def _ints(field: Column) -> Column:
    return F.when(field == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(field, ITEM), lambda x: x.cast("bigint")))


def parse_labels(lines: DataFrame) -> DataFrame:
    """Label rows from lines (value) of six fields; any other number of fields fails."""
    parts = F.split(F.col("value"), FIELD, -1)
    checked = F.when(F.size(parts) == 6, parts).otherwise(F.raise_error(F.concat(F.lit("a label line must have 6 fields: "), F.col("value"))).cast("array<string>"))
    rows = lines.select(checked.alias("f"))
    names = F.split(F.col("f")[2], ITEM)
    words = F.array_min(F.transform(names, lambda x: F.size(F.split(F.trim(x), r"\s+"))))
    return rows.select(
        F.when(F.col("f")[0] != HYPERNYM_ONLY, F.col("f")[0]).cast("bigint").alias("label_id"),
        F.col("f")[1].cast("bigint").alias("synset_id"),
        names.alias("names"),
        _ints(F.col("f")[3]).alias("hyponyms"),
        _ints(F.col("f")[4]).alias("hypernyms"),
        F.col("f")[5].alias("description"),
        words.alias("min_words"),
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return parse_labels(spark.read.text(path))


def format_labels(labels: DataFrame) -> DataFrame:
    """The lines (value) that parse_labels reads."""
    def joined(c: str) -> Column:
        return F.concat_ws(ITEM, F.transform(F.coalesce(c, F.array().cast("array<bigint>")), lambda x: x.cast("string")))

    return labels.select(
        F.concat_ws(
            FIELD,
            F.coalesce(F.col("label_id").cast("string"), F.lit(HYPERNYM_ONLY)),
            F.col("synset_id").cast("string"),
            F.concat_ws(ITEM, "names"),
            joined("hyponyms"),
            joined("hypernyms"),
            F.coalesce("description", F.lit("")),
        ).alias("value")
    )


def write_labels(labels: DataFrame, path: str) -> None:
    """Label lines in synset order."""
    ordered = labels.orderBy("synset_id")
    format_labels(ordered).write.mode("overwrite").text(path)


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """query_id (place in the file), target_id, terms."""
    lines = spark.read.text(path).where("value != ''").withColumn("at", F.monotonically_increasing_id())
    numbered = dense_ids(lines, "at", name="query_id")
    return parse_query_log(numbered)


def parse_query_log(lines: DataFrame) -> DataFrame:
    """query_id, target_id, terms of lines (query_id, value) `frame~synset:flag,...`."""
    fields = F.split("value", FIELD)
    terms = F.transform(F.split(fields[1], ","), lambda t: F.struct(F.split(t, ":")[0].cast("bigint").alias("synset_id"), (F.split(t, ":")[1] == "1").alias("use_children")))
    return lines.select("query_id", fields[0].cast("bigint").alias("target_id"), terms.alias("terms"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet with a fixed schema: annotations, scores, features, label sums, co-occurrences."""
    return spark.read.schema(schema).parquet(path)


def read_postings(spark: SparkSession, path: str, label_ids: Sequence[int] | None = None) -> DataFrame:
    """The lists of the given labels only: the filter reaches the row groups, which are clustered by label."""
    postings = spark.read.schema(POSTINGS).parquet(path)
    return postings if label_ids is None else postings.where(F.col("label_id").isin(*label_ids))


def write_postings(postings: DataFrame, path: str) -> None:
    """Lists clustered by label, the most probable images first.

    Ranges go over (label, image), so that a label of very many images is not
    one task's; readers order by prob where the order matters.
    """
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.select("label_id", "image_id", "prob").repartitionByRange(n, "label_id", F.desc("prob"), "image_id")
    dealt.sortWithinPartitions("label_id", F.desc("prob"), "image_id").write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_synset_ids(spark: SparkSession, path: str) -> DataFrame:
    """synset_id of lines n########."""
    return spark.read.text(path).where(F.col("value").rlike("^n[0-9]{8}")).select(F.substring("value", 2, 8).cast("bigint").alias("synset_id"))


def read_category_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=":", schema="category string, synset string")


def parse_detections(lines: DataFrame) -> DataFrame:
    """A row for each box of JSON (value) {file: [[label, prob, [x, y, w, h]], ...]}."""
    files = lines.select(F.explode(F.from_json("value", "map<string,string>")).alias("file", "boxes"))
    return _boxes(files.select("file", F.from_json("boxes", "array<array<string>>").alias("boxes")))


def _boxes(files: DataFrame) -> DataFrame:
    """A row for each of the boxes (arrays of label, prob, place as texts) of a file."""
    boxes = files.select("file", F.posexplode("boxes").alias("box_no", "box"))
    place = F.from_json(F.col("box")[2], "array<double>")
    return boxes.select(
        "file", F.col("box_no").cast("int"), F.col("box")[0].alias("label"), F.col("box")[1].cast("double").alias("prob"),
        place[0].alias("x"), place[1].alias("y"), place[2].alias("w"), place[3].alias("h"),
    )


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """The boxes of files of JSON objects {file: [[label, prob, [x, y, w, h]], ...], ...}, however long an object or a line is.

    A key's boxes end with three brackets, and Spark's text reader takes those for
    the ends of lines, so that ranges of bytes of one file are different tasks'. What lies between
    is read as an object of its own; a key without boxes goes with the next one.
    Brackets follow each other without spaces, and none in threes in a name; what is no JSON fails.
    """
    body = F.regexp_replace(F.regexp_replace("value", r"^[\s,{}]+", ""), r"[\s}]+$", "")
    text = F.concat(F.lit("{"), F.col("body"), F.when(F.endswith("body", F.lit("]")), "").otherwise(DETECTIONS_END), F.lit("}"))
    pieces = spark.read.option("lineSep", DETECTIONS_END).text(path).select(body.alias("body")).where("body != ''").select(text.alias("value"))
    # each text is parsed once, for the check and for its boxes
    found = F.from_json("value", "map<string,array<array<string>>>")
    wrong = F.raise_error(F.concat(F.lit("no detections: "), F.substring("value", 1, 100)))
    return _boxes(pieces.select(F.explode(F.when(F.endswith("value", F.lit("]}")), F.coalesce(found, wrong)).otherwise(wrong)).alias("file", "boxes")))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, image_id (place in the sorted listing) of folder/file listings; contents are not read. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return dense_ids(files, "path", name="image_id")


def non_empty(files: DataFrame) -> DataFrame:
    return files.where("length > 0")


def emptied(spark: SparkSession, folders: Sequence[str]) -> None:
    """Puts an empty file in place of each file of these folders (a stated few)."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path):
            for status in files.listStatus(path):
                files.create(status.getPath(), True).close()


def class_eligibility(lines: DataFrame, least: int = 1000, most: int = 2999) -> DataFrame:
    """synset, images of release lines (value) with a number of images in the range, by synset."""
    found = lines.select(F.regexp_extract("value", r'wnid="(n[0-9]+)"', 1).alias("synset"), F.regexp_extract("value", r'numImages="([0-9]+)"', 1).cast("bigint").alias("images"))
    return found.where((F.col("synset") != "") & F.col("images").between(least, most)).orderBy("synset")


def read_rank_curves(spark: SparkSession, path: str, ranks: int = 4) -> DataFrame:
    return spark.read.csv(path, header=True, schema=", ".join([*(f"Rank{i + 1} double" for i in range(ranks)), "Percentage double"]))


def save_ranks(ranks: DataFrame, path: str) -> None:
    """Ranks (config, query_id, rank) by configuration; those of other configurations stay."""
    ranks.write.partitionBy("config").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def restore_ranks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id bigint, rank bigint, config string").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def once(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; made by make() and written first if it is not there."""
    if not _exists(spark, path + "/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def with_shards(df: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """df with shard (0 to shards - 1): runs of ceil(N / shards) rows in the given order."""
    numbered = dense_ids(df, *order, name="_row")
    size = -(-df.count() // shards)
    return numbered.withColumn("shard", F.floor(F.col("_row") / max(size, 1)).cast("bigint")).drop("_row")


def shard_path(path: str, shard: int) -> str:
    return f"{path}/shard={shard}"


def write_sharded(df: DataFrame, order: Sequence[str], shards: int, path: str) -> DataFrame:
    """One folder a shard, each readable alone; an earlier result is used again if all its shards are there."""
    spark = df.sparkSession
    filled = -(-df.count() // max(1, -(-df.count() // shards)))  # the last shards of few rows are empty
    if not all(_exists(spark, p) for p in [path + "/_SUCCESS", *(shard_path(path, i) for i in range(filled))]):
        with_shards(df, order, shards).write.partitionBy("shard").mode("overwrite").parquet(path)
    return spark.read.schema(df.select("*", F.lit(0).cast("bigint").alias("shard")).schema).parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """The rows of one shard; no other folder is opened."""
    return spark.read.parquet(shard_path(path, shard))
