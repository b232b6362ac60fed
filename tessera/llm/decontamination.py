"""Benchmark decontamination (operator 5), in DataFrame functions only.

A hash set of the benchmark's n-grams is broadcast (behind a check of its size),
each window of a document probes it, and hits are verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, stored, table

#: Letters and digits of ASCII, and everything beyond ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The normalised words; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(TOKEN), F.lit(0))


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """size, win, win_hash, items: each different window and the items that have it.

    An item of fewer than n words, but not none, is one window.
    """
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    words = words.withColumn("size", F.least(F.lit(n), F.size("w")))
    at = words.select("item", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("i"))
    wins = at.select("item", "size", F.slice("w", F.col("i"), F.col("size")).alias("win"))
    return wins.groupBy("size", "win").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("win_hash", F.xxhash64("win"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_broadcast: int = 1_000_000, most_bytes: int = 64 << 20) -> DataFrame:
    """docs' doc_id, text_hash with n_words, spans (array of pos, len in words, merged), items (array), a row each.

    The hashes of the benchmark's windows (12 bytes each) are broadcast up to
    most_broadcast of them. The text is read and split once then, and only
    windows that hit leave their task, with their words; they are verified
    against the windows themselves, which are broadcast up to most_bytes. Past
    the first bound, narrow rows (hash and place of a window) are joined with the
    hashes by a shuffle, and texts with a hit are joined with their places.
    """
    windows = stored(benchmark_windows(benchmark, n))
    size_of = F.sum(F.octet_length(F.concat_ws(" ", "win")) + F.octet_length(F.concat_ws(",", "items")) + 48)
    sizes, total, held = [], 0, 0
    for r in windows.groupBy("size").agg(F.count("*").alias("n"), size_of.alias("bytes")).collect():  # at most n rows
        sizes.append(r["size"])
        total, held = total + r["n"], held + r["bytes"]
    keys = windows.select("size", "win_hash").distinct()
    base = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), words_of(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id())
    base = base.withColumn("n_words", F.size("w"))

    def windows_at(rows: DataFrame, *names: str) -> DataFrame:
        # start 0 stands for the row itself, so that rows without hits stay
        last = F.greatest(F.lit(0), F.col("n_words") - min(sizes) + 1) if sizes else F.lit(0)
        at = rows.select(*names, "w", F.explode(F.sequence(F.lit(0), last)).alias("i"))
        if len(sizes) > 1:
            at = at.withColumn("len", F.explode(F.when(F.col("i") > 0, F.array(*map(F.lit, sorted(sizes)))).otherwise(F.array(F.lit(0)))))
        else:
            at = at.withColumn("len", F.lit(sizes[0] if sizes else n))
        fits = (F.col("i") > 0) & (F.col("i") + F.col("len") - 1 <= F.col("n_words"))
        return at.withColumn("h", F.when(fits, F.xxhash64(slice_at)))

    slice_at = F.slice("w", F.greatest("i", F.lit(1)), F.col("len"))
    probed = (F.col("h") == F.col("win_hash")) & (F.col("len") == F.col("size"))
    if total <= most_broadcast:
        at = windows_at(base, "row", "doc_id", "text_hash", "n_words").join(F.broadcast(keys), probed, "left")
        found = at.where((F.col("i") == 0) | F.col("win_hash").isNotNull()).select("row", "doc_id", "text_hash", "n_words", "i", "len", "h", F.when(F.col("i") > 0, slice_at).alias("words"))
    else:
        place = base.select("doc_id", "text_hash", "w", "n_words")
        at = windows_at(place, "doc_id", "text_hash", "n_words").where("h is not null").select("doc_id", "text_hash", "i", "len", "h")
        hit = at.join(keys, probed).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("i", "len", "h")).alias("hits"))
        hit = hit.withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
        met = base.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
        none = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("len"), F.lit(None).cast("bigint").alias("h")))
        met = met.withColumn("x", F.explode(F.concat(none, F.coalesce("hits", F.array().cast("array<struct<i:int,len:int,h:bigint>>")))))
        met = met.select("row", "doc_id", "text_hash", "n_words", "w", "x.i", "x.len", "x.h")
        found = met.select("row", "doc_id", "text_hash", "n_words", "i", "len", "h", F.when(F.col("i") > 0, slice_at).alias("words"))
    # rows without a hit get a key of their own, so that they don't meet in one task
    found = found.withColumn("h", F.coalesce("h", F.xxhash64("row")))
    same = (F.col("h") == F.col("win_hash")) & (F.col("len") == F.col("size")) & (F.col("words") == F.col("win"))
    found = found.join(F.broadcast(windows) if held <= most_bytes else windows, same, "left").where((F.col("i") == 0) | F.col("win_hash").isNotNull())
    span = F.when(F.col("win_hash").isNotNull(), F.struct("i", "len"))
    return found.groupBy("row", "doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))

    def step(state: Column, span: Column) -> Column:
        end = (span["i"] + span["len"]).cast("bigint")
        return F.struct((state["n"] + F.greatest(F.lit(0).cast("bigint"), end - F.greatest(state["end"], span["i"].cast("bigint")))).alias("n"), F.greatest(state["end"], end).alias("end"))

    return F.aggregate(spans, start, step, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, **bounds: int) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row.

    Null texts and items have no words. Each row of a repeated doc_id gives a row
    of its own; null ids are kept; an empty benchmark hits nothing; further
    columns are not read.
    """
    out = hits(docs, benchmark, n, **bounds).withColumn("n_hit", covered(F.col("spans")))
    return out.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_broadcast: int = 500_000) -> DataFrame:
    """The rows of docs without a hit, those without a doc_id included; all columns as they are.

    What is dropped is known by doc_id and hash of the text, 16 bytes each, and
    broadcast up to most_broadcast of them, else joined by a shuffle.
    """
    bad = stored(hits(docs, benchmark, n).where(F.size("spans") > 0).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    bad = F.broadcast(bad) if bad.count() <= most_broadcast else bad
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("bad_hash"))
    return rows.join(bad, same, "left_anti").select(*[F.col("row")[c].alias(c) for c in names])


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}
ORACLES = {
    "op5_benchmark_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT rid, i, dw.size, item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
}
