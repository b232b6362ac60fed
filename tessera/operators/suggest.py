"""Suggestions: searching label names and descriptions for typed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bonus of the first hit in the name (fixed values): whole name, before a comma, at the start of a text without comma, at the start, after a space.
WHOLE, COMMA, ALONE, START, WORD = 10, 5, 4, 2, 1
#: Marks around a hit (fixed values).
OPEN, CLOSE = "$~START~$", "$~END~$"
#: Letters of the stretches that labels are found by.
GRAM = 3


def last_term(text: Column) -> Column:
    """What follows the last + or *, trimmed."""
    return F.trim(F.regexp_extract(text, r"([^+*]*)$", 1))


def match(name: Column, description: Column, term: Column) -> Column:
    return F.contains(F.lower(name), F.lower(term)) | F.contains(F.lower(description), F.lower(term))


def hits(text: Column, term: Column) -> Column:
    """Occurrences without overlap, whatever the case."""
    low, t = F.lower(text), F.lower(term)
    return F.when(F.length(t) == 0, 0).otherwise(((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("int"))


def highlight(text: Column, term: Column) -> Column:
    """text with marks around each hit."""
    quoted = F.concat(F.lit(r"(?i)(\Q"), term, F.lit(r"\E)"))
    mark = lambda m: m.replace("$", r"\$")
    return F.when(F.length(term) == 0, text).otherwise(F.regexp_replace(text, quoted, F.lit(f"{mark(OPEN)}$1{mark(CLOSE)}")))


def bonus(name: Column, term: Column) -> Column:
    """Worth of the first hit at the name's start, or else of any after a space."""
    low, t = F.lower(name), F.lower(term)
    at = F.position(t, low)
    after = F.substring(low, at + F.length(t), F.lit(1))
    return (
        F.when(at == 0, 0)
        .when(low == t, WHOLE)
        .when((at == 1) & (after == ","), COMMA)
        .when((at == 1) & ~F.contains(low, F.lit(",")), ALONE)
        .when(at == 1, START)
        .when(F.contains(low, F.concat(F.lit(" "), t)), WORD)
        .otherwise(0)
    )


def columns(labels: DataFrame, term: Column) -> DataFrame:
    """labels (synset_id, names, description, ...) with hits, bonus, relevance and highlighted texts."""
    name = F.concat_ws(", ", "names")
    words = F.array_min(F.transform("names", lambda x: F.size(F.split(F.trim(x), r"\s+"))))
    out = labels.withColumn("name", name).withColumn("term", term).withColumn("name_hits", hits(F.col("name"), F.col("term"))).withColumn("description_hits", hits(F.col("description"), F.col("term"))).withColumn("bonus", bonus(F.col("name"), F.col("term")))
    relevance = (F.col("bonus") + F.col("name_hits")) * 2.0 / words + F.col("description_hits")
    return out.withColumn("relevance", relevance).withColumn("marked", highlight(F.col("name"), F.col("term")))


def grams(text: Column, longest: int = GRAM) -> Column:
    """The different stretches of 1 to `longest` characters of a text."""
    def of(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, longest + 1)]))


def gram_index(labels: DataFrame) -> DataFrame:
    """gram, synset_id: stretches of up to three characters, in lower case, of the names and descriptions (synset_id, names, description)."""
    name, description = F.lower(F.concat_ws(", ", "names")), F.lower(F.coalesce("description", F.lit("")))
    return labels.select("synset_id", F.explode(F.array_union(grams(name), grams(description))).alias("gram"))


def gram_matches(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """wanted and the columns of labels whose name or description holds it, whatever the case, for terms (wanted).

    Labels that have all three-letter stretches of a term are candidates, found by
    equal stretches, and are verified. A shorter term is one stretch itself.
    """
    low = F.lower("wanted")
    parts = F.when(F.length(low) < GRAM, F.array(low)).otherwise(F.filter(grams(low), lambda g: F.length(g) == GRAM))
    asked = terms.select("wanted", parts.alias("parts")).select("wanted", F.size("parts").alias("n"), F.explode("parts").alias("gram"))
    met = asked.join(gram_index(labels), "gram").groupBy("wanted", "n", "synset_id").agg(F.count_distinct("gram").alias("common"))
    some = met.where("common = n").select("wanted", "synset_id")
    named = labels.join(some, "synset_id").withColumn("_name", F.concat_ws(", ", "names"))
    return named.where(match(F.col("_name"), F.coalesce("description", F.lit("")), F.col("wanted")))


def suggest(labels: DataFrame, texts: DataFrame, top: int = 50) -> DataFrame:
    """text, synset_id, name, relevance, name_hits, description_hits, bonus, marked, rank for texts (text).

    Texts are a stated set; labels are found by the stretches of letters that they
    share with a text (gram_matches). A negative top has no limit.
    """
    terms = texts.select("text", last_term(F.col("text")).alias("wanted")).where("wanted != ''").distinct()
    found = gram_matches(labels, terms.select("wanted").distinct()).join(terms, "wanted")
    rated = columns(found, F.col("wanted"))
    rank = F.row_number().over(W.partitionBy("text").orderBy(F.desc("relevance"), "synset_id"))
    out = rated.withColumn("rank", rank).select("text", "synset_id", "name", "relevance", "name_hits", "description_hits", "bonus", "marked", "rank")
    return out if top < 0 else out.where(F.col("rank") <= top)


def suggest_children(labels: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """The same columns for given labels (synset_id), neither filtered nor sorted."""
    own = labels.join(ids.select("synset_id").distinct(), "synset_id", "left_semi")
    return columns(own, F.lit(text)).select("synset_id", "name", "relevance", "name_hits", "description_hits", "bonus", "marked")
