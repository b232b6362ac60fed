"""The label graph: edges, closures, query expansion, label files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.columns import dense_ids
from tessera.functions.storage import settled

#: Uses of clauses (three short values each) up to which they are broadcast.
MOST_BROADCAST = 500_000


def edges_of(labels: DataFrame) -> DataFrame:
    """parent, child of label rows, from both directions of the lists."""
    down = labels.select(F.col("synset_id").alias("parent"), F.explode("hyponyms").alias("child"))
    up = labels.select(F.explode("hypernyms").alias("parent"), F.col("synset_id").alias("child"))
    return down.unionByName(up).distinct()


def closure(edges: DataFrame, start: DataFrame, down: bool = True, most_steps: int = 100) -> DataFrame:
    """start_id, node, depth (shortest): everything reachable from the nodes of start (start_id), themselves included.

    One join a step over the new pairs only; pairs seen are dropped, so shared
    nodes and cycles end. Each step writes its new pairs and nothing else.
    """
    here, there = ("parent", "child") if down else ("child", "parent")
    step = edges.select(F.col(here).alias("node"), F.col(there).alias("next")).distinct()
    new = seen = settled(start.select("start_id", F.col("start_id").alias("node")).distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, most_steps + 1):
        met = new.join(step, "node").select("start_id", F.col("next").alias("node")).distinct()
        new = settled(met.join(seen, ["start_id", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    raise RuntimeError("the label graph is deeper than most_steps")


def expand_query(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, clause_no, label_id of parts (query_id, position, synset_id, is_and, use_children).

    A part after an AND begins a clause. A label expands to the model labels
    reachable from it, unless its children are switched off and it has a class
    of its own. A part without any model label gives its clause a null label.
    """
    clause = F.sum(F.col("is_and").cast("int")).over(W.partitionBy("query_id").orderBy("position"))
    placed = parts.withColumn("clause_no", clause)
    own = labels.select("synset_id", "label_id")
    flagged = placed.join(own, "synset_id", "left").withColumn("expands", F.col("use_children") | F.col("label_id").isNull())
    # clauses of the same parts expand once; their labels are not shuffled again for each query
    part = F.struct("synset_id", "expands", "label_id")
    uses = settled(flagged.groupBy("query_id", "clause_no").agg(F.array_sort(F.collect_set(part)).alias("parts")).withColumn("clause_key", F.md5(F.to_json("parts"))))
    clauses = settled(uses.groupBy("clause_key").agg(F.first("parts").alias("parts")).select("clause_key", F.explode("parts").alias("p")).select("clause_key", "p.*"))
    wide = clauses.where("expands").select("clause_key", "synset_id")
    reach = closure(edges_of(labels), wide.select(F.col("synset_id").alias("start_id")).distinct())
    below = reach.join(own.where("label_id is not null").withColumnRenamed("synset_id", "node"), "node").select(F.col("start_id").alias("synset_id"), F.col("label_id").alias("found"))
    rows = wide.join(below, "synset_id").select("clause_key", F.col("found").alias("label_id")).unionByName(clauses.where("not expands").select("clause_key", "label_id")).distinct()
    found = clauses.select("clause_key").distinct().join(rows, "clause_key", "left")
    # a clause of many labels that many queries share is dealt out by its labels, all its uses to each deal
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.withColumn("_deal", F.pmod(F.xxhash64("label_id"), F.lit(n)))
    used = uses.select("query_id", "clause_no", "clause_key")
    if used.count() <= MOST_BROADCAST:
        return dealt.repartition(n, "clause_key", "_deal").join(F.broadcast(used), "clause_key").select("query_id", "clause_no", "label_id")
    deals = found.groupBy("clause_key").agg(F.collect_set(F.pmod(F.xxhash64("label_id"), F.lit(n))).alias("deals"))
    used = used.join(deals, "clause_key").select("query_id", "clause_no", "clause_key", F.explode("deals").alias("_deal"))
    return dealt.join(used.hint("merge"), ["clause_key", "_deal"]).select("query_id", "clause_no", "label_id")


def ordered_labels(parts: DataFrame) -> DataFrame:
    """query_id, clause_no, label_id, first_position: each label of a clause once, where it comes first."""
    return parts.groupBy("query_id", "clause_no", "label_id").agg(F.min("position").alias("first_position"))


def build_labels(synsets: DataFrame, edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Label rows of the selected classes (synset_id) and all their ancestors.

    synsets has synset_id, names, description. Classes get numbers in synset
    order; ancestors are hypernym-only (null label_id). Lists hold the edges on
    paths from the selected classes only.
    """
    up = closure(edges, selected.select(F.col("synset_id").alias("start_id")), down=False)
    nodes = up.select(F.col("node").alias("synset_id")).distinct()
    inner = edges.distinct().join(nodes.withColumnRenamed("synset_id", "parent"), "parent").join(nodes.withColumnRenamed("synset_id", "child"), "child")
    numbered = dense_ids(selected.select("synset_id").distinct(), "synset_id", name="label_id")
    hypo = inner.groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("hyponyms")).withColumnRenamed("parent", "synset_id")
    hyper = inner.groupBy("child").agg(F.array_sort(F.collect_list("parent")).alias("hypernyms")).withColumnRenamed("child", "synset_id")
    none = F.array().cast("array<bigint>")
    rows = nodes.join(synsets, "synset_id").join(numbered, "synset_id", "left").join(hypo, "synset_id", "left").join(hyper, "synset_id", "left")
    return rows.select("label_id", "synset_id", "names", F.coalesce("hyponyms", none).alias("hyponyms"), F.coalesce("hypernyms", none).alias("hypernyms"), "description")


def cluster_subgraph(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, node, parents, is_class, is_root: the ancestors of each cluster's classes (cluster, class_id), one job for all."""
    up = closure(edges, clusters.select(F.col("class_id").alias("start_id")).distinct(), down=False)
    nodes = clusters.join(up.withColumnRenamed("start_id", "class_id"), "class_id").groupBy("cluster", "node").agg(F.max((F.col("depth") == 0).cast("int")).alias("is_class"))
    parents = edges.distinct().groupBy("child").agg(F.array_sort(F.collect_list("parent")).alias("parents")).withColumnRenamed("child", "node")
    return nodes.join(parents, "node", "left").select("cluster", "node", F.coalesce("parents", F.array().cast("array<bigint>")).alias("parents"), (F.col("is_class") == 1).alias("is_class"), F.col("parents").isNull().alias("is_root"))


def label_kind(labels: DataFrame) -> DataFrame:
    """labels with kind: hypernym_only, has_children or leaf."""
    kind = F.when(F.col("label_id").isNull(), "hypernym_only").when(F.size("hyponyms") > 0, "has_children").otherwise("leaf")
    return labels.withColumn("kind", kind)


def model_labels_only(labels: DataFrame) -> DataFrame:
    return labels.where("label_id is not null")


def label_set(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """synset_id of model labels and of everything above them."""
    return labels.where("label_id is not null").select("synset_id").unionByName(edges.select(F.col("parent").alias("synset_id"))).distinct()


def child_names(labels: DataFrame) -> DataFrame:
    """synset_id, children: structs (place, synset_id, name) of the hyponyms, in list order."""
    rows = labels.select("synset_id", F.posexplode("hyponyms").alias("place", "child"))
    named = rows.join(labels.select(F.col("synset_id").alias("child"), F.concat_ws(", ", "names").alias("name")), "child")
    return named.groupBy("synset_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("child").alias("synset_id"), "name"))).alias("children"))


def names_to_synsets(labels: DataFrame) -> DataFrame:
    """name, synset_ids."""
    return labels.select(F.explode("names").alias("name"), "synset_id").groupBy("name").agg(F.array_sort(F.collect_set("synset_id")).alias("synset_ids"))


def with_names(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (label_id) with name; unknown labels get null."""
    return rows.join(labels.where("label_id is not null").select("label_id", F.concat_ws(", ", "names").alias("name")), "label_id", "left")


def search_synsets(synsets: DataFrame, text: str, selected: DataFrame) -> DataFrame:
    """synset_id, names, selected: names that contain text, or equal it after a leading '!'."""
    found = F.array_contains("names", text[1:]) if text.startswith("!") else F.exists("names", lambda x: x.contains(text))
    flags = selected.select("synset_id").distinct().withColumn("selected", F.lit(True))
    return synsets.where(found).join(flags, "synset_id", "left").select("synset_id", "names", F.coalesce("selected", F.lit(False)).alias("selected"))


def remap_categories(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """files (category, ...) with folder synset.places2.category for the categories that have a synset."""
    return files.join(mapping, "category").withColumn("folder", F.format_string("%s.places2.%s", "synset", "category"))


def query_lengths(queries: DataFrame) -> DataFrame:
    """queries, mean_labels, longest."""
    per = queries.groupBy("query_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("queries"), F.avg("n").alias("mean_labels"), F.max("n").alias("longest"))
