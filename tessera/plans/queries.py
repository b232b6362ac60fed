"""One query for each operator, over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions.storage import scratch, settled
from tessera.operators import boxes as B
from tessera.operators import cells as N
from tessera.operators import contest as X
from tessera.operators import evaluation as E
from tessera.operators import grouping as K
from tessera.operators import impacts as I
from tessera.operators import labels as L
from tessera.operators import patterns as A
from tessera.operators import postings as P
from tessera.operators import ranking as R
from tessera.operators import sampling as S
from tessera.operators import scan as M
from tessera.operators import suggest as G
from tessera.operators import vectors as V
from tessera.plans import fixtures as D
from tessera.sources import tables as T

#: Typed texts that the suggestion queries look for (two without a term to find).
TEXTS = ["red", "widget", "econ", "small bo", "zzz", "gear+bolt", "ring*", "re"]
#: Thresholds and query lengths of the evaluation queries.
THRESHOLDS, LENGTHS = [0.0, 0.05, 0.1], [1, 2, 3]


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to 6 digits, for comparison."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def r9(df: DataFrame, *names: str) -> DataFrame:
    """To 9 digits, where values often end in a 5 at the seventh."""
    return df.withColumns({n: F.round(n, 9) for n in names})


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TEXTS], "text string")


def rank_frames(spark: SparkSession, d: str) -> DataFrame:
    p = settled(D.postings(spark, d))
    out = R.rank_frames(p, D.queries(spark, d).drop("target_id"), P.idf(P.label_sums(p)), top=70)
    return r6(out, "score").select("query_id", "image_id", "score", "rank")


def brand_query(spark: SparkSession, d: str) -> DataFrame:
    """{Brand#1 or Brand#2} and {Brand#3 or Brand#4}, brands expanded to their parts through the graph."""
    parts = spark.createDataFrame([(1, i + 1, 2000 + b, b == 3, True) for i, b in enumerate([1, 2, 3, 4])], "query_id bigint, position int, synset_id bigint, is_and boolean, use_children boolean")
    p = settled(D.postings(spark, d))
    q = L.expand_query(parts, D.labels(spark, d))
    out = R.rank_page(R.scores(p, q, P.idf(P.label_sums(p))), 70)
    return r6(out, "score").select("image_id", "score")


def expand_query(spark: SparkSession, d: str) -> DataFrame:
    """A search for every hundredth part: the part, then an AND with its brand, children on and off."""
    part = D.read(spark, d, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint") + 2000
    rows = part.select(F.col("p_partkey").alias("query_id"), F.explode(F.array(F.struct(F.lit(1).alias("position"), (F.col("p_partkey") + 1_000_000).alias("synset_id"), F.lit(False).alias("is_and"), F.lit(True).alias("use_children")), F.struct(F.lit(2).alias("position"), brand.alias("synset_id"), F.lit(True).alias("is_and"), F.lit(False).alias("use_children")))).alias("x")).select("query_id", "x.*")
    out = L.expand_query(rows.where(F.col("query_id") % D.EVERY == 0), D.labels(spark, d))
    return out.select("query_id", F.col("clause_no").cast("bigint"), "label_id")


def closure_down(spark: SparkSession, d: str) -> DataFrame:
    e = D.edges(spark, d)
    out = L.closure(e, e.select(F.col("parent").alias("start_id")).distinct())
    return out.groupBy("start_id", "depth").agg(F.count("*").alias("nodes"))


def closure_up(spark: SparkSession, d: str) -> DataFrame:
    e = D.edges(spark, d)
    out = L.closure(e, D.labels(spark, d).where("label_id is not null").select(F.col("synset_id").alias("start_id")), down=False)
    return out.select("start_id", "node", "depth")


def build_labels(spark: SparkSession, d: str) -> DataFrame:
    """Parts of size 25 and more as classes."""
    chosen = D.read(spark, d, "part").where("p_size >= 25").select((F.col("p_partkey") + 1_000_000).alias("synset_id"))
    out = L.build_labels(D.labels(spark, d).select("synset_id", "names", "description"), D.edges(spark, d), chosen)
    return out.select("label_id", "synset_id", F.concat_ws(",", "names").alias("names"), F.size("hyponyms").alias("n_hyponyms"), F.concat_ws(",", F.transform("hypernyms", lambda x: x.cast("string"))).alias("hypernyms"))


def cluster_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Clusters are the sizes of parts."""
    c = D.read(spark, d, "part").select(F.col("p_size").alias("cluster"), (F.col("p_partkey") + 1_000_000).alias("class_id"))
    out = L.cluster_subgraph(c, D.edges(spark, d))
    return out.select("cluster", "node", F.size("parents").alias("n_parents"), "is_class", "is_root")


def label_file(spark: SparkSession, d: str) -> DataFrame:
    """Labels written as lines and read again, with their kind. The lines' separator can't be in a name."""
    path = scratch(spark)
    T.write_labels(D.labels(spark, d).withColumn("names", F.transform("names", lambda x: F.replace(x, F.lit("#"), F.lit("-")))), path)
    out = L.label_kind(T.read_labels(spark, path))
    return out.select("label_id", "synset_id", F.concat_ws("|", "names").alias("names"), F.size("hyponyms").alias("n_hyponyms"), F.size("hypernyms").alias("n_hypernyms"), "description", "min_words", "kind")


def label_names(spark: SparkSession, d: str) -> DataFrame:
    """Each order's best label with its name."""
    out = L.with_names(P.best_label(D.postings(spark, d)), D.labels(spark, d))
    return r6(out.select("image_id", "label_id", "prob", "name"), "prob")


def label_children(spark: SparkSession, d: str) -> DataFrame:
    out = L.child_names(D.labels(spark, d))
    return out.select("synset_id", F.concat_ws(",", F.transform("children", lambda x: x["name"])).alias("children"))


def names_to_synsets(spark: SparkSession, d: str) -> DataFrame:
    out = L.names_to_synsets(D.labels(spark, d))
    return out.select("name", F.size("synset_ids").alias("n"), F.array_min("synset_ids").alias("first"))


def search_synsets(spark: SparkSession, d: str) -> DataFrame:
    part = D.read(spark, d, "part")
    chosen = part.where("p_size < 10").select((F.col("p_partkey") + 1_000_000).alias("synset_id"))
    found = [L.search_synsets(D.labels(spark, d), t, chosen).withColumn("text", F.lit(t)) for t in ("ring", "!red ring")]
    return found[0].unionByName(found[1]).select("text", "synset_id", F.concat_ws(",", "names").alias("names"), "selected")


def label_set(spark: SparkSession, d: str) -> DataFrame:
    return L.label_set(D.labels(spark, d), D.edges(spark, d))


def remap_categories(spark: SparkSession, d: str) -> DataFrame:
    """Brands as categories, mapped by a table derived from part; each part is a file."""
    part = D.read(spark, d, "part")
    mapping = part.select(F.col("p_brand").alias("category")).distinct().withColumn("synset", F.format_string("n%08d", F.regexp_extract("category", r"(\d+)", 1).cast("int")))
    out = L.remap_categories(part.select(F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("category")), mapping)
    return out.select("file_id", "folder")


def postings_file(spark: SparkSession, d: str) -> DataFrame:
    """Lists written by label and read again for the labels of brand 7, positions included."""
    path = scratch(spark)
    T.write_postings(D.postings(spark, d), path)
    wanted = D.read(spark, d, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("label_id"))
    return r6(T.read_postings(spark, path).join(wanted, "label_id"), "prob").select("label_id", "image_id", "prob")


def query_log(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a log line (its parts as terms), written as text and read again."""
    path = scratch(spark)
    line = F.concat(F.col("l_orderkey").cast("string"), F.lit("~"), F.concat_ws(",", F.array_sort(F.collect_set(F.concat(F.col("l_partkey").cast("string"), F.lit(":"), (F.col("l_linenumber") % 2).cast("string"))))))
    D.read(spark, d, "lineitem").groupBy("l_orderkey").agg(line.alias("value")).select("value").write.text(path)
    out = T.read_query_log(spark, path)
    return out.select("target_id", F.size("terms").alias("n_terms"), F.size(F.filter("terms", lambda t: t["use_children"])).alias("n_children"))


def detections_json(spark: SparkSession, d: str) -> DataFrame:
    """Every order's boxes as a JSON object, written as text and read again."""
    b = D.boxes(spark, d)
    box = F.array(F.format_string('"%s"', F.lit("part")), F.col("score").cast("string"), F.concat(F.lit("["), F.concat_ws(", ", *[F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")]), F.lit("]")))
    lines = b.groupBy("image_id").agg(F.concat_ws(", ", F.array_sort(F.collect_list(F.concat(F.lit("["), F.concat_ws(", ", box), F.lit("]"))))).alias("all"))
    path = scratch(spark)
    lines.select(F.concat(F.lit('{"'), C.file_name(F.col("image_id")), F.lit('": ['), F.col("all"), F.lit("]}")).alias("value")).write.text(path)
    out = T.read_detections(spark, path)
    return out.groupBy("file").agg(F.count("*").alias("boxes"), F.round(F.sum("prob"), 6).alias("prob"), F.round(F.sum("w"), 6).alias("w"))


def class_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Parts as synsets and the orders that hold them as images, as release lines."""
    n = D.read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    lines = n.select(F.format_string('<synset wnid="n%08d" words="x" numImages="%d"/>', "l_partkey", "n").alias("value"))
    return T.class_eligibility(lines, 25, 35)


def sharded(spark: SparkSession, d: str) -> DataFrame:
    """All shards, and the fourth read alone."""
    path = scratch(spark)
    out = T.write_sharded(D.read(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand", "p_partkey"], 7, path)
    out = out.unionByName(T.read_shard(spark, path, 3).withColumn("shard", F.lit(-1).cast("bigint")))
    return out.groupBy("shard").agg(F.count("*").alias("n"), F.min("p_brand").alias("first"), F.max("p_brand").alias("last"))


def saved_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of two configurations saved one after the other and restored together."""
    path = scratch(spark)
    ranked = _evaluation(spark, d).select("config", "query_id", "rank")
    for n in (1, 2):
        T.save_ranks(ranked.where(F.col("config") == f"plain t0.0 n{n}"), path)
    return T.restore_ranks(spark, path)


def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return C.dense_ids(D.read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", name="image_id")


def threshold_scores(spark: SparkSession, d: str) -> DataFrame:
    """Squared features as dense scores."""
    v = D.features(spark, d).select("image_id", F.transform("features", lambda x: x.cast("double") * x.cast("double")).alias("scores"))
    return r6(P.threshold_scores(v, 0.01), "prob")


def threshold_report(spark: SparkSession, d: str) -> DataFrame:
    return r6(P.threshold_report(D.postings(spark, d), [0.0, 0.1, 0.25]), "mean_labels")


def quantize(spark: SparkSession, d: str) -> DataFrame:
    """Quarters of the scores in 255 steps."""
    return P.quantize(D.postings(spark, d), 255, 0.1).groupBy("prob").agg(F.count("*").alias("n"))


def invert(spark: SparkSession, d: str) -> DataFrame:
    out = P.list_lengths(P.invert(P.annotations(D.postings(spark, d))))
    return out


def label_sums(spark: SparkSession, d: str) -> DataFrame:
    return r6(P.label_sums(D.postings(spark, d)), "sum_prob")


def text_idf(spark: SparkSession, d: str) -> DataFrame:
    """Word sums over documents, whose common words are in most lists, and their weights."""
    sums = D.text_sums(spark, d).withColumnRenamed("word", "label_id")
    return r6(P.idf(settled(sums), "smoothed").withColumnRenamed("label_id", "word"), "idf")


def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return r9(P.cooccurrence(D.postings(spark, d)), "sum_xy")


def covariance(spark: SparkSession, d: str) -> DataFrame:
    return P.covariance(D.postings(spark, d)).select("label_i", "label_j", F.round(F.col("cov") * 1e6, 4).alias("cov"))


def idf(spark: SparkSession, d: str) -> DataFrame:
    sums = settled(P.label_sums(D.postings(spark, d)))
    out = None
    for mode in ("app", "smoothed", "paper"):
        one = P.idf(sums, mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return r6(out, "idf")


def image_distribution(spark: SparkSession, d: str) -> DataFrame:
    return r9(P.image_distribution(D.postings(spark, d)), "prob")


def label_positions(spark: SparkSession, d: str) -> DataFrame:
    return P.top_labels(D.postings(spark, d), 5).select("image_id", "label_id", "position")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return R.scores(settled(D.postings(spark, d)), D.queries(spark, d).drop("target_id"))


def target_ranks(spark: SparkSession, d: str) -> DataFrame:
    return R.target_ranks(settled(r6(_scored(spark, d), "score")), D.queries(spark, d).select("query_id", "target_id").distinct())


def result_status(spark: SparkSession, d: str) -> DataFrame:
    return R.result_status(D.queries(spark, d).drop("target_id"), _scored(spark, d))


def query_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Every order is a query, its parts are the labels."""
    rows = D.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (2 - F.col("l_linenumber") % 2).alias("clause_no"), F.col("l_partkey").alias("label_id"))
    return r6(L.query_lengths(rows.distinct()), "mean_labels")


def two_images(spark: SparkSession, d: str) -> DataFrame:
    """First image by clause 1, second within 5 orders by clause 2; all images that score."""
    q = D.queries(spark, d).drop("target_id")
    p = settled(D.postings(spark, d))
    one = lambda c: R.scores(p, q.where(F.col("clause_no") == c))
    return r6(R.two_image_scores(one(1), one(2), 5), "score")


def rank_two_images(spark: SparkSession, d: str) -> DataFrame:
    q = D.queries(spark, d)
    p = settled(D.postings(spark, d))
    one = lambda c: R.scores(p, q.drop("target_id").where(F.col("clause_no") == c))
    return E.rank_two_images(one(1), one(2), q.select("query_id", "target_id").distinct(), 5, digits=6)


def sliding_max(spark: SparkSession, d: str) -> DataFrame:
    """Largest of an order's price and the four after it, within its customer."""
    o = D.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.sliding_max(o, 5, ["o_custkey"], "o_orderkey", "o_totalprice")


def fused(spark: SparkSession, d: str) -> DataFrame:
    """Clause 1 and clause 2 as two modalities."""
    q = D.queries(spark, d).drop("target_id")
    p = settled(D.postings(spark, d))
    rows = None
    for c in (1, 2):
        one = R.scores(p, q.where(F.col("clause_no") == c)).withColumn("modality", F.lit(c))
        rows = one if rows is None else rows.unionByName(one)
    return r9(R.fuse(settled(rows)), "score")


def filtered_by_model(spark: SparkSession, d: str) -> DataFrame:
    q = D.queries(spark, d).drop("target_id")
    p = settled(D.postings(spark, d))
    one = lambda c: R.scores(p, q.where(F.col("clause_no") == c))
    return r6(R.filter_by_model(one(1), one(2), 0.25), "score")


def routed(spark: SparkSession, d: str) -> DataFrame:
    """Two sources: returned and other lines; even and odd queries go to one each."""
    items = D.read(spark, d, "lineitem")
    by = {n: items.where(w).groupBy(F.col("l_partkey").alias("label_id"), F.col("l_orderkey").alias("image_id")).agg((F.sum("l_quantity") / 50).alias("prob")) for n, w in (("returned", "l_returnflag = 'R'"), ("kept", "l_returnflag <> 'R'"))}
    q = D.queries(spark, d).select("query_id", F.lit(1).alias("clause_no"), "label_id").distinct().withColumn("source_name", F.when(F.col("query_id") % 200 == 0, "returned").otherwise("kept"))
    return r6(R.route(q, by, top=10), "score")


def _evaluation(spark: SparkSession, d: str) -> DataFrame:
    p = settled(D.postings(spark, d))
    q = D.one_clause(spark, d)
    targets = q.select("query_id", F.col("query_id").alias("target_id")).distinct()
    return E.rank_targets(p, q, targets, THRESHOLDS, LENGTHS, P.idf(P.label_sums(p)), digits=6)


def rank_targets(spark: SparkSession, d: str) -> DataFrame:
    return _evaluation(spark, d)


def rank_curve(spark: SparkSession, d: str) -> DataFrame:
    return r6(E.rank_curve(_evaluation(spark, d)), "percent")


def exponential_fit(spark: SparkSession, d: str) -> DataFrame:
    return r6(E.exponential_fit(_evaluation(spark, d)), "rate")


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """What a returned line's part is in its order's ranking."""
    chosen = D.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("label_id"))
    return E.chosen_positions(D.postings(spark, d), chosen)


def position_distribution(spark: SparkSession, d: str) -> DataFrame:
    return r6(E.position_distribution(_positions(spark, d)), "share")


def hit_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines' parts, beside five labels of each order drawn by their scores."""
    p = settled(r6(D.postings(spark, d), "prob"))
    drawn = S.draw_labels(p, 5, 7).select("image_id", "label_id")
    out = E.hit_histograms(_positions(spark, d), E.chosen_positions(p, drawn))
    return out.select(F.col("position").cast("int"), "hits", "top_hits", "hits_rand", "top_hits_rand")


def accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The truth is the order's smallest part."""
    p = D.postings(spark, d)
    return r6(E.accuracy(E.truth_ranks(p, p.groupBy("image_id").agg(F.min("label_id").alias("label_id"))), (1, 2, 5)), "percent")


def patch_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers are patches of an order."""
    items = D.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("patch"), F.col("l_partkey").alias("label_id")).agg(F.sum("l_quantity").alias("prob"))
    p = E.average_patches(items)
    return r6(E.accuracy(E.truth_ranks(p, p.groupBy("image_id").agg(F.min("label_id").alias("label_id"))), (1, 2, 5)), "percent")


def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.group_counts(D.read(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    e = D.read(spark, d, "events")
    return e.groupBy("event_type", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("day")).agg(F.count("*").cast("double").alias("n"))


def exponential_average(spark: SparkSession, d: str) -> DataFrame:
    return r6(E.exponential_average(_daily(spark, d), "event_type", "day", "n", 0.9), "smooth")


def box_average(spark: SparkSession, d: str) -> DataFrame:
    return r6(E.box_average(_daily(spark, d), "event_type", "day", "n"), "smooth")


def monotone_average(spark: SparkSession, d: str) -> DataFrame:
    return r6(E.monotone_average(_daily(spark, d), "event_type", "day", "n"), "smooth")


def suggest(spark: SparkSession, d: str) -> DataFrame:
    out = G.suggest(D.labels(spark, d), texts(spark))
    return r6(out, "relevance")


def suggest_children(spark: SparkSession, d: str) -> DataFrame:
    """The parts of brand 3 for the text 're'."""
    ids = D.edges(spark, d).where("parent = 2003").select(F.col("child").alias("synset_id"))
    return r6(G.suggest_children(D.labels(spark, d), ids, "re"), "relevance")


def find_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the patterns in all documents, counted by document and pattern."""
    patterns = spark.createDataFrame([("the",), ("th",), ("tion",), ("anan",), ("é",)], "pattern string")
    out = A.find_patterns(D.read(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), patterns)
    return out.groupBy("text_id", "pattern").agg(F.count("*").alias("hits"), F.min("start").alias("first"), F.sum("start").alias("total"))


def class_means(spark: SparkSession, d: str) -> DataFrame:
    out = V.class_means(D.features(spark, d))
    return r6(out.select("class_id", F.posexplode("features").alias("pos", "x")), "x")


def nearest(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest of all vectors to every query vector."""
    f = D.features(spark, d)
    q = f.where(F.col("image_id") % D.EVERY == 0).select(F.col("image_id").alias("query_id"), "image_id")
    return r6(V.nearest(q, f, 10), "distance")


def knn_rank(spark: SparkSession, d: str) -> DataFrame:
    """Two vectors a query (itself and the next), the target being the next but one."""
    f = settled(D.features(spark, d))
    ids = f.where(F.col("image_id") % D.EVERY == 0).select(F.col("image_id").alias("query_id"))
    q = ids.select("query_id", F.explode(F.array("query_id", F.col("query_id") + 1)).alias("image_id"))
    ranks, _ = V.knn_rank(q, f, ids.select("query_id", (F.col("query_id") + 2).alias("target_id")))
    return r6(ranks, "gap")


def _start(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors, targets, and for each target the ranking by its class's first vectors."""
    f = settled(D.features(spark, d))
    targets = f.where(F.col("image_id") % D.EVERY == 0).select(F.col("image_id").alias("query_id"), F.col("image_id").alias("target_id"))
    q = targets.select("query_id", ((F.col("query_id") * 7 + 13) % f.count()).alias("image_id"))
    return f, targets, settled(V.nearest(q, f, 50))


def relevance_feedback(spark: SparkSession, d: str) -> DataFrame:
    f, targets, ranking = _start(spark, d)
    return r6(V.relevance_feedback(ranking, targets, f, 50, 3, 3), "gap")


def feedback_grid(spark: SparkSession, d: str) -> DataFrame:
    f, targets, ranking = _start(spark, d)
    return V.feedback_grid(ranking, targets, f, [(20, 1), (50, 3)], 2)


def _pairs(spark: SparkSession, d: str, metric: str) -> DataFrame:
    """Every hundredth vector against all others."""
    f = D.features(spark, d).select("image_id", "features")
    return V.pairwise_distances(f.where(F.col("image_id") % D.EVERY == 0), metric, others=f)


def pairwise(spark: SparkSession, d: str) -> DataFrame:
    return r6(_pairs(spark, d, "euclidean"), "distance")


def distance_summary(spark: SparkSession, d: str) -> DataFrame:
    return r6(V.distance_summary(_pairs(spark, d, "cosine")), "least", "most")


def distance_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return r6(V.quantiles(_pairs(spark, d, "cosine"), 10), "distance")


def histogram(spark: SparkSession, d: str) -> DataFrame:
    out = V.histogram(D.read(spark, d, "orders"), "o_totalprice", 200)
    return out.select("bin", F.round("low", 4).alias("low"), "n", F.round(F.col("density") * 1e6, 6).alias("density"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Classes, seeded and clustered; where SQL can't follow the seeding, see lloyd_clusters."""
    return K.clusters(V.class_means(D.features(spark, d)), k=4, seed=42)[0]


def _rounds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All vectors, their clusters, the centres: three rounds from the first four vectors."""
    f = settled(D.features(spark, d).select("image_id", "features"))
    start = f.where("image_id < 4").select(F.col("image_id").alias("cluster"), F.transform("features", lambda x: x.cast("double")).alias("centre"))
    return f, *K.lloyd(f, settled(start), 3, "image_id")


def lloyd_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _rounds(spark, d)[1]


def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    out = K.cluster_members(_rounds(spark, d)[1], "image_id")
    return out.select("cluster", F.concat_ws(",", F.transform("classes", lambda x: x.cast("string"))).alias("members"))


def axes_places(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and centres on two axes, after five rounds of iteration."""
    f, _, centres = _rounds(spark, d)
    mean, axes = K.principal_axes(f, 2, 5, "image_id")
    rows = K.projected(f, "features", mean, axes).select(F.lit("vector").alias("kind"), F.col("image_id").alias("id"), "x", "y")
    return r6(rows.unionByName(K.projected(centres, "centre", mean, axes).select(F.lit("centre").alias("kind"), F.col("cluster").alias("id"), "x", "y")), "x", "y")


def dense_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Squared features as dense scores."""
    scores = D.features(spark, d).select(F.transform("features", lambda x: x.cast("double") * x.cast("double")).alias("scores"))
    return r9(K.gramian(scores), "sum_xy")


def top_page(spark: SparkSession, d: str) -> DataFrame:
    """The first 70 of every query, from the upper bands of long lists."""
    path = scratch(spark)
    p = settled(D.supplier_postings(spark, d))
    I.write_impacts(p, path)
    page, _ = I.top_page(spark, path, D.supplier_queries(spark, d), 70, settled(P.idf(P.label_sums(p))))
    return r6(page, "score").select("query_id", "image_id", "score", "rank")


def lists_sought(spark: SparkSession, d: str) -> DataFrame:
    """Lists by parts of the labels, and those of brand 7 sought."""
    path = scratch(spark)
    I.write_impacts(D.postings(spark, d), path)
    wanted = D.read(spark, d, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("label_id"))
    return r6(I.seek(spark, path, wanted), "prob").select("label_id", "image_id", "prob")


def nearest_by_cells(spark: SparkSession, d: str) -> DataFrame:
    f = settled(D.features(spark, d).select("image_id", "features"))
    q = f.where(F.col("image_id") % D.EVERY == 0).select(F.col("image_id").alias("query_id"), "image_id")
    return r6(N.nearest_by_cells(q, f, 10)[0], "distance")


def find_words(spark: SparkSession, d: str) -> DataFrame:
    """All words of five and six letters of the benchmark in all documents, whatever the case."""
    words = D.read(spark, d, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where("length(w) between 5 and 6").select(F.lower("w").alias("pattern")).distinct()
    out = A.find_patterns(D.read(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), words, ignore_case=True)
    return out.groupBy("pattern").agg(F.count("*").alias("hits"), F.count_distinct("text_id").alias("texts"), F.sum("start").alias("total"))


def two_images_wide(spark: SparkSession, d: str) -> DataFrame:
    """As two_images, the second image within 500 orders."""
    q = D.queries(spark, d).drop("target_id")
    p = settled(D.postings(spark, d))
    one = lambda c: R.scores(p, q.where(F.col("clause_no") == c))
    return r6(R.two_image_scores(one(1), one(2), 500), "score")


def samples_once(spark: SparkSession, d: str) -> DataFrame:
    """Samples drawn and written at first, and read after that: the second call would draw others."""
    path = scratch(spark)
    images = D.read(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    T.once(spark, path, lambda: S.sample_ids(images, 1000, 7, window=5))
    return T.once(spark, path, lambda: S.sample_ids(images, 1000, 8, window=5))


def box_corners(spark: SparkSession, d: str) -> DataFrame:
    """Line items as boxes by centre and size."""
    items = D.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1280).cast("double").alias("x"), (F.col("l_suppkey") % 720).cast("double").alias("y"), F.col("l_quantity").alias("w"), (F.col("l_tax") * 100).alias("h"))
    return r6(B.to_corners(items).select("l_orderkey", "l_linenumber", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2")


def sketched_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sketch's quantiles lie between exact ones a hundredth of the rows away."""
    pairs = _pairs(spark, d, "cosine")
    exact = V.quantiles(pairs, 100).select(F.round(F.col("share") * 100).cast("int").alias("i"), F.col("distance").alias("at"))
    found = V.sketched_quantiles(pairs, 10).select("share", "distance", F.round(F.col("share") * 100).cast("int").alias("i"))
    near = found.join(exact, (exact["i"] >= found["i"] - 1) & (exact["i"] <= found["i"] + 1)).groupBy("share", "distance").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    return near.select(F.round("share", 6).alias("share"), F.col("distance").between(F.col("low"), F.col("high")).alias("within"))


def sample_ids(spark: SparkSession, d: str) -> DataFrame:
    images = D.read(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    return S.sample_ids(images, 1000, 7, window=5)


def draw_labels(spark: SparkSession, d: str) -> DataFrame:
    return S.draw_labels(r6(D.postings(spark, d), "prob"), 3, 7)


def _distribution(spark: SparkSession, d: str) -> DataFrame:
    return settled(r6(E.position_distribution(_positions(spark, d)), "share").select("position", "share"))


def draw_positions(spark: SparkSession, d: str) -> DataFrame:
    return S.draw_positions(D.postings(spark, d), _distribution(spark, d), 3, 7)


def draw_mixed(spark: SparkSession, d: str) -> DataFrame:
    return S.draw_mixed(r6(D.postings(spark, d), "prob"), _distribution(spark, d), 3, 7)


def query_prefixes(spark: SparkSession, d: str) -> DataFrame:
    out = S.prefixes(S.draw_labels(r6(D.postings(spark, d), "prob"), 3, 7), [1, 2, 3])
    return out.groupBy("length", "draw").agg(F.count("*").alias("n"))


def split_classes(spark: SparkSession, d: str) -> DataFrame:
    part = D.read(spark, d, "part").select("p_brand", "p_partkey")
    return S.split_classes(part, "p_brand", "p_partkey", 0.2, 0.5)


def first_per_class(spark: SparkSession, d: str) -> DataFrame:
    return S.first_per_class(D.features(spark, d).select("class_id", "image_id"), "class_id", "image_id", 10)


def filter_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of quantity scales and line templates; templates 6 and 7 are not allowed at scale 0."""
    items = D.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") / 25).cast("int").alias("scale"), F.col("l_linenumber").alias("template"), (F.col("l_extendedprice") / 20000 - 2).alias("score"))
    every = items.select("scale", "template").distinct()
    allowed = every.where("scale > 0 or template < 6")
    out = B.filter_boxes(items, 0.5, B.ignored_templates(every, allowed))
    return out.groupBy("scale", "template").agg(F.count("*").alias("n"))


def decode_boxes(spark: SparkSession, d: str) -> DataFrame:
    items = D.read(spark, d, "lineitem")
    raw = items.select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 160).alias("fx"), (F.col("l_suppkey") % 90).alias("fy"), F.lit(24.0).alias("cw"), F.lit(32.0).alias("ch"), F.col("l_discount").alias("tx"), F.col("l_tax").alias("ty"), F.col("l_discount").alias("tw"), F.col("l_tax").alias("th"), (1 + F.col("l_linenumber") % 3).cast("double").alias("scale"), F.col("l_quantity").alias("score"))
    return r6(B.decode_boxes(raw), "x1", "y1", "x2", "y2")


def non_maximum_suppression(spark: SparkSession, d: str) -> DataFrame:
    return B.non_maximum_suppression(D.boxes(spark, d))


def occupancy(spark: SparkSession, d: str) -> DataFrame:
    return B.occupancy(D.boxes(spark, d))


def known_item_scores(spark: SparkSession, d: str) -> DataFrame:
    return r6(X.known_item_scores(D.submissions(spark, d), 86400.0), "score")


def ad_hoc_scores(spark: SparkSession, d: str) -> DataFrame:
    return r6(X.ad_hoc_scores(D.submissions(spark, d)), "score")


def overall_scores(spark: SparkSession, d: str) -> DataFrame:
    rounds = X.ad_hoc_scores(D.submissions(spark, d)).withColumnRenamed("task", "round")
    return r6(X.overall_scores(rounds), "score")


def sketch_scores(spark: SparkSession, d: str) -> DataFrame:
    """Line items as colour points of their order, two ellipses each of two queries."""
    items = D.read(spark, d, "lineitem")
    points = items.select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 20).cast("double").alias("px"), (F.col("l_suppkey") % 15).cast("double").alias("py"), (F.col("l_quantity") * 2).alias("l"), (F.col("l_discount") * 1000).alias("a"), (F.col("l_tax") * 1000).alias("b"))
    regions = spark.createDataFrame([(1, 1, 5.0, 5.0, 4.0, 3.0, 50.0, 40.0, 40.0, "any"), (1, 2, 12.0, 8.0, 6.0, 4.0, 80.0, 10.0, 20.0, "all"), (2, 1, 10.0, 7.0, 9.0, 6.0, 20.0, 60.0, 60.0, "all")], "query_id bigint, region_no int, cx double, cy double, rx double, ry double, l double, a double, b double, mode string")
    return r6(X.sketch_scores(points, regions), "score")


def score_images(spark: SparkSession, d: str) -> DataFrame:
    """A model given by the caller, here the sum and the largest place of each vector."""

    def load():
        import numpy as np
        import pandas as pd

        def model(frame):
            x = np.array(frame["features"].tolist(), float)
            return pd.DataFrame({"image_id": frame["image_id"], "total": x.sum(axis=1), "best": x.argmax(axis=1)})

        return model

    return r6(M.score_images(D.features(spark, d).select("image_id", "features"), load, "image_id bigint, total double, best bigint"), "total")


def percentile_clip(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.percentile_clip(D.read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 99.0), "o_totalprice")


def annotations_table(spark: SparkSession, d: str) -> DataFrame:
    """Annotations, written and read with their fixed schema."""
    path = scratch(spark)
    T.write_table(P.annotations(D.postings(spark, d)).select("image_id", F.transform("labels", lambda x: F.struct(x["label_id"].cast("int").alias("label_id"), x["prob"].cast("float").alias("prob"))).alias("labels")), path)
    out = T.read_table(spark, path, T.ANNOTATIONS)
    return out.select("image_id", F.size("labels").alias("n_labels"), F.round(F.array_max(F.transform("labels", lambda x: x["prob"].cast("double"))), 5).alias("best"))


def scores_table(spark: SparkSession, d: str) -> DataFrame:
    """Squared features as dense scores, and the features, written and read with their fixed schemas."""
    one, two = scratch(spark), scratch(spark)
    f = D.features(spark, d)
    T.write_table(f.select("image_id", F.transform("features", lambda x: (x * x).cast("float")).alias("scores")), one)
    T.write_table(f.select("image_id", F.transform("features", lambda x: x.cast("float")).alias("features")), two)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
    scores = T.read_table(spark, one, T.SCORES).select("image_id", total("scores").alias("sum_scores"))
    return scores.join(T.read_table(spark, two, T.FEATURES).select("image_id", total("features").alias("sum_features")), "image_id")


def label_sums_table(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    T.write_table(P.label_sums(D.postings(spark, d)), path)
    return r6(T.read_table(spark, path, T.LABEL_SUMS), "sum_prob")


def synset_ids_file(spark: SparkSession, d: str) -> DataFrame:
    """Parts as synset lines, every seventh spoilt, written as text and read again."""
    path = scratch(spark)
    line = F.format_string("n%08d", "p_partkey")
    D.read(spark, d, "part").select(F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("#"), line)).otherwise(line).alias("value")).write.text(path)
    return T.read_synset_ids(spark, path)


def category_mapping_file(spark: SparkSession, d: str) -> DataFrame:
    """Parts as categories with a synset, written as lines and read again."""
    path = scratch(spark)
    D.read(spark, d, "part").select(F.format_string("/p/part_%d:n%08d", "p_partkey", "p_size").alias("value")).write.text(path)
    return T.read_category_mapping(spark, path)


def listed_files(spark: SparkSession, d: str) -> DataFrame:
    """A text file for each size of parts, listed with numbers and lengths."""
    path = scratch(spark)
    part = D.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("value"), "p_size")
    # the parts of size 3 and 4 lose their texts: their files are empty
    part.repartition("p_size").write.partitionBy("p_size").text(path)
    T.emptied(spark, [f"{path}/p_size={n}" for n in (3, 4)])
    out = T.non_empty(T.list_files(spark, path))
    return out.select(F.regexp_extract("path", r"p_size=(\d+)", 1).cast("bigint").alias("p_size"), F.col("length").alias("bytes"), "image_id")


def rank_curves_file(spark: SparkSession, d: str) -> DataFrame:
    """Customers as points of four curves, written as CSV and read again."""
    path = scratch(spark)
    c = D.read(spark, d, "customer")
    c.select(*[C.rounded(F.col("c_custkey") * (i + 1) / 1000, 3).alias(f"Rank{i + 1}") for i in range(4)], C.rounded(F.col("c_acctbal") / 10000, 4).alias("Percentage")).write.option("header", True).csv(path)
    return T.read_rank_curves(spark, path)


def model_labels(spark: SparkSession, d: str) -> DataFrame:
    out = L.model_labels_only(D.labels(spark, d))
    return out.select("label_id", "synset_id", F.concat_ws(",", "names").alias("names"))


def ordered_labels(spark: SparkSession, d: str) -> DataFrame:
    """Lines as parts of their order's query, odd and even ones as clauses."""
    items = D.read(spark, d, "lineitem")
    out = L.ordered_labels(items.select(F.col("l_orderkey").alias("query_id"), (2 - F.col("l_linenumber") % 2).alias("clause_no"), F.col("l_partkey").alias("label_id"), F.col("l_linenumber").alias("position")))
    return out.select("query_id", "clause_no", "label_id", "first_position")


def postings_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Lists written by label, and those of three labels read alone."""
    path = scratch(spark)
    T.write_postings(D.postings(spark, d), path)
    return r6(T.read_postings(spark, path, [7, 50, 101]), "prob")


def shuffled(spark: SparkSession, d: str) -> DataFrame:
    return S.shuffled(D.read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


def closest_shown(spark: SparkSession, d: str) -> DataFrame:
    f, targets, ranking = _start(spark, d)
    return V.closest_shown(ranking, targets, f, 50, 3)


QUERIES = {
    f.__name__: f
    for f in (
        rank_frames, brand_query, expand_query, closure_down, closure_up, build_labels, cluster_subgraph, label_file, label_names, label_children, names_to_synsets, search_synsets,
        label_set, remap_categories, postings_file, query_log, detections_json, class_eligibility, sharded, saved_ranks, dense_ids, threshold_scores, threshold_report, quantize,
        invert, label_sums, text_idf, cooccurrence, covariance, idf, image_distribution, label_positions, target_ranks, result_status, query_lengths, two_images, rank_two_images,
        sliding_max, fused, filtered_by_model, routed, rank_targets, rank_curve, exponential_fit, position_distribution, hit_histograms, accuracy, patch_accuracy, group_counts,
        exponential_average, box_average, monotone_average, suggest, suggest_children, find_patterns, class_means, nearest, knn_rank, relevance_feedback, feedback_grid, pairwise,
        distance_summary, distance_quantiles, sketched_quantiles, histogram, clusters, lloyd_clusters, cluster_members, axes_places, dense_cooccurrence, top_page, lists_sought, nearest_by_cells,
        find_words, two_images_wide, samples_once, box_corners, sample_ids, draw_labels, draw_positions, draw_mixed, query_prefixes, split_classes,
        first_per_class, filter_boxes, decode_boxes, non_maximum_suppression, occupancy, known_item_scores, ad_hoc_scores, overall_scores, sketch_scores, score_images, percentile_clip,
        annotations_table, scores_table, label_sums_table, synset_ids_file, category_mapping_file, listed_files, rank_curves_file, model_labels, ordered_labels, postings_by_label,
        shuffled, closest_shown,
    )
}
