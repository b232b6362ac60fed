"""Groups of similar rows from lists of candidates, shared by the fuzzy line and near-duplicate operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.common import discard, stored
from tessera.llm.components import connected

#: Rows up to which a table of two numbers a row is broadcast.
MOST_BROADCAST = 500_000


def sized(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """df stored, and its number of rows (n) and these sums, taken while it is written instead of by jobs of their own.

    A stage that is run again may count rows twice, so these numbers choose ways
    of joining and tell whether there are rows at all; no result depends on more.
    """
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(k) for k, c in sums.items()]))
    return out, seen.get


def picked(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi", n: int | None = None) -> DataFrame:
    """rows joined with keys, which are broadcast if their number (n, where it is known) is within the bound."""
    return rows.join(F.broadcast(keys) if (keys.count() if n is None else n) <= MOST_BROADCAST else keys, on, how)


def picked_by(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """rows joined with keys, which are stored and counted first."""
    keys, seen = sized(keys)
    return picked(rows, keys, on, how, seen["n"])


def _central(hot: DataFrame) -> DataFrame:
    """key, id of the row of each list whose fingerprint is nearest to the list's majority of bits."""
    bit = [F.sum(F.getbit("sim", F.lit(i)).cast("bigint")).alias(f"s{i}") for i in range(64)]
    most = hot.groupBy("key").agg(F.count("*").alias("n"), *bit)
    whole = F.lit(0).cast("bigint")
    for i in range(64):
        whole = whole.bitwiseOR(F.when(F.col(f"s{i}") * 2 > F.col("n"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(i))).otherwise(F.lit(0).cast("bigint")))
    most = most.select("key", whole.alias("most"))
    near = F.min(F.struct(F.bit_count(F.col("sim").bitwiseXOR(F.col("most"))).alias("d"), "id")).alias("x")
    return picked_by(hot, most, "key", "inner").groupBy("key").agg(near).select("key", F.col("x.id").alias("id"))


def similar_groups(
    entries: DataFrame,
    nodes: DataFrame,
    near: Callable[[str, str], Column],
    payloads: Callable[[DataFrame], DataFrame],
    alike: Callable[[Column, Column], Column],
    crowd: int = 4,
) -> DataFrame:
    """node, root of the groups that similar nodes make.

    entries: key, id; nodes that share a key are candidates. nodes: id, brief (a
    struct with at least sim, a 64-bit fingerprint), one row each. A candidate
    pair must meet near(names of both briefs) and then alike(payloads of both);
    payloads(ids) gives id, payload of the nodes that take part.

    In lists of up to crowd rows all pairs are tried. In longer ones the member
    nearest to the list's majority fingerprint is tried against those that are in
    no longer list, which connects near copies of one text in one pass. Then heads from outside a
    list's largest group are tried against all members in other groups, 8 a list
    at first, 32 times as many in each round, until none is left untried. So every
    pair is tried that others do not connect already, and no list is paired whole
    unless its members are unlike one another.
    """
    lists = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("a != b")
    counted, lists_seen = sized(lists, hot=F.col("n") > crowd, middle=F.col("n").between(3, crowd))
    hot_keys = counted.where(F.col("n") > crowd).select("key")
    middle = picked(entries, counted.where(F.col("n").between(3, crowd)).select("key"), "key", n=lists_seen["middle"]).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    each = F.flatten(F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = counted.where("n = 2").select("a", "b").unionByName(middle.select(F.explode(each).alias("p")).select("p.a", "p.b")).distinct()
    pairs = stored(pairs)
    hot = picked(entries, hot_keys, "key", n=lists_seen["hot"]).distinct() if lists_seen["hot"] else None
    hot = hot if hot is None else stored(hot)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    # the nodes that are candidates at all, found in one pass
    some = stored(picked_by(nodes, (ids if hot is None else ids.unionByName(hot.select("id"))).distinct(), "id"))
    x, y = (some.select(F.col("id").alias(c), F.col("brief").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    pairs, before = stored(pairs.join(x, "a").join(y, "b").where(near("x", "y")).select("a", "b")), pairs
    discard(before)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    if hot is not None:
        hot, before = stored(hot.join(some, "id").select("key", "id", "brief", F.col("brief.sim").alias("sim"))), hot
        ids = ids.unionByName(hot.select("id"))
        discard(before)
    texts = stored(payloads(stored(ids.distinct())))

    def tried(pairs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        one, two = (texts.select(F.col("id").alias(c), F.col("payload").alias(n)) for c, n in (("a", "p"), ("b", "q")))
        return sized(pairs.join(one, "a").join(two, "b").where(alike(F.col("p"), F.col("q"))).select("a", "b"))

    def across(heads: DataFrame, n: int, rows: DataFrame, apart: str) -> DataFrame:
        """The pairs of n heads and others of the same list that differ in this column."""
        x = F.broadcast(heads.alias("x")) if n <= MOST_BROADCAST // 10 else heads.alias("x")
        met = (F.col("x.key") == F.col("y.key")) & (F.col(f"x.{apart}") != F.col(f"y.{apart}")) & near("x.brief", "y.brief")
        return rows.alias("y").join(x, met).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))

    if hot is None:
        return stored(connected(tried(pairs)[0]))
    heads, heads_seen = sized(picked_by(hot.drop("sim"), _central(hot), ["key", "id"]))
    # a member of several lists meets the head of the longest; what that leaves apart, the rounds try
    sizes = counted.where(F.col("n") > crowd).select("key", "n")
    longest = picked(hot.select("key", "id", "brief"), sizes, "key", "inner", lists_seen["hot"]).groupBy("id").agg(F.max(F.struct("n", "key")).alias("x"), F.first("brief").alias("brief"))
    first = across(heads, heads_seen["n"], longest.select(F.col("x.key").alias("key"), "id", "brief"), "id")
    groups = stored(connected(tried(pairs.unionByName(first).distinct())[0]))
    done, limit = None, 8
    while True:
        now = stored(hot.drop("sim").join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "brief", F.coalesce("root", "id").alias("root")))
        sizes = now.groupBy("key", "root").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all")).where(F.col("all") > F.col("most.n")).select("key", F.col("most.root").alias("largest"))
        others = picked_by(now.select("key", "id", "root"), largest, "key", "inner").where("root != largest").select("key", "id")
        others, untried = sized(others if done is None else others.join(done, ["key", "id"], "left_anti"))
        if not untried["n"]:
            discard(now, others, hot, texts, pairs, counted, some)
            return groups
        # about limit heads a list, by hash; all where there are no more
        left, seen = sized(others.groupBy("key").agg(F.count("*").alias("n")), over=F.col("n") > limit)
        last = not seen["over"]
        chosen, heads_seen = sized(picked(others, left, "key", "inner", seen["n"]).where(F.pmod(F.xxhash64("id", F.lit(limit)), "n") < limit).select("key", "id"))
        found, seen = tried(across(picked(now, chosen, ["key", "id"], n=heads_seen["n"]), heads_seen["n"], now, "root").distinct())
        discard(now, others, left)
        if seen["n"]:
            # links between groups, by their smallest nodes
            roots = groups.withColumnRenamed("node", "a")
            lifted = found.join(roots, "a", "left").select(F.coalesce("root", "a").alias("a"), "b").join(roots.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
            merged = stored(connected(lifted).select(F.col("node").alias("root"), F.col("root").alias("top")))
            raised = groups.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            before, groups = groups, stored(raised.unionByName(merged.select(F.col("root").alias("node"), F.col("top").alias("root"))).distinct())
            discard(before)
        if last:
            # none is left untried, and groups only grow
            discard(hot, texts, pairs, counted, some)
            return groups
        done = chosen if done is None else done.unionByName(chosen)
        limit *= 32
