"""N-gram Jaccard join (operator 11): adaptive multi-match prefixes.

A document is its set of word shingles, as 64-bit hashes in ascending order. Sets
of n shingles and a similarity of t or more share all but n - ceil(t * n) of either
set; so of the first n - ceil(t * n) + l shingles of each, they share l at least.

1. Shingles that stand in the heads (the first shingles, as many as any prefix may
   need) of over `crowd` documents are too costly as candidates' lists; they go into
   a Bloom filter of bounded size.
2. Each document lengthens its prefix, and the matches l that it requires, until l
   exceeds the costly shingles in it by as much as it wants (more for long
   prefixes). Then two similar documents share an affordable shingle, and only
   those are indexed: no list is longer than `crowd`. Pairs that share as many as
   the shorter of both prefixes requires are verified on their whole sets.
3. Documents that find no such prefix consist of crowded shingles nearly whole:
   members of large families. Against all others they are found by their affordable
   shingles, as above. Among themselves, those go first that too few other members
   share shingles with (repeatedly); what is left is ordered by its most frequent
   shingle, packed into blocks, and blocks that share a shingle of their rarest-first
   prefixes are compared as one matrix product, which returns links enough to connect
   the same documents. No family is one task or one group.

A false positive of the filter makes a shingle costly for all alike: no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.columns import dense_ids
from tessera.llm import wordhash
from tessera.llm.bloom import Filter, build, segment_of
from tessera.llm.common import discard, stored, table
from tessera.llm.components import connected
from tessera.llm.similar import picked

#: Where a row without a key stands among others.
LAST = (1 << 63) - 1
#: Part of a set that a prefix may be lengthened by, in percent, and shingles on top.
SPARE, MORE = 15, 8
#: Costly shingles in the filter at most (12 bits each); beyond, only longer lists are costly. Segments it is built in.
MOST_COSTLY, SEGMENTS = 1 << 24, 64
#: Words whose hashes a task remembers; shingles of a block of a family; columns multiplied at once.
WORDS, BLOCK_SHINGLES, COLUMNS = 500_000, 1 << 15, 4096
BASE = pa.schema([("key", pa.int64()), ("raw", pa.int64()), ("node", pa.binary()), ("n", pa.int32()), ("head", pa.list_(pa.int64()))])
PLAN = pa.schema([("node", pa.binary()), ("n", pa.int32()), ("matches", pa.int32()), ("need", pa.int32()), ("crowded", pa.bool_()), ("tokens", pa.list_(pa.int64()))])
SETS = pa.schema([("node", pa.binary()), ("tokens", pa.list_(pa.int64()))])


class WordHashes(dict):
    """XXH3 of each word, kept for a while."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Ascending hashes of the different shingles; fewer words than width are one shingle, no words none."""
    words = text.lower().split()  # ASCII case and white space
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return np.unique(wordhash.shingles(h, min(width, len(h)))) if len(h) else h


def spared(n: int, percent: int) -> int:
    """Shingles of a set of n that a similar one may lack."""
    return n + -percent * n // 100


def head_length(n: int, percent: int) -> int:
    return min(n, spared(n, percent) + -(-SPARE * n // 100) + MORE)


def most_matches(n: int, percent: int) -> int:
    """So many that a similar set's head holds a prefix for as many, too: it has percent of n shingles at least."""
    return min(n - spared(n, percent), SPARE * percent * n // 10_000 + MORE // 2)


def chosen_prefix(n: int, costly: np.ndarray, percent: int) -> tuple[int, int, int] | None:
    """(length, matches, need): need is what matches exceed the costly shingles by; None if no prefix does."""
    spare, most = spared(n, percent), most_matches(n, percent)
    matches = np.arange(1, most + 1)
    over = matches - np.cumsum(costly)[spare + matches - 1]
    for want in range(min(4, 1 + (spare + 1) // 16), 0, -1):
        at = np.flatnonzero(over >= want)
        if len(at):
            return spare + int(matches[at[0]]), int(matches[at[0]]), int(over[at[0]])
    return None


def list_column(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    value = F.col(f"`{text}`").cast("string")
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(LAST)).alias("key"), F.xxhash64(value).alias("raw"), value.alias("text"))


def heads(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """key, raw, node (hash of the set; null if empty), n, head of rows (key, raw, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in batches:
            for a, b in wordhash.groups(part.column(2)):
                sets = [shingle_set(t, width, hashes) for t in wordhash.raw(part.column(2), a, b)]
                nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                # a set that no other one can be similar to needs no head
                alone = [100 * len(s) < percent * (len(s) + 1) for s in sets]
                first = [s[: 0 if x else head_length(len(s), percent)] for s, x in zip(sets, alone, strict=True)]
                cut = [part.column(c).slice(a, b - a) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cut, pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), list_column(first)], schema=BASE)

    return rows.select("key", "raw", "text").mapInArrow(run, "key bigint, raw bigint, node binary, n int, head array<bigint>")


def sets_of(rows: DataFrame, width: int) -> DataFrame:
    """node, tokens (the whole set) of rows (key, raw, text, node), one row a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in batches:
            for a, b in wordhash.groups(part.column(1)):
                sets = [shingle_set(t, width, hashes) for t in wordhash.raw(part.column(1), a, b)]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), list_column(sets)], schema=SETS)

    return rows.select("node", "text").mapInArrow(run, "node binary, tokens array<bigint>").dropDuplicates(["node"])


def costly_shingles(base: DataFrame, crowd: int, most: int = MOST_COSTLY) -> Filter:
    """The shingles of the heads of over crowd rows, or of over a multiple of it that keeps them within most."""
    counted = stored(base.select(F.explode("head").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > crowd))
    while counted.where(F.col("c") > crowd).count() > most:
        crowd *= 2
    segment = F.shiftright(F.shiftrightunsigned("token", 32) * SEGMENTS, 32)  # as in segment_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)]).view(np.uint64)
        own = segment_of(h, SEGMENTS)
        for s in np.unique(own):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([build(h[own == s], 1, 12, 1 << 32)])], names=["segment", "bits"])

    rows = counted.where(F.col("c") > crowd).repartition(SEGMENTS, segment).select("token").mapInArrow(run, "segment int, bits binary")
    found = Filter(SEGMENTS, {r["segment"]: bytes(r["bits"]) for r in rows.collect()})  # bounded by most
    discard(counted)
    return found


def planned(base: DataFrame, costly: Filter, percent: int) -> DataFrame:
    """PLAN of each row with a head: its prefix's affordable tokens, or its head's if it is crowded."""
    shared = base.sparkSession.sparkContext.broadcast(costly)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes = rows.column(1).to_numpy()
            head = rows.column(2)
            ends = head.offsets.to_numpy() - head.offsets[0].as_py()
            flat = head.flatten().to_numpy().view(np.uint64)
            marks = shared.value.has(flat)
            out: dict[str, list] = {f.name: [] for f in PLAN}
            for i, n in enumerate(sizes.tolist()):
                tokens, mark = flat[ends[i] : ends[i + 1]], marks[ends[i] : ends[i + 1]]
                prefix = chosen_prefix(n, mark, percent)
                length, matches, need = prefix or (len(tokens), len(tokens), 1)
                for name, value in zip(("n", "matches", "need", "crowded", "tokens"), (n, matches, need, prefix is None, tokens[:length][~mark[:length]]), strict=True):
                    out[name].append(value)
            columns = [pa.array(out[f.name], f.type) for f in list(PLAN)[1:-1]]
            yield pa.RecordBatch.from_arrays([rows.column(0), *columns, list_column(out["tokens"])], schema=PLAN)

    some = base.where(F.size("head") > 0).select("node", "n", "head")
    return some.mapInArrow(run, "node binary, n int, matches int, need int, crowded boolean, tokens array<bigint>")


def fits(n: Column, m: Column, percent: int) -> Column:
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def candidates(plan: DataFrame, percent: int) -> DataFrame:
    """a, b of the nodes, not both crowded, that share as many tokens as required."""
    entries = plan.select(F.struct("node", "n", "matches", "need", "crowded").alias("x"), F.explode("tokens").alias("token"))
    # exact copies are one node; no list holds more than crowd rows
    lists = entries.groupBy("token").agg(F.collect_set("x").alias("xs")).where(F.size("xs") > 1)
    later = lambda a: F.filter("xs", lambda b: (b["node"] > a["node"]) & ~(a["crowded"] & b["crowded"]) & fits(a["n"], b["n"], percent))
    each = F.flatten(F.transform("xs", lambda a: F.transform(later(a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met = lists.select(F.explode(each).alias("p")).select("p.a", "p.b")
    need = F.when(F.col("a.matches") < F.col("b.matches"), F.col("a.need")).when(F.col("a.matches") > F.col("b.matches"), F.col("b.need")).otherwise(F.greatest("a.need", "b.need"))
    shared = met.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.count("*").alias("shared"), F.max(need).alias("need"))
    return shared.where("shared >= need").select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one, two = (sets.select(F.col("node").alias(c), F.col("tokens").alias(n)) for c, n in (("a", "p"), ("b", "q")))
    common = F.size(F.array_intersect("p", "q"))
    return pairs.join(one, "a").join(two, "b").where(common * 100 >= (F.size("p") + F.size("q") - common) * percent).select("a", "b")


def peeled(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, token: tokens that several have, of the nodes that share enough of theirs to be similar to any."""
    entries = stored(sets.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token")))
    before = None
    while True:
        common = entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
        entries, old = stored(entries.join(common, "token")), entries
        kept = stored(entries.groupBy("node", "n").agg(F.count("*").alias("c")).where(F.col("c") * 100 >= F.col("n") * percent).select("node"))
        left = kept.count()
        entries, again = stored(entries.join(kept, "node")), entries
        discard(old, again, kept)
        if before is not None and left > 0.9 * before or not left:
            return entries.select("node", "n", "token")
        before = left


def spanning(count: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Places of the links (i, j) that connect what all of them connect."""
    parent = list(range(count))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            kept.append(k)
    return kept


def block_links(sets_a: list[np.ndarray], sets_b: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets of two blocks that are similar."""
    owner = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (sets_a, sets_b)]
    values = [np.concatenate([*s, np.zeros(0, np.int64)]) for s in (sets_a, sets_b)]
    both = np.intersect1d(np.unique(values[0]), np.unique(values[1]))
    common = np.zeros((len(sets_a), len(sets_b)), np.float32)
    places = []
    for v, o in zip(values, owner, strict=True):
        at = np.minimum(np.searchsorted(both, v), max(0, len(both) - 1))
        here = both[at] == v if len(both) else np.zeros(len(v), bool)
        places.append((at[here], o[here]))
    for a in range(0, len(both), COLUMNS):
        rows = []
        for (at, o), count in zip(places, (len(sets_a), len(sets_b)), strict=True):
            own = (at >= a) & (at < a + COLUMNS)
            marks = np.zeros((count, min(COLUMNS, len(both) - a)), np.float32)
            marks[o[own], at[own] - a] = 1
            rows.append(marks)
        common += rows[0] @ rows[1].T
    n, m = (np.array([len(x) for x in s]) for s in (sets_a, sets_b))
    common = np.rint(common).astype(np.int64)
    return np.nonzero(100 * common >= percent * (n[:, None] + m[None, :] - common))


def family_links(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect all similar nodes of sets (node, tokens), which share crowded tokens."""
    entries = peeled(sets, percent)
    counted = entries.join(entries.groupBy("token").agg(F.count("*").alias("c")), "token")
    about = stored(counted.groupBy("node", "n").agg(F.count("*").alias("held"), F.max(F.struct("c", "token")).alias("top")))
    # nodes of about one length, then of one family, next to each other
    size = F.floor(F.log2(F.col("n"))).cast("int")
    numbered = stored(dense_ids(about.select("node", size.alias("size"), F.col("top.token").alias("family"), "n"), "size", "family", "n", "node", name="at"))
    starts = numbered.groupBy("size").agg(F.min("at").alias("start"))
    each = F.greatest(F.lit(16), F.floor(F.lit(BLOCK_SHINGLES) / F.pow(F.lit(2), F.col("size"))))
    block = F.struct("size", F.floor((F.col("at") - F.col("start")) / each).alias("part"))
    of = stored(numbered.join(F.broadcast(starts), "size").select("node", block.alias("block")))
    # the rarest first; what only one has is no longer there
    rank = F.row_number().over(W.partitionBy("node").orderBy("c", "token"))
    prefix = counted.join(about.select("node", "held"), "node").withColumn("rank", rank + F.col("n") - F.col("held"))
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100)
    prefix = prefix.where((F.col("rank") <= spare + 1) & (F.col("c") > 1)).select("node", "token")
    holders = prefix.join(of, "node").groupBy("token").agg(F.sort_array(F.collect_set("block")).alias("blocks")).select("blocks").distinct()
    pairs = holders.select("blocks", F.explode("blocks").alias("x")).select("x", F.explode(F.filter("blocks", lambda b: (b >= F.col("x")) & (b["size"] <= F.col("x.size") + 1))).alias("y")).distinct()
    packed = stored(sets.join(of, "node").groupBy("block").agg(F.collect_list(F.struct("node", "tokens")).alias("rows")))
    met = pairs.join(packed.select(F.col("block").alias("x"), F.col("rows").alias("p")), "x").join(packed.select(F.col("block").alias("y"), F.col("rows").alias("q")), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                nodes, held = [], []
                for c in (0, 1):
                    own = rows.column(c)[k].values
                    tokens = own.field("tokens")
                    nodes.append(own.field("node").to_pylist())
                    ends = tokens.offsets.to_numpy()
                    flat = tokens.values.to_numpy()
                    held.append([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
                i, j = block_links(*held, percent)
                every = nodes[0] + nodes[1]
                kept = spanning(len(every), i, j + len(nodes[0]))
                yield pa.RecordBatch.from_arrays([pa.array([nodes[0][i[x]] for x in kept], pa.binary()), pa.array([nodes[1][j[x]] for x in kept], pa.binary())], names=["a", "b"])

    return stored(met.select("p", "q").mapInArrow(run, "a binary, b binary").where("a != b"))


def jaccard_components(docs: DataFrame, percent: int = 90, width: int = 3, key: str = "doc_id", text: str = "text", crowd: int = 8, most_costly: int = MOST_COSTLY) -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links) of every row.

    Words are what ASCII white space separates, A-Z in lower case; shingles are
    `width` words; a text of fewer words is one shingle, one without words (null,
    empty) has none and links with nothing. Two rows link if 100 * shared shingles
    >= percent * shingles of either. Rows that repeat key and text each give a row.
    Rows without a key take part; they name a component only where no row of it
    has a key. Empty tables give no rows; further columns are not read. Shingles
    are compared by 64-bit hashes, sets by 128-bit ones.

    Documents are read and hashed once, those of candidates and families once
    more. A family of f members costs f * f / 2 products of short vectors, in
    blocks, whatever their similarity; its pairs are never rows.
    """
    rows = keyed(docs, key, text)
    base = stored(heads(rows, width, percent))
    nodes = stored(base.where("node is not null").groupBy("node").agg(F.min(F.struct("key", "raw")).alias("first")))
    plan = stored(planned(base, costly_shingles(base, crowd, most_costly), percent))

    def whole(wanted: DataFrame) -> DataFrame:
        """The sets of these nodes, from the text of the first row of each."""
        first = stored(nodes.join(wanted, "node").select("first.key", "first.raw", "node"))
        return stored(sets_of(picked(rows, first, ["key", "raw"], "inner"), width))

    pairs = stored(candidates(plan, percent))
    links = stored(verified(pairs, whole(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), percent))
    crowded = stored(plan.where("crowded").select("node").distinct())
    if not crowded.isEmpty():
        links = links.unionByName(family_links(whole(crowded), percent))
    roots = connected(links)
    joined = nodes.select("node", F.col("first.key").alias("key")).join(roots, "node")
    least = joined.groupBy("root").agg(F.min("key").alias("component"))
    linked = joined.join(least, "root").select("node", "component")
    own = nodes.select("node", F.col("first.key").alias("own")).join(linked, "node", "left").select("node", F.coalesce("component", "own").alias("component"))
    out = base.select("key", "n", "node").join(own, "node", "left")
    named = lambda c: F.when(c != LAST, c)
    return out.select(named(F.col("key")).alias(key), F.col("n").cast("bigint").alias("n_shingles"), named(F.coalesce("component", "key")).alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op11_jaccard_join": op11_jaccard_join}
ORACLES: dict[str, str] = {}
