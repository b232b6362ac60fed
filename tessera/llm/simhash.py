"""SimHash near-dedup (operator 3): byte-position index with count filtering.

Two 64-bit fingerprints that differ in at most 2 bits share at least 6 of their
8 positional bytes. A posting list of a single positional byte holds one in 256
of all fingerprints, and pairs from it would grow with the square of the input.
So the index holds lists of four positional bytes: six sets of four positions,
of which any six shared positions contain one. Candidates of a list are tallied
over all 8 positions, kept from 6 shared bytes on, and verified by their bits.
A list with more than `crowd` fingerprints is not paired: there, fingerprints
meet at the values one bit away from them, where at most 65 different ones can
meet and any two that meet differ in at most 2 bits. Nothing is capped.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import wordhash
from tessera.llm.bloom import mix
from tessera.llm.common import batch, parts, stored, table
from tessera.llm.components import connected
from tessera.llm.similar import picked, similar_groups

#: Bits that linked fingerprints may differ in; the crowded lists' way is exact for 2.
MAX_BITS = 2
#: Any 6 of the 8 byte positions contain one of these sets of 4.
INDEX = [(*a, *b) for a, b in combinations([(0, 1), (2, 3), (4, 5), (6, 7)], 2)]
#: 64-bit parts of the fingerprint of single words in the near-duplicate stage.
TABLES = 16
MARKS = pa.schema([("doc_id", pa.int64()), ("raw", pa.int64()), ("text_hash", pa.int64()), ("fps", pa.list_(pa.int64())), ("mins", pa.list_(pa.int64()))])
#: 64-bit parts of the second fingerprint, of shingles: eight bytes each, every one of the smallest hash under another order.
MINS = 4
ROWS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_hash", pa.int64()), ("raw", pa.int64())])
#: Where a row without a doc_id stands among others.
LAST = (1 << 63) - 1


def fingerprint(words: list[bytes], width: int) -> bytes:
    """8 bytes: bit set if set in over half of the shingles' XXH64 (seed 42); zero without words."""
    if not words:
        return bytes(8)
    digest, n = xxhash.xxh64_digest, len(words) - width + 1
    if width == 1:
        hashes = [digest(w, 42) for w in words]
    elif n < 2:
        hashes = [digest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)]
    raw = np.frombuffer(b"".join(hashes), np.uint8)
    votes = sum((np.unpackbits(raw[i : i + (1 << 16)]).reshape(-1, 64).sum(axis=0, dtype=np.int64) for i in range(0, len(raw), 1 << 16)), np.zeros(64, np.int64))
    return np.packbits(2 * votes > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (bigint), text_hash (of the normalised words), raw (of the text as it is) of every row."""

    def run(batches):
        for rows in batches:
            fps, hashes = [], []
            for value in rows.column(1):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
                fps.append(int.from_bytes(fingerprint(words, width), "big", signed=True))
                hashes.append(int.from_bytes(xxhash.xxh3_64_digest(b" ".join(words)), "big", signed=True))
            yield batch(ROWS, {"doc_id": rows.column(0), "fp": fps, "text_hash": hashes, "raw": rows.column(2)})

    source = docs.select(F.col(key).cast("bigint"), F.col(text).cast("string"), F.xxhash64(F.col(text).cast("string")))
    return source.mapInArrow(run, "doc_id bigint, fp bigint, text_hash bigint, raw bigint")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 56 - 8 * position).bitwiseAND(F.lit(255))


def _listed(entries: DataFrame) -> DataFrame:
    """entries (t, fp and more) with the key of each of their lists that has others, and its length n."""
    keys = []
    for i, places in enumerate(INDEX):
        key = (F.col("t") * len(INDEX) + i).cast("bigint")
        for p in places:
            key = key * 256 + _byte(F.col("fp"), p)
        keys.append(key)
    index = entries.select("*", F.explode(F.array(*keys)).alias("key"))
    return index.join(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def _around(fp: str) -> Column:
    """The fingerprint and the 64 values one bit away; two that share one differ in at most 2 bits."""
    return F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col(fp).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))


def links(distinct: DataFrame, crowd: int = 64) -> DataFrame:
    """t, a, b: links of the column fp (different values) that connect all of one t that differ in at most 2 bits.

    Of lists up to crowd every such pair comes out; of larger ones enough of
    them that the same fingerprints are connected.
    """
    listed = stored(_listed(distinct.select("t", "fp")))
    cold = listed.where(F.col("n") <= crowd)
    mixed = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    shared = sum(((_byte(mixed, p) == 0).cast("int") for p in range(8)), F.lit(0))
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (shared >= 8 - MAX_BITS) & (F.bit_count(mixed) <= MAX_BITS)
    pairs = cold.alias("x").join(cold.alias("y"), near).select("x.t", F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    # dealt out before each becomes 65 rows
    hot = listed.where(F.col("n") > crowd).select("t", "fp").distinct().repartition(parts(distinct), "t", "fp")
    met = hot.select("t", "fp", F.explode(_around("fp")).alias("value"))
    first = met.groupBy("t", "value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    meets = met.join(first, ["t", "value"]).where("fp != a").select("t", "a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(meets)


def simhash_components(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable) of every row.

    Fingerprints of `width`-word shingles link at 2 or fewer differing bits;
    equal ones are one node, so copies are never expanded into pairs. Null and
    empty texts have the fingerprint zero, linked like any other. Repeated rows
    each give a row; null ids never name a component unless it has no other;
    empty tables give no rows; further columns are not read.
    """
    base = stored(fingerprints(docs, width, key, text).select("doc_id", "fp"))
    nodes = stored(base.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(nodes.select(F.lit(0).alias("t"), "fp"))).withColumnRenamed("node", "fp")
    joined = nodes.join(roots, "fp")
    smallest = joined.groupBy("root").agg(F.min("first").alias("smallest"))
    linked = stored(joined.join(smallest, "root").select("fp", "smallest"))
    labels = nodes.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"))
    return base.join(labels, "fp").select(F.col("doc_id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def document_marks(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, raw, text_hash, fps, mins of rows (doc_id, text): TABLES fingerprints of single words, MINS of shingles."""

    def run(batches):
        for part in batches:
            ids, raws = part.column(0).to_numpy(), part.column(2).to_numpy()
            for a, b in wordhash.groups(part.column(1)):
                h, n = wordhash.words_of(wordhash.raw(part.column(1), a, b))
                fps = np.packbits(2 * wordhash.votes(h, np.repeat(np.arange(b - a), n), b - a, TABLES) > n[:, None], axis=1).view(">i8").astype(np.int64)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (fps, least_bytes(h, n, width))]
                yield batch(MARKS, {"doc_id": ids[a:b], "raw": raws[a:b], "text_hash": whole_hashes(h, n), "fps": lists[0], "mins": lists[1]})

    return rows.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id bigint, raw bigint, text_hash bigint, fps array<bigint>, mins array<bigint>")


def least_bytes(h: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """[text, MINS]: bytes of the smallest shingle hashes under 8 * MINS orders; a shorter text is one shingle."""
    out = np.zeros((len(n), 8 * MINS), np.uint8)
    some = np.flatnonzero(n)
    if not len(some):
        return out.view(np.int64)
    first = (np.cumsum(n) - n)[some]
    runs = np.concatenate([wordhash.shingles(h, width), np.zeros(width - 1, np.uint64)])[: len(h)] if len(h) >= width else h.copy()
    for i in np.flatnonzero(n[some] < width):  # a short text's only shingle stands at its first word
        runs[first[i]] = wordhash.shingles(h[first[i] : first[i] + n[some[i]]], int(n[some[i]]))[0]
    inside = np.arange(len(h)) - np.repeat(first, n[some]) <= np.repeat(np.maximum(n[some] - width, 0), n[some])
    with np.errstate(over="ignore"):
        for i in range(8 * MINS):
            ordered = np.where(inside, mix(runs + np.uint64(i + 1) * np.uint64(0x9FB21C651E98DF25)), np.uint64(0xFFFFFFFFFFFFFFFF))
            out[some, i] = (np.minimum.reduceat(ordered, first) & np.uint64(255)).astype(np.uint8)
    return out.view(np.int64)


def whole_hashes(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the words of each text, in order; 0 without words."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        first = np.cumsum(n) - n
        out[some] = wordhash.sequence_hashes(h, first[some], np.arange(len(h)) - np.repeat(first, n), n[some])
    return out.view(np.int64)


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """id, payload (sorted, distinct 32-bit hashes) of rows (id, text); a shorter text is one shingle, none has none.

    Two of n shingles in about n / 2^33 of the cases share a hash, which moves a
    similarity by less than 0.0003 up to a million shingles.
    """

    def run(batches):
        for part in batches:
            for a, b in wordhash.groups(part.column(1)):
                h, n = wordhash.words_of(wordhash.raw(part.column(1), a, b))
                ends, sets = np.cumsum(n), []
                for end, size in zip(ends.tolist(), n.tolist(), strict=True):
                    own = h[end - size : end]
                    sets.append(np.unique(wordhash.shingles(own, min(words, size)).astype(np.uint32)).view(np.int32) if size else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(sets, pa.list_(pa.int32()))], names=["id", "payload"])

    return rows.select("id", "text").mapInArrow(run, "id bigint, payload array<int>")


def near_duplicate_rows(docs: DataFrame, words: int = 5, min_similarity: float = 0.8, most_bits: int = 110, least_mins: int = 16, crowd: int = 4) -> DataFrame:
    """key, raw (hash of the text) of the rows to drop so that one of each near-duplicate group stays.

    Texts of the same words are one node. Its second fingerprint has 32 positional
    bytes, of the smallest shingle hashes under 32 orders: at a similarity of 0.8
    each is shared with a probability of 0.8. The index holds lists of four
    positional bytes, eight a node, of which such a pair shares one with a
    probability of 0.985; pairs of a list are tallied over all bytes and kept from
    least_mins on (26 are expected, with a deviation of 2.3). The SimHash, over
    single words in TABLES * 8 bytes, must differ in at most most_bits of its bits
    (about 70 are expected, fewer with frequent words), and finds the centre of
    long lists. It doesn't make the lists itself: texts that repeat one word have
    equal SimHashes however unlike their shingles are. The rest are verified: the
    sets of `words`-word shingles must have a Jaccard similarity of min_similarity
    or more. Pairs that others connect already need not be tried (similar_groups).
    The smallest (doc_id, hash) of a group stays. Null and empty texts are equal
    to each other.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = stored(document_marks(rows, words))
    nodes = stored(base.groupBy(F.col("text_hash").alias("id")).agg(F.min(F.struct("doc_id", "raw")).alias("first"), F.first("fps").alias("fps"), F.first("mins").alias("mins")))
    # two lists from each part: its upper and its lower four bytes
    halves = [F.col("mins")[t].bitwiseAND(F.lit(0xFFFFFFFF)) if low else F.shiftrightunsigned(F.col("mins")[t], 32) for t in range(MINS) for low in (0, 1)]
    entries = nodes.where("id != 0").select(F.explode(F.array(*[half.bitwiseOR(F.lit(i << 32)) for i, half in enumerate(halves)])).alias("key"), "id")

    def near(x: str, y: str) -> Column:
        def mixed(c: str, parts: int) -> list[Column]:
            return [F.col(f"{x}.{c}")[t].bitwiseXOR(F.col(f"{y}.{c}")[t]) for t in range(parts)]

        shared = sum(((_byte(m, p) == 0).cast("int") for m in mixed("mins", MINS) for p in range(8)), F.lit(0))
        return (shared >= least_mins) & (sum((F.bit_count(m) for m in mixed("fps", TABLES)), F.lit(0)) <= most_bits)

    def payloads(ids: DataFrame) -> DataFrame:
        wanted = stored(nodes.join(ids, "id").select("id", F.col("first.raw").alias("raw")).groupBy("raw").agg(F.min("id").alias("id")))
        texts = picked(rows.select("text", F.xxhash64("text").alias("raw")), wanted, "raw", "inner").select("id", "text")
        return shingle_sets(texts, words).groupBy("id").agg(F.first("payload").alias("payload"))

    def alike(p: Column, q: Column) -> Column:
        common = F.size(F.array_intersect(p, q))
        sizes = F.least(F.size(p), F.size(q)) >= min_similarity * F.greatest(F.size(p), F.size(q)) - 1e-6
        return sizes & (common >= min_similarity * (F.size(p) + F.size(q) - common) - 1e-6)

    groups = similar_groups(entries, nodes.select("id", F.struct("fps", "mins", F.col("fps")[0].alias("sim")).alias("brief")), near, payloads, alike, crowd)
    joined = nodes.join(groups.withColumnRenamed("node", "id"), "id")
    kept = joined.groupBy("root").agg(F.min("first").alias("kept"))
    keep = joined.join(kept, "root").select("id", "kept")
    keep = nodes.select("id", "first").join(keep, "id", "left").select(F.col("id").alias("text_hash"), F.coalesce("kept", "first").alias("kept"))
    return base.select("doc_id", "raw", "text_hash").join(keep, "text_hash").where(F.struct("doc_id", "raw") != F.col("kept")).select(F.col("doc_id").alias("key"), "raw").distinct()


def drop_near_duplicates(docs: DataFrame, most_broadcast: int = 2_000_000, **options) -> DataFrame:
    """docs without the rows of near_duplicate_rows, all columns as they are.

    Rows that repeat doc_id and text share the decision. What goes is broadcast
    up to most_broadcast rows of 16 bytes, else joined by a shuffle.
    """
    gone = stored(near_duplicate_rows(docs, **options))
    gone = F.broadcast(gone) if gone.count() <= most_broadcast else gone
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    rows = rows.withColumn("key", F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(LAST))).withColumn("raw", F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))))
    return rows.join(gone, ["key", "raw"], "left_anti").select(*[F.col("row")[c].alias(c) for c in names])


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash_dedup": op3_simhash_dedup}
ORACLES: dict[str, str] = {}
