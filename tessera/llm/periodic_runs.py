"""Periodic run detection (operator 12) by uniting suffix classes in descending order of their common prefixes.

The suffixes of a text's words are ordered by doubling, and neighbours' common
prefixes (LCP) are read off the classes of the doublings. Going down the LCPs as
Kruskal's algorithm goes through edges, classes of suffixes are united by
union-find, each class an ordered set of positions. Where uniting at an LCP of l
makes positions u < v neighbours, and their distance d is within l, the words from
u have period d for l + d words; if the word before does not carry the period on,
that is a run. A run's first position and the one a period later are neighbours
when they meet: anything between would give the run a smaller period.

Only texts with a repeated stretch of words are sorted at all: a run's words
come back a period later, at least `shortest` of them in a row.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import wordhash
from tessera.llm.common import SPACE, table

#: Positions of a block of an ordered set; buckets in which repeated stretches are looked for first.
BLOCK, BUCKET_BITS = 1024, 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS_SQL = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def shortest(min_length: int, min_exponent: int) -> int:
    """Words that any run has in common with itself one period on."""
    return min(max(min_length - d, (min_exponent - 1) * d) for d in range(1, min_length + 1))


class Positions:
    """An ordered set of numbers, in blocks."""

    __slots__ = ("blocks", "firsts", "n")

    def __init__(self, first: int):
        self.blocks, self.firsts, self.n = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The members next below and above x, which is no member."""
        b = max(0, bisect_left(self.firsts, x) - 1)
        block = self.blocks[b]
        at = bisect_left(block, x)
        above = block[at] if at < len(block) else self.firsts[b + 1] if b + 1 < len(self.blocks) else None
        return (block[at - 1] if at else None), above

    def add(self, x: int) -> None:
        b = max(0, bisect_left(self.firsts, x) - 1)
        block = self.blocks[b]
        insort(block, x)
        self.firsts[b] = block[0]
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[b : b + 1] = [block[:half], block[half:]]
            self.firsts[b : b + 1] = [block[0], block[half]]
        self.n += 1


def suffix_order(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the suffixes of x in order, and their classes by the first 1, 2, 4, ... numbers.

    Suffixes must differ before x ends. A class is named by the place of its first
    member; classes of one member are not looked at again.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    new = np.flatnonzero(np.diff(x[order], prepend=x[order[0]] - 1))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(new, np.diff(np.append(new, n)))
    levels, width = [rank.astype(np.int32)], 1
    active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(active):
        next_rank = np.where(active + width < n, rank[np.minimum(active + width, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + next_rank
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        own, at = rank[active], np.arange(len(active))
        starts = np.diff(key, prepend=key[0] - 1) != 0
        first = np.maximum.accumulate(np.where(starts, at, 0))
        first_old = np.maximum.accumulate(np.where(np.diff(own, prepend=own[0] - 1) != 0, at, 0))
        rank[active] = own + first - first_old
        width *= 2
        levels.append(rank.astype(np.int32))
        size = np.bincount(first, minlength=len(active))[first]
        active = active[size > 1]
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    return place, levels


def common_prefixes(i: np.ndarray, j: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many first numbers the suffixes at i and j share."""
    shared = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        shared += (levels[k][i + shared] == levels[k][j + shared]).astype(np.int64) << k
    return shared


def runs_of(x: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of x, in no order. x: numbers of words; texts have no number in common and each ends with one of its own."""
    place, levels = suffix_order(x)
    i, j = place[:-1], place[1:]
    least = shortest(min_length, min_exponent)
    near = levels[min(len(levels), least.bit_length()) - 1]
    some = near[i] == near[j]  # the widest class within the least prefix
    i, j = i[some], j[some]
    lcp = common_prefixes(i, j, levels)
    some = np.flatnonzero(lcp >= least)
    some = some[np.argsort(-lcp[some], kind="stable")]
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def root(p: int) -> int:
        if p not in parent:
            parent[p] = p
            sets[p] = Positions(p)
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    found = []

    def neighbours(u: int, v: int, shared: int) -> None:
        d = v - u
        if shared + d >= min_length and shared >= (min_exponent - 1) * d and (u == 0 or x[u - 1] != x[v - 1]):
            found.append((u, shared + d, d))

    for u, v, shared in zip(i[some].tolist(), j[some].tolist(), lcp[some].tolist(), strict=True):
        a, b = root(u), root(v)
        if sets[a].n < sets[b].n:
            a, b = b, a
        large, small = sets[a], list(sets.pop(b))
        parent[b] = a
        for k, p in enumerate(small):
            below, above = large.around(p)
            # neighbours of which one was in each set; no member of the small set stands between
            if below is not None and (k == 0 or small[k - 1] < below):
                neighbours(below, p, shared)
            if above is not None and (k + 1 == len(small) or small[k + 1] > above):
                neighbours(p, above, shared)
        for p in small:
            large.add(p)
    return found


def numbered(words: list[bytes], base: int) -> np.ndarray:
    """A number from base on for each different word."""
    of = {w: base + i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(of.__getitem__, words), np.int64, len(words))


def repeating(x: np.ndarray, width: int) -> np.ndarray:
    """Places of x where a stretch of `width` numbers begins that may stand elsewhere too; none is missed."""
    if len(x) < width:
        return np.zeros(0, np.int64)
    h = wordhash.shingles(x.astype(np.uint64), width)
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    some = np.flatnonzero(np.bincount(bucket, minlength=1 << BUCKET_BITS)[bucket] > 1)
    order = some[np.argsort(h[some], kind="stable")]
    same = h[order][1:] == h[order][:-1]
    return order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order


def runs_of_texts(texts: list[list[bytes]], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """Sorted runs of each text's words; texts with a repeated stretch are sorted together."""
    numbers, base = [], 0
    for words in texts:
        own = numbered(words, base)
        base += len(words) + 1
        numbers.append(np.append(own, base - 1))  # ends with a number of its own
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not numbers:
        return found
    ends = np.cumsum([len(x) for x in numbers])
    whole = np.concatenate(numbers)
    which = np.unique(np.searchsorted(ends, repeating(whole, shortest(min_length, min_exponent)), "right"))
    if not len(which):
        return found
    # numbers that are as small as there are places
    kept = np.concatenate([numbers[k] for k in which])
    starts = np.concatenate(([0], np.cumsum([len(numbers[k]) for k in which])))
    for start, length, period in sorted(runs_of(kept, min_length, min_exponent), key=lambda r: (r[0], r[2])):
        k = int(np.searchsorted(starts, start, "right")) - 1
        found[int(which[k])].append((start - int(starts[k]), length, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay, each run's first period and all outside of runs, joined by spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = 6, min_exponent: int = 4, names: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """docs (all columns) with runs (start, length, period; by start, then period) and collapsed (the text without repetitions).

    Words are what white space (ASCII) separates, numbered from 0. A run is a
    stretch whose words are the same `period` apart, of at least min_length words
    and min_exponent (2 or more) periods, that neither neighbour carries on; its
    period is the smallest it has. Collapsed texts keep each run's first period
    only, words joined by one space. Null and empty texts have no runs and an
    empty collapsed text. Each row is worked on for itself, so repeated rows give
    repeated results; an empty table gives no rows. names must not be columns of
    docs. A text of n words takes about 24 + 4 * log2(longest repetition) bytes
    a word, besides the words themselves.
    """
    columns = docs.columns
    if {n.lower() for n in names} & {c.lower() for c in columns}:
        raise ValueError(f"docs has columns {names}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            value = rows.column(len(columns))
            for a, b in wordhash.groups(value):
                texts = [t.split() for t in wordhash.raw(value, a, b)]
                runs = runs_of_texts(texts, min_length, min_exponent)
                left = [collapsed(w, r) for w, r in zip(texts, runs, strict=True)]
                held = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                yield pa.RecordBatch.from_arrays([*(rows.column(c).slice(a, b - a) for c in range(len(columns))), pa.array(held, pa.list_(RUN)), pa.array(left, pa.string())], names=[f"c{c}" for c in range(len(columns))] + ["runs", "collapsed"])

    # under plain names, so that no name clashes
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{text}`").cast("string").alias("t"))
    schema = ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes))
    out = plain.mapInArrow(run, f"{schema}, {RUNS_SQL}")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("runs").alias(names[0]), F.col("collapsed").alias(names[1]))


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text of docs, where a tenth of the texts go on with a stretch of their own words again and again.

    With h the CRC-32 of the key as text and g = h div 10, texts of n words with
    h mod 10 = 0 repeat, from word a = g mod n on, the 1 + (n - a) div (3 + g mod 8)
    words from there. Rows without a key keep their text.
    """
    h = F.crc32(F.col(key).cast("string"))
    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.floor(h / 10).alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("chosen"))
    split = chosen.withColumn("words", F.when(F.col("chosen"), F.filter(F.split("text", SPACE), lambda w: w != "")))
    n = F.size("words")
    placed = split.withColumn("a", F.when(F.col("chosen") & (n > 0), F.col("g") % n)).withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return placed.select(F.col("key").alias(key), F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias(text))


def strongest(runs: Column) -> Column:
    """The run of the greatest length over period, of equal ones the first; null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(with_planted_runs(docs)).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
#: SQL has no suffix classes; tests hold the runs against all periods tried one by one.
ORACLES: dict[str, str] = {}
