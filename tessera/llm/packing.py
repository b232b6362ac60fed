"""Best-fit packing (operator 1) after a dominance reduction.

Packing depends on the lengths alone, and there are at most `capacity` different
ones. So the plan is made over the histogram of lengths, whose size is fixed
however large the corpus is, and the rows find their place in the plan by their
rank within their length. The reduction and the best fit are those of the whole
corpus, not of a partition.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, parts, stored, table
from tessera.llm.encoding import byte_bpe_path, encoder

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces.

    A document is its token ids and end_id. Those longer than capacity are cut
    into pieces of capacity, of which the first may be shorter.
    """
    path = tokenizer or byte_bpe_path()

    def run(batches):
        enc = encoder(path)
        for rows in batches:
            out = {f.name: [] for f in PIECES}
            for key, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                ids = np.append(enc.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                at = 0
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    for name, value in zip(out, (key, piece, at, stop - at, zlib.crc32(ids[at:stop].tobytes())), strict=True):
                        out[name].append(value)
                    at = stop
            yield batch(PIECES, out)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def dominance(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes sets that dominate every other set with the same largest item.

    counts[s] items of size s; it is reduced in place. Returns (sizes, copies).
    For an item j the set {j} is fixed if nothing fits beside it; {j, k} with k
    the largest that fits if it fills the bin, if no two items fit beside j, or
    if no three do and every pair that fits is no larger than k together; and
    {j, k, b} if no three fit beside j and every pair that fits is matched item
    by item by (k, b). An optimal packing with those sets exists each time.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    again = True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while counts[j] > 0:
                counts[j] -= 1  # one item j is held out; the others may go beside it
                room = capacity - j
                fits = np.flatnonzero(counts[1 : room + 1]) + 1
                chosen: tuple[int, ...] | None = None
                if not len(fits):
                    chosen = (j,)
                else:
                    k = int(fits[-1])
                    low = np.repeat(fits[:3], np.minimum(counts[fits[:3]], 3))[:3].tolist()
                    if k == room or len(low) < 2 or low[0] + low[1] > room:
                        chosen = (j, k)
                    elif len(low) < 3 or sum(low) > room:
                        pairs = [(int(x), int(y)) for x in fits for y in fits[fits <= min(x, room - x)] if x != y or counts[x] > 1]
                        if all(x + y <= k for x, y in pairs):
                            chosen = (j, k)
                        else:
                            beside = [y for x, y in pairs if x == k]
                            if beside and all(y <= max(beside) for _, y in pairs):
                                chosen = (j, k, max(beside))
                counts[j] += 1
                if chosen is None:
                    break
                # fewer items left mean fewer alternatives, so the proof holds for every copy
                copies = min(int(counts[s]) // chosen.count(s) for s in set(chosen))
                for s in chosen:
                    counts[s] -= copies
                fixed.append((chosen, copies))
                again = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing with multiplicities: (sizes, copies) of the bins.

    Bins of equal content are one entry, so that the work depends on the number
    of different lengths. An item goes to the fullest bin that it fits into.
    """
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            room = next((r for r in range(size, capacity) if open_bins.get(r)), None)
            if room is None:
                held, copies = (), left
                room = capacity
            else:
                held, copies = open_bins[room].pop()
            each = min(room // size, left)
            full = min(copies, left // each)
            left -= full * each
            open_bins.setdefault(room - each * size, []).append(((*held, *[size] * each), full))
            if room < capacity and full < copies:
                open_bins[room].append((held, copies - full))
    return [x for held in open_bins.values() for x in held if x[1]]


def pack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first_rank, count, per_bin, first_sequence, offset).

    Items of a length with ranks from first_rank on go, per_bin at a time, into
    the sequences from first_sequence on, from offset on.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    bins = dominance(counts, capacity)
    bins += best_fit(counts, capacity)
    merged: dict[tuple[int, ...], int] = {}
    for sizes, copies in bins:
        merged[sizes] = merged.get(sizes, 0) + copies
    runs, used, sequence = [], {}, 0
    for sizes, copies in merged.items():
        offset = 0
        for size in dict.fromkeys(sizes):
            each = sizes.count(size)
            runs.append((size, used.get(size, 0), copies * each, each, sequence, offset))
            used[size] = used.get(size, 0) + copies * each
            offset += each * size
        sequence += copies
    return runs


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset: each sequence holds at most capacity.

    One shuffle, of the narrow rows by range of (length, hash): a row's place in
    that order less the number of shorter rows is its rank in its length, without
    a window over a length that may hold a third of all rows. The driver sees the
    histogram (at most capacity rows) and one count a partition.

    No rows give no rows; equal rows get places of their own; lengths must be 1
    to capacity; null keys are kept.
    """
    spark = pieces.sparkSession
    n = parts(pieces)
    order = ["length", "h", "doc_id", "piece"]
    ranged = pieces.withColumn("h", F.xxhash64("doc_id", "piece")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ranged.groupBy("pid", "length").count().collect()  # a length spans neighbouring partitions: at most n + capacity rows
    histogram: dict[int, int] = {}
    held: dict[int, int] = {}
    for r in sizes:
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["count"]
        held[r["pid"]] = held.get(r["pid"], 0) + r["count"]
    before, total = [], 0
    for pid in sorted(held):
        before.append((pid, total))
        total += held[pid]
    below, shorter = {}, 0
    for length in sorted(histogram):
        below[length] = shorter
        shorter += histogram[length]
    runs = [(*r[:3], below[r[0]], *r[3:]) for r in pack_plan(histogram, capacity)]
    starts = spark.createDataFrame(before, "pid int, before bigint")
    plan = spark.createDataFrame(runs, "length bigint, first_rank bigint, n bigint, below bigint, per_bin bigint, first_sequence bigint, first_offset bigint")
    rank = F.col("before") + F.col("at") - F.col("below")
    # both small sides have a proven bound: the number of partitions; a few runs for each of capacity lengths
    placed = ranged.join(F.broadcast(starts), "pid").join(F.broadcast(plan), "length").where((rank >= F.col("first_rank")) & (rank < F.col("first_rank") + F.col("n")))
    place = rank - F.col("first_rank")
    return placed.select(
        *[c for c in pieces.columns],
        (F.col("first_sequence") + F.floor(place / F.col("per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("first_offset") + (place % F.col("per_bin")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """The pieces of docs (doc_id, text) with their place in the sequences.

    A null text is empty: its piece holds end_id alone. Further columns are not
    read, so their names can't clash.
    """
    return pack(stored(cut_pieces(docs, capacity, end_id, tokenizer)), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
ORACLES: dict[str, str] = {}
