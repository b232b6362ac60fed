"""Suffix-array dedup (operator 6): removes 50-byte strings seen in earlier documents.

1. Each window of `length` bytes has an anchor, the smallest hash of its k-byte
   parts, so that equal windows have equal anchors. Tasks send their anchors as
   compressed hash lists to owners of hash ranges; an owner keeps those of more
   than one document in a filter of bounded size.
2. The stretches of text whose anchor is in the filter go to the anchor's group.
   There, in blocks of whole groups, a suffix array is built by two-stage sorting: only suffixes smaller than
   their successors are sorted directly, the rest are induced by scanning the
   buckets; adjacent common prefixes of `length` bytes give equal windows, and
   the smallest doc_id of each.
3. Anchors of more than `crowd` stretches are not grouped: their windows meet by
   an aggregation that collapses copies before the shuffle.
A false positive of a filter only sends a stretch further than needed.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bloom import Filter, build, mix, segment_of
from tessera.llm.common import batch, parts, stored, table
from tessera.llm.exact_dedup import golomb_decode, golomb_encode, rice_bits
from tessera.llm.wordhash import BLOCK, groups, powers, raw

#: Bytes of the parts that anchors are chosen from; bits of an anchor; windows in a stretch at most.
PART, ANCHOR_BITS, STRETCH = 20, 48, 256
#: Bounds of the two filters together, in bits, and bytes sorted at a time.
MOST_FILTER_BITS, BLOCK_BYTES = 1 << 29, 1 << 20
#: Bytes of stretches that a task holds before it packs them.
FLUSH_BYTES = 18 << 20
#: Bytes of texts whose anchors are found at once.
GROUP = 1 << 18
#: A value of each byte, for the hashes of windows.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
#: A row is a stretch of a crowded anchor, or (with bucket) the packed stretches of a range of the others.
STRETCHES = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])
STRETCHES_SQL = "bucket int, doc_id bigint, start bigint, bytes binary"
RUNS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
RUNS_SQL = "doc_id bigint, start bigint, n bigint"
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
OUT_SQL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def window_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte window, from running sums of bytes times powers; anchors need no more than equal hashes of equal windows."""
    n = len(text) - k + 1
    out = np.empty(max(n, 0), np.uint64)
    up, down = powers(min(BLOCK, max(n, 1)) + k)
    with np.errstate(over="ignore"):
        for a in range(0, n, BLOCK):
            part = _BYTES[text[a : a + BLOCK + k - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            m = len(part) - k + 1
            out[a : a + m] = mix((sums[k:] - sums[:-k]) * down[:m])
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner (number of the text), start, end and anchor of the runs of windows with one anchor, of all texts at once."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = np.frombuffer(b"".join(texts), np.uint8)
    n = len(joined) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = min(PART, length)
    low = sliding_min(window_hashes(joined, k), length - k + 1)
    low = low >> np.uint64(64 - ANCHOR_BITS) << np.uint64(64 - ANCHOR_BITS)
    change = np.concatenate(([True], low[1:] != low[:-1]))
    # windows that begin in one text and end in another are runs of their own, and go
    begin, some = np.cumsum(sizes) - sizes, sizes >= length
    last = (begin + sizes - length + 1)[some]
    change[begin[some]] = True
    change[last[last < n]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n)
    owner = np.searchsorted(begin, starts, "right") - 1
    own = starts - begin[owner] <= sizes[owner] - length
    starts, ends, owner = starts[own], ends[own], owner[own]
    # mixed again: as minima they would crowd the low ranges
    h = mix(low[starts]) >> np.uint64(64 - ANCHOR_BITS) << np.uint64(64 - ANCHOR_BITS)
    return owner, starts - begin[owner], ends - begin[owner], h


def utf8(value: pa.Scalar) -> bytes:
    buffer = value.as_buffer() if value.is_valid else None
    return buffer.to_pybytes() if buffer else b""


def shared_anchors(docs: DataFrame, length: int, crowd: int) -> tuple[Filter, Filter]:
    """Filters of the anchors of more than one document, and of those with more than crowd stretches of up to STRETCH windows."""
    owners = 4 * parts(docs)
    span = -(-(1 << ANCHOR_BITS) // owners)
    shift = np.uint64(64 - ANCHOR_BITS)

    def send(batches):
        held, stretches = [], []
        for b in batches:
            for i, j in groups(b.column(0), GROUP):
                owner, starts, ends, h = anchors(raw(b.column(0), i, j), length)
                # an anchor once a text, with its stretches
                order = np.lexsort((h, owner))
                own, of = h[order] >> shift, owner[order]
                first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (of[1:] != of[:-1]))))[: len(own)]
                held.append(own[first])
                stretches.append(np.add.reduceat(-(-(ends - starts)[order] // STRETCH), first) if len(own) else own.astype(np.int64))
        if not held:
            return
        values, inverse, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        pieces = np.bincount(inverse, weights=np.concatenate(stretches)).astype(np.int64)
        whose = (values // np.uint64(span)).astype(np.int64)
        at = np.flatnonzero(np.diff(whose, prepend=-1))
        for a, b in zip(at, [*at[1:], len(values)], strict=True):
            owner = int(whose[a])
            code = golomb_encode(values[a:b] - np.uint64(owner * span), rice_bits(b - a, span))
            many = np.flatnonzero((counts[a:b] > 1) | (pieces[a:b] > 1))
            more = np.concatenate([many, counts[a:b][many], pieces[a:b][many]]).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int32()), pa.array([b - a], pa.int32()), pa.array([code]), pa.array([more])], names=["owner", "n", "code", "more"])

    def own(rows):
        values, counts = [], []
        for n, code, more in zip(rows["n"], rows["code"], rows["more"], strict=True):
            values.append(golomb_decode(code, n, rice_bits(n, span)))
            c = np.ones((2, n), np.int64)
            many = np.frombuffer(more, "<u4").reshape(3, -1)
            c[:, many[0]] = many[1:]
            counts.append(c)
        every, inverse = np.unique(np.concatenate(values), return_inverse=True)
        total, pieces = (np.bincount(inverse, weights=c) for c in np.concatenate(counts, axis=1))
        h = every + np.uint64(int(rows["owner"].iloc[0]) * span) << shift
        import pandas as pd

        out = [(level, part, build(x, 1, 16, MOST_FILTER_BITS // (2 * owners))) for level, which in (("shared", total > 1), ("hot", (total > 1) & (pieces > crowd))) for part, x in by_segment(h[which], owners)]
        return pd.DataFrame(out, columns=["kind", "segment", "bits"])

    sent = docs.where("doc_id is not null").select("text").mapInArrow(send, "owner int, n int, code binary, more binary")
    rows = sent.groupBy("owner").applyInPandas(own, "kind string, segment int, bits binary").collect()  # at most MOST_FILTER_BITS
    found = {"shared": {}, "hot": {}}
    for r in rows:
        found[r["kind"]].setdefault(r["segment"], []).append(bytes(r["bits"]))
    return tuple(Filter(owners, {k: merged(v) for k, v in found[kind].items()}) for kind in ("shared", "hot"))


def by_segment(h: np.ndarray, segments: int):
    where = segment_of(h, segments)
    for part in np.unique(where):
        yield int(part), h[where == part]


def merged(held: list[bytes]) -> bytes:
    """Filters of one segment, of which owners at the range's edges may have built two, as one of the larger size."""
    size = max(map(len, held))
    out = np.zeros(size, np.uint8)
    for x in held:
        out |= np.tile(np.frombuffer(x, np.uint8), size // len(x))
    return out.tobytes()


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes at least, by two-stage sorting.

    text ends in a byte smaller than all others. A suffix is smaller than its
    successor (type S) if its first byte is, or on equal bytes if the successor
    is of that type. Those are sorted directly; each other one is appended to
    its byte's bucket when the scan meets its successor.
    """
    n = len(text)
    small = np.zeros(n, bool)
    change = np.flatnonzero(text[:-1] != text[1:])
    if len(change):
        # a byte takes the type of the last one of its run of equal bytes
        run = np.searchsorted(change, np.arange(n - 1))
        inside = run < len(change)
        last = change[np.minimum(run, len(change) - 1)]
        small[:-1] = inside & (text[last] < text[last + 1])
    small[-1] = True
    direct = np.flatnonzero(small)
    words = np.zeros(n + depth + 8, np.uint64)
    words[:n] = text
    for bits in (8, 16, 32):
        words[: -(bits // 8)] = words[: -(bits // 8)] << np.uint64(bits) | words[bits // 8 :]
    order = direct[np.argsort(words[direct], kind="stable")]
    for at in range(8, depth, 8):  # refine what is still equal
        key = words[order + at - 8] if at == 8 else None
        if at == 8:
            group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        tied = np.concatenate((group[1:] == group[:-1], [False]))
        tied[1:] |= group[1:] == group[:-1]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        part, own = order[where], group[where]
        part = part[np.lexsort((words[part + at], own))]
        order[where] = part
        key = np.zeros(len(order), np.uint64)
        key[where] = words[part + at]
        group = np.concatenate(([0], np.cumsum((group[1:] != group[:-1]) | (key[1:] != key[:-1]))))
    heads = text[order]
    direct_of = np.split(order, np.searchsorted(heads, np.arange(1, 256)))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(met: np.ndarray, head: int) -> np.ndarray:
        """Sends the larger predecessors of met to their buckets; returns those of this one."""
        before = met[met > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return before
        first = text[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        cuts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        own = before[:0]
        for a, b in zip(cuts, [*cuts[1:], len(before)], strict=True):
            if first[a] == head:
                own = before[a:b]
            else:
                induced[first[a]].append(before[a:b])
        return own

    for head in range(256):
        met = np.concatenate(induced[head]) if induced[head] else direct[:0]
        while len(met):  # those with a smaller successor first, then runs of this byte, longer by one each time
            out.append(met)
            met = induce(met, head)
        if len(direct_of[head]):
            out.append(direct_of[head])
            induce(direct_of[head], head)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def first_docs(stretches: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each stretch the smallest doc of each of its windows among these stretches.

    docs[i] is the smallest doc with stretch i. Bytes are raised by one so that a
    zero byte can end each stretch; 255 and 254 become one for the order alone.
    """
    joined = b"\0".join(stretches) + b"\0"
    raw = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ends = begin + sizes
    text = np.minimum(raw, 254) + np.uint8(1)
    text[ends] = 0
    order = suffix_order(text, length)
    valid = np.zeros(len(raw), bool)
    counts = sizes - length + 1
    starts = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    valid[starts] = True
    order = order[valid[order]]
    # adjacent common prefixes, as far as `length`
    words = np.zeros(len(raw) + length + 8, np.uint64)
    words[: len(raw)] = raw
    for bits in (8, 16, 32):
        words[: -(bits // 8)] = words[: -(bits // 8)] << np.uint64(bits) | words[bits // 8 :]
    same = np.ones(max(0, len(order) - 1), bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        w = words[order + at]
        same &= w[1:] == w[:-1]
    owner = np.repeat(np.arange(len(stretches)), counts)
    own = np.zeros(len(raw), np.int64)
    own[starts] = docs[owner]
    cuts = np.flatnonzero(np.concatenate(([True], ~same)))
    smallest = np.minimum.reduceat(own[order], cuts)
    own[order] = np.repeat(smallest, np.diff(np.append(cuts, len(order))))
    return np.split(own[starts], np.cumsum(counts)[:-1])


def removed_runs(first: np.ndarray, doc: int, start: int) -> list[tuple[int, int]]:
    """(start, windows) of the runs of windows with a smaller doc."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], first < doc, [0])).astype(np.int8)))
    return [(start + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def packed(h: np.ndarray, docs: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> bytes:
    """Stretches as one compressed blob, by anchor, so that copies lie together."""
    order = np.argsort(h, kind="stable")
    columns = [h[order], docs[order], starts[order], np.fromiter(map(len, texts), np.int64, len(texts))[order]]
    raw = len(h).to_bytes(8, "little") + b"".join(c.tobytes() for c in columns) + b"".join([texts[i] for i in order])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    h, docs, starts, sizes = (np.frombuffer(raw, np.int64, n, 8 + 8 * n * i) for i in range(4))
    ends = (8 + 32 * n + np.cumsum(sizes)).tolist()
    return h.view(np.uint64), docs, starts, [raw[b - size : b] for b, size in zip(ends, sizes.tolist(), strict=True)]


def solve(h: np.ndarray, docs: np.ndarray, starts: np.ndarray, texts: list[bytes], length: int) -> pa.RecordBatch:
    """The windows to remove among stretches that hold whole anchor groups."""
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    uid = np.fromiter(map(ids.__getitem__, texts), np.int64, len(texts))
    different = list(ids)
    least = np.full(len(different), np.iinfo(np.int64).max)
    np.minimum.at(least, uid, docs)
    windows = np.fromiter(map(len, different), np.int64, len(different)) - length + 1
    anchor = np.zeros(len(different), np.uint64)
    anchor[uid] = h  # equal stretches have equal anchors
    _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[group] > 1)
    low, high, firsts = least.copy(), least.copy(), {}
    if len(several):
        solved = first_docs([different[i] for i in several], least[several], length)
        firsts = dict(zip(several.tolist(), solved, strict=True))
        low[several] = [x.min() for x in solved]
        high[several] = [x.max() for x in solved]
    whole = high[uid] < docs
    partly = np.flatnonzero(~whole & (low[uid] < docs))
    out = {"doc_id": docs[whole].tolist(), "start": starts[whole].tolist(), "n": windows[uid[whole]].tolist()}
    for i in partly.tolist():
        for a, n in removed_runs(firsts[int(uid[i])], int(docs[i]), int(starts[i])):
            out["doc_id"].append(int(docs[i]))
            out["start"].append(a)
            out["n"].append(n)
    return batch(RUNS, out)


def cold_runs(stretches: DataFrame, length: int) -> DataFrame:
    """doc_id, start, n: runs of windows to remove, by suffix arrays of whole anchor groups."""

    def bucket(blobs: list[bytes]):
        parts_ = [unpacked(b) for b in blobs]
        h, docs, starts = (np.concatenate([p[i] for p in parts_]) for i in range(3))
        texts = [t for p in parts_ for t in p[3]]
        order = np.argsort(h, kind="stable")
        ordered = h[order]
        edges = np.append(np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))), len(order))
        size = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))[order] + 1)))
        at = 0
        while at < len(edges) - 1:  # whole groups, up to BLOCK_BYTES at a time
            stop = max(at + 1, int(np.searchsorted(size[edges], size[edges[at]] + BLOCK_BYTES, "right")) - 1)
            own = order[edges[at] : edges[stop]]
            yield solve(h[own], docs[own], starts[own], [texts[i] for i in own], length)
            at = stop

    def run(batches):
        held, last = [], None
        for b in batches:
            for number, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if number != last and held:
                    yield from bucket(held)
                    held = []
                last = number
                held.append(blob.as_py())
        if held:
            yield from bucket(held)

    dealt = stretches.where("bucket is not null").select("bucket", "bytes").repartition(parts(stretches), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, RUNS_SQL)


def hot_runs(stretches: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many documents, by aggregation: equal stretches, then equal windows."""
    hot = stretches.where("bucket is null").select("doc_id", "start", "bytes")
    different = hot.groupBy("bytes").agg(F.min("doc_id").alias("doc"))
    at = different.select("bytes", "doc", F.explode(F.sequence(F.lit(1), F.length("bytes") - length + 1)).alias("i"))
    windows = at.select("bytes", "doc", "i", F.substring(F.col("bytes"), F.col("i"), F.lit(length)).alias("window"))
    least = windows.groupBy("window").agg(F.min("doc").alias("first"))
    solved = windows.join(least, "window").groupBy("bytes").agg(F.collect_list(F.struct("i", "first")).alias("firsts"))
    smaller = F.array_sort(F.transform(F.filter("firsts", lambda x: x["first"] < F.col("doc_id")), lambda x: x["i"]))
    met = hot.join(solved, "bytes").select("doc_id", "start", smaller.alias("places")).where(F.size("places") > 0)

    def runs(batches):
        for b in batches:
            out = {f.name: [] for f in RUNS}
            for doc, start, places in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                at = np.array(places)
                cuts = np.flatnonzero(np.diff(at, prepend=at[0] - 2) > 1)
                out["doc_id"] += [doc] * len(cuts)
                out["start"] += (start + at[cuts] - 1).tolist()
                out["n"] += np.diff(np.append(cuts, len(at))).tolist()
            yield batch(RUNS, out)

    return met.mapInArrow(runs, RUNS_SQL)


def removed_windows(docs: DataFrame, length: int = 50, crowd: int = 20_000) -> DataFrame:
    """doc_id, start, n: the windows of docs (doc_id, text) that start in a document with a smaller doc_id too."""
    shared, hot = shared_anchors(docs, length, crowd)
    sent = docs.sparkSession.sparkContext.broadcast((shared, hot))

    buckets = 4 * parts(docs)

    def cut(batches):
        shared, hot = sent.value
        cold: list[tuple] = []
        size = 0

        def flush():
            to, h, docs, starts = (np.concatenate([c[i] for c in cold]) for i in range(4))
            texts = [x for c in cold for x in c[4]]
            order = np.argsort(to, kind="stable")
            at = np.flatnonzero(np.diff(to[order], prepend=-1))
            owns = [order[a:b] for a, b in zip(at, [*at[1:], len(order)], strict=True)]
            none = [None] * len(owns)
            blobs = [packed(h[own], docs[own], starts[own], [texts[i] for i in own.tolist()]) for own in owns]
            return batch(STRETCHES, {"bucket": to[order[at]], "doc_id": none, "start": none, "bytes": blobs})

        for rows in batches:
            ids = rows.column(0).to_numpy()
            for i, j in groups(rows.column(1), GROUP):
                texts = raw(rows.column(1), i, j)
                owner, starts, ends, h = anchors(texts, length)
                chosen = np.flatnonzero(shared.has(h))
                # stretches of at most STRETCH windows
                pieces = -(-(ends - starts)[chosen] // STRETCH)
                of = np.repeat(chosen, pieces)
                starts = starts[of] + STRETCH * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                ends = np.minimum(starts + STRETCH, ends[of]) + length - 1
                crowded, h, owner = np.repeat(hot.has(h[chosen]), pieces), h[of], owner[of]
                docs, found = ids[i + owner], [texts[t][a:b] for t, a, b in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True)]
                if crowded.any():
                    which = np.flatnonzero(crowded)
                    yield batch(STRETCHES, {"bucket": [None] * len(which), "doc_id": docs[which], "start": starts[which], "bytes": [found[x] for x in which.tolist()]})
                    rest = np.flatnonzero(~crowded)
                    h, docs, starts, ends, found = h[rest], docs[rest], starts[rest], ends[rest], [found[x] for x in rest.tolist()]
                if len(found):
                    cold.append((segment_of(h, buckets), h, docs, starts, found))
                    size += sum(map(len, found))
                if size > FLUSH_BYTES:
                    yield flush()
                    cold, size = [], 0
        if size:
            yield flush()

    stretches = stored(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(cut, STRETCHES_SQL))
    return cold_runs(stretches, length).unionByName(hot_runs(stretches, length))


def dedup(docs: DataFrame, length: int = 50, crowd: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null is the empty text; texts under `length` bytes lose nothing; rows that
    share a doc_id do not remove each other's bytes; rows without a doc_id lose
    nothing and remove nothing; an empty table gives no rows; further columns
    are not read.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    runs = removed_windows(plain, length, crowd)
    runs = runs.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))

    def squeeze(batches):
        press = zstandard.ZstdCompressor(level=1)
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([press.compress(utf8(x)) for x in rows.column(1)], pa.binary())], names=["doc_id", "text"])

    def finish(batches):
        press = zstandard.ZstdDecompressor()
        for rows in batches:
            out = {f.name: [] for f in OUT}
            for i, value in enumerate(rows.column(1)):
                text = press.decompress(value.as_py())
                starts, ns = (np.array(rows.column(c)[i].as_py() or [], np.int64) for c in (2, 3))
                delta = np.zeros(len(text) + 1, np.int64)
                np.add.at(delta, starts, 1)
                np.add.at(delta, starts + ns + length - 1, -1)
                gone = np.cumsum(delta)[: len(text)] > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(starts) else text
                row = (rows.column(0)[i].as_py(), len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum()), hashlib.sha256(kept).hexdigest())
                for name, x in zip(out, row, strict=True):
                    out[name].append(x)
            yield batch(OUT, out)

    # texts cross the shuffle to their runs compressed
    small = plain.mapInArrow(squeeze, "doc_id bigint, text binary")
    return small.join(runs, "doc_id", "left").select("doc_id", "text", "starts", "ns").mapInArrow(finish, OUT_SQL)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op6_suffix_array_dedup": op6_suffix_array_dedup}
ORACLES: dict[str, str] = {}
