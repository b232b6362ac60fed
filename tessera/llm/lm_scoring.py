"""LM scoring (operator 10): a log-frequency Bloom filter of quantised n-gram counts.

The texts are dealt into blocks. The word pairs that are learned from go, as
sorted compressed hashes with their counts, a few times a map task, to the owners
of the hash ranges. An owner builds its segment of the filter, in which a pair is
inserted once for each step of its logarithmic count, and the segments are kept
as a table: from there on no count of a pair is known. Probing one step after
another gives a pair's step back. Up to a stated number of bytes the filter is
broadcast, and the tasks that hold the texts probe it; a larger one stays with the
owners, to whom the blocks send the hashes of their pairs and who probe their
segments. The bits are the same, and so are the answers. Single words have exact
counts, which the owners return. Interpolated probabilities come from both.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import wordhash
from tessera.llm.bloom import Filter, build, mix, segment_of
from tessera.llm.common import batch, parts, stored, table
from tessera.llm.exact_dedup import golomb_decode, golomb_encode, rice_bits

#: The hash of the token that ends every text. It is also the context of a text's first word.
END = np.uint64(0x5851F42D4C957F2D)
#: Bits of a pair's fingerprint, ratio of neighbouring count steps, most steps, bits for each insertion.
HASH_BITS, RATIO, STEPS, BITS_EACH = 48, 1.5, 60, 12
#: Weight of the one-word model against a context's count.
PRIOR = 200.0
#: Bytes of text of a block, and from which a text is cut between words; bytes of text for each segment, at most.
BLOCK_BYTES, PIECE_BYTES, SEGMENT_BYTES = 1 << 23, 1 << 22, 1 << 24
#: Bytes of a filter that is broadcast, at most; pairs that a map task holds before it sends them.
MOST_BROADCAST, HELD_PAIRS = 1 << 20, 1 << 21
PAIRS, WORDS, TEXTS = 0, 1, 2
SENT = pa.schema([("block", pa.int64()), ("segment", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("code", pa.binary()), ("counts", pa.binary())])
SENT_SQL = "block bigint, segment int, kind int, n bigint, code binary, counts binary"
ANSWERS = pa.schema([("block", pa.int64()), ("segment", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("answer", pa.binary())])
ANSWERS_SQL = "block bigint, segment int, kind int, n bigint, answer binary"
SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
SCORED_SQL = "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double"
_SHIFT = np.uint64(64 - HASH_BITS)
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: What is known of a piece besides its bytes: its row, doc_id (and whether null), size, words that are context only, whether the text ends there, whether it is learned from.
META = ("row", "doc_id", "null", "size", "lead", "tail", "learn")


def packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, dtype: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype)


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(before) + word) >> _SHIFT << _SHIFT


def step_of(counts: np.ndarray) -> np.ndarray:
    """The logarithmic step of counts from 1 on."""
    return np.minimum(1 + np.floor(np.log(counts) / np.log(RATIO) + 1e-9).astype(np.int64), STEPS)


def step_values() -> np.ndarray:
    """The count that a step stands for: the mean of the counts in it; 0 for step 0."""
    edges = [int(np.ceil(RATIO**i - 1e-9)) for i in range(STEPS + 1)]
    return np.array([0.0] + [(a + max(a, b - 1)) / 2 for a, b in zip(edges, edges[1:], strict=False)])


def cut(text: bytes, most: int):
    """(bytes, lead, tail): a text in pieces that end between words, each but the first led by the word before it."""
    at, last = 0, b""
    while True:
        gap = _GAP.search(text, at + most) if len(text) - at > most else None
        part = text[at : gap.start()] if gap else text[at:]
        yield (last + b" " + part if last else part), int(bool(last)), int(gap is None)
        if gap is None:
            return
        last = (part.rsplit(None, 1) or [last])[-1]
        at = gap.start()


class Tokens:
    """The tokens of some pieces in order: hash, context's hash, piece."""

    def __init__(self, texts: list[bytes], meta: np.ndarray):
        h, n = wordhash.words_of(texts)
        lead, tail = meta[META.index("lead")], meta[META.index("tail")]
        ends = np.cumsum(n)
        flat = np.insert(h, ends[tail == 1], END)
        sizes = n + tail
        piece = np.repeat(np.arange(len(n)), sizes)
        before = np.concatenate(([END], flat[:-1]))
        own = np.ones(len(flat), bool)
        own[(np.cumsum(sizes) - sizes)[lead == 1]] = False
        self.word, self.before, self.piece = flat[own], before[own], piece[own]
        self.pair = pair_hash(self.before, self.word)
        #: The first token of each piece that has any, and the words to ask for: all, then the first tokens' contexts.
        self.first = np.flatnonzero(np.diff(self.piece, prepend=-1))
        self.asked = np.concatenate((self.word, self.before[self.first]))


def by_owner(grams: np.ndarray, segments: int):
    """(segment, a, b) of the ranges of sorted hashes that one owner has."""
    whose = segment_of(grams, segments)
    at = np.flatnonzero(np.diff(whose, prepend=-1))
    if not len(grams):
        return []
    return [(int(whose[a]), int(a), int(b)) for a, b in zip(at, [*at[1:], len(grams)], strict=True)]


def coded_pairs(pairs: np.ndarray, wide: int) -> bytes:
    """Sorted pair hashes of one owner's range as Golomb codes."""
    part = pairs >> _SHIFT
    return int(part[0]).to_bytes(8, "big") + golomb_encode(part - part[0], rice_bits(len(pairs), wide))


def decoded_pairs(code: bytes, n: int, wide: int) -> np.ndarray:
    return (golomb_decode(code[8:], n, rice_bits(n, wide)) + np.uint64(int.from_bytes(code[:8], "big"))) << _SHIFT


def range_width(segments: int) -> int:
    return -(-(1 << HASH_BITS) // segments)


def blocks(rows: DataFrame, segments: int) -> DataFrame:
    """Rows SENT of rows (doc_id, text, learn): the texts of each block, its distinct words with their counts in what is learned from, and the pairs learned from with theirs (of no block)."""
    wide = range_width(segments)

    def sent(block: int, texts: list[bytes], meta: np.ndarray, pairs: list):
        tokens = Tokens(texts, meta)
        learn = meta[META.index("learn")][tokens.piece]
        asked = np.concatenate((learn, np.zeros(len(tokens.first)))).astype(np.float64)
        out = {f.name: [] for f in SENT}

        def add(*values):
            for name, value in zip(out, values, strict=True):
                out[name].append(value)

        if len(tokens.asked):
            words, inverse = np.unique(tokens.asked, return_inverse=True)
            counts = np.bincount(inverse, weights=asked, minlength=len(words)).astype("<u4")
            for segment, a, b in by_owner(words, segments):
                add(block, segment, WORDS, b - a, words[a:b].tobytes(), packed(counts[a:b]))
        pairs.append(np.unique(tokens.pair[learn > 0], return_counts=True))
        yield batch(SENT, out)
        out = {f.name: [] for f in SENT}
        add(block, -1, TEXTS, len(texts), pa.compress(b"".join(texts), "zstd", asbytes=True), meta.astype("<i8").tobytes())
        yield batch(SENT, out)

    def learned(pairs: list):
        """The pairs gathered so far, as one row an owner."""
        values, inverse = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([c for _, c in pairs]), minlength=len(values)).astype("<u4")
        pairs.clear()
        out = {f.name: [] for f in SENT}
        for segment, a, b in by_owner(values, segments):
            for name, value in zip(out, (-1, segment, PAIRS, b - a, coded_pairs(values[a:b], wide), packed(counts[a:b])), strict=True):
                out[name].append(value)
        return batch(SENT, out)

    def run(batches):
        block = row = TaskContext.get().partitionId() << 33
        texts, meta, held, pairs = [], [], 0, []
        for part in batches:
            ids, learn = part.column(0).to_pylist(), part.column(2).to_pylist()
            for i, value in enumerate(part.column(1)):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                for text, lead, tail in cut(raw, PIECE_BYTES):
                    texts.append(text)
                    meta.append((row, ids[i] or 0, ids[i] is None, len(text), lead, tail, bool(learn[i])))
                    held += len(text) + 1
                    if held >= BLOCK_BYTES:
                        yield from sent(block, texts, np.array(meta, np.int64).T, pairs)
                        block += 1
                        texts, meta, held = [], [], 0
                        if sum(len(p) for p, _ in pairs) > HELD_PAIRS:
                            yield learned(pairs)
                row += 1
        if texts:
            yield from sent(block, texts, np.array(meta, np.int64).T, pairs)
        if pairs:
            yield learned(pairs)

    return rows.select("doc_id", "text", "learn").mapInArrow(run, SENT_SQL)


def filters(coded: DataFrame, segments: int) -> DataFrame:
    """segment, bits: the filter's segments, of the pairs learned from (rows SENT)."""
    wide = range_width(segments)

    def own(rows: pa.Table) -> pa.Table:
        sizes = rows.column("n").to_pylist()
        values = [decoded_pairs(c.as_buffer().to_pybytes(), n, wide) for n, c in zip(sizes, rows.column("code"), strict=True)]
        counts = [unpacked(c.as_buffer().to_pybytes(), n, "<u4") for n, c in zip(sizes, rows.column("counts"), strict=True)]
        every, inverse = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        return pa.table({"segment": pa.array([rows.column("segment")[0].as_py()], pa.int32()), "bits": pa.array([build(every, step_of(total), BITS_EACH, 1 << 62)])})

    return coded.groupBy("segment").applyInArrow(own, "segment int, bits binary")


def word_counts(coded: DataFrame) -> DataFrame:
    """Rows ANSWERS to coded (SENT): counts of a block's words; of each segment the sum of words and how many differ."""

    def own(rows: pa.Table) -> pa.Table:
        out = {f.name: [] for f in ANSWERS}
        segment = rows.column("segment")[0].as_py()

        def add(*values):
            for name, value in zip(out, values, strict=True):
                out[name].append(value)

        sizes = rows.column("n").to_pylist()
        values = [np.frombuffer(c.as_buffer().to_pybytes(), np.uint64) for c in rows.column("code")]
        counts = [unpacked(c.as_buffer().to_pybytes(), n, "<u4") for n, c in zip(sizes, rows.column("counts"), strict=True)]
        every, inverse = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts)).astype("<i8")
        add(None, segment, TEXTS, int(total.sum()), int((total > 0).sum()).to_bytes(8, "big"))
        ends = np.cumsum(sizes)
        for block, a, b in zip(rows.column("block").to_pylist(), ends - sizes, ends, strict=True):
            add(block, segment, WORDS, int(b - a), packed(total[inverse[a:b]]))
        return pa.Table.from_batches([batch(ANSWERS, out)])

    return coded.groupBy("segment").applyInArrow(own, ANSWERS_SQL)


def tokens_of(rows: pa.Table, i: int) -> tuple[Tokens, np.ndarray]:
    """The tokens of a block (row i of TEXTS rows) and what is known of its pieces."""
    meta = np.frombuffer(rows.column("counts")[i].as_py(), "<i8").reshape(len(META), -1)
    sizes = meta[META.index("size")]
    raw = pa.decompress(rows.column("code")[i].as_buffer(), int(sizes.sum()), "zstd", asbytes=True)
    ends = np.cumsum(sizes)
    return Tokens([raw[a:b] for a, b in zip(ends - sizes, ends, strict=True)], meta), meta


def probed(texts: DataFrame, kept: DataFrame, segments: int) -> DataFrame:
    """Rows ANSWERS: the steps of each block's pairs, from the owners of the segments (segment, bits), who get their hashes alone."""
    wide = range_width(segments)

    def ask(batches):
        for rows in batches:
            for i in range(rows.num_rows):
                pairs = np.unique(tokens_of(rows, i)[0].pair)
                out: dict[str, list] = {"block": [], "segment": [], "n": [], "code": []}
                for segment, a, b in by_owner(pairs, segments):
                    for name, value in zip(out, (rows.column("block")[i].as_py(), segment, b - a, coded_pairs(pairs[a:b], wide)), strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int64()), pa.array(out["segment"], pa.int32()), pa.array(out["n"], pa.int64()), pa.array(out["code"], pa.binary())], names=[*out])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        held = Filter(1, {0: own.column("bits")[0].as_buffer().to_pybytes()} if own.num_rows else {})
        out: dict[str, list] = {f.name: [] for f in ANSWERS}
        for i, n in enumerate(asked.column("n").to_pylist()):
            steps = held.level(decoded_pairs(asked.column("code")[i].as_buffer().to_pybytes(), n, wide), STEPS)
            for name, value in zip(out, (asked.column("block")[i].as_py(), asked.column("segment")[i].as_py(), PAIRS, n, packed(steps.astype(np.uint8))), strict=True):
                out[name].append(value)
        return pa.Table.from_batches([batch(ANSWERS, out)])

    asked = texts.select("block", "code", "counts").mapInArrow(ask, "block bigint, segment int, n bigint, code binary")
    return asked.groupBy("segment").cogroup(kept.groupBy("segment")).applyInArrow(answer, ANSWERS_SQL)


def scored(texts: DataFrame, found: DataFrame, z: float, held: Broadcast | None) -> DataFrame:
    """Rows SCORED of the pieces of each block; the steps of pairs are probed in the filter held, or among what was found."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        value_of, rows = step_values(), []
        right = right.sort_by("segment")
        for i in range(left.num_rows):
            tokens, meta = tokens_of(left, i)
            count = {}
            for kind, values, dtype in ((PAIRS, tokens.pair, "u1"), (WORDS, tokens.asked, "<i8")):
                grams, inverse = np.unique(values, return_inverse=True)
                if kind == PAIRS and held is not None:
                    count[kind] = (grams, held.value.level(grams, STEPS), inverse)
                    continue
                mine = right.filter(pc.equal(right.column("kind"), kind))
                got = [unpacked(a.as_buffer().to_pybytes(), n, dtype) for a, n in zip(mine.column("answer"), mine.column("n").to_pylist(), strict=True)]
                got = np.concatenate(got) if got else np.zeros(0, dtype)
                if len(got) != len(grams):
                    raise ValueError("the answers of a block don't fit its texts")
                count[kind] = (grams, got, inverse)
            words = count[WORDS][1][count[WORDS][2]]
            single, two = words[: len(tokens.word)], value_of[count[PAIRS][1][count[PAIRS][2]]]
            context = np.concatenate((single[:1], single[:-1]))
            context[tokens.first] = words[len(tokens.word) :]
            log = np.log10((np.minimum(two, context) + PRIOR * (single + 0.1) / z) / (context + PRIOR))
            k = meta.shape[1]
            rows.append(
                batch(
                    SCORED,
                    {
                        "row": meta[META.index("row")],
                        "doc_id": pa.array(meta[META.index("doc_id")], pa.int64(), mask=meta[META.index("null")] > 0),
                        "n_tokens": np.bincount(tokens.piece, minlength=k),
                        "n_known": np.bincount(tokens.piece, weights=single > 0, minlength=k).astype(np.int64),
                        "base": np.bincount(tokens.piece, weights=np.log10((single + 0.1) / z), minlength=k),
                        "score": np.bincount(tokens.piece, weights=log, minlength=k),
                    },
                )
            )
        return pa.Table.from_batches(rows, SCORED)

    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, SCORED_SQL)


def score(docs: DataFrame, learn: Column, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs, learned from those where learn is true.

    base_score: sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))), from
    exact counts (words are told apart by 64-bit hashes). score: the two-word
    model's log10 probability, with the one-word model as prior: pairs count as
    the filter says, whose steps are a factor of RATIO apart and never read low;
    as a step stands for its mean count, a context's pairs may add up to somewhat more than it.
    A filter of up to most_broadcast bytes is broadcast, which changes no score.
    Null is the empty text, whose one token is the end. Repeated rows and null
    keys each give a row; without rows to learn from every count is 0; long texts
    are worked on in pieces; further columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    segments = max(64, 4 * parts(docs), -(-size // SEGMENT_BYTES))
    gathered = stored(blocks(rows, segments))
    texts = gathered.where(F.col("kind") == TEXTS)
    kept = stored(filters(gathered.where(F.col("kind") == PAIRS), segments))
    found = stored(word_counts(gathered.where(F.col("kind") == WORDS)))
    number = F.conv(F.hex("answer"), 16, 10).cast("bigint")
    totals = found.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(number), F.lit(0)).alias("v")).first()
    z = totals["n"] + 0.1 * (totals["v"] + 1)
    words, held = found.where(F.col("kind") == WORDS), None
    if kept.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0] <= most_broadcast:
        held = docs.sparkSession.sparkContext.broadcast(Filter(segments, {r["segment"]: bytes(r["bits"]) for r in kept.collect()}))
    else:
        words = words.unionByName(probed(texts, kept, segments))
    pieces = scored(texts, words, z, held)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")]
    return pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums).select("doc_id", "n_tokens", "n_known", F.lit(totals["n"]).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def held_out(key: str = "doc_id", mod: int = 10, rest: int = 0):
    """Whether crc32 of the key as text leaves this remainder; not for null keys."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % mod == rest, F.lit(False))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
ORACLES: dict[str, str] = {}
