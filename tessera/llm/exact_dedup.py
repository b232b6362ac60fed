"""Exact dedup (operator 8) by a Golomb-coded fingerprint exchange.

Each partition sends its sorted, distinct 64-bit fingerprints to owners by hash
range, as gaps in a Golomb-Rice code; an owner answers with one bit a
fingerprint: seen elsewhere, or more than once there. Only documents with such a
fingerprint (suspects) have their text shuffled, where bytes decide.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, batch, parts, stored, table

SENT = pa.schema([("owner", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("repeated", pa.binary()), ("code", pa.binary())])
SENT_SQL = "owner int, shard int, n int, repeated binary, code binary"


def golomb_encode(values: np.ndarray, bits: int) -> bytes:
    """Sorted unsigned values as Rice-coded gaps: remainders of `bits` bits, then quotients in unary."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    quotients = (gaps >> np.uint64(bits)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    low = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - bits :]
    return np.packbits(low.ravel()).tobytes() + np.packbits(unary).tobytes()


def golomb_decode(code: bytes, n: int, bits: int) -> np.ndarray:
    """The inverse of golomb_encode."""
    raw = np.frombuffer(code, np.uint8)
    cut = (n * bits + 7) // 8
    low = np.zeros((n, 64), np.uint8)
    low[:, 64 - bits :] = np.unpackbits(raw[:cut], count=n * bits).reshape(n, bits)
    ends = np.flatnonzero(np.unpackbits(raw[cut:]))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    gaps = np.packbits(low, axis=1).view(">u8").ravel().astype(np.uint64) + (quotients.astype(np.uint64) << np.uint64(bits))
    return np.cumsum(gaps, dtype=np.uint64)


def rice_bits(n: int, span: int) -> int:
    """The remainder's width for n values spread over span."""
    return max(0, min(63, int(np.log2(max(1.0, 0.69 * span / max(1, n))))))


def exchange(hashes: DataFrame, owners: int) -> DataFrame:
    """The values of the one column (bigint) of hashes that occur in more than one row."""
    span = -(-(1 << 64) // owners)

    def send(batches):
        shard = TaskContext.get().partitionId()
        held = [np.asarray(b.column(0)).astype(np.int64).view(np.uint64) for b in batches if b.num_rows]
        if not held:
            return
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        whose = (values // np.uint64(span)).astype(np.int64)
        starts = np.flatnonzero(np.diff(whose, prepend=-1))
        out = {f.name: [] for f in SENT}
        for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
            owner = int(whose[a])
            code = golomb_encode(values[a:b] - np.uint64(owner * span), rice_bits(b - a, span))
            for name, value in zip(out, (owner, shard, int(b - a), np.packbits(counts[a:b] > 1).tobytes(), code), strict=True):
                out[name].append(value)
        yield batch(SENT, out)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        values = [golomb_decode(c, n, rice_bits(n, span)) for c, n in zip(rows["code"], rows["n"], strict=True)]
        twice = [np.unpackbits(np.frombuffer(r, np.uint8), count=n) for r, n in zip(rows["repeated"], rows["n"], strict=True)]
        every, inverse, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        seen = counts + np.bincount(inverse, weights=np.concatenate(twice), minlength=len(every)) > 1
        marks = np.split(seen[inverse], np.cumsum([len(v) for v in values])[:-1])
        return pd.DataFrame({"owner": rows["owner"], "shard": rows["shard"], "duplicate": [np.packbits(m).tobytes() for m in marks]})

    def suspects(batches):
        for b in batches:
            for owner, n, code, marks in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                values = golomb_decode(code, n, rice_bits(n, span)) + np.uint64(owner * span)
                yield pa.RecordBatch.from_arrays([pa.array(values[np.unpackbits(np.frombuffer(marks, np.uint8), count=n) > 0].view(np.int64))], names=["h"])

    sent = stored(hashes.mapInArrow(send, SENT_SQL))
    answers = sent.groupBy("owner").applyInPandas(answer, "owner int, shard int, duplicate binary")
    back = sent.join(answers, ["owner", "shard"]).select("owner", "n", "code", "duplicate")
    return back.mapInArrow(suspects, "h bigint").distinct()


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", most_broadcast: int = 2_000_000) -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal if they are after each run of white space became one space;
    null is the empty text. Of equal texts the row with the smallest key stays.
    Rows that repeat key and text count in group_size and share the decision;
    null keys sort after others and stay only where the whole group has none.
    Empty tables give no rows; further columns are not read.

    Text is read twice; only that of suspects is shuffled. Suspect fingerprints
    (8 bytes each) are broadcast up to most_broadcast of them, else joined by a
    shuffle. A group that holds a third of all rows is one row a map task after
    partial aggregation, and the joins' large sides can be split by AQE.
    """
    plain = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE, " ")
    rows = docs.select(F.col(key).alias("key"), plain.alias("plain"))
    base = stored(rows.select("key", F.xxhash64("plain").alias("h"), F.unhex(F.sha2("plain", 256)).alias("sha")))
    found = stored(exchange(base.select("h"), 4 * parts(docs)))
    hint = F.broadcast(found) if found.count() <= most_broadcast else found
    suspects = rows.withColumn("h", F.xxhash64("plain")).join(hint, "h", "left_semi")
    groups = suspects.groupBy("h", "plain").agg(F.min("key").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = stored(groups.select(F.unhex(F.sha2("plain", 256)).alias("sha"), "keep_id", "group_size"))
    keep = F.when(F.col("group_size").isNull(), F.col("key")).otherwise(F.col("keep_id"))
    return base.join(groups, "sha", "left").select(
        F.col("key").alias(key),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("key").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLES = {
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS plain FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(plain) AS text_sha256
FROM d WINDOW w AS (PARTITION BY plain)
"""
}
