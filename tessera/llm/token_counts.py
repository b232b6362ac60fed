"""Token counts (operator 9): batch encoding that returns lengths only."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.encoding import byte_bpe_path, encoder, safe_pieces


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, limit: int = 512, batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row.

    A map without shuffle: the texts of one Arrow batch after another are
    regrouped into encoding batches of about batch_bytes, whatever their row
    count; texts longer than piece_chars are cut at boundaries no token crosses
    and their counts summed. Only lengths leave the worker.

    Null and empty texts have 0 tokens. Repeated rows and keys each give a row,
    null keys stay null, and further columns are not read.
    """
    path = tokenizer or byte_bpe_path()
    source = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = pa.schema([("k", pa.int64() if dict(docs.dtypes)[key] == "bigint" else pa.string()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    if schema.field("k").type == pa.string():
        source = source.withColumn("k", F.col("k").cast("string"))

    def run(batches):
        enc = encoder(path)
        # rows that wait for their last piece, with their sizes and counts so far; pieces not yet encoded, with the counts they add to
        waiting, owners, pieces, held = [], [], [], 0

        def encode():
            for (totals, i), n in zip(owners, enc.counts(pieces), strict=True):
                totals[i] += n
            owners.clear()
            pieces.clear()

        def finished():
            for keys, sizes, totals in waiting:
                yield pa.RecordBatch.from_arrays([keys, sizes, pa.array(totals, pa.int64())], schema=schema)
            waiting.clear()

        for rows in batches:
            sizes = pc.fill_null(pc.binary_length(rows.column(1)), 0).cast(pa.int64())
            totals = [0] * rows.num_rows
            for i, (value, n) in enumerate(zip(rows.column(1), sizes.to_pylist(), strict=True)):
                if not n:
                    continue
                text = value.as_py()
                for piece in safe_pieces(text, piece_chars) if enc.byte_level and len(text) > piece_chars else [text]:
                    owners.append((totals, i))
                    pieces.append(piece)
                    held += n * len(piece) // len(text)
                    if held >= batch_bytes:
                        encode()
                        held = 0
            waiting.append((rows.column(0).cast(schema.field(0).type), sizes, totals))
            if not pieces or len(waiting) >= 64:
                encode()
                held = 0
                yield from finished()
        encode()
        yield from finished()

    kind = "bigint" if schema.field("k").type == pa.int64() else "string"
    out = source.mapInArrow(run, f"k {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
