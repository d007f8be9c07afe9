"""Packing by power-of-two decomposition.

A document's n token ids (its text's, then one end id) are cut into full windows of `window` ids and, for the rest, one
piece for each binary digit of its length, longest first. Every piece is a sequence by itself and pieces of equal length
form a bucket, so that batches need no padding and no sequence crosses documents. A null or empty text gives one piece
that holds the end id. Repeated rows are packed each. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.shared import by_bytes
from tarnweave.llm.token_counts import encoder, safe_pieces


def piece_lengths(n: int, window: int) -> list[int]:
    """Full windows, then the binary digits of the rest, longest first."""
    rest = n % window
    return [window] * (n // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start (the document's ids before it), length, ids (binary, little-endian unsigned 32-bit), doc_tokens, bucket (the binary logarithm of length), sequence_id, offset (0).

    `window` is a power of two below 2**16. sequence_id has the bucket in its upper bits, so sequences sort by bucket.
    """
    if window & (window - 1) or not 0 < window < 1 << 16:
        raise ValueError("window must be a power of two below 65536")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, may_split = encoder(vocabulary)
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 20):
                owner, start, length, ids, total = [], [], [], [], []
                for k, text in enumerate(part.column(1).cast(pa.large_string()).to_pylist()):
                    data = np.array([x for piece in (safe_pieces(text, 1 << 16) if may_split else [text]) for x in encode(piece)] + [end_id], "<u4").tobytes()
                    n, at = len(data) // 4, 0
                    for size in piece_lengths(n, window):
                        owner.append(k)
                        start.append(at)
                        length.append(size)
                        ids.append(data[4 * at : 4 * (at + size)])
                        total.append(n)
                        at += size
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())], ["id", "start", "length", "ids", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {kind}, start long, length long, ids binary, doc_tokens long")
    bucket = F.log2(F.col("length")).cast("int")
    return rows.select(
        F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", bucket.alias("bucket"),
        (F.shiftleft(bucket.cast("long"), 59) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
