"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as
many of the longest length as fit, then the binary digits of what is left, long
pieces first. Each piece is a sequence of its own, so no sequence crosses
documents and none is padded; batches are made within a bucket of equal length.
No shuffle is needed: a piece depends on its document alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotweave.llm.batches import slices
from spotweave.llm.tokens import encoder

#: The id after the last token of each document.
END_ID = 1
MAX_TOKENS = 2048
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def piece_lengths(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Powers of two, longest first, that add up to ``n``."""
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, ranks: str | None = None) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids``: the piece's token ids, little-endian unsigned 32-bit. ``start``:
    ids of the document before the piece. ``length`` is also the bucket.
    ``sequence_id`` is unique within one evaluation: the number of the task and
    the piece's place in it, which a repeated task makes again.

    A null or empty text is one piece with the end id alone. A null doc_id is
    kept. Repeated rows are packed once each. Other columns are left out. A very
    long text has many pieces, handled one slice at a time. No rows: no pieces.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                keys, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                rows = []
                for key, ids in zip(keys, encode(texts)):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length in piece_lengths(n, max_tokens):
                        rows.append((key, start, length, ids[4 * start : 4 * (start + length)], n))
                        start += length
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))],
                        names=["doc_id", "start", "length", "ids", "doc_tokens"],
                    )

    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, PIECES)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length; equal lengths lie together, so a batch needs no padding."""
    pieces.write.partitionBy("length").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
