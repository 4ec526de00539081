"""Arrow batches of documents in tasks: bounded slices, and columns added beside those that pass through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Bytes of text that a task works on at once; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20


def bound_batches(spark: SparkSession, most: int = SLICE_BYTES) -> None:
    """Batches that go to tasks from now on in this session end at ``most`` bytes, not at 10,000 rows of any length or 64 MB alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has at most ``most`` bytes in ``column``, or one row."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def hashed_share(rows: int, wanted: int, *columns: Column) -> Column:
    """True for about ``wanted`` of so many rows, by the hash of the columns; equal rows have the same answer."""
    return F.pmod(F.xxhash64(*columns, F.lit("sample")), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, wanted / max(1, rows)))


def map_texts(
    df: DataFrame, column: str, added: str, work: Callable[[list[str | None]], list[pa.Array]], keep: list[str] | None = None
) -> DataFrame:
    """Rows of ``df`` (columns ``keep``, or all) with columns ``added`` (DDL) made from the texts, slice by slice.

    ``work`` gets the texts of a slice and returns one array for each added column.
    """
    keep = df.columns if keep is None else keep
    fields = T._parse_datatype_string(added).fields
    names = keep + [f.name for f in fields]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    # a text that is kept goes to the task once
    text = column if column in keep else free_name(df, "text_in")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = work(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, names=names)

    sent = [df[f"`{c}`"] for c in keep] + ([] if text == column else [df[f"`{column}`"].alias(text)])
    return df.select(*sent).mapInArrow(task, schema)
