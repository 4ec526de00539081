"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

Rows without text, id, language or source, repeated rows and empty tables go
through all stages: a null or empty text is kept by the classifier, is one empty line, is a near
copy of other texts without words (one stays), and packs to its end token. A
null doc_id never is the one that a group keeps while another row has one. Columns beside those of documents
pass unchanged, whatever their names. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.llm import line_dedup, mixing, near_copies, packing, quality_lm
from spotweave.llm.batches import bound_batches
from spotweave.session import scratch_group, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(fn: Stage) -> Stage:
    """A stage whose intermediate results last until the next stage begins: then its own result has been written."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)  # for the rest of the session: the result is computed after the stage returns
        with scratch_group(spark, "corpus-stage"):
            return fn(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text doesn't reject."""
    return quality_lm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of at least 0.8."""
    return near_copies.drop_near_copies(docs)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents, so that all sources weigh the same, in random order."""
    return mixing.mix(docs, mixing.repetition_rates(docs)).select(*(F.col(f"`{c}`") for c in docs.columns))


@stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with a checksum of their token ids."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", sequences),
]

#: The hashes and token ids of the stages have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = scratch_path(spark, name.replace(" ", "_"))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
