"""Exact histogram of encoded lengths; suffix sums answer totals, quantiles and truncated totals.

Lengths are counted in the tasks that encode, so a shuffle moves one row for
each task and length. The histogram's size depends on the longest document, not
on the number of documents. Suffix sums go in two levels, within slabs of
neighbouring lengths and over the slabs, so no task holds all lengths.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spotweave.llm.batches import map_texts
from spotweave.llm.tokens import encoder
from spotweave.session import stored

SLAB = 256


def token_lengths(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """One row for each document: n_tokens. A null or empty text has 0 tokens."""
    cache = []

    def work(texts: list[str | None]) -> list[pa.Array]:
        if not cache:
            cache.append(encoder(ranks))
        return [pa.array([len(ids) // 4 for ids in cache[0](texts)], pa.int64())]

    return map_texts(docs, "text", "n_tokens long", work, keep=[])


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs. Null lengths are left out."""
    return lengths.where(F.col("n_tokens").isNotNull()).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, slab: int = SLAB) -> DataFrame:
    """For each length that occurs, taken as the context limit L: what the documents hold there and beyond.

    ``docs_from``, ``tokens_from``: documents of L tokens or more and their
    tokens. ``truncated_tokens``: all tokens if every document is cut to L.
    ``quantile``: share of the documents with at most L tokens. For a limit
    between two rows take the next longer row r:
    truncated = r.truncated_tokens - (r.n_tokens - L) * r.docs_from (``truncated_at``).
    No rows: no rows.
    """
    h = histogram.select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / slab).alias("slab")
    )
    # a row for each slab: far fewer than lengths
    slabs = h.groupBy("slab").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    longer = Window.orderBy(F.desc("slab")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    slabs = slabs.select(
        "slab",
        F.coalesce(F.sum("d").over(longer), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(longer), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(everything).alias("all_docs"),
        F.sum("t").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("slab").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = h.join(slabs, "slab").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("docs_after")).alias("docs_from"),
        (F.sum("tokens").over(inside) + F.col("tokens_after")).alias("tokens_from"),
        "all_docs",
        "all_tokens",
    )
    return sums.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_tokens: all tokens if every document is cut to the limit, from the suffix sums alone."""
    n = F.col("n_tokens")
    at = lambda limit: F.struct(n, (F.col("truncated_tokens") - (n - limit) * F.col("docs_from")).alias("total"))
    wanted = [
        F.struct(
            F.lit(limit).cast("long").alias("limit"),
            # the next longer length; past the longest nothing is cut
            F.coalesce(F.min(F.when(n >= limit, at(limit)))["total"], F.max("truncated_tokens"), F.lit(0)).alias(
                "truncated_tokens"
            ),
        )
        for limit in limits
    ]
    return sums.agg(F.array(*wanted).alias("all")).select(F.inline("all"))


def length_quantile(sums: DataFrame, q: float) -> DataFrame:
    """n_tokens: the least length that at least a share ``q`` of the documents do not exceed."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Suffix sums over the encoded lengths of all documents.

    Every row counts, repeated ones too; null and empty texts count with 0
    tokens; other columns are not read.
    """
    # stored: it is read twice, and encoding is what costs
    return suffix_sums(stored(length_histogram(token_lengths(docs, ranks)), "histogram"))
