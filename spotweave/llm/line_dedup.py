"""Removal of lines that many documents share, with DataFrame functions only.

Lines are exploded with their position, hashed, counted by distinct document
and dropped over a threshold; what stays is put together by position. Only
hashes and positions are shuffled for the count. A line found in a third of all
documents is counted before the shuffle. The lines in excess are stored before
they meet all lines again: few of them go to all tasks, and where they are too
many for that Spark splits the part of a hot one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.llm.batches import free_name
from spotweave.session import stored

#: The characters stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_CHARS = 40
MIN_DOCS = 5


def lines_of(text: Column) -> Column:
    """Lines of a text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def _hashes(value: Column, a: str, b: str) -> list[Column]:
    """Two independent 64-bit hashes: no two texts of any corpus share both."""
    return [F.xxhash64(value).alias(a), F.xxhash64(F.lit(1), value).alias(b)]


def common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(occurrences, common): long lines with hashes and place, and the hashes found in ``min_docs`` documents.

    occurrences: doc_id, t0, t1 (hashes of the whole text), pos, k0, k1 (of the
    line's key). common: k0, k1, keeper (the largest doc_id).
    """
    lines = docs.select("doc_id", *_hashes(F.coalesce("text", F.lit("")), "t0", "t1"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    # a key is no longer than its line
    keys = lines.where(F.length("line") >= min_chars).select("doc_id", "t0", "t1", "pos", line_key(F.col("line")).alias("key"))
    found = keys.where(F.length("key") >= min_chars).select("doc_id", "t0", "t1", "pos", *_hashes(F.col("key"), "k0", "k1"))
    common = (
        found.groupBy("k0", "k1")
        .agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("k0", "k1", "keeper")
    )
    return found, common


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, ...) with n_lines, n_dropped and kept_text.

    A line whose key has ``min_chars`` code points or more and occurs in
    ``min_docs`` documents or more stays only in the largest doc_id that holds
    it, there as often as it occurs. ``kept_text``: the other lines joined by
    newlines; empty if none stays.

    A null or empty text is one empty line. A null doc_id counts as no document
    and keeps no common line. Rows that repeat a doc_id count as one document.
    Columns of ``docs`` with the names of the new ones are replaced. No rows:
    no rows.
    """
    found, common = common_lines(docs, min_chars, min_docs)
    # stored: Spark knows how many they are, and can split a hot line that meets them
    common = stored(common, "common_lines")
    marked = found.join(common, ["k0", "k1"]).where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("keeper")))
    positions, key, a, b, c, d, split_lines = (
        free_name(docs, n) for n in ("drop_positions", "drop_id", "drop_t0", "drop_t1", "text_t0", "text_t1", "split_lines")
    )
    drop = (
        marked.groupBy("doc_id", "t0", "t1")
        .agg(F.collect_set("pos").alias(positions))
        .select(F.col("doc_id").alias(key), F.col("t0").alias(a), F.col("t1").alias(b), positions)
    )
    kept_columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    plain = docs.select(*kept_columns, *_hashes(F.coalesce("text", F.lit("")), c, d))
    both = plain.join(drop, plain["doc_id"].eqNullSafe(F.col(key)) & (F.col(c) == F.col(a)) & (F.col(d) == F.col(b)), "left")
    # a column of its own: inside a lambda an expression is computed again for each element
    split = both.select(*kept_columns, positions, lines_of(F.col("text")).alias(split_lines))
    lines, gone = F.col(split_lines), F.col(positions)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return split.select(
        *kept_columns,
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(gone.isNull(), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
        .alias("kept_text"),
    )
