"""Near-duplicates by SimHash: fingerprints of word shingles, linked at few differing bits.

Equal fingerprints are grouped first, so thousands of copies cost one row. Two
fingerprints that differ in at most two bits agree on two of four blocks of 16
bits (pigeonhole), so they meet in a join on one of six block pairs; the join
then verifies the distance. Where many fingerprints share a block pair, all
pairs would be too many: there, each fingerprint is listed under itself and its
64 neighbours at one bit. All under one such key differ in at most two bits from
each other, and any two that do share a key, so a star to the smallest of them
loses no link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from spotweave.llm.batches import free_name, map_texts
from spotweave.llm.components import components
from spotweave.session import stored

#: Words of a shingle, seed of the hash, differing bits that link.
SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 2
BLOCK_BITS = 16
#: Fingerprints on a block pair that are joined pair by pair; more go the other way.
PAIRED = 24
_CHUNK = 1 << 15


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a text as a signed 64-bit integer: bit j is 1 if over half of the shingles' hashes have it."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six ASCII blanks alone
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], HASH_SEED) for a, b in spans), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp for each row of ``docs`` (doc_id, text); no text or no word: fingerprint 0."""

    def work(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([simhash(t) for t in texts], pa.int64())]

    return map_texts(docs.select("doc_id", "text"), "text", "fp long", work, keep=["doc_id"])


def _masks() -> list[int]:
    block = (1 << BLOCK_BITS) - 1
    pairs = [(block << BLOCK_BITS * i) | (block << BLOCK_BITS * j) for i, j in combinations(range(64 // BLOCK_BITS), 2)]
    return [m - (1 << 64) if m >> 63 else m for m in pairs]


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) of distinct fingerprints (fp) that connect exactly those within two bits of each other.

    Where more than ``paired`` fingerprints share a block pair the edges are stars
    with the same components, not all pairs.
    """
    blocks = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(_masks())))
    keys = prints.select("fp", F.inline(blocks))
    shared = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(keys.join(shared, ["t", "key"]), "blocks")
    few = met.where(F.col("n") <= paired)
    pairs = (
        few.select("t", "key", F.col("fp").alias("a"))
        .join(few.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
        .select("a", "b")
    )
    many = met.where(F.col("n") > paired).select("fp").distinct()
    flips = [0] + [1 << j if j < 63 else -(1 << 63) for j in range(64)]
    near = many.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(z)) for z in flips))).alias("z"))
    least = near.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("z", "b")
    stars = near.join(least, "z").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs`` (doc_id, text, ...).

    component_id: the smallest doc_id reachable over links, the row's own
    included. Rows without a word all have fingerprint 0 and are linked like any
    other. A null doc_id gets a fingerprint and the component of its links; it is
    never the smallest, and a component without any doc_id has null. Repeated rows
    stay, with equal results. Other columns are left out. No rows: no rows.
    """
    return with_components(stored(fingerprints(docs), "prints")).select("doc_id", "fp", "component_id")


def with_components(prints: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fp) with component (its smallest fingerprint) and component_id."""
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    nodes = components(links(groups.select("fp")))
    named = stored(
        groups.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first", F.coalesce("component", "fp").alias("component")
        ),
        "named",
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return prints.join(named.drop("first").join(least, "component"), "fp")


def hex_print(fp: str) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with all its columns, one of each component: the one with the smallest doc_id.

    Of rows that repeat that doc_id the one with the smallest fingerprint, then
    the smallest text stays. In a component without any doc_id one row stays, by
    the same rule.
    """
    fp, key, none = (free_name(docs, c) for c in ("fp", "id_key", "id_null"))
    printed = stored(map_texts(docs, "text", f"{fp} long", lambda texts: [pa.array([simhash(t) for t in texts], pa.int64())]), "printed")
    found = with_components(stored(printed.select("doc_id", F.col(fp).alias("fp")), "prints"))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("kept"))
    ids = [F.coalesce("doc_id", F.lit(0)).alias(key), F.col("doc_id").isNull().alias(none)]
    kept = first.select("kept.*").select(*ids, F.col("fp").alias(fp))
    once = Window.partitionBy(key, none, fp).orderBy("text")
    rank = free_name(docs, "rank_in")
    return (
        printed.select("*", *ids)
        .join(kept, [key, none, fp], "left_semi")
        .withColumn(rank, F.row_number().over(once))
        .where(F.col(rank) == 1)
        .select(*(F.col(f"`{c}`") for c in docs.columns))
    )
