"""Near-duplicates by exact Jaccard similarity of word shingles; SimHash, then MinHash bands find the candidates.

Texts with the same set of shingles are one node, so thousands of copies cost one
row. Nodes are grouped by their SimHash fingerprints first, as operator 9 links them, and each meets the
first of its group. Edits of a text at Jaccard 0.8 turn about ten bits of 64, which no
fingerprint of that length finds, so nodes meet again where one of 24 bands of five minima agrees: a pair at Jaccard
0.8 is missed with probability (1 - 0.8^5)^24 = 7e-5, a closer one less often.
Every link is verified on the sets. In a bucket, members first meet a leader
alone, so a crowd of close copies costs few pairs; those that no link connects
yet then meet by the prefixes of their sets, which leaves out no pair that is
similar enough, and keeps a crowd of texts below the similarity apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from spotweave.llm import simhash
from spotweave.llm.batches import free_name, map_texts
from spotweave.llm.components import components
from spotweave.session import stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Rounds of leaders at most, and pairs for each bucket row that end the rounds early.
LEADER_ROUNDS = 4
PAIRS_PER_ROW = 2
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_CHUNK = 2048


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted different 64-bit hashes of the shingles; a shorter text is one shingle, none has no word."""
    found = (text or "").encode().lower().split()  # of bytes: A-Z and the six ASCII blanks alone
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    spans = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b]) for a, b in spans), np.uint64, len(found) - k + 1))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of minima of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, (hashes[i : i + _CHUNK, None] * _FACTORS + _ADDED).min(axis=0))
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[t].tobytes(), t) - (1 << 63) for t in range(BANDS)]


def _sketch(words: int):
    def work(texts: list[str | None]) -> list[pa.Array]:
        nodes, keys, prints = [], [], []
        for text in texts:
            held = shingles(text, words)
            nodes.append(xxhash.xxh3_128_digest(held.astype("<u8").tobytes()))
            keys.append(bands(held) if len(held) else [])
            prints.append(simhash.simhash(text, words))
        return [pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.int64())]

    return work


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets (node, held) have the similarity."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("held_a"), batch.column("held_b")):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                small, large = sorted((len(x), len(y)))
                if small < similarity * large:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both / (small + large - both) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    held = [sets.select(F.col("node").alias(c), F.col("held").alias(f"held_{c}")) for c in "ab"]
    # a leader has many pairs: it comes second, where rows with the other's set show its weight
    joined = pairs.join(held[0], "a").join(held[1], "b").select("a", "b", "held_a", "held_b")
    return joined.mapInArrow(task, "a binary, b binary")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, component) of two components that can have the similarity; none that has it is left out.

    Shingles are put in one order, the rarest among these nodes first. Of two sets of sizes
    m >= n with the similarity t at least one shingle is among the first m - t m + 1 of the larger and
    the first n - 2 t n / (1 + t) + 1 of the smaller one, and what follows it leaves enough for the
    overlap t (m + n) / (1 + t). Texts that share a frame and differ in the rest have their own
    shingles in front, so they don't meet.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, component, held in zip(batch.column("node"), batch.column("component"), batch.column("held")):
                own = np.frombuffer(held.as_buffer(), "<i8")
                arrays = [pa.array([v.as_py()] * len(own), pa.binary()) for v in (node, component)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(own), pa.array(np.full(len(own), len(own)))], names=["node", "component", "shingle", "m"])

    rows = stored(sets.join(nodes, "node").select("node", "component", "held").mapInArrow(spread, "node binary, component binary, shingle long, m long"), "shingles")
    often = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    # a shingle of one node only is in front, and meets nothing
    ranked = rows.join(often, "shingle").groupBy("node", "component", "m").agg(
        F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("order"), (F.col("m") - F.count("*")).alias("own")
    )
    m, own = F.col("m"), F.col("own")
    small = 1e-9
    longer = (m - F.ceil(similarity * m - small) + 1 - own).cast("int")
    shorter = (m - F.ceil(2 * similarity / (1 + similarity) * m - small) + 1 - own).cast("int")
    ranked = stored(ranked.select("node", "component", "m", "own", "order", longer.alias("longer"), shorter.alias("shorter")), "ranked")

    def prefix(size: str, tag: str) -> DataFrame:
        first = ranked.where(F.col(size) > 0).select("node", "component", "m", "own", F.slice("order.shingle", 1, F.col(size)).alias("first"))
        front = first.select("*", F.posexplode("first").alias("at", "shingle"))
        return front.select(
            "shingle", F.col("node").alias(tag), F.col("component").alias(f"component_{tag}"), F.col("m").alias(f"m_{tag}"),
            (F.col("m") - F.col("own") - F.col("at")).alias(f"left_{tag}"), F.slice("first", 1, F.col("at")).alias(f"before_{tag}"),
        )

    ordered = F.struct(F.col("m_a"), F.col("a")) > F.struct(F.col("m_b").alias("m_a"), F.col("b").alias("a"))
    enough = F.least("left_a", "left_b") >= similarity / (1 + similarity) * (F.col("m_a") + F.col("m_b")) - small
    # a pair is met once: at the first shingle that both have in front
    once = ~F.arrays_overlap("before_a", "before_b")
    met = prefix("longer", "a").join(prefix("shorter", "b"), "shingle")
    met = met.where(ordered & (F.col("m_b") >= similarity * F.col("m_a") - small) & enough & (F.col("component_a") != F.col("component_b")) & once)
    return met.select("a", "b")


def links(groups: DataFrame, texts: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """node, component of all nodes that are linked to another.

    ``groups``: node, row, bands, fp; ``texts``: row, text. The smallest node of a
    component names it.
    """
    keys = groups.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = stored(keys.join(shared, "key"), "met")
    printed = simhash.with_components(groups.select(F.col("node").alias("doc_id"), "fp"))
    tested = stored(printed.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), "print_pairs")
    several = met.select("node").union(tested.select("a")).union(tested.select("b")).distinct()
    wanted = groups.join(several, "node", "left_semi").select("node", "row")

    def sets_of(values: list[str | None]) -> list[pa.Array]:
        return [pa.array([shingles(v, words).astype("<u8").tobytes() for v in values], pa.binary())]

    sets = stored(map_texts(texts.join(wanted, "row").select("node", "text"), "text", "held binary", sets_of, keep=["node"]), "sets")
    edges = stored(_verified(tested, sets, similarity), "print_links")
    now = met.join(components(edges), "node", "left").select("node", "key", F.coalesce("component", F.col("node")).alias("component"))
    now = stored(now, "buckets")
    for turn in range(LEADER_ROUNDS):
        # a leader for each bucket by another order in each turn; members of its component are linked to it already
        leader = now.groupBy("key").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn))).alias("leader"))
        pairs = now.join(leader, "key").where(F.col("component") != F.col("leader.component"))
        pairs = stored(pairs.select(F.col("node").alias("a"), F.col("leader.node").alias("b")).distinct(), "pairs")
        found = stored(_verified(pairs, sets, similarity), "links")
        helped = 2 * found.count() >= pairs.count()
        edges, tested = edges.union(found), tested.union(pairs)
        named = components(edges)
        now = stored(
            met.join(named, "node", "left").select("node", "key", F.coalesce("component", F.col("node")).alias("component")),
            "buckets",
        )
        part = now.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("own"))
        open_keys = stored(part.where("n * n > own").select("key", ((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs")), "open")
        left = open_keys.agg(F.sum("pairs")).first()[0] or 0
        if left == 0:
            return named
        now = stored(now.join(open_keys.select("key"), "key"), "unlinked")
        if not helped or left <= PAIRS_PER_ROW * now.count():
            break
    left_over = stored(now.select("node", "component").distinct(), "left_over")
    rest = _prefix_pairs(left_over, sets, similarity)
    done = tested.union(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = rest.join(done.distinct(), ["a", "b"], "left_anti")
    return components(edges.union(stored(_verified(stored(rest, "rest"), sets, similarity), "last_links")))


def drop_near_copies(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, ...) with all columns, one of each component: the one with the smallest doc_id.

    Linked: texts whose shingles of ``words`` words have a Jaccard similarity of
    at least ``similarity``; texts without a word are alike. Of rows that repeat
    the smallest doc_id the one with the smallest node, then the smallest text
    stays. In a component without any doc_id one row stays, by the same rule. No
    rows: no rows.
    """
    node, keys, fp, row, key, none, rank = (free_name(docs, c) for c in ("node_in", "bands_in", "fp_in", "row_in", "id_key", "id_null", "rank_in"))
    made = map_texts(docs, "text", f"{node} binary, {keys} array<long>, {fp} long", _sketch(words))
    printed = stored(made.withColumn(row, F.monotonically_increasing_id()), "printed")
    rows = printed.select("doc_id", F.col(node).alias("node"), F.col(keys).alias("bands"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("first")
    groups = stored(rows.groupBy("node").agg(first, F.min_by("bands", "row").alias("bands"), F.min_by("fp", "row").alias("fp"), F.min("row").alias("row")), "groups")
    named = links(groups, printed.select(F.col(row).alias("row"), "text"), words, similarity)
    component = F.coalesce("component", F.col("node")).alias("component")
    kept = groups.join(named, "node", "left").select(component, "first", "node").groupBy("component").agg(F.min(F.struct("first", "node")).alias("kept"))
    ids = [F.coalesce("doc_id", F.lit(0)).alias(key), F.col("doc_id").isNull().alias(none)]
    stay = kept.select(F.coalesce("kept.first.id", F.lit(0)).alias(key), F.col("kept.first.none").alias(none), F.col("kept.node").alias(node))
    return (
        printed.select("*", *ids)
        .join(stay, [key, none, node], "left_semi")
        .withColumn(rank, F.row_number().over(Window.partitionBy(key, none, node).orderBy("text")))
        .where(F.col(rank) == 1)
        .select(*(F.col(f"`{c}`") for c in docs.columns))
    )
