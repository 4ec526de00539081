"""How the word counts of sources differ, by hash-consed segment trees over term ids.

The kept terms of a language are dealt to segments of at most about ``SEGMENT``
ids, terms of like frequency together. In a segment each source has a binary
tree over the term ids whose leaves are its counts. Trees are hash-consed: equal
subtrees are one node, whichever source or place they come from, so the many
stretches that a source hasn't used are a single node on each level. Two trees
are priced by walking both at once; a pair of nodes that was met before is not
walked again, its price is taken as often as it occurs. The sums of the
segments are added in Spark. All arithmetic is of integers and exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spotweave.llm.batches import slices
from spotweave.llm.terms import splitter
from spotweave.session import stored

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
#: Term ids of a segment, about.
SEGMENT = 2048
#: Sources of a language that meet in a task: two blocks of so many. More sources make more tasks.
BLOCK = 64
#: Terms held in a task before their counts are handed on.
HELD = 400_000
#: Node pairs that are walked together.
WALK = 1 << 20
split = splitter(digits=False)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: occurrences and documents (rows) by term; null lang, source: ''.

    Counted in the tasks, so a very frequent term leaves a task as one row for each
    of its groups. Every group has one more row, of a null term with count 0.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = defaultdict(lambda: (Counter(), Counter())), 0

        def rows() -> pa.RecordBatch:
            lang, source, terms, counts, n_docs = [], [], [], [], []
            for (a, b), (times, in_docs) in found.items():
                lang += [a] * (len(times) + 1)
                source += [b] * (len(times) + 1)
                terms += [None, *times]
                counts += [0, *times.values()]
                n_docs += [0, *(in_docs[t] for t in times)]
            arrays = [
                pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array(counts, pa.int64()), pa.array(n_docs, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "count", "docs"])

        for batch in batches:
            for part in slices(batch, "text"):
                for text, lang, source in zip(*(part.column(c).to_pylist() for c in ("text", "lang", "source"))):
                    times, in_docs = found[lang, source]
                    words = split(text)
                    before = len(times)
                    times.update(words)
                    in_docs.update(set(words))
                    held += len(times) - before
                    if held > HELD:
                        yield rows()
                        found.clear()
                        held = 0
        if found:
            yield rows()

    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("text").cast("binary").alias("text"),
    )
    made = texts.mapInArrow(task, "lang string, source string, term string, count long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def smoothed(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact at any count."""
    wide = [c.cast("decimal(20,0)") for c in (count + 1, total + terms)]
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide[0], wide[1])


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


# trees ----------------------------------------------------------------------------------------------------------------


def cons(counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hash-consed trees of the rows of ``counts`` (width a power of two).

    (root of each row, children of the nodes of each level from the top, count of
    each leaf node). A node of a level is a number; equal subtrees have the same.
    """
    leaves, nodes = np.unique(counts, return_inverse=True)
    nodes = nodes.reshape(counts.shape)
    levels = []
    while nodes.shape[1] > 1:
        width = int(nodes.max()) + 1
        keys, nodes_flat = np.unique(nodes[:, 0::2].astype(np.int64) * width + nodes[:, 1::2], return_inverse=True)
        levels.append(np.stack([keys // width, keys % width], axis=1))
        nodes = nodes_flat.reshape(len(counts), -1)
    return nodes[:, 0], levels[::-1], leaves


def price(a: np.ndarray, b: np.ndarray, totals: np.ndarray, n_terms: int, trees) -> tuple[np.ndarray, np.ndarray]:
    """Sums of both gaps, of row a[i] against row b[i] and the other way round, over the leaves of two trees.

    Both trees are walked at once from the top. On each level equal pairs of
    nodes of the same two rows are one; on the way back each has its price.
    """
    roots, levels, leaves = trees
    pair, left, right = np.arange(len(a)), roots[a].astype(np.int64), roots[b].astype(np.int64)
    back = []
    for children in levels:
        width = int(children.max()) + 1
        keys = [(pair * width + children[left, side]) * width + children[right, side] for side in (0, 1)]
        met, at = np.unique(np.concatenate(keys), return_inverse=True)
        back.append(at)
        pair, left, right = met // (width * width), met // width % width, met % width
    p = _shares(leaves[left], totals[a[pair]], n_terms)
    q = _shares(leaves[right], totals[b[pair]], n_terms)
    square = (p - q) * (p - q)
    forth, other = square // q, square // p
    for at in reversed(back):
        half = len(at) // 2
        forth, other = (x[at[:half]] + x[at[half:]] for x in (forth, other))
    return forth, other


def _shares(counts: np.ndarray, totals: np.ndarray, n_terms: int) -> np.ndarray:
    if len(counts) and int(counts.max()) >= 2**63 // SCALE - 1:  # beyond 64 bits
        exact = [1 + SCALE * (c + 1) // (n + n_terms) for c, n in zip(counts.tolist(), totals.tolist())]
        return np.array(exact, np.int64)
    return 1 + SCALE * (counts + 1) // (totals + n_terms)


def _priced(key: tuple, table: pa.Table) -> pa.Table:
    """a, b, value for all pairs of sources of a segment and two blocks (lang, segment, low, high)."""
    sources = table.filter(pa.compute.is_null(table.column("term")))
    order = pa.compute.sort_indices(sources, [("source", "ascending")])
    sources = sources.take(order)
    names, blocks = sources.column("source").to_pylist(), np.array(sources.column("block").to_pylist())
    number = {s: i for i, s in enumerate(names)}
    here = sources.column("count")[0].as_py()  # kept terms of the segment, also those that no source here has
    used = table.filter(pa.compute.is_valid(table.column("term")))
    terms = used.column("term").combine_chunks().dictionary_encode()
    width = 1 << max(0, len(terms.dictionary) - 1).bit_length()
    counts = np.zeros((len(names), width), np.int64)
    rows = np.array([number[s] for s in used.column("source").to_pylist()], np.int64)
    counts[rows, terms.indices.to_numpy()] = used.column("count").to_numpy()
    trees = cons(counts)
    totals = sources.column("total").to_numpy()
    n_terms = sources.column("n_terms")[0].as_py()
    low, high = key[2].as_py(), key[3].as_py()
    a, b = np.triu_indices(len(names), 1)
    # two sources of one block are priced where that block is on its own
    mine = (blocks[a] != blocks[b]) | (low == high)
    a, b = a[mine], b[mine]
    out = []
    # the tree has ``width`` places: those too many or too few for the terms of the segment are zero in all rows
    spare = width - here
    step = max(1, WALK // width)
    for i in range(0, len(a), step):
        x, y = a[i : i + step], b[i : i + step]
        forth, other = price(x, y, totals, n_terms, trees)
        if spare:
            p, q = (_shares(np.zeros(len(x), np.int64), totals[z], n_terms) for z in (x, y))
            square = (p - q) * (p - q)
            forth, other = forth - spare * (square // q), other - spare * (square // p)
        out += [(x, y, forth), (y, x, other)]
    name = np.array(names, object)
    left, right, value = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (list(zip(*out)) or [[], [], []]))
    lang = pa.array([key[0].as_py()] * len(value), pa.string())
    return pa.table([lang, pa.array(name[left], pa.string()), pa.array(name[right], pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def _segments(kept: DataFrame) -> DataFrame:
    """lang, term, segment: terms of like frequency, so that subtrees are alike, about ``SEGMENT`` in each."""
    band = F.floor(F.log2(F.col("docs"))).cast("int")
    banded = kept.withColumn("band", band)
    size = banded.groupBy("lang", "band").agg(F.ceil(F.count("*") / SEGMENT).alias("parts"))
    part = F.pmod(F.xxhash64("term"), F.col("parts"))
    return banded.join(size, ["lang", "band"]).select("lang", "term", F.concat_ws(":", "band", part).alias("segment"))


def pair_gaps(counts: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language.

    ``counts``: lang, source, term, count of kept terms; ``kept``: lang, term, docs;
    ``groups``: lang, source, total, n_terms of every group. Sources are dealt to
    blocks by hash, and each segment of terms meets each two blocks in a task of
    its own, so neither many sources nor many terms meet in one task.
    """
    many = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = groups.join(many, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    dealt = stored(dealt, "sources")
    segments = stored(_segments(kept), "segments")
    leaf = counts.join(segments, ["lang", "term"]).join(dealt, ["lang", "source"])
    leaf = leaf.select("lang", "segment", "source", "term", "count", "block", "blocks", "total", "n_terms")
    # a row of every source for each segment, with the segment's size: also a source without its terms is priced there
    empty = segments.groupBy("lang", "segment").agg(F.count("*").alias("count")).join(dealt, "lang")
    no_term = F.lit(None).cast("string").alias("term")
    empty = empty.select("lang", "segment", "source", no_term, "count", "block", "blocks", "total", "n_terms")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = leaf.union(empty).withColumn("other", other)
    met = met.select(
        "lang", "segment", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "source", "term", "count", "block", "total", "n_terms",
    )
    priced = met.groupBy("lang", "segment", "low", "high").applyInArrow(_priced, "lang string, source string, item string, value long")
    without = dealt.where("n_terms = 0").select("lang", "source")
    # a language without kept terms: every two sources differ by nothing
    nothing = without.join(without.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    return priced.union(nothing).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of the sources of ``docs`` (text, lang, source).

    A language keeps the terms found in ``min_docs`` of its documents (rows).
    Part ``pair``: how far the source's smoothed shares of the kept terms are from
    those of each other source of its language, all of them. Part ``term``: the terms that
    the source has above the language's share, the ``top`` farthest. Rank by
    value, then by item; 1 is the farthest.

    Null text, lang and source are read as ''. Every group of lang and source
    counts, also one without terms; a source alone in its language has no pairs.
    Repeated rows count as often as they occur. No rows: no rows. Other columns
    are not looked at.
    """
    counts = stored(term_counts(docs), "term_counts")
    with_terms = counts.where(F.col("term").isNotNull())
    kept = with_terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count"))
    kept = stored(kept.where(F.col("docs") >= min_docs), "kept_terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_count").alias("lang_total"))
    used = stored(
        with_terms.select("lang", "source", "term", "count").join(kept.select("lang", "term", "lang_count"), ["lang", "term"]),
        "used_terms",
    )
    totals = used.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    none = F.lit(0).cast("long")
    groups = (
        counts.where(F.col("term").isNull()).select("lang", "source")
        .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select(
            "lang", "source", F.coalesce("total", none).alias("total"), F.coalesce("n_terms", none).alias("n_terms"),
            F.coalesce("lang_total", none).alias("lang_total"),
        )
    )
    groups = stored(groups, "groups")
    pairs = pair_gaps(used.drop("lang_count"), kept, groups.drop("lang_total"))
    p = smoothed(F.col("count"), F.col("total"), F.col("n_terms"))
    q = smoothed(F.col("lang_count"), F.col("lang_total"), F.col("n_terms"))
    shares = used.join(groups, ["lang", "source"]).where(F.col("count") > 0).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    terms = shares.where("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [
        pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")),
        terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top),
    ]
    return ranked[0].union(ranked[1])
