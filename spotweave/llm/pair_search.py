"""Ranked lexical search by MaxScore with bounds of term pairs.

The documents are indexed in blocks of like length, made in the tasks that read
them, so nothing is shuffled. A block has the postings of the query terms with
their exact impacts, the largest impact of each term, and for each pair of the
most frequent query terms the intersection list with the largest joint impact.
For an item the units (pairs and single terms) with the least bounds, that
together can't reach the score of its last rank so far, are not essential:
documents with none of the other terms are never looked at, and a document is
dropped as soon as its score and the bounds of the rest fall short. A pair's
joint bound is below the sum of its terms' bounds, as two terms are seldom at
their best in one document, and a document outside the pair's list gets one
of the two terms at most.

A sixteenth of the blocks is searched first; the last rank of an item there is
where it starts in all others. Bounds are of exact integers, so skipping
loses nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spotweave.llm.batches import map_texts
from spotweave.llm.terms import splitter
from spotweave.session import stored

TOP = 20
#: Documents and postings of a block, at most (one document makes a block at least).
BLOCK_DOCS, BLOCK_POSTINGS = 2048, 1 << 20
#: Most frequent query terms of which all pairs have lists.
PAIR_TERMS = 32
#: Different terms of items that are searched together; more items make further passes over the documents.
ITEM_TERMS = 500_000
FIRST = 16
split = splitter(digits=True)

_INDEX = (
    "docs binary, none binary, terms binary, starts binary, ords binary, impacts binary, maxima binary, "
    "pairs binary, pair_starts binary, pair_ords binary, joint binary"
)
_KINDS = dict(zip([c.split()[0] for c in _INDEX.split(", ")], "<i8 ? <i4 <i8 <i4 <i4 <i8 <i4 <i8 <i4 <i8".split()))


def _counted(texts: list[bytes | None]) -> list[pa.Array]:
    found = [Counter(split(t)) for t in texts]
    return [
        pa.array([list(c) for c in found], pa.list_(pa.binary())),
        pa.array([list(c.values()) for c in found], pa.list_(pa.int64())),
    ]


def _known(ids: dict[bytes, int]):
    """The work of a slice: number of terms, and ids and counts of those in ``ids``."""

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        n, held, times = [], [], []
        for text in texts:
            words = split(text)
            n.append(len(words))
            found = Counter(map(ids.get, words))
            found.pop(None, None)
            held.append(np.fromiter(found, "<i4", len(found)).tobytes())
            times.append(np.fromiter(found.values(), "<i8", len(found)).tobytes())
        return [pa.array(n, pa.int64()), pa.array(held, pa.binary()), pa.array(times, pa.binary())]

    return work


def _frequencies(size: int):
    """Documents for each term id, counted in the task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for held in batch.column("held").to_pylist():
                df[np.frombuffer(held, "<i4")] += 1
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(df[term])], names=["term", "df"])

    return task


def impacts(times: np.ndarray, lengths: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Impact of a term that occurs ``times`` times in a document of ``lengths`` terms, without its weight."""
    m = 75 + (25 * lengths * docs) // total
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


def _block(doc_ids, lengths, held, times, weights, often, docs, total) -> list[bytes]:
    """An index row of documents: postings by term, maxima, and the lists of pairs of the terms ``often``."""
    sizes = np.array([len(h) for h in held])
    ords = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
    term, tf = np.concatenate(held), np.concatenate(times)
    order = np.lexsort((ords, term))
    term, ords = term[order], ords[order]
    impact = impacts(tf[order], np.asarray(lengths, np.int64)[ords], docs, total)
    names, starts = np.unique(term, return_index=True)
    starts = np.append(starts, len(term))
    weighted = impact * weights[term]
    maxima = np.maximum.reduceat(weighted, starts[:-1]) if len(names) else np.zeros(0, np.int64)
    there = [(t, p) for t in often if (p := np.searchsorted(names, t)) < len(names) and names[p] == t]
    dense = np.zeros((len(there), len(held)), np.int64)
    has = np.zeros((len(there), len(held)), bool)
    for i, (_, p) in enumerate(there):
        dense[i, ords[starts[p] : starts[p + 1]]] = weighted[starts[p] : starts[p + 1]]
        has[i, ords[starts[p] : starts[p + 1]]] = True
    pairs, lists, joint = [], [], []
    for i in range(len(there)):
        for j in range(i + 1, len(there)):
            both = np.flatnonzero(has[i] & has[j]).astype(np.int32)
            pairs.append((there[i][0], there[j][0]))
            lists.append(both)
            joint.append((dense[i, both] + dense[j, both]).max() if len(both) else 0)
    none = [d is None for d in doc_ids]
    parts = {
        "docs": [0 if d is None else d for d in doc_ids],
        "none": none,
        "terms": names,
        "starts": starts,
        "ords": ords,
        "impacts": impact,
        "maxima": maxima,
        "pairs": np.array(pairs).reshape(-1),
        "pair_starts": np.concatenate(([0], np.cumsum([len(x) for x in lists]))),
        "pair_ords": np.concatenate(lists) if lists else [],
        "joint": joint,
    }
    return [np.asarray(parts[k]).astype(kind).tobytes() for k, kind in _KINDS.items()]


def _blocks(weights: np.ndarray, often: list[int], docs: int, total: int):
    """Index rows from documents in order of length."""
    names = list(_KINDS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def done() -> pa.RecordBatch:
            columns = _block(*map(list, zip(*waiting)), weights, often, docs, total)
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=names)

        for batch in batches:
            for doc, n, held, times in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "held", "times"))):
                held, times = np.frombuffer(held, "<i4"), np.frombuffer(times, "<i8")
                if waiting and (len(waiting) == BLOCK_DOCS or size + len(held) > BLOCK_POSTINGS):
                    yield done()
                    waiting, size = [], 0
                waiting.append((doc, n, held, times))
                size += len(held)
        if waiting:
            yield done()

    return task


class _Items:
    """Terms and repeats of the items of a pass, as arrays that all tasks get."""

    def __init__(self, rows, ids: dict[bytes, int]):
        self.rows = np.array([r["item"] for r in rows], np.int64)
        self.starts = np.concatenate(([0], np.cumsum([len(r["terms"]) for r in rows]))).astype(np.int64)
        self.terms = np.array([ids[bytes(t)] for r in rows for t in r["terms"]], np.int64)
        self.times = np.array([q for r in rows for q in r["times"]], np.int64)


class _Block:
    """A block as it is searched."""

    def __init__(self, row: dict[str, bytes], weights: np.ndarray):
        for name, kind in _KINDS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.scores = self.impacts * np.repeat(weights[self.terms], np.diff(self.starts))
        self.place = np.full(len(weights), -1, np.int64)
        self.place[self.terms] = np.arange(len(self.terms))
        self.pair = {(a, b): i for i, (a, b) in enumerate(self.pairs.reshape(-1, 2).tolist())}
        self.paired = set(self.pairs.tolist())

    def list_of(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[p], self.starts[p + 1]
        return self.ords[a:b], self.scores[a:b]

    def units(self, terms: np.ndarray, times: np.ndarray) -> list[tuple[int, int, list[tuple[int, int]], int]]:
        """(bound, bound outside the pair's list, [(place, times)], pair or -1), least bound first.

        Frequent terms are paired in descending order of their bounds: a joint
        maximum helps most where both terms weigh much.
        """
        place = self.place[terms]
        found = sorted(zip((times * self.maxima[place]).tolist(), terms.tolist(), place.tolist(), times.tolist()), reverse=True)
        out, partner = [], None
        for x in found:
            if x[1] not in self.paired:
                out.append((x[0], x[0], [(x[2], x[3])], -1))
            elif partner is None:
                partner = x
            else:
                (bound_a, a, pa_, qa), (bound_b, b, pb, qb) = partner, x
                pair = self.pair[(a, b)] if (a, b) in self.pair else self.pair[(b, a)]
                low, alone = min(qa, qb), max(bound_a, bound_b)
                rest = (qa - low) * int(self.maxima[pa_]) + (qb - low) * int(self.maxima[pb])
                both = low * int(self.joint[pair]) + rest if self.joint[pair] else 0
                out.append((max(alone, min(both, bound_a + bound_b)), alone, [(pa_, qa), (pb, qb)], pair))
                partner = None
        if partner is not None:
            out.append((partner[0], partner[0], [(partner[2], partner[3])], -1))
        return sorted(out, key=lambda u: u[0])

    def search(self, terms: np.ndarray, times: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (their places) with a score of ``least`` or more, at least 1, and the scores."""
        units = self.units(terms, times)
        least = max(least, 1)
        before = np.cumsum([u[0] for u in units]).tolist()
        cut = sum(b < least for b in before)  # units before it can't reach ``least`` together
        nothing = np.zeros(0, np.int64)
        if cut == len(units):
            return nothing, nothing
        score = np.zeros(len(self.docs), np.int64)
        for _, _, members, _ in units[cut:]:
            for p, q in members:
                ords, got = self.list_of(p)
                score[ords] += got * q if q > 1 else got
        left = before[cut - 1] if cut else 0
        found = np.flatnonzero((score > 0) & (score + left >= least))
        for i in range(cut - 1, -1, -1):
            if not len(found):
                break
            bound, alone, members, pair = units[i]
            rest = left - bound
            if pair >= 0 and alone < bound:
                inside = _held(self.pair_ords[self.pair_starts[pair] : self.pair_starts[pair + 1]], found)[0]
                found = found[score[found] + np.where(inside, bound, alone) + rest >= least]
            for p, q in members:
                ords, got = self.list_of(p)
                inside, at = _held(ords, found)
                score[found[inside]] += got[at[inside]] * q
            left = rest
            found = found[score[found] + left >= least]
        return found, score[found]


def _held(ords: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are in the sorted list, and where."""
    if not len(ords):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(ords, wanted), len(ords) - 1)
    return ords[at] == wanted, at


class _Best:
    """The documents of the highest scores of an item so far."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.parts = k, least, []

    def add(self, scores: np.ndarray, docs: np.ndarray, none: np.ndarray) -> None:
        self.parts.append((scores, docs, none))
        if sum(len(p[0]) for p in self.parts) >= self.k:
            scores, docs, none = self.all()
            order = np.lexsort((docs, none, -scores))[: self.k]
            self.parts = [(scores[order], docs[order], none[order])]
            self.least = max(self.least, int(scores[order[-1]]))

    def all(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.parts)]


def _search(items: _Items, weights: np.ndarray, least: np.ndarray, k: int):
    """The best documents of each item in the blocks of a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {i: _Best(k, int(least[i])) for i in range(len(items.rows))}
        lows = least.copy()
        for batch in batches:
            for at in range(batch.num_rows):
                block = _Block({c: batch.column(c)[at].as_py() for c in _KINDS}, weights)
                place = block.place[items.terms]
                bound = np.where(place >= 0, block.maxima[place] if len(block.maxima) else 0, 0) * items.times
                sums = np.concatenate(([0], np.cumsum(bound)))
                whole = sums[items.starts[1:]] - sums[items.starts[:-1]]
                for i in np.flatnonzero(whole >= np.maximum(lows, 1)).tolist():
                    part = slice(items.starts[i], items.starts[i + 1])
                    here = place[part] >= 0
                    found, scores = block.search(items.terms[part][here], items.times[part][here], best[i].least)
                    if len(found):
                        best[i].add(scores, block.docs[found], block.none[found])
                        lows[i] = best[i].least
        for i, held in best.items():
            if held.parts:
                scores, docs, none = held.all()
                item = np.full(len(scores), items.rows[i])
                columns = [pa.array(item), pa.array(docs, pa.int64(), mask=none), pa.array(scores, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return task


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _one_pass(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """item, rank, doc_id, score for the items of ``rows``."""
    ids = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    made = map_texts(texts, "text", "n long, held binary, times binary", _known(ids), keep=["doc_id"])
    counted = stored(made.where("n > 0"), "counted")
    n_docs, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(ids), np.int64)
    for r in counted.mapInArrow(_frequencies(len(ids)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    often = np.argsort(-df, kind="stable")[:PAIR_TERMS].tolist()
    with_terms = counted.where(F.length("held") > 0).sortWithinPartitions("n")
    index = stored(with_terms.mapInArrow(_blocks(weights, often, n_docs, total), _INDEX), "index")
    items = _Items(rows, ids)
    turn = F.pmod(F.xxhash64("docs"), F.lit(FIRST))
    result = "item long, doc_id long, score long"
    start = np.zeros(len(rows), np.int64)
    first = stored(_ranked(index.where(turn == 0).mapInArrow(_search(items, weights, start, k), result), k), "first_blocks")
    position = {item: i for i, item in enumerate(items.rows.tolist())}
    for r in first.where(F.col("rank") == k).select("item", "score").collect():
        start[position[r["item"]]] = r["score"]
    other = index.where(turn != 0).mapInArrow(_search(items, weights, start, k), result)
    return _ranked(first.select("item", "doc_id", "score").union(other), k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents (doc_id, text) of the highest scores for each item (item_id, text).

    The score is a sum over the item's terms, repeats included, of a rarity
    weight times a saturating share of the term in the document; only scores
    above 0 are ranked, equal ones by doc_id, null last. Each row of either
    table is an item or a document of its own, repeated ones too. A null or
    empty text has no terms; such an item has no rows, and such a document
    counts for nothing. No rows on either side: no rows. Other columns are not
    looked at.

    Items are searched in passes of about ``ITEM_TERMS`` terms, which bounds what
    the driver and the tasks hold of them; each pass reads the documents once.
    """
    texts = items.select(F.col("item_id").alias("item_id"), F.col("text").cast("binary").alias("text"))
    split_items = map_texts(texts, "text", "terms array<binary>, times array<long>", _counted, keep=["item_id"])
    asked = stored(split_items.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, math.ceil(total / ITEM_TERMS))
    names, result = asked.select("item", "item_id"), None
    for i in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == i).select("item", "terms", "times").collect()
        if rows:
            part = _one_pass(docs, rows, k)
            part = stored(part, "ranked") if passes > 1 else part
            result = part if result is None else result.union(part)
    if result is None:
        return names.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return result.join(names, "item").select("item_id", "rank", "doc_id", "score")
