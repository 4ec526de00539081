"""Licence notices in documents: MinHash bands over overlapping windows retrieve templates, containment verifies.

Windows of a few fixed widths slide over the words of each text. A window's
MinHash values, in bands, are looked up among those of the templates' windows of
the same width. With 12 bands of 2 rows a window of Jaccard similarity 0.6 meets
its template with probability 1 - (1 - 0.36)^12 = 0.995, one of 0.67 (what a
containment of 0.8 between equal lengths leaves) with 0.999. Wide windows begin at
every eighth of their width, so the nearest to a template's window is up to a
sixteenth aside: of an exact copy it still has a similarity of 0.9, and is missed with
probability (1 - 0.81)^12 = 2e-9; of a copy at 0.67 it has 0.6 or more.
Each hit is then checked word by word: the share of the template's five-word
shingles in the passage. The templates are handled in shards of bounded size,
each in its own pass over the texts, so a task holds one shard and no text is
shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from spotweave.llm.batches import slices

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 12, 2
#: Window widths in words; a template uses the two largest that fit.
WIDTHS = (5, 8, 16, 32, 64)
#: Other words that a passage may have inside, where the template is shorter than that.
INSERTED = 64
#: Words of all templates in a shard.
SHARD_WORDS = 200_000
#: Bytes of text that a task hashes at once.
SLICE_BYTES = 1 << 20
FOUND = "doc_id long, template string, start long, n_words long, containment double"
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words: runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


def _shingle_hashes(words: np.ndarray) -> np.ndarray:
    h = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        h = (h ^ words[j : j + len(h)]) * _A
        h ^= h >> np.uint64(31)
    return h


def _band_keys(shingles: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """For each width the band keys (bands x windows) of all windows, by their first word."""
    out = {w: np.zeros((BANDS, max(0, len(shingles) - (w - SHINGLE))), np.uint64) for w in widths}
    for band in range(BANDS):
        for row in range(ROWS):
            seed = np.uint64((band * ROWS + row + 1) * 0x94D049BB133111EB & (1 << 64) - 1)
            low, covered = (shingles ^ seed) * _B, 1
            low ^= low >> np.uint64(32)
            low *= _A
            for w in widths:  # ascending: minima over more shingles from those over fewer
                want = w - SHINGLE + 1
                while covered < want:
                    step = min(covered, want - covered)
                    rest = max(0, len(low) - step)  # a slice of few words has no window so wide
                    low, covered = np.minimum(low[:rest], low[step:]), covered + step
                n = out[w].shape[1]
                out[w][band] = (out[w][band] ^ low[:n]) * _A + np.uint64(band)
    return out


class _Shard:
    """Band keys and words of some templates."""

    def __init__(self, templates: list[tuple[str, list[str]]]):
        self.templates = templates
        #: For each template the places of each of its shingles.
        self.places: list[dict[tuple[str, ...], list[int]]] = []
        for _, words in templates:
            found: dict[tuple[str, ...], list[int]] = {}
            for i in range(len(words) - SHINGLE + 1):
                found.setdefault(tuple(words[i : i + SHINGLE]), []).append(i)
            self.places.append(found)
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for number, (_, words) in enumerate(templates):
            # the two largest widths that fit: the smaller one finds a copy with other words in its middle
            for width in [w for w in WIDTHS if w <= len(words)][-2:]:
                keys = _band_keys(_shingle_hashes(_hash_words(words)), [width])[width]
                places = self.at.setdefault(width, {})
                last = keys.shape[1] - 1
                for start in sorted({*range(0, last + 1, max(1, width // 2)), last}):
                    for key in keys[:, start].tolist():
                        places.setdefault(key, []).append((number, start))
        self.widths = sorted(self.at)
        self.sorted = {w: np.array(sorted(p), np.uint64) for w, p in self.at.items()}
        self.maybe = {w: np.isin(np.arange(1 << 16, dtype=np.uint64), k >> np.uint64(48)) for w, k in self.sorted.items()}


def _hash_words(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def _candidates(shard: _Shard, words: np.ndarray) -> set[tuple[int, int]]:
    """(template, word where it would begin) for all windows that share a band with a template's window."""
    found = set()
    for width, keys in _band_keys(_shingle_hashes(words), shard.widths).items():
        step = max(1, (width - SHINGLE + 1) // 8)
        keys = keys[:, ::step]
        band, window = np.nonzero(shard.maybe[width][keys >> np.uint64(48)])
        hits = keys[band, window]
        sure = np.isin(hits, shard.sorted[width])
        for key, at in zip(hits[sure].tolist(), window[sure].tolist()):
            found.update((number, at * step - start) for number, start in shard.at[width][key])
    return found


def _verify(shard: _Shard, words: list[str], begins: dict[int, list[int]]) -> list[tuple[str, int, int, float]]:
    """Passages of one text that hold enough of a template.

    Matching shingles near the candidates are read in the order of the text. A
    passage goes on while their places in the template do; it ends where they
    go back by half the template or more, as at the start of a next copy, or after
    more other words than the template has (or ``INSERTED``).
    """
    out = []
    for number, starts in begins.items():
        name, template = shard.templates[number]
        places, size = shard.places[number], len(template)
        half, apart = (size - SHINGLE + 1) // 2, max(size, INSERTED)
        runs, last, done = [], 0, 0
        for start in sorted(starts):
            low, high = max(done, start - size // 4), min(len(words), start + size + size // 4) - SHINGLE + 1
            for i in range(low, high):
                found = places.get(tuple(words[i : i + SHINGLE]))
                if found is None:
                    continue
                at = next((p for p in found if p > last), found[-1])
                if not runs or (at <= last and last - at >= half) or i - runs[-1][-1][0] > apart:
                    runs.append([])
                    at = found[0]
                runs[-1].append((i, found[0]))
                last = at
            done = max(done, high)
        for run in runs:
            share = len({p for _, p in run}) / len(places)
            if share >= CONTAINMENT:
                begin = run[0][0]
                out.append((name, begin, run[-1][0] + SHINGLE - begin, share))
    return out


def scan(docs: DataFrame, templates: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, template, start, n_words, containment: each passage of a text that holds a template.

    ``docs``: doc_id, text, ...; ``templates``: template (its name), text; at
    least ``SHINGLE`` words, shorter ones and null texts are refused. ``start`` and
    ``n_words`` count words (``words_of``). containment: share of the template's
    distinct shingles in the passage, at least 0.8.

    A null, empty or too short text has no passage. A null doc_id is reported as
    null. Repeated rows are reported each. Other columns are left out. Templates
    of the same words are all reported. No documents or no templates: no rows.
    """
    shards, held = [], []
    # the library of templates, read shard by shard
    for row in templates.orderBy("template", "text").toLocalIterator():
        words = words_of(row["text"])
        if len(words) < SHINGLE:
            raise ValueError(f"template {row['template']!r} has fewer than {SHINGLE} words")
        if held and sum(len(w) for _, w in held) + len(words) > shard_words:
            shards.append(held)
            held = []
        held.append((row["template"], words))
    if held:
        shards.append(held)
    spark = docs.sparkSession
    out = spark.createDataFrame([], FOUND)
    for rows in shards:
        sent = spark.sparkContext.broadcast(rows)

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shard = _Shard(sent.value)
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    keys = part.column("doc_id").to_pylist()
                    texts = [words_of(t) for t in part.column("text").to_pylist()]
                    starts = np.cumsum([0] + [len(t) for t in texts])
                    begins: dict[int, dict[int, list[int]]] = {}
                    for number, at in _candidates(shard, _hash_words([w for t in texts for w in t])):
                        # a window may begin in one text and end in the next: both are looked at
                        size = len(shard.templates[number][1])
                        first, last = np.searchsorted(starts, [max(at, 0), max(at + size - 1, 0)], "right") - 1
                        for doc in {int(first), min(int(last), len(texts) - 1)}:
                            begins.setdefault(doc, {}).setdefault(number, []).append(int(at - starts[doc]))
                    found = [(keys[d], *hit) for d in sorted(begins) for hit in _verify(shard, texts[d], begins[d])]
                    if found:
                        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=[f.split()[0] for f in FOUND.split(", ")])

        out = out.union(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, FOUND))
    return out
