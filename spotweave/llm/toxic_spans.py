"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents, so the words of the fitting sample are labelled first:
a word of a toxic document is a toxic token if it, or a stem of it (its first
bytes), is much more frequent in toxic documents than in others; all other words
are clean. The field has two tags. What a word says for the toxic tag is the
sum of the weights of the word and of its stems, so unseen words with a known
stem count; the tags of neighbours depend on each other. It is fitted to the
tokens by gradients from forward and backward sums. Forward-backward marginals
of all words of a document give its expected toxic words and their share, and a
logistic curve, fitted on documents that the field hasn't seen, turns these
into a probability.

The model is fitted on a bounded sample of labelled rows in one task: at most
about ``FIT_DOCS`` of each label with at most ``FIT_BYTES`` of text. Scoring
takes whole texts, needs no shuffle, and sends the model to all tasks.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from spotweave.llm.batches import map_texts
from spotweave.llm.terms import splitter
from spotweave.session import stored

#: Bounds of the fitting sample: labelled documents of each label, about, and bytes of a text.
FIT_DOCS, FIT_BYTES = 3000, 20_000
#: Lengths of stems in bytes.
STEMS = range(3, 13)
#: A feature marks toxic tokens when so many times as frequent in toxic documents, and as significant (log-likelihood ratio).
RATIO, SIGNIFICANT = 6.0, 25.0
#: Gradient steps of the field, their size at the start, and the penalty of weights.
STEPS, RATE, PENALTY = 70, 0.4, 1.0
#: Smaller weights are left out of the model.
LEAST_WEIGHT = 0.02
#: Marginal from which a word is part of a span.
SPAN = 0.5
#: Matrices of a lane.
LANE = 64
#: Known words of a task.
CACHE = 300_000
split = splitter(digits=False)


def features(word: bytes) -> list[bytes]:
    """The word itself (marked by a blank, which no word has) and its stems."""
    return [word + b" ", *(word[:k] for k in STEMS if k <= len(word))]


# chains ---------------------------------------------------------------------------------------------------------------


def _times(m: list[np.ndarray], v: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return m[0] * v[0] + m[1] * v[1], m[2] * v[0] + m[3] * v[1]


def chain(m: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """v[t] = m[t] v[t-1], scaled to sum 1, from (1, 1), for matrices given by their four entries.

    Lanes of ``LANE`` matrices are multiplied side by side, the products chained
    in the same way, and the lanes run again from where the one before ends.
    """
    n = len(m[0])
    if n <= LANE:
        out = np.empty((2, n))
        a = b = 0.5
        for t, (p, q, r, s) in enumerate(zip(*(x.tolist() for x in m))):
            a, b = p * a + q * b, r * a + s * b
            total = a + b
            a, b = a / total, b / total
            out[0, t], out[1, t] = a, b
        return out[0], out[1]
    lanes = -(-n // LANE)
    grid = []
    for x, one in zip(m, (1.0, 0.0, 0.0, 1.0)):
        full = np.full(lanes * LANE, one)
        full[:n] = x
        grid.append(np.ascontiguousarray(full.reshape(lanes, LANE).T))
    left, right = (grid[0][0], grid[2][0]), (grid[1][0], grid[3][0])
    for t in range(1, LANE):
        step = [x[t] for x in grid]
        left, right = _times(step, left), _times(step, right)
        total = left[0] + left[1] + right[0] + right[1]
        left, right = tuple(x / total for x in left), tuple(x / total for x in right)
    ends = chain([left[0], right[0], left[1], right[1]])
    v = tuple(np.concatenate(([0.5], e[:-1])) for e in ends)
    out = np.empty((2, LANE, lanes))
    for t in range(LANE):
        v = _times([x[t] for x in grid], v)
        total = v[0] + v[1]
        v = v[0] / total, v[1] / total
        out[0, t], out[1, t] = v
    return tuple(x.T.reshape(-1)[:n] for x in out)


class Chains:
    """Sequences of words one after another; ``first`` marks the first word of each."""

    def __init__(self, first: np.ndarray):
        self.first = first

    def run(self, emission: np.ndarray, link: np.ndarray, begin: float):
        """Marginal of the toxic tag of each word, and the forward and backward vectors and potentials they come from.

        ``link``: logarithms of the four transition potentials; ``begin``: that of the toxic tag at a first word.
        """
        hot = np.exp(np.clip(emission, -30, 30))
        t00, t01, t10, t11 = np.exp(np.clip(link, -30, 30))
        start = math.exp(max(-30.0, min(30.0, begin)))
        m = [
            np.where(self.first, 1.0, t00), np.where(self.first, 1.0, t10),
            hot * np.where(self.first, start, t01), hot * np.where(self.first, start, t11),
        ]
        ahead = chain(m)
        # backward: transposed matrices of the words that follow, in reverse order
        turned = [np.concatenate(([1.0], x[:0:-1])) for x in (m[0], m[2], m[1], m[3])]
        behind = tuple(x[::-1] for x in chain(turned))
        toxic, clean = ahead[1] * behind[1], ahead[0] * behind[0]
        return toxic / (toxic + clean), ahead, behind, m


# fitting --------------------------------------------------------------------------------------------------------------


def _near_copy(words: list[bytes], seen: set[int]) -> bool:
    """Whether the least of the hashed five-word shingles, under one of eight orders, is that of a text before."""
    hashes = np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))], np.uint64)
    keys = [int((hashes * np.uint64(2 * k * 0x9E3779B97F4A7C15 % 2**64 | 1)).min()) ^ k for k in range(1, 9)]
    known = any(k in seen for k in keys)
    seen.update(keys)
    return known


def marked_features(texts: list[Counter], toxic: np.ndarray) -> set[bytes]:
    """Features that are significantly more frequent in toxic texts: by documents, and ``RATIO`` times by words."""
    times, in_docs = (Counter(), Counter()), (Counter(), Counter())
    for words, y in zip(texts, toxic.tolist()):
        held = Counter()
        for word, n in words.items():
            for f in features(word):
                held[f] += n
        times[y].update(held)
        in_docs[y].update(held.keys())
    words = [max(1, sum(sum(t.values()) for t, y in zip(texts, toxic.tolist()) if y == k)) for k in (0, 1)]
    docs = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    out = set()
    for f, c1 in times[1].items():
        c0 = times[0][f]
        if c1 / words[1] < RATIO * (c0 + 0.5) / words[0]:
            continue
        d1, d0 = in_docs[1][f], in_docs[0][f]
        share = (d1 + d0) / (docs[0] + docs[1])
        g = sum(k * math.log(k / (n * s)) for k, n, s in ((d1, docs[1], share), (d0, docs[0], share), (docs[1] - d1, docs[1], 1 - share), (docs[0] - d0, docs[0], 1 - share)) if k)
        if d1 / docs[1] > d0 / docs[0] and 2 * g >= SIGNIFICANT:
            out.add(f)
    return out


class _Words:
    """Words of texts as numbers, and the features of each different word."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}

    def number(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))

    def matrix(self, least: int, used: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Features of ``least`` different words or occurrences, and (word, feature) pairs."""
        weight = Counter()
        for word, i in self.ids.items():
            for f in features(word):
                weight[f] += int(used[i])
        names = [f for f, n in weight.items() if n >= least]
        number = {f: i for i, f in enumerate(names)}
        pairs = [(i, number[f]) for word, i in self.ids.items() for f in features(word) if f in number]
        pairs = np.array(pairs, np.int64).reshape(-1, 2)
        return names, pairs[:, 0], pairs[:, 1]


def fit_field(texts: list[list[bytes]], tags: list[np.ndarray], steps: int = STEPS) -> dict:
    """Weights of features, links and begin of the field that make the tags of the words likeliest, by Adam steps."""
    words = _Words()
    ids = [words.number(t) for t in texts if t]
    if not ids:
        return {"weights": {}, "bias": -5.0, "link": [0.0] * 4, "begin": 0.0}
    first = np.concatenate([np.arange(len(i)) == 0 for i in ids])
    ids = np.concatenate(ids)
    y = np.concatenate([t for t in tags if len(t)]).astype(float)
    names, row, col = words.matrix(3, np.bincount(ids, minlength=len(words.ids)))
    chains = Chains(first)
    # parameters: a weight for each feature, bias, begin, three links (that of two clean words is 0)
    x = np.zeros(len(names) + 5)
    share = min(0.5, max(1e-6, y.mean()))
    x[-5] = math.log(share / (1 - share))
    mean, square = np.zeros_like(x), np.zeros_like(x)
    inner = ~first
    at = np.flatnonzero(inner)
    want = [((y[at - 1] == a) & (y[at] == b)).sum() for a, b in ((0, 1), (1, 0), (1, 1))]
    for step in range(1, steps + 1):
        w, bias, begin, link = x[:-5], x[-5], x[-4], np.concatenate(([0.0], x[-3:]))
        of_word = np.bincount(row, weights=w[col], minlength=len(words.ids)) + bias
        marginal, ahead, behind, m = chains.run(of_word[ids], link, begin)
        # two words and their tags: forward of the first, potential, backward of the second
        joint = [ahead[a][at - 1] * m[2 * b + a][at] * behind[b][at] for a, b in ((0, 0), (0, 1), (1, 0), (1, 1))]
        total = sum(joint)
        gap = marginal - y
        by_word = np.bincount(ids, weights=gap, minlength=len(words.ids))
        gradient = np.empty_like(x)
        gradient[:-5] = np.bincount(col, weights=by_word[row], minlength=len(names)) + PENALTY * w
        gradient[-5] = gap.sum()
        gradient[-4] = gap[first].sum() + 0.1 * PENALTY * begin
        gradient[-3:] = [(j / total).sum() - k for j, k in zip(joint[1:], want)] + 0.1 * PENALTY * x[-3:]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient * gradient
        rate = RATE * (1 - 0.9 * step / steps)
        x -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = {f: float(v) for f, v in zip(names, x[:-5]) if abs(v) >= LEAST_WEIGHT}
    return {"weights": weights, "bias": float(x[-5]), "link": [0.0, *x[-3:].tolist()], "begin": float(x[-4])}


def evidence(expected: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """What a document's score is made from: 1, expected toxic words and their share, on logarithmic scales."""
    return np.stack([np.ones(len(expected)), np.log(expected + 0.02), np.log(expected / np.maximum(n_words, 1) + 2e-4)], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic weights by Newton steps with a small penalty; without both labels: the share of label 1."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return w
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w -= np.clip(np.linalg.solve(hessian, x.T @ (p - y) + ridge @ w), -2, 2)
    return w


def fit(texts: list[bytes], labels: list[int]) -> dict:
    """The model of a sample of labelled texts. Near copies in it count once; a quarter of it fits the curve alone."""
    order = sorted(range(len(texts)), key=lambda i: (xxhash.xxh3_64_intdigest(texts[i]), labels[i]))
    words, toxic, seen = [], [], set()
    for i in order:
        found = split(texts[i])
        if found and not _near_copy(found, seen):
            words.append(found)
            toxic.append(int(labels[i] == 1))
    toxic = np.array(toxic, np.int64)
    # every fourth of either label is kept for the curve
    turn = np.where(toxic == 1, np.cumsum(toxic), np.cumsum(1 - toxic)) % 4 == 0
    inside = np.flatnonzero(~turn)
    marked = marked_features([Counter(words[i]) for i in inside], toxic[inside])
    hits: dict[bytes, bool] = {}

    def tags(found: list[bytes], y: int) -> np.ndarray:
        if not y:
            return np.zeros(len(found), bool)
        for w in found:
            if w not in hits:
                hits[w] = any(f in marked for f in features(w))
        return np.fromiter((hits[w] for w in found), bool, len(found))

    tagged = [tags(words[i], toxic[i]) for i in inside]
    # a toxic document without any marked word teaches nothing about its words
    use = [k for k, i in enumerate(inside) if not toxic[i] or tagged[k].any()]
    field = fit_field([words[inside[k]] for k in use], [tagged[k] for k in use])
    outside = np.flatnonzero(turn)
    scorer = Scorer(field)
    sums, counts = scorer.expected([words[i] for i in outside])[:2]
    return field | {"curve": fit_curve(evidence(sums, counts), toxic[outside].astype(float)).tolist()}


# scoring --------------------------------------------------------------------------------------------------------------


class Scorer:
    """A model in a task; words that it has met keep their weight."""

    def __init__(self, model: dict):
        self.model, self.known = model, {}
        self.link = np.array(model["link"])

    def weight(self, word: bytes) -> float:
        weights = self.model["weights"]
        total = self.model["bias"] + weights.get(word + b" ", 0.0)
        for k in STEMS:
            if k > len(word):
                break
            total += weights.get(word[:k], 0.0)
        return total

    def expected(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(expected toxic words, words) of each text; marginals of all words; where each text begins."""
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        if not starts[-1]:
            return np.zeros(len(texts)), sizes, np.zeros(0), starts
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for t in texts:
            for w in set(t).difference(known):
                known[w] = self.weight(w)
        emission = np.concatenate([np.fromiter(map(known.__getitem__, t), float, len(t)) for t in texts])
        first = np.zeros(len(emission), bool)
        first[starts[:-1][sizes > 0]] = True
        marginal = Chains(first).run(emission, self.link, self.model["begin"])[0]
        sums = np.concatenate(([0.0], np.cumsum(marginal)))
        return np.maximum(sums[starts[1:]] - sums[starts[:-1]], 0.0), sizes, marginal, starts

    def score(self, expected: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence(expected, n_words) @ np.array(self.model["curve"]), -30, 30)))


def spans(text: bytes, words: list[bytes], hot: np.ndarray) -> list[dict[str, int]]:
    """Code point offsets [begin, end) of runs of hot words next to each other."""
    data = np.frombuffer(text, np.uint8)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    letter = np.concatenate(([False], (data >= 128) | ((data | 32) >= 97) & ((data | 32) <= 122) & (data >= 65), [False]))
    begin, end = np.flatnonzero(letter[1:] & ~letter[:-1]), np.flatnonzero(~letter[1:] & letter[:-1])
    at = np.flatnonzero(hot)
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    return [{"begin": int(points[begin[r[0]]]), "end": int(points[end[r[-1]]])} for r in np.split(at, cut) if len(r)]


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from; a null id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, bound: int = FIT_DOCS) -> dict:
    """The model of labelled documents; labels (doc_id, toxic) with a null are left out, one 1 outweighs other labels of an id.

    Of each label about ``bound`` documents are taken, those with the smallest
    hashes: how many labels there are says how small. So the sample doesn't grow with the
    labels and no task sorts them.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    count = known.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    share = [min(1.0, bound / max(1, n)) for n in count]
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where(place <= F.when(F.col("toxic") == 1, share[0]).otherwise(share[1]))
    # stored: few rows, whose size Spark knows
    sample = stored(sample.withColumnRenamed("doc_id", "sample_id"), "sample")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.length("text") <= FIT_BYTES)
    chosen = texts.join(sample, F.col("doc_id") == F.col("sample_id")).select("text", "toxic")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, y = [], []
        for batch in batches:
            found += batch.column("text").to_pylist()
            y += batch.column("toxic").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(found, y))], pa.binary())], names=["model"])

    # a bounded sample: one task fits it
    model = stored(chosen.repartition(1).mapInArrow(task, "model binary"), "model")
    made = model.first()
    return pickle.loads(made["model"]) if made else fit([], [])


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, spans: the probability of being toxic for each row of ``docs`` (doc_id, text), and its offending places.

    spans: [begin, end) in code points of runs of words whose toxic tag has a
    marginal of ``SPAN`` or more. A null or empty text has no words: the least
    score, no spans. Each row is scored by its text alone, repeated rows alike. No rows: no rows. Other
    columns are not looked at.
    """
    made = []

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        if not made:
            made.append(Scorer(model))
        words = [split(t) for t in texts]
        expected, n_words, marginal, starts = made[0].expected(words)
        score = made[0].score(expected, n_words)
        places = []
        for i, text in enumerate(texts):
            hot = marginal[starts[i] : starts[i + 1]] >= SPAN
            places.append(spans(text, words[i], hot) if hot.any() else [])
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return [pa.array(score, pa.float64()), pa.array(places, kind)]

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_texts(texts, "text", "score double, spans array<struct<begin:bigint,end:bigint>>", work, keep=["doc_id"])
