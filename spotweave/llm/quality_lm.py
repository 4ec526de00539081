"""Perplexity of documents under an interpolated modified Kneser-Ney model of trusted text.

The units are characters, with white space as one blank: the number of different
n-grams then follows from the languages, and hardly from the size of the corpus.
There is one model for each language and fold. Counts, continuation counts, discounts and
interpolated probabilities are joins and aggregations in Spark. The model is cut
into shards by the context's last two characters, so all orders of a position
lie in one shard; each shard has a bounded size and is joined to the documents
in its own pass, inside the tasks, so the text is never shuffled for scoring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from spotweave.llm.batches import free_name, slices
from spotweave.session import forget, stored

ORDER = 5
#: Entries of a model shard that tasks hold at once, on average.
SHARD_ENTRIES = 2_000_000
#: Bytes of text that a task counts or scores at once, and characters that it looks up at once: numpy holds about 80 bytes for each.
COUNT_BYTES, SCORE_BYTES, LOOKED_UP = 2 << 20, 1 << 20, 1 << 18
#: Share of the trusted documents of a language that the threshold keeps.
QUANTILE = 0.995
#: Parts of the documents; each is judged by models of the trusted text of the other parts.
FOLDS = 2
#: Before the first character of a text.
PAD = "\x02"
#: Resolution of the exact histogram of deviations.
BINS = 1000
#: Bits of the filter of trusted ids that most other texts don't pass: 2 MB, whatever the number of ids.
FILTER_BITS = 1 << 24
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _codes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each after order - 1 pads; number of characters of each text)."""
    clean = [" ".join((t or "").split()) for t in texts]
    pad = PAD * (order - 1)
    codes = np.frombuffer("".join(pad + t for t in clean).encode("utf-32-le"), "<u4").astype(np.uint64)
    return codes, np.fromiter(map(len, clean), np.int64, len(clean))


def _positions(lengths: np.ndarray, order: int) -> np.ndarray:
    """Where in the codes the characters of the texts are, without pads."""
    return np.arange(lengths.sum()) + (order - 1) * np.repeat(np.arange(1, len(lengths) + 1), lengths)


def _keys(codes: np.ndarray, last: np.ndarray, order: int) -> np.ndarray:
    """64-bit keys of the n-grams of ``order`` characters that end at ``last``; never 0."""
    h = np.full(len(last), order, np.uint64) * _SPREAD  # far from any code point, so orders do not meet
    for j in range(order - 1, -1, -1):
        h = (h ^ codes[last - j]) * _MIX
        h ^= h >> np.uint64(29)
    return (h * _SPREAD) | np.uint64(1)


class Table:
    """Values by non-zero 64-bit key in two arrays with open addresses; 0 marks a free place."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.float32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = self._place(keys[left], step)
            free = self.keys[at] == 0
            at, first = np.unique(at[free], return_index=True)
            chosen = left[free][first]
            self.keys[at], self.values[at] = keys[chosen], values[chosen]
            left = np.setdiff1d(left, chosen, assume_unique=True)
            step += 1

    def _place(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys >> self.shift) + np.uint64(step)) & np.uint64(len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, NaN where it has none."""
        out = np.full(len(keys), np.nan, np.float32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = self._place(keys[left], step)
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (there != 0)]
            step += 1
        return out


def ngram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n: all n-grams of ``order`` characters of the texts; counted in the tasks, then over all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", COUNT_BYTES):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    codes, lengths = _codes(texts, order)
                    last = _positions(lengths, order)
                    if not len(last):
                        continue
                    _, first, n = np.unique(_keys(codes, last, order), return_index=True, return_counts=True)
                    window = codes[last[first][:, None] + np.arange(1 - order, 1)].astype("<u4")
                    whole = window.tobytes().decode("utf-32-le")
                    grams = [whole[i : i + order] for i in range(0, len(whole), order)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams)), pa.array(grams), pa.array(n, pa.int64())], names=["lang", "gram", "n"]
                    )

    seen = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInArrow(task, "lang string, gram string, n long")
    return seen.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _levels(counts: DataFrame, order: int) -> DataFrame:
    """lang, gram, n for all orders: counts of the highest, below it the number of different characters seen before the gram."""
    longer = counts.select("lang", F.explode(F.array(*(F.substring("gram", 1 + order - k, k) for k in range(2, order + 1)))).alias("longer"))
    lower = longer.distinct().groupBy("lang", F.expr("substring(longer, 2)").alias("gram")).agg(F.count("*").alias("n"))
    return counts.union(lower)


def _discounts(levels: DataFrame) -> DataFrame:
    """lang, k, d1, d2, d3: modified Kneser-Ney discounts from counts of counts; common values where those are too few."""
    c = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"c{i}") for i in (1, 2, 3, 4)]
    counted = levels.groupBy("lang", F.length("gram").alias("k")).agg(*c)
    y = F.try_divide(F.col("c1"), F.col("c1") + 2 * F.col("c2"))

    def one(i: int, common: float) -> Column:
        d = i - (i + 1) * y * F.try_divide(F.col(f"c{i + 1}"), F.col(f"c{i}"))
        return F.when((F.col(f"c{i}") > 0) & (d > 0) & (d < i), d).otherwise(common).alias(f"d{i}")

    return counted.select("lang", "k", one(1, 0.5), one(2, 1.0), one(3, 1.5))


def train(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """Model of the texts (lang, text): lang, kind, gram, value.

    kind 'p': log probability of the gram's last character after the others,
    interpolated over all lower orders; kind 'g': log of the weight that the gram,
    as a context, leaves to the lower order; kind 'u' (gram empty): log
    probability of a character never seen.
    """
    counts = stored(ngram_counts(trusted, order), "counts")
    levels = stored(_levels(counts, order), "levels")
    forget(counts)
    # a row for each language and order, stored so that Spark knows its size
    joined = levels.withColumn("k", F.length("gram")).join(stored(_discounts(levels), "discounts"), ["lang", "k"])
    context = F.expr("left(gram, k - 1)")
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    freed = joined.select("lang", "k", "gram", context.alias("context"), "n", d.alias("d"))
    # as many rows for a context as there are characters
    same = Window.partitionBy("lang", "k", "context")
    total = F.sum("n").over(same)
    parts = freed.select(
        "lang",
        "k",
        "gram",
        "context",
        ((F.col("n") - F.col("d")) / total).alias("seen"),
        (F.sum("d").over(same) / total).alias("weight"),
        F.count("*").over(same).alias("types"),
    )
    parts = stored(parts, "parts")
    forget(levels)
    # the weights of contexts: every gram of a context has the same
    weights = parts.groupBy("lang", "k", "context").agg(F.first("weight").alias("weight"), F.first("types").alias("types"))
    unseen = F.when(F.col("k") == 1, F.log(F.col("weight") / (F.col("types") + 1))).otherwise(F.log("weight"))
    model = weights.select("lang", F.when(F.col("k") == 1, "u").otherwise("g").alias("kind"), F.col("context").alias("gram"), unseen.alias("value"))
    lower, orders = None, []
    for k in range(1, order + 1):
        own = parts.where(F.col("k") == k)
        if lower is None:
            p = own.select("lang", "gram", (F.col("seen") + F.col("weight") / (F.col("types") + 1)).alias("p"))
        else:
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            own = own.withColumn("suffix", F.expr("substring(gram, 2)")).join(below, ["lang", "suffix"])
            p = own.select("lang", "gram", (F.col("seen") + F.col("weight") * F.col("below")).alias("p"))
        lower = stored(p, f"order{k}")
        orders.append(lower)
        model = model.union(lower.select("lang", F.lit("p").alias("kind"), "gram", F.log("p").alias("value")))
    model = stored(model, "model")
    forget(parts, *orders)
    return model


def _shard_of(shards: int) -> Column:
    """Shard of a model row: by the last two characters of its context; -1 (all shards) if the context is shorter."""
    context = F.when(F.col("kind") == "g", F.col("gram")).otherwise(F.expr("left(gram, length(gram) - 1)"))
    a, b = F.substring(context, -2, 1), F.substring(context, -1, 1)
    return F.when(F.length(context) >= 2, (31 * F.ascii(a) + F.ascii(b)) % shards).otherwise(-1)


def keyed(model: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """name, key, value: the model with the place of its (lang, kind) in ``names`` and a 64-bit key in place of each gram."""
    number = {v: i for i, v in enumerate(names)}
    kind, width = (pa.int16(), "short") if len(names) < 1 << 15 else (pa.int32(), "int")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("gram").to_pylist()
            lengths = np.fromiter(map(len, grams), np.int64, len(grams))
            keys = np.zeros(len(grams), np.uint64)
            for k in np.unique(lengths[lengths > 0]).tolist():
                own = np.flatnonzero(lengths == k)
                codes = np.frombuffer("".join(grams[i] for i in own).encode("utf-32-le"), "<u4").astype(np.uint64)
                keys[own] = _keys(codes, np.arange(k - 1, len(codes), k), k)
            at = [number[v] for v in zip(batch.column("lang").to_pylist(), batch.column("kind").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, kind), pa.array(keys.view(np.int64)), batch.column("value")], names=["name", "key", "value"])

    return model.select("lang", "kind", "gram", F.col("value").cast("float").alias("value")).mapInArrow(task, f"name {width}, key long, value float")


class Shard:
    """Model rows of a shard; a worker makes the tables once and keeps them for its later tasks."""

    def __init__(self, rows: pa.Table, names: list[tuple[str, str]]):
        self.names = names
        self.name, self.keys, self.values = (rows.column(c).to_numpy() for c in ("name", "key", "value"))
        self.made: dict[str, tuple[Table, Table, float]] | None = None

    def tables(self) -> dict[str, tuple[Table, Table, float]]:
        """For each language the tables of probabilities and weights, and the value of an unseen character."""
        if self.made is None:
            keys, self.made = self.keys.view(np.uint64), {}
            for lang in {v for v, _ in self.names}:
                own = {k: self.name == i for i, (v, k) in enumerate(self.names) if v == lang}
                none = np.zeros(len(keys), bool)
                p, g = (Table(keys[m], self.values[m]) for m in (own.get("p", none), own.get("g", none)))
                self.made[lang] = (p, g, float(self.values[own["u"]][0]))
            self.name = self.keys = self.values = None  # the tables have them
        return self.made


def _log_probs(codes: np.ndarray, last: np.ndarray, tables: tuple[Table, Table, float], order: int) -> np.ndarray:
    p, g, unseen = tables
    out = p.get(_keys(codes, last, order))
    left = np.flatnonzero(np.isnan(out))
    backed = np.zeros(len(left), np.float32)
    for k in range(order - 1, 0, -1):
        if not len(left):
            break
        backed += np.nan_to_num(g.get(_keys(codes, last[left] - 1, k)), nan=0.0)
        found = p.get(_keys(codes, last[left], k))
        hit = ~np.isnan(found)
        out[left[hit]] = found[hit] + backed[hit]
        left, backed = left[~hit], backed[~hit]
    out[left] = unseen + backed
    return out


def _summed(totals: np.ndarray, codes: np.ndarray, last: np.ndarray, row: np.ndarray, tables: tuple[Table, Table, float], order: int) -> np.ndarray:
    """``totals`` by row with the log probabilities of the characters added, one after the other; some are looked up at once."""
    first = np.arange(len(totals))
    for i in range(0, len(last), LOOKED_UP):
        logs = _log_probs(codes, last[i : i + LOOKED_UP], tables, order)
        # a total goes in front of what is added to it, so the order of additions, and each bit, is that of one sum
        totals = np.bincount(np.concatenate((first, row[i : i + LOOKED_UP])), np.concatenate((totals, logs)), len(totals))
    return totals


def broadcast_shards(model: DataFrame, shard_entries: int = SHARD_ENTRIES) -> list[Broadcast]:
    """The shards of a model, each in a broadcast of its own; they pass through the driver one by one."""
    names = sorted((r.lang, r.kind) for r in model.select("lang", "kind").distinct().collect())  # a few for each language and fold
    shards = max(1, math.ceil(model.count() / shard_entries))
    held, spark = _shard_of(shards), model.sparkSession
    return [spark.sparkContext.broadcast(Shard(keyed(model.where((held == s) | (held == -1)), names).toArrow(), names)) for s in range(shards)]


def score(
    docs: DataFrame, model: DataFrame | list[Broadcast], order: int = ORDER, keep: list[str] | None = None, by: str = "lang", shard_entries: int = SHARD_ENTRIES
) -> tuple[DataFrame, str]:
    """(``docs`` with its columns ``keep`` and one more, that column's name): log perplexity per character.

    Null for a text without characters, and for a language that the model doesn't
    know. ``docs`` has text and ``by``, the language; a null one is a language of its own. A model that
    scores several tables is given as its ``broadcast_shards``.
    """
    keep = docs.columns if keep is None else keep
    name = free_name(docs, "log_perplexity")
    held = model if isinstance(model, list) else broadcast_shards(model, shard_entries)
    shards = len(held)
    sum_name = free_name(docs, f"{name}_sum")
    current = docs.withColumns({sum_name: F.lit(0.0)})
    for s, tables in enumerate(held):
        final = s == shards - 1
        columns = (keep if final else docs.columns) + [name if final else sum_name]

        def task(batches, s=s, tables=tables, columns=columns, final=final):
            known = tables.value.tables()
            for batch in batches:
                for part in slices(batch, "text", SCORE_BYTES):
                    langs = [v or "" for v in part.column(by).to_pylist()]
                    texts, total = part.column("text").to_pylist(), part.column(sum_name).to_numpy().copy()
                    n = np.zeros(len(texts), np.int64)
                    for lang in set(langs) & known.keys():
                        own = np.array([i for i, v in enumerate(langs) if v == lang])
                        codes, lengths = _codes([texts[i] for i in own], order)
                        last = _positions(lengths, order)
                        row = np.repeat(np.arange(len(own)), lengths)
                        if shards > 1:
                            mine = (31 * codes[last - 2] + codes[last - 1]) % np.uint64(shards) == s
                            last, row = last[mine], row[mine]
                        total[own] += _summed(np.zeros(len(own)), codes, last, row, known[lang], order)
                        n[own] = lengths
                    value = pa.array(-total / np.maximum(n, 1), mask=n == 0) if final else pa.array(total)
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in columns[:-1]] + [value], names=columns)

        schema = current.select(*(F.col(f"`{c}`") for c in columns[:-1]), F.lit(0.0).cast("double").alias(columns[-1])).schema
        for field in schema:
            field.nullable = True
        current = current.mapInArrow(task, schema)
        if not final:
            current = stored(current, "shard")
    return current, name


def _spread(n: Column) -> Column:
    """Standard deviation of the log perplexity of a text of ``n`` characters, by the language's ``a`` and ``b``."""
    return F.sqrt(F.col("a") + F.col("b") / F.greatest(n, F.lit(1)))


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """lang, mean, a, b, cut: a document of n characters is rejected above ``mean + cut * sqrt(a + b / n)``.

    ``scored``: lang, n, log_perplexity of trusted documents, each by a model
    that wasn't trained on it. Short texts vary more: the variance about the language's mean
    is fitted as ``a + b / n`` by least squares over its trusted documents. The
    cut is the interpolated ``quantile`` of their deviations in units of that
    spread, so it never exceeds their maximum. One rule for each language at any number of documents,
    from sums and an exact histogram, whose number of bins doesn't depend on it.
    """
    known = scored.where("log_perplexity IS NOT NULL")
    y, x = F.col("log_perplexity"), 1 / F.greatest(F.col("n"), F.lit(1))
    sums = known.groupBy("lang").agg(
        F.avg(y).alias("mean"), F.avg(x).alias("x"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), F.avg(x * y).alias("xy"), F.avg(x * y * y).alias("xyy")
    )
    mean = F.col("mean")
    var = F.greatest(F.col("yy") - mean * mean, F.lit(0.0))
    cross = F.col("xyy") - 2 * mean * F.col("xy") + mean * mean * F.col("x") - F.col("x") * var
    slope = F.greatest(F.coalesce(F.try_divide(cross, F.col("xx") - F.col("x") * F.col("x")), F.lit(0.0)), F.lit(0.0))
    # some part of the variance is left to texts of any length, and none is without any
    floor = F.greatest(var - slope * F.col("x"), 0.05 * var, F.lit(1e-6))
    spread = stored(sums.select("lang", "mean", floor.alias("a"), slope.alias("b")), "spread")
    z = (F.col("log_perplexity") - F.col("mean")) / _spread(F.col("n"))
    bins = known.join(spread, "lang").groupBy("lang", F.ceil(z * BINS).alias("bin")).agg(F.count("*").alias("n"))
    bins = stored(bins, "bins")
    each = Window.partitionBy("lang")
    rows = bins.select("lang", "bin", F.sum("n").over(each.orderBy("bin")).alias("up_to"), F.sum("n").over(each).alias("all_n"))
    at = (F.col("all_n") - 1) * F.lit(quantile)
    below, above = (F.min(F.when(F.col("up_to") > f(at), F.col("bin"))) for f in (F.floor, F.ceil))
    share = F.first(at - F.floor(at))
    cuts = rows.groupBy("lang").agg(((below + (above - below) * share) / BINS).alias("cut"))
    return spread.join(cuts, "lang")


def _limit() -> Column:
    """The log perplexity above which a document of ``n`` characters is rejected."""
    return F.col("mean") + F.col("cut") * _spread(F.col("n"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents with quality 1 in every one of their labels."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def _likely(ids: DataFrame, bits: int = FILTER_BITS) -> Column:
    """True for each of ``ids`` and for few other doc_ids: a bit for the hash of an id, in one value of a fixed size."""
    words = bits // 64
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    word, bit = F.floor(slot / 64), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    held = ids.groupBy(word.alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = ids.sparkSession.range(words).join(held, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    mask = stored(every.agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).getField("bits").alias("mask")), "id_filter")
    return F.get(mask.scalar(), word.cast("int")).bitwiseAND(bit) != 0


def _model_name(fold: Column) -> Column:
    return F.concat(F.coalesce("lang", F.lit("")), F.lit("\x1f"), fold.cast("string"))


def _with_fold(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``: the model, one for each language and fold, that judges the document; folds are by the hash of doc_id."""
    return docs.withColumn(name, _model_name(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))))


def _fit(docs: DataFrame, labels: DataFrame, order: int, quantile: float) -> tuple[list[Broadcast], DataFrame, DataFrame]:
    """(models of all languages and folds, scored documents, thresholds)."""
    ids = trusted_ids(labels)
    texts = _with_fold(docs.select("doc_id", "lang", "text"), "model")
    # the same plan at every size: labels grow with the corpus, so they are never broadcast; the filter spares
    # most other texts the shuffle of the exact join
    trusted = texts.where(_likely(ids)).join(ids.hint("merge"), "doc_id", "left_semi")
    # the model of a fold is trained on the trusted documents outside it
    models = F.explode(F.array(*(_model_name(F.lit(i)) for i in range(FOLDS)))).alias("for_model")
    model = train(trusted.select("model", "text", models).where("for_model <> model").select(F.col("for_model").alias("lang"), "text"), order)
    held = broadcast_shards(model)
    forget(model)
    sized = texts.withColumn("n", F.length("text").cast("long"))
    rows, name = score(sized, held, order, ["doc_id", "lang", "n"], by="model")
    scored = stored(rows.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "n", F.col(name).alias("log_perplexity")), "scored")
    return held, scored, stored(thresholds(scored.join(ids, "doc_id", "left_semi"), quantile), "thresholds")


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept for each row of ``docs`` (doc_id, lang, text, ...).

    ``labels``: doc_id, quality; the documents with quality 1 are the trusted
    text. The documents are dealt in two folds by the hash of the id, and each is
    scored by a model of the trusted text of the other fold, so all trusted
    documents set the thresholds and none is scored by a model that read it.
    kept: the perplexity per character doesn't exceed the threshold of the
    language for a text of this length.

    A text without characters and a language without trusted text have no
    perplexity and are kept: there is nothing to judge them by. A null lang counts
    as a language of its own, with lang empty. A null doc_id is scored but never
    trusted. Repeated rows are scored each. Labels of unknown documents do
    nothing. No rows: no rows.
    """
    _, scored, cuts = _fit(docs, labels, order, quantile)
    joined = scored.join(cuts, "lang", "left")  # stored: a row for each language
    return joined.select(
        "doc_id",
        "lang",
        F.exp("log_perplexity").alias("perplexity"),
        F.exp(_limit()).alias("threshold"),
        F.coalesce(F.col("log_perplexity") <= _limit(), F.lit(True)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """Rows of ``docs`` that ``classify`` keeps, with all their columns."""
    model, _, cuts = _fit(docs, labels, order, quantile)
    by = free_name(docs, "model")
    rows, name = score(_with_fold(docs, by), model, order, docs.columns, by)
    lang, limit = free_name(docs, "cut_lang"), free_name(docs, "cut_rule")
    rule = F.struct("mean", "a", "b", "cut").alias(limit)
    joined = rows.join(cuts.select(F.col("lang").alias(lang), rule), F.coalesce(rows["lang"], F.lit("")) == F.col(lang), "left")
    r, n = F.col(limit), F.greatest(F.length(rows["text"]), F.lit(1))
    good = joined.where(F.coalesce(F.col(name) <= r["mean"] + r["cut"] * F.sqrt(r["a"] + r["b"] / n), F.lit(True)))
    return good.select(*(F.col(f"`{c}`") for c in docs.columns))
