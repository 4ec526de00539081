"""Lexical search, source divergence and toxic spans against plain Python versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.llm import divergence, pair_search, toxic_spans
from spotweave.llm.terms import splitter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, n long, item long, score double, held binary"
WORDS = "the of and ing er tion der ung ß É 7 42 x9 ñ".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(WORDS, rng.integers(1, 3))) for _ in range(n))


def rows(texts, langs=("en", "de", None), sources=("a", "b", None, "")):
    return [
        (i, t, langs[i % len(langs)], sources[i * i % 7 % len(sources)], 0, "t", 1, 2, 0.5, b"x") for i, t in enumerate(texts)
    ]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def terms(text, digits=True):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


TEXTS = [None, "", " \n", "!?", "One", "one", "ONE two", "É É é", "7 42 x9x", "\x00a\x7fb\x80c", prose(1, 30000), *(prose(i, 5 + 7 * i) for i in range(2, 40))]
TEXTS += [TEXTS[20]] * 30


def test_terms():
    for text in [*TEXTS[:10], *TEXTS[11:]]:
        for digits in (True, False):
            assert [t.decode() for t in splitter(digits)((text or "").encode())] == terms(text, digits)
    assert splitter(True)(None) == []


def brute_search(docs, items, k=20):
    held = [(d, Counter(t)) for d, t in ((r[0], terms(r[1])) for r in docs) if t]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for doc, c in held:
            score = 0
            for t, q in asked.items():
                df = sum(t in other for _, other in held)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                m = 75 + 25 * sum(c.values()) * n_docs // total
                score += q * w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,pairs,passes", [(2048, 32, 500_000), (7, 4, 500_000), (1, 0, 40)])
def test_search_is_brute_force(spark, monkeypatch, block, pairs, passes):
    monkeypatch.setattr(pair_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(pair_search, "PAIR_TERMS", pairs)
    monkeypatch.setattr(pair_search, "ITEM_TERMS", passes)
    docs = rows(TEXTS) + [(None, prose(3, 40), *rows(TEXTS)[0][2:]), (20, prose(9, 9), *rows(TEXTS)[0][2:])]
    items = [(1, prose(50, 30)), (2, prose(2, 19) + " " + prose(2, 19)), (3, None), (4, ""), (5, "nowhere else"), (5, "The the THE of"), (None, "one É 42")]
    table = spark.createDataFrame(docs, DOCS).repartition(5)
    found = pair_search.search(table, spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("x")))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_search(docs, items)


def test_search_empty(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "the of")], "item_id long, text string")
    assert pair_search.search(none, items).count() == 0
    assert pair_search.search(spark.createDataFrame(rows(TEXTS[:4]), DOCS), items).count() == 0
    assert pair_search.search(spark.createDataFrame(rows(TEXTS), DOCS), items.limit(0)).count() == 0


def test_block_bounds_hold():
    """No unit of a block gives a document more than its bound, nor one outside the pair's list more than the other bound."""
    rng = np.random.default_rng(3)
    held = [np.sort(rng.choice(12, rng.integers(1, 9), replace=False)).astype("<i4") for _ in range(60)]
    times = [rng.integers(1, 9, len(h)) for h in held]
    weights = rng.integers(0, 5000, 12)
    raw = pair_search._block(list(range(60)), [int(t.sum()) for t in times], held, times, weights, [3, 1, 4, 5], 60, 5000)
    block = pair_search._Block(dict(zip(pair_search._KINDS, raw)), weights)
    asked = np.array([0, 1, 3, 4, 5, 7])
    repeats = np.array([1, 3, 1, 2, 1, 5])
    place = block.place[asked]
    units = block.units(asked[place >= 0], repeats[place >= 0])
    assert any(u[3] >= 0 for u in units)
    for bound, alone, members, pair in units:
        score = np.zeros(60, np.int64)
        for p, q in members:
            ords, got = block.list_of(p)
            score[ords] += q * got
        assert score.max() <= bound
        if pair >= 0:
            inside = block.pair_ords[block.pair_starts[pair] : block.pair_starts[pair + 1]]
            assert np.delete(score, inside).max() <= alone


def brute_audit(docs, min_docs=3, top=200):
    count, in_docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        found = terms(text, False)
        count[lang, source].update(found)
        in_docs[lang].update(set(found))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        whole = Counter({t: sum(count[lang, s][t] for s in sources) for t in kept})

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(count[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            near = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", near, top)):
                out += [(lang, s, part, i, -v, r + 1) for r, (v, _, i) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.mark.parametrize("segment,block", [(2048, 64), (8, 64), (16, 2)])
def test_audit_is_brute_force(spark, monkeypatch, segment, block):
    monkeypatch.setattr(divergence, "SEGMENT", segment)
    monkeypatch.setattr(divergence, "BLOCK", block)
    docs = rows(TEXTS) + [(90, "", "xx", "alone", *rows(TEXTS)[0][4:])] + [(i, "", "yy", f"s{i}", *rows(TEXTS)[0][4:]) for i in range(3)]
    docs += [(100 + i, prose(60 + i % 5, 40), "zz", f"src{i % 9}", *rows(TEXTS)[0][4:]) for i in range(45)]
    found = divergence.audit(spark.createDataFrame(docs, DOCS).repartition(5), top=7)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute_audit(docs, top=7)


def test_audit_empty(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_trees_share_equal_subtrees():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (6, 256))
    counts[:, 64:192] = 0
    counts[3] = counts[1]
    roots, levels, leaves = trees = divergence.cons(counts)
    assert roots[3] == roots[1] and leaves.tolist() == [0, 1, 2]
    assert sum(map(len, levels)) < counts.size / 2
    totals = counts.sum(1)
    a, b = np.triu_indices(6, 1)
    forth, other = divergence.price(a, b, totals, 256, trees)
    p = 1 + 10**9 * (counts + 1) // (totals + 256)[:, None]
    assert forth.tolist() == [int(((p[i] - p[j]) ** 2 // p[j]).sum()) for i, j in zip(a, b)]
    assert other.tolist() == [int(((p[i] - p[j]) ** 2 // p[i]).sum()) for i, j in zip(a, b)]
    big = np.array([2**40, 5])
    assert divergence._shares(big, np.array([2**41, 2**41]), 7).tolist() == [1 + 10**9 * (c + 1) // (2**41 + 7) for c in big.tolist()]


# toxicity -------------------------------------------------------------------------------------------------------------


def brute_marginals(emission, link, begin):
    """Over all tag sequences of one chain."""
    n, total, toxic = len(emission), 0.0, np.zeros(len(emission))
    for code in range(1 << n):
        tags = [code >> i & 1 for i in range(n)]
        s = sum(e for e, t in zip(emission, tags) if t) + begin * tags[0]
        s += sum(link[2 * a + b] for a, b in zip(tags, tags[1:]))
        w = math.exp(s)
        total += w
        toxic += w * np.array(tags)
    return toxic / total


def test_marginals_are_brute_force():
    rng = np.random.default_rng(5)
    sizes = [1, 3, 7, 2, 9] * 30  # more words than a lane
    emission, link, begin = rng.normal(0, 2, sum(sizes)), np.array([0.0, -1.0, 0.5, 1.5]), -0.7
    ends = np.cumsum(sizes)
    first = np.zeros(sum(sizes), bool)
    first[ends - sizes] = True
    got = toxic_spans.Chains(first).run(emission, link, begin)[0]
    want = np.concatenate([brute_marginals(emission[e - n : e], link, begin) for e, n in zip(ends, sizes)])
    assert np.allclose(got, want, atol=1e-12)


def labelled(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words, y = ["".join(rng.choice(list("abdegilmnorst"), rng.integers(2, 7))) for _ in range(rng.integers(10, 80))], int(i % 4 == 0)
        for k in rng.choice(len(words), 3 if y else 0, replace=False):
            words[k] = "vexqu" + "".join(rng.choice(list("aeiou"), 3))
        out.append((i, " ".join(words).capitalize() + ".", y))
    return out


def test_toxic_documents(spark):
    made = labelled(400)
    odd = [(1000, None), (1001, ""), (1002, "?! 12"), (1003, "Ünd vexquaio,\nvexquoia x " + "fine words " * 20000), (None, "vexquuue vexquiii vexquooo a b"), (3, made[3][1])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in made] + odd, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("text_in", F.lit(1))
    # labels of held-out rows say the opposite: nothing may be learned from them
    shown = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in made] + [(None, 1), (5, None), (77777, 1)]
    labels = spark.createDataFrame(shown, "doc_id long, toxic int")
    model = toxic_spans.fit_model(docs, labels)
    assert toxic_spans.fit_model(docs.repartition(7), labels.repartition(3)) == model
    found = toxic_spans.score_documents(docs, model).collect()
    assert len(found) == len(made) + len(odd)
    score = {r.doc_id: r.score for r in found}
    truth = {i: y for i, _, y in made}
    right = [(score[i] >= 0.7) == (y == 1) for i, y in truth.items()]
    assert np.mean(right) >= 0.98
    assert score[1000] == score[1001] == score[1002] < 0.5
    assert score[None] >= 0.7
    spans = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in found}
    assert spans[1003] == [(4, 12), (14, 22)] or spans[1003] == [(4, 22)]
    assert spans[1000] == []
    held = docs.select("doc_id", toxic_spans.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(1, 1)], [(2, 1), (1, 0)]):
        model = toxic_spans.fit_model(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [0 <= r.score <= 1 for r in toxic_spans.score_documents(docs, model).collect()] == [True, True]
    assert toxic_spans.score_documents(docs.limit(0), model).count() == 0
