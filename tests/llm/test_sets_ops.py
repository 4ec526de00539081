"""SimHash groups, mixing, URL rules, top-k search, the language model and the pipeline against plain Python versions."""

import hashlib
import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from spotweave.llm import batches, components, line_dedup, mixing, near_copies, quality_lm, queries, simhash, topk_search, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, copy int"
SYLLABLES = {"en": "the of and ing er tion".split(), "de": "der und ung ich sch ß".split()}


def prose(seed: int, n: int, lang: str = "en") -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


def groups_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes)) if hashes else 0


TEXTS = [None, "", " \n", "One", "one", "one two", "a b c", "É É É É", prose(1, 50), prose(1, 50).upper().lower(), prose(2, 40000)]


def test_fingerprint():
    for text in [*TEXTS[:-1], prose(3, 500)]:
        assert simhash.simhash(text) % 2**64 == brute_print(text)


def test_spark_hash_is_the_same(spark):
    row = spark.sql("SELECT xxhash64('the quick fox') AS h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"the quick fox", 42)


@pytest.mark.parametrize("paired", [0, 3, 24])
def test_links_keep_components(spark, paired):
    rng = np.random.default_rng(4)
    prints = {0, 1, 3, 7, 15, -1, -2, -4, 1 << 40, -(1 << 63)}
    for _ in range(30):  # clouds of close fingerprints and chains
        at = int(rng.integers(-(2**63), 2**63, dtype=np.int64))
        for _ in range(40):
            prints.add(at)
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            turned = at % 2**64
            for b in bits:
                turned ^= 1 << int(b)
            at = turned - 2**64 if turned >= 2**63 else turned
    prints = sorted(prints)
    close = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 2]
    want = groups_of(prints, close)
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), paired)
    assert groups_of(prints, [(r.a, r.b) for r in edges.collect()]) == want
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert {n: c for n, c in want.items() if n in got} == got
    assert all(want[n] == n and list(want.values()).count(n) == 1 for n in want if n not in got)


def test_components_of_odd_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    assert components.components(frame([])).count() == 0
    rows = [(5, 5), (1, 2), (2, 1), (2, 3), (None, 4), (9, 8)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.component for r in components.components(frame(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 8, 8: 8} | {i: 100 for i in range(100, 161)}


def near_rows():
    base = prose(10, 400).split()
    rows = [(50 - i, " ".join(base)) for i in range(5)] + [(60, " ".join(base[:-1] + ["changed"])), (None, " ".join(base)), (50, " ".join(base))]
    rows += list(enumerate(TEXTS, 100)) + [(None, prose(77, 90)), (None, prose(77, 90)), (200, prose(78, 90)), (200, prose(79, 90))]
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    frame = spark.createDataFrame([(i, t, "en", "s", 1, "clash", 1) for i, t in rows], DOCS)
    prints = [brute_print(t) for _, t in rows]
    same = groups_of(set(prints), [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 2])
    least = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        least[same[p]] += [i] if i is not None else []
    want = Counter((i, f"{p:016x}", min(least[same[p]], default=None)) for (i, _), p in zip(rows, prints))
    got = simhash.near_duplicates(frame).select("doc_id", simhash.hex_print("fp").alias("h"), "component_id")
    assert Counter(map(tuple, got.collect())) == want
    assert simhash.near_duplicates(frame.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    ids = Counter(r.doc_id for r in kept.collect())
    want_ids = Counter(min(v) if v else None for v in least.values())
    # two texts of one id may lie in two groups
    assert {k: v for k, v in ids.items() if k != 200} == {k: v for k, v in want_ids.items() if k != 200} and ids[200] == 2
    assert simhash.drop_near_duplicates(frame.limit(0)).count() == 0


def edited_rows():
    """Originals, each with exact and edited copies on both sides of the similarity; a crowd of close copies of one text."""
    rng = np.random.default_rng(8)
    texts = ["", None, "one two", "One  two", "a b c d e f g h", "a b c d e f g h i"]
    for i, (n, edits) in enumerate([(60, 1), (120, 2), (200, 5), (300, 4), (500, 30), (900, 12)]):
        base = prose(500 + i, n).split()
        texts += [" ".join(base), " ".join(base).upper()]
        for _ in range(60 if n == 300 else 8):
            copy = list(base)
            for at in rng.choice(n, rng.integers(1, edits + 1), replace=False):
                copy[at] = f"edit{rng.integers(10**9)}"
            texts.append(" ".join(copy))
    return [(1000 - i, t) for i, t in enumerate(texts)]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("rounds", [0, 4])
def test_near_copies_are_linked_at_jaccard(spark, rounds, monkeypatch):
    monkeypatch.setattr(near_copies, "LEADER_ROUNDS", max(rounds, 1))
    monkeypatch.setattr(near_copies, "PAIRS_PER_ROW", 0 if rounds else 10**9)
    rows = edited_rows()
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    close = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if jaccard(sets[i], sets[j]) >= 0.8]
    groups = groups_of(range(len(rows)), close)
    want = {min(rows[i][0] for i in groups if groups[i] == g) for g in set(groups.values())}
    frame = spark.createDataFrame([(i, t, "en", "s", 1, "clash", 1) for i, t in rows], DOCS)
    stage = dict(corpus_pipeline.STAGES)["near-duplicates"]
    kept = stage(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert stage(spark, frame.limit(0), "").count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 7.5, 399.0, 401.0, 900.0, 250000.0, 1.5e7])
def test_poisson_counts_of_any_rate(spark, rate):
    us = [0.0, 1e-9, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 2.0**-52]
    frame = spark.createDataFrame([(u, rate) for u in us], "u double, rate double").repartition(4)
    got = {r.u: r.k for r in frame.select("u", mixing.poisson_count(F.col("rate"), F.col("u")).alias("k")).collect()}
    first = max(0, math.floor(rate - 15 * math.sqrt(rate)))
    k = np.arange(first, math.ceil(rate + 15 * math.sqrt(rate) + 40))
    if rate > 1e5:  # the middle of a wide distribution, by the expansion of Cornish and Fisher
        from statistics import NormalDist

        for u in us[2:-1]:
            z = NormalDist().inv_cdf(u)
            assert abs(got[u] - (rate + math.sqrt(rate) * z + (z * z - 1) / 6)) < 2
        assert math.floor(rate - 12 * math.sqrt(rate)) <= got[us[0]] <= got[us[1]] <= got[us[2]] and got[us[-2]] < got[us[-1]] < k[-1]
        return
    below = np.cumsum([math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) if rate else 1.0 for i in k.tolist()])
    for u in us[1:-1]:
        assert got[u] == first + np.count_nonzero(below <= u)
    assert got[us[-2]] <= got[us[-1]] <= k[-1]


def test_mixing_of_a_small_source(spark):
    rows = [(1, "x", "en", None, 1, None, 0)] + [(2 + i, "y" * 30000, "en", "big", 1, None, 0) for i in range(10)]
    frame = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(frame, mixing.repetition_rates(frame)).where("doc_id = 1").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("m"))
    n, d, m = got.first()
    assert n == d == m + 1 and abs(n - 150000.5) < 6 * math.sqrt(150000)


def test_mixing(spark):
    rows = [(i, "x" * (1 + i % 7), "en", "big" if i % 3 else "small", 1, None, 9) for i in range(6000)]
    rows += [(6000 + i, "null source", "en", None, 1, None, 9) for i in range(300)]
    frame = spark.createDataFrame(rows, DOCS)
    rates = {r.source: r.rate for r in mixing.repetition_rates(frame).collect()}
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(t)
    assert rates == pytest.approx({s: sum(size.values()) / 3 / n for s, n in size.items()})
    mixed = mixing.mix(frame, mixing.repetition_rates(frame))
    assert set(mixed.columns) == {*frame.columns, "order_key"}
    got = mixed.collect()
    keys = [r.order_key for r in got]
    assert keys == sorted(keys)
    # the share of each source is near its target, and counts behave like a Poisson variable
    mass = Counter()
    for r in got:
        mass[r.source] += len(r.text)
    for s, n in size.items():
        assert mass[s] == pytest.approx(sum(size.values()) / 3, rel=0.12)
    counts = Counter(r.doc_id for r in got if r.source == "small")
    each = np.array([counts[i] for i in range(0, 6000, 3)])
    assert each.mean() == pytest.approx(rates["small"], rel=0.05) and each.var() == pytest.approx(rates["small"], rel=0.1)
    assert {(r.doc_id, r.copy) for r in got} == {(i, k) for i, n in Counter(r.doc_id for r in got).items() for k in range(n)}
    # the same on any partitioning
    assert Counter(r.doc_id for r in mixing.mix(frame.repartition(7), mixing.repetition_rates(frame)).collect()) == Counter(r.doc_id for r in got)


def test_query_mixes_whole_documents(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}\n" * (1 + i % 5), "en", "ab"[i % 3 == 0], 7) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    made = []
    store = queries.stored
    monkeypatch.setattr(queries, "stored", lambda df, label: made.append(store(df, label)) or made[-1])
    got = Counter(map(tuple, queries.op10_mixing(spark, str(tmp_path)).collect()))
    (mixed,) = made
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "order_key"]
    texts = {i: t for i, t, *_ in rows}
    found = mixed.collect()
    assert found and all(r.text == texts[r.doc_id] for r in found)
    assert got == Counter((r.doc_id, r.source, r["copy"], r.order_key, hashlib.md5(r.text.encode()).hexdigest()) for r in found)


def test_mixing_targets_and_odd_rows(spark):
    rows = [(1, "aa", "en", "a", 1, None, 0), (1, "aa", "en", "a", 1, None, 0), (None, "bb", "en", "b", 1, None, 0), (3, None, "en", "c", 1, None, 0)]
    frame = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 30.0), ("a", 10.0), ("b", 20.0), ("c", 1.0), ("zz", 5.0)], "source string, weight double")
    rates = {r.source: r.rate for r in mixing.repetition_rates(frame, targets, total=300.0).collect()}
    assert rates == pytest.approx({"a": 300 * 6 * 40 / 60 / 4, "b": 300 * 6 * 20 / 60 / 2, "c": 1.0})
    got = Counter(r.doc_id for r in mixing.mix(frame, mixing.repetition_rates(frame, targets, total=300.0)).collect())
    assert got[1] % 2 == 0 and got[1] > 300 and got[None] > 150
    only_a = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "source string, weight double")
    assert {r.source: r.rate for r in mixing.repetition_rates(frame, only_a).collect()} == pytest.approx({"a": 1.0, "b": 0.0, "c": 0.0})
    assert mixing.mix(frame.limit(0), mixing.repetition_rates(frame.limit(0))).count() == 0


def brute_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, default)))


RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
    ("a.com", "", "block"), ("a.com", "/x", "allow"), ("a.com", "/x/y", "block"), ("b.a.com", "/", "allow"), ("", "/q", "block"), ("xn.co", "/é", "block"),
]


def test_url_rules(spark):
    rng = np.random.default_rng(2)
    hosts = ["org", "example.org", "WWW.Example.ORG", "notexample.org", "a.com", "b.a.com", "c.b.a.com", "ba.com", "com", "xn.co", "a..com", "", ".com", "a.com:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/de/", "/fr/a#/de/", "/de/", "/x", "/x/y/z", "/xy", "?/fr/", "#", "/é\n", "/q", "//fr/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "org/es/", "mailto:x@example.org", "a://b://example.org/es/", "://org/"]
    rows = [(int(i), u, "h", "clash") for i, u in enumerate(urls)] + [(0, urls[0], "h", "x"), (None, "https://example.org/es/x", "h", "x"), (None, None, "h", "x")]
    rows += [(5000 + i, "https://www.example.org/es/" + "x" * int(rng.integers(0, 4)), "h", "x") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    rules = spark.createDataFrame(RULES + [("com", "/de/", "allow")], "host string, path string, verdict string")
    got = Counter(map(tuple, url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert got == Counter((i, *brute_url(u, RULES)) for i, u, *_ in rows)
    none = url_filter.judge_urls(pages, rules.limit(0), default="block")
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "block")}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def brute_top(rows, k, is_query):
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max(len(v) for _, v in valid)
    valid = [(i, v + [0] * (dim - len(v))) for i, v in valid]
    queries = {}
    for i, v in valid:
        if is_query(i):
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, qv in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in valid if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["clusters", "equal", "scaled"])
def test_top_k(spark, shape, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 150)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 8)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 12)) @ np.diag(np.linspace(3, 0.1, 12)) + 2 * rng.normal(size=(5, 12))[rng.integers(0, 5, 900)]
    if shape == "equal":
        v[::2] = v[0]
    if shape == "scaled":
        v *= rng.exponential(size=(900, 1)) ** 2
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    rows += [(1000, None), (1010, [1.0, None]), (1020, [float("nan")] * 12), (1030, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (1040, [1.0]), (1050, [])]
    rows += [(7, [0.5] * 12), (20, [0.5] * 12)]
    frame = spark.createDataFrame([(i, e, 0, 1) for i, e in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = topk_search.top_k(frame, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, lambda i: i % 10 == 0)


def test_top_k_of_few(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.top_k(frame, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 327680), (0, 2, 2, -65536)]
    assert topk_search.top_k(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk_search.top_k(frame, F.col("vec_id") > 9).count() == 0
    assert topk_search.top_k(frame.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def brute_kneser_ney(texts, order):
    """log p(character | context) by the textbook, with dictionaries."""
    pad = quality_lm.PAD * (order - 1)
    level = Counter()
    for t in texts:
        s = pad + " ".join((t or "").split())
        level.update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)))
    levels = {order: level}
    for k in range(order - 1, 0, -1):
        levels[k] = level = Counter(g[1:] for g in level)
    discount, total, types, freed = {}, Counter(), Counter(), Counter()
    for k, level in levels.items():
        c = [sum(n == j for n in level.values()) for j in range(5)]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else None
        d = []
        for j, common in ((1, 0.5), (2, 1.0), (3, 1.5)):
            x = j - (j + 1) * y * c[j + 1] / c[j] if y is not None and c[j] else 0
            d.append(x if 0 < x < j else common)
        discount[k] = lambda n, d=d: d[min(n, 3) - 1]
        for g, n in level.items():
            total[k, g[:-1]] += n
            types[k, g[:-1]] += 1
            freed[k, g[:-1]] += discount[k](n)

    def p(context, ch, k):
        if k == 0:
            return 1 / (types[1, ""] + 1)
        context = context[len(context) - k + 1 :]
        if not total[k, context]:
            return p(context, ch, k - 1)
        n = levels[k][context + ch]
        seen = (n - discount[k](n)) / total[k, context] if n else 0.0
        return seen + freed[k, context] / total[k, context] * p(context, ch, k - 1)

    def log_perplexity(text):
        s = pad + " ".join((text or "").split())
        logs = [math.log(p(s[i - order + 1 : i], s[i], order)) for i in range(order - 1, len(s))]
        return -sum(logs) / len(logs) if logs else None

    return log_perplexity


@pytest.mark.parametrize("shard_entries", [10**6, 700])
def test_perplexity(spark, shard_entries):
    trusted = [(f"{prose(i, 30, lang)}.", lang) for i in range(30) for lang in ("en", "de")]
    model = quality_lm.train(spark.createDataFrame(trusted + [(None, "en"), ("", "de")], "text string, lang string"), order=4)
    asked = [(prose(99, 20), "en"), (prose(98, 20, "de"), "en"), ("ZQ!! 漢字 zzz", "de"), ("", "en"), (None, "en"), ("a", "en"), ("x y", "fr"), ("the", None)]
    frame = spark.createDataFrame([(t, lang, 1.0, None) for t, lang in asked], "text string, lang string, log_perplexity double, extra string")
    scored, name = quality_lm.score(frame, model, 4, shard_entries=shard_entries)
    assert name == "log_perplexity_" and scored.columns == [*frame.columns, name]
    brute = {lang: brute_kneser_ney([t for t, own in trusted if own == lang], 4) for lang in ("en", "de")}
    got = {(r.text, r.lang): r[name] for r in scored.collect()}
    for text, lang in asked:
        want = brute[lang](text) if lang in brute else None
        assert got[text, lang] == (pytest.approx(want, abs=1e-4) if want is not None else None)


def test_scoring_holds_few_bytes_and_adds_in_order():
    rng = np.random.default_rng(4)
    codes, lengths = quality_lm._codes(["".join(rng.choice(list("abcdefg "), n)) for n in (700_000, 5, 600_000)], 5)
    last = quality_lm._positions(lengths, 5)
    row = np.repeat(np.arange(3), lengths)
    few = np.unique(quality_lm._keys(codes, last[:200_000], 5))
    tables = (quality_lm.Table(few, rng.normal(size=len(few)).astype(np.float32)), quality_lm.Table(few[:0], np.zeros(0, np.float32)), -9.0)
    tracemalloc.start()
    got = quality_lm._summed(np.zeros(3), codes, last, row, tables, 5)
    most = tracemalloc.get_traced_memory()[1]
    whole = np.bincount(row, quality_lm._log_probs(codes, last, tables, 5), 3)
    at_once = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == whole.tolist()  # each bit
    assert most < 30e6 and 2 * most < at_once


def test_stages_send_bounded_batches_and_each_text_once(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcd "), 2000).alias("text")).coalesce(1)
    try:
        got = corpus_pipeline.stage(lambda s, d, _: d.mapInArrow(sizes, "n long, bytes long"))(spark, docs, "").collect()
    finally:
        spark.conf.set(name, before)
    assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) < 5 << 20
    made = batches.map_texts(docs, "text", "n int", lambda texts: [pa.array([len(t) for t in texts], pa.int32())])
    assert "text_in" not in made._jdf.queryExecution().toString()
    assert made.groupBy("n").count().collect() == [(10000, 3000)]
    aside = batches.map_texts(docs, "text", "n int", lambda texts: [pa.array([len(t) for t in texts], pa.int32())], keep=["doc_id"])
    assert aside.groupBy("n").count().collect() == [(10000, 3000)] and aside.columns == ["doc_id", "n"]


def test_classifier_on_held_out_documents(spark):
    def junk(i):
        return " ".join(w.upper() + "!!" for w in prose(i, 60).split()) if i % 2 else "".join(np.random.default_rng(i).choice(list("qxzjkv"), 300))

    rows = [(i, prose(i, 60, lang), lang, "s", 1, "clash", 0) for i in range(600) for lang in ("en",)]
    rows += [(1000 + i, prose(i, 60, "de"), "de", "s", 1, "clash", 0) for i in range(600)]
    rows += [(2000 + i, junk(i), "en", "s", 1, "clash", 0) for i in range(60)]
    rows += [(3000, None, "en", "s", 1, None, 0), (3001, "", "de", "s", 1, None, 0), (3002, "hello", None, "s", 1, None, 0), (None, prose(5, 60), "en", "s", 1, None, 0), (4, prose(4, 60), "en", "s", 1, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = [(i, 1) for i in range(0, 1600, 2)] + [(2000 + i, 0) for i in range(60)] + [(2001, 1), (99999, 1), (None, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_lm.classify(docs, labels)
    assert got.count() == len(rows)
    kept = {r.doc_id: r.kept for r in got.collect()}
    unseen = [i for i in [*range(1, 600, 2), *range(1001, 1600, 2)]]
    assert np.mean([kept[i] for i in unseen]) > 0.97
    assert not any(kept[2000 + i] for i in range(60))
    assert kept[3000] and kept[3001] and kept[3002] and kept[None]
    stays = quality_lm.keep_good(docs, labels)
    assert stays.columns == docs.columns
    assert Counter(r.doc_id for r in stays.collect()) == Counter(r.doc_id for r in got.collect() if r.kept)
    assert quality_lm.classify(docs.limit(0), labels).count() == 0
    assert {r.kept for r in quality_lm.classify(docs.limit(5), labels.limit(0)).collect()} == {True}


@pytest.mark.parametrize("n", [1, 2, 40, 198, 1000])
def test_thresholds_have_one_rule(spark, n):
    """A quantile of the language in units of the fitted spread, at any number of documents."""
    rng = np.random.default_rng(n)
    size = rng.integers(20, 5000, n)
    y = 2 + rng.normal(0, 1, n) * np.sqrt(0.01 + 30 / size)
    y[0] = 9.0  # an odd text among the trusted
    frame = spark.createDataFrame([("en", int(k), float(v)) for k, v in zip(size, y)] + [("en", 5, None)], "lang string, n long, log_perplexity double")
    got = quality_lm.thresholds(frame).first()
    x, var = 1 / size, y.var()
    e = (y - y.mean()) ** 2
    b = max(0.0, (np.mean(x * e) - x.mean() * e.mean()) / x.var()) if n > 1 and x.var() > 0 else 0.0
    a = max(var - b * x.mean(), 0.05 * var, 1e-6)
    assert (got["mean"], got.a, got.b) == pytest.approx((y.mean(), a, b), rel=1e-6, abs=1e-9)
    z = np.ceil((y - got["mean"]) / np.sqrt(got.a + got.b / size) * quality_lm.BINS)
    assert got.cut == pytest.approx(np.quantile(z, 0.995) / quality_lm.BINS, abs=0.0011) and got.cut <= z.max() / quality_lm.BINS


def test_id_filter_spares_untrusted_texts(spark):
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    docs = spark.range(3000).select(F.when(F.col("id") < 2999, F.col("id")).alias("doc_id"))
    passed = {r.doc_id for r in docs.where(quality_lm._likely(ids, 1 << 14)).collect()}
    trusted = set(range(0, 3000, 3)) - {2999}
    assert trusted <= passed and len(passed - trusted) < 300
    assert docs.where(quality_lm._likely(ids.limit(0), 1 << 14)).count() == 0


def test_model_is_taken_to_the_driver_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some plain text number {i % 7} of many", "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    taken, broadcast = [], quality_lm.broadcast_shards
    monkeypatch.setattr(quality_lm, "broadcast_shards", lambda model: taken.append(1) or broadcast(model))
    assert quality_lm.keep_good(docs, labels).count() > 30 and len(taken) == 1


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(i, prose(i, 80) + "\n" + "a line that many of the documents share, forty characters", "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, prose(1, 80), "en", "s0", 1) for i in range(20)] + [(200, None, None, None, None), (201, "", "en", None, 0), (None, "no id", "en", "s1", 5), (1, prose(1, 80), "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "line dedup":
            assert docs.where("text LIKE '%a line that many%'").select("doc_id").distinct().count() == 1
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "near-duplicates":
            assert docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").count() == 0
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).groupBy().sum("length").first() == docs.groupBy().sum("length").first()


CLASHES = (
    "u_ rate_ r_source copies_ chunk_ copies chunk rate uniform rate_source drop_ id_ t0_ t0_in lines_ drop_id drop_positions split_lines "
    "text_t0 text_t1 log_perplexity log_perplexity_sum model cut_lang cut_rule n_in text_in node_in bands_in row_in id_key id_null rank_in"
).split()


def test_temporary_names_may_be_columns(spark):
    """Every name that an operator of the pipeline uses for itself, or used to, as a column of the documents: they pass unchanged."""
    rows = [(i, prose(i, 60), "en", f"s{i % 2}", *[f"{c}{i}" for c in CLASHES]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES))
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    values = {r.doc_id: tuple(r[c] for c in CLASHES) for r in docs.collect()}
    for out in (
        mixing.mix(docs, mixing.repetition_rates(docs)), line_dedup.dedup_lines(docs), quality_lm.keep_good(docs, labels), near_copies.drop_near_copies(docs),
    ):
        found = out.collect()
        assert found and all(tuple(r[c] for c in CLASHES) == values[r.doc_id] for r in found)


def test_crowd_below_the_similarity(spark, monkeypatch):
    """400 texts of one frame with five words changed each: few pairs are verified, no link is lost, none is made up."""
    frame = prose(77, 200).split()
    texts = []
    for i in range(400):
        words = list(frame)
        for place in np.random.default_rng(i).choice(200, 5, replace=False):
            words[place] = f"w{i}x{place}"
        texts.append(" ".join(words))
    texts += [t + " tail" for t in texts[:6]]
    seen = []
    verify = near_copies._verified

    def counted(pairs, sets, similarity):
        seen.append(pairs.count())
        return verify(pairs, sets, similarity)

    monkeypatch.setattr(near_copies, "_verified", counted)
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in near_copies.drop_near_copies(docs).collect()}
    assert kept == set(groups_of(range(len(texts)), edges).values())
    assert sum(seen) < 15 * 400


def test_prefix_pairs_lose_nothing(spark):
    """Against all pairs of random sets of many sizes and overlaps."""
    rng = np.random.default_rng(8)
    sets = []
    for i in range(120):
        base = set(rng.choice(60, rng.integers(1, 50), replace=False).tolist()) if i % 3 or not sets else set(sets[int(rng.integers(len(sets)))])
        sets.append(base ^ set(rng.choice(60, rng.integers(0, 4), replace=False).tolist()) or {1})
    rows = [(bytes([i]), np.array(sorted(s), "<u8").tobytes()) for i, s in enumerate(sets)]
    held = spark.createDataFrame(rows, "node binary, held binary")
    found = near_copies._prefix_pairs(held.select("node", F.col("node").alias("component")), held, 0.8).collect()
    got = {tuple(sorted((r.a[0], r.b[0]))) for r in found}
    want = {(j, i) for i in range(120) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want <= got and len(found) == len(got) and len(got) < 120 * 119 / 4


def test_near_copies_go_through_fingerprints(spark):
    """Without any band, texts that SimHash groups are linked, if their similarity is high enough."""
    base = prose(91, 600).split()
    copies = [" ".join([*base[:at], "edited", *base[at + 1 :]]) for at in range(0, 600, 40)]
    near = [c for c in copies if (simhash.simhash(c, 5) ^ simhash.simhash(" ".join(base), 5)) % 2**64 in {0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i in range(64) for j in range(i))}]
    texts = [" ".join(base), *near[:3], prose(92, 600)]
    assert len(texts) >= 3
    prints = [simhash.simhash(t, 5) for t in texts[:-1]]
    # a fingerprint may be equal by chance: the sets decide
    rows = [(bytes([i]), i, [], p, t) for i, (p, t) in enumerate(zip([*prints, prints[0]], texts))]
    frame = spark.createDataFrame(rows, "node binary, row long, bands array<long>, fp long, text string")
    got = {bytes(r.node): bytes(r.component) for r in near_copies.links(frame.drop("text"), frame.select("row", "text")).collect()}
    assert got == {bytes([i]): bytes([0]) for i in range(len(texts) - 1)}
