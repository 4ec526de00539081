"""Packing, token counts, line dedup, quality rules and licence scan against plain Python versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.llm import license_scan, line_dedup, packing, quality_rules, token_counts
from spotweave.llm.licenses import NOTICES
from spotweave.llm.tokens import encoder

DOCS = "doc_id long, text string, source string, copy int, n_lines string, fp string, t string"
WORDS = "the quick brown fox jumps over a lazy dog while 42 cats watch; don't they?".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


TEXTS = [
    None, "", " ", "\n", "\n\n\n", "one", "one two", "a b c", "  lead and   wide \t gap \n\n next ", "x<|endoftext|> y <|endoftext|>",
    "Straße ÉCOLE ñandú 漢字 \U0001f600 \U0001f600", prose(1, 60), prose(1, 60), prose(2, 300), "word " * 400, prose(3, 20000),
    " non breaking  　wide\x1c odd\x85 x", "tail \n", "a  b", "a   b", "a \n  b", "\r\nwindows\r\nlines\r\n",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}", i, "x", "y", "z") for i, t in enumerate(TEXTS)]
    rows += [(3, TEXTS[3], None, 0, None, None, None), (None, prose(4, 80), None, 0, None, None, None), (None, None, None, 0, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def reference_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("cache_words", [0, 5, 1 << 18])
def test_ids_equal_the_tokenizers_library(reference_tokenizer, cache_words):
    encode = encoder(cache_words=cache_words)
    want = [np.array(e.ids, "<u4").tobytes() for e in reference_tokenizer.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    assert encode(TEXTS) == want
    assert encode(TEXTS) == want  # now from the cache


def test_piece_lengths():
    for n in [1, 2, 3, 2047, 2048, 2049, 5000]:
        pieces = packing.piece_lengths(n)
        assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 2048 for p in pieces)
        assert pieces == sorted(pieces, reverse=True)


def test_packing_round_trip(spark, docs, reference_tokenizer):
    rows = packing.pack(docs).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    by_sum = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length & (r.length - 1) == 0 and r.length <= 2048
        by_sum[r.doc_id].append(r)
    for key, text in enumerate(TEXTS):
        ids = reference_tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by_sum[key], key=lambda r: r.start)
        if key == 3:  # repeated row
            assert len(pieces) == 2 * len(packing.piece_lengths(len(ids)))
            continue
        assert b"".join(bytes(r.ids) for r in pieces) == np.array(ids, "<u4").tobytes()
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces])[:-1])
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    assert sorted(r.length for r in by_sum[None] if r.doc_tokens == 1) == [1]
    got = packing.digest(packing.pack(docs.where("doc_id = 5"))).first()
    ids = reference_tokenizer.encode("one", add_special_tokens=False).ids + [1]
    assert got.ids_crc32 == zlib.crc32(np.array(ids[: got.length], "<u4").tobytes())
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, max_tokens=100)


def test_buckets_hold_equal_lengths(spark, docs, tmp_path):
    packing.write_buckets(packing.pack(docs), str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.where(F.octet_length("ids") != 4 * F.col("length")).count() == 0
    assert back.count() == packing.pack(docs).count()


def test_token_counts(spark, docs, reference_tokenizer):
    n = [len(reference_tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    got = {r.n_tokens: r for r in token_counts.count_tokens(docs).collect()}
    assert set(got) == set(n)
    for limit, r in got.items():
        assert r.n_docs == n.count(limit)
        assert r.docs_from == sum(x >= limit for x in n)
        assert r.tokens_from == sum(x for x in n if x >= limit)
        assert r.truncated_tokens == sum(min(x, limit) for x in n)
        assert r["quantile"] == pytest.approx(sum(x <= limit for x in n) / len(n))
    sums = token_counts.suffix_sums(token_counts.length_histogram(token_counts.token_lengths(docs)), slab=7)
    assert {r.n_tokens: r for r in sums.collect()} == got
    limits = [0, 1, 17, 63, 64, 5000, 10**7]
    assert [r.truncated_tokens for r in token_counts.truncated_at(sums, limits).orderBy("limit").collect()] == [sum(min(x, k) for x in n) for k in limits]
    assert token_counts.length_quantile(sums, 0.5).first()[0] == sorted(n)[-(-len(n) // 2) - 1]
    empty = token_counts.count_tokens(docs.limit(0))
    assert empty.count() == 0
    assert token_counts.truncated_at(empty, [5]).first().truncated_tokens == 0


def brute_lines(rows):
    blanks = "\x20\x09\x0a\x0b\x0c\x0d"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blanks))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders[key(x)]) < 5 or (i is not None and i == max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def test_line_dedup(spark, docs):
    common, other = "Copyright Of A Very Common Notice, ALL RIGHTS reserved É", "this exact line is long enough but it is in only four texts"
    rows = [(i, f"{common if i % 2 else '  ' + common.lower().replace('é', 'É')}\t\nown {i}\n{common}" ) for i in range(7)]
    rows += [(10 + i, f"{other}\n\nx") for i in range(4)] + [(10, f"{other}\n\nx")]
    rows += [(20 + i, "short line\n" * 3) for i in range(6)] + [(None, common), (None, None), (30, None), (31, ""), (5, "another text of the same id\n" + common)]
    rows += [(40 + i, "é" * 40 + "\n" + "é" * 39) for i in range(5)]
    frame = spark.createDataFrame([(i, t, "s", 1, "clash", "f", "t") for i, t in rows], DOCS)
    got = line_dedup.dedup_lines(frame)
    assert got.columns == ["doc_id", "text", "source", "copy", "fp", "t", "n_lines", "n_dropped", "kept_text"]
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=repr)
    assert found == brute_lines(rows)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs).collect()), key=repr) == brute_lines(
        [(r.doc_id, r.text) for r in docs.collect()]
    )
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_measures(spark, docs):
    more = ["a b c a b c", "x x x x", "A\nB\n A\nA\n\n\nB", "p q r s p q r z p q", "# * <b> 50%"] + [prose(9, 40) + " " + prose(9, 40)]
    frame = docs.unionByName(spark.createDataFrame([(100 + i, t, None, 0, None, None, None) for i, t in enumerate(more)], DOCS))
    judged = quality_rules.judge(frame)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted(((r.doc_id, *(r[c] for c in names)) for r in judged.collect()), key=repr)
    assert got == sorted(((r.doc_id, *brute_measures(r.text)) for r in frame.collect()), key=repr)
    assert judged.where("base_failed AND kept").count() == 0
    assert quality_rules.judge(docs.limit(0)).count() == 0


def brute_em(patterns, rounds):
    """The same model in numpy."""
    votes = np.array([v for v, _ in patterns])
    n = np.array([float(c) for _, c in patterns])
    lean = dict(ng=0.02, nb=0.3, pg=0.9, pb=0.5)
    prior, rates = 0.9, {k: np.full(votes.shape[1], v) for k, v in lean.items()}

    def post():
        g, b = np.log(prior), np.log(1 - prior)
        g += (np.where(votes < 0, np.log(rates["ng"]), np.where(votes > 0, np.log(rates["pg"]), np.log(1 - rates["ng"] - rates["pg"])))).sum(1)
        b += (np.where(votes < 0, np.log(rates["nb"]), np.where(votes > 0, np.log(rates["pb"]), np.log(1 - rates["nb"] - rates["pb"])))).sum(1)
        return 1 / (1 + np.exp(b - g))

    for _ in range(rounds):
        g = n * post()
        b = n - g
        rates = {
            k: ((w[:, None] * (votes == v)).sum(0) + lean[k]) / (w.sum() + 1)
            for k, w, v in (("ng", g, -1), ("nb", b, -1), ("pg", g, 1), ("pb", b, 1))
        }
        prior = (g.sum() + 0.9) / (n.sum() + 1)
    return prior, rates, post()


def test_expectation_maximisation(spark):
    rng = np.random.default_rng(5)
    good = rng.random(4000) < 0.85
    votes = np.where(rng.random((4000, 4)) < np.where(good[:, None], 0.03, 0.6), -1, np.where(rng.random((4000, 4)) < 0.7, 1, 0))
    patterns = Counter(map(tuple, votes.tolist()))
    frame = spark.createDataFrame([(list(v), c) for v, c in patterns.items()], "votes array<int>, n long")
    fit = quality_rules.estimate(frame, 4, rounds=30).first()
    prior, rates, post = brute_em(list(patterns.items()), 30)
    assert fit.prior == pytest.approx(prior)
    for k, v in rates.items():
        assert [r[k] for r in fit.rates] == pytest.approx(list(v))
    # held against the truth that the estimate never saw
    of = dict(zip(patterns, post))
    assert np.mean([(of[tuple(v)] >= 0.5) == g for v, g in zip(votes.tolist(), good)]) > 0.93
    assert quality_rules.estimate(frame.limit(0), 4).first().prior == pytest.approx(0.9)


def test_junk_is_told_from_prose(spark):
    clean = [". ".join(prose(i * 10 + j, 12).capitalize() for j in range(8)) + "." for i in range(200)]
    junk = [" ".join(f"{w}***" for w in prose(i, 80).split()) for i in range(20)]
    junk += [" | ".join(prose(i, 80).upper().split()) for i in range(20)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)], "doc_id long, text string")
    kept = {r.doc_id for r in quality_rules.judge(frame).where("kept").collect()}
    assert kept == set(range(200))


def brute_scan(text, template):
    """Best containment of the template in any passage of one and a half times its length."""
    words, t = license_scan.words_of(text), license_scan.words_of(template)
    want = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    size = len(t) + 2 * (len(t) // 4)
    best = 0.0
    for i in range(max(1, len(words) - size + 1)):
        part = words[i : i + size]
        best = max(best, len(want & {tuple(part[j : j + 5]) for j in range(len(part) - 4)}) / len(want))
    return best


def test_license_scan(spark, docs):
    templates = spark.createDataFrame(list(NOTICES.items()), "template string, text string")
    rng = np.random.default_rng(1)
    rows = []
    for i, (name, text) in enumerate(sorted(NOTICES.items())):
        rows.append((i, prose(i, 150) + "\n" + text.upper() + "\n" + prose(i + 50, 90)))
        words = text.split()
        for k in range(6):  # near copies: some words replaced
            changed = list(words)
            for at in rng.choice(len(words), max(1, len(words) // 40), replace=False):
                changed[at] = "other"
            rows.append((100 + 10 * i + k, prose(i + k, 64) + " " + " ".join(changed) + " " + prose(k, 40)))
    rows += [(900, NOTICES["MIT"] + "\n" + prose(3, 100) + "\n" + NOTICES["MIT"]), (901, prose(7, 3000)), (901, prose(7, 3000)), (902, None), (903, "mit license")]
    frame = spark.createDataFrame([(i, t, None, 0, None, None, None) for i, t in rows], DOCS)
    got = license_scan.scan(frame, templates).collect()
    texts = dict(rows)
    found = {(r.doc_id, r.template) for r in got}
    for i, text in texts.items():
        for name, notice in NOTICES.items():
            assert ((i, name) in found) == (brute_scan(text, notice) >= 0.8), (i, name, brute_scan(text, notice))
    assert sum(r.doc_id == 900 for r in got) == 2
    for r in got:
        words = license_scan.words_of(texts[r.doc_id])[r.start : r.start + r.n_words]
        assert brute_scan(" ".join(words), NOTICES[r.template]) >= 0.8
    # small shards give the same
    assert {(r.doc_id, r.template) for r in license_scan.scan(frame, templates, shard_words=40).collect()} == found
    assert license_scan.scan(docs, templates).count() == 0
    assert license_scan.scan(docs.limit(0), templates).count() == 0
    assert license_scan.scan(frame, templates.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(docs, spark.createDataFrame([("x", "too short")], "template string, text string"))


def test_kept_hash(spark):
    frame = spark.createDataFrame([(1, "é\nx")], "doc_id long, text string")
    got = line_dedup.dedup_lines(frame).select(F.sha2("kept_text", 256)).first()[0]
    assert got == hashlib.sha256("é\nx".encode()).hexdigest()


def test_slices_of_few_words(spark):
    """License scan of one text of any small number of words alone in its slice."""
    templates = spark.createDataFrame(list(NOTICES.items()), "template string, text string")
    shard_of = [("t", license_scan.words_of(v)) for v in NOTICES.values()]
    shard = license_scan._Shard(shard_of)
    for n in range(101):
        words = license_scan._hash_words([f"w{i}" for i in range(n)])
        assert license_scan._candidates(shard, words) == set()
    for n in (1, 10, 50, 57):
        docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string")
        assert license_scan.scan(docs, templates).count() == 0


def test_long_words_of_many_parts(spark):
    text = "a-" * 200_000 + "b" + " It's a well-known rock-'n'-roll song."
    docs = spark.createDataFrame([(1, text), (2, "don't stop-it o'clock. (it's) 'a-b' x-- -y")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert got[1].n_words == 6 and got[2].n_words == 7
    plain = docs.where("doc_id = 2").select(F.regexp_count("text", F.lit(quality_rules.PLAIN_WORD)).alias("n")).first().n
    assert plain == 5


@pytest.mark.parametrize("copies", [2, 4, 8])
def test_copies_back_to_back(spark, copies):
    templates = spark.createDataFrame(list(NOTICES.items()), "template string, text string")
    names = sorted(NOTICES)
    docs = spark.createDataFrame([(i, prose(i, 13) + " " + " ".join([NOTICES[n]] * copies) + " " + prose(i, 20)) for i, n in enumerate(names)], "doc_id long, text string")
    got = Counter((r.doc_id, r.template) for r in license_scan.scan(docs, templates).collect())
    assert all(got[i, n] == copies for i, n in enumerate(names)), got


def test_words_inserted_in_a_notice(spark):
    templates = spark.createDataFrame(list(NOTICES.items()), "template string, text string")
    long_ones = [n for n in sorted(NOTICES) if len(NOTICES[n].split()) >= 50]
    assert long_ones
    rows = []
    for i, n in enumerate(long_ones):
        words = NOTICES[n].split()
        rows.append((i, prose(i, 30) + " " + " ".join(words[: len(words) // 2]) + " " + prose(i + 9, 50) + " " + " ".join(words[len(words) // 2 :]) + " " + prose(i, 30)))
    got = {(r.doc_id, r.template): r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    for i, n in enumerate(long_ones):
        assert got[i, n].containment >= 0.9 and got[i, n].n_words >= len(NOTICES[n].split()) + 50
