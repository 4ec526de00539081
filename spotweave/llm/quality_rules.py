"""Document quality by weak supervision, with DataFrame functions only.

Rules vote for (1) or against (-1) a document, or abstain (0). How far a vote is
to be trusted isn't set by hand: expectation-maximisation over the counted vote
patterns estimates for each rule how often it votes either way on good and on
bad documents. The posterior probability of "good" replaces the demand that all
rules pass. The number of patterns is bounded by 3 to the number of rules, not
by the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.session import stored

#: What separates words, and the characters that count as symbols.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
# possessive, as no part of a word is ever given back: matching takes no stack for long words of many parts
PLAIN_WORD = r"(?<![^\x20\x09-\x0D])[(\"']?\p{L}++(?:['’-]\p{L}++)*+[\"')]?[.,;:!?]?(?![^\x20\x09-\x0D])"
SENTENCE_END = r"[.!?][\"')]?[\x20\x09-\x0D]*(?:\n|$)"
MIN_WORDS = 50
ROUNDS = 30


def words_of(text: Column) -> Column:
    """Words of a text without the empty strings at its ends; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK, -1), lambda w: w != "")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with one column for each measure of the text; null: an empty text.

    n_words, word_chars (code points in words), n_symbols, n_lines, n_dup_lines
    (lines with a word, equal to an earlier line), n_repeat_words (words in
    3-word windows found twice or more), n_same_next (words equal to the next
    one), n_plain (words of letters with common punctuation), n_upper,
    n_letters, n_ends (lines that end a sentence).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    base = docs.select("doc_id", text.alias("t"))
    base = base.select("doc_id", "t", words_of(F.col("t")).alias("w"))
    n = F.size("w")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    base = base.withColumn("h", hashes)
    # equal windows lie side by side after the sort; most texts have none and need no places
    pairs = F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs))
    twice = F.filter("s", lambda p, k: (F.get("s", k - 1)["h"] == p["h"]) | (F.coalesce(F.get("s", k + 1)["h"] == p["h"], F.lit(False))))
    base = base.withColumn("p", F.sort_array(F.transform(twice, lambda p: p["i"])))
    gaps = F.transform("p", lambda i, k: F.coalesce(F.least(F.lit(3), F.get("p", k + 1) - i), F.lit(3)))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    base = base.withColumn("l", lines)
    same = F.filter("w", lambda x, i: x == F.get("w", i + 1))
    return base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count(SYMBOL).alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, g: a + g), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(same).cast("long").alias("n_same_next"),
        count(PLAIN_WORD).alias("n_plain"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"\p{L}").alias("n_letters"),
        count(SENTENCE_END).alias("n_ends"),
    )


def _vote(against: Column, in_favour: Column) -> Column:
    return F.when(against, -1).when(in_favour, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by rule, from the measures. All abstain on a text without words."""
    n, letters, lines = F.col("n_words"), F.col("n_letters"), F.col("n_lines")
    c = F.col
    votes = {
        "word_length": _vote((c("word_chars") < 2.5 * n) | (c("word_chars") > 12 * n), (c("word_chars") >= 3.5 * n) & (c("word_chars") <= 8 * n)),
        "symbols": _vote(c("n_symbols") > 0.1 * n, c("n_symbols") <= 0.01 * n),
        "plain_words": _vote(c("n_plain") < 0.7 * n, c("n_plain") >= 0.95 * n),
        "repeated_words": _vote(c("n_repeat_words") > 0.3 * n, c("n_repeat_words") <= 0.1 * n),
        "stuttering": _vote(c("n_same_next") > 0.2 * n, c("n_same_next") <= 0.02 * n),
        "repeated_lines": _vote(c("n_dup_lines") > 0.3 * lines, c("n_dup_lines") == 0),
        "capitals": _vote(c("n_upper") > 0.4 * letters, c("n_upper") <= 0.15 * letters),
        "sentences": _vote(c("n_ends") < 0.1 * lines, c("n_ends") >= 0.5 * lines),
    }
    return {name: F.when(n > 0, v).otherwise(0) for name, v in votes.items()}


def estimate(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS, prior: float = 0.9) -> DataFrame:
    """One row: prior (share of good documents) and rates, by expectation-maximisation.

    ``patterns``: votes (array of -1, 0, 1) and n. ``rates``: for each rule the
    probability of a vote against on good and bad documents, and of a vote in
    favour on good and bad ones. Each starts at a value that says which way the
    rule leans and is smoothed with one pseudo-document of that value, so that
    "good" keeps its meaning and rules that never vote stay neutral. No patterns:
    the start values.
    """
    rate = "struct<ng double, nb double, pg double, pb double>"
    state_type = f"struct<prior double, rates array<{rate}>>"
    # fixed values: the leaning of a rule before any data
    lean = {"ng": 0.02, "nb": 0.3, "pg": 0.9, "pb": 0.5}
    one = F.struct(*(F.lit(v).alias(k) for k, v in lean.items()))
    start = F.struct(F.lit(prior).alias("prior"), F.array_repeat(one, n_rules).alias("rates")).cast(state_type)

    def good(state: Column, votes: Column) -> Column:
        return posterior(state["prior"], state["rates"], votes)

    def improve(state: Column, _: Column) -> Column:
        shared = F.transform(
            "patterns",
            lambda p: F.struct(
                p["votes"].alias("votes"),
                (p["n"] * good(state, p["votes"])).alias("g"),
                (p["n"] * (1 - good(state, p["votes"]))).alias("b"),
            ),
        )
        total = lambda side, test: F.aggregate(shared, F.lit(0.0), lambda a, p: a + F.when(test(p), p[side]).otherwise(0.0))
        everywhere = lambda p: F.lit(True)
        share = lambda side, j, v, k: (total(side, lambda p: F.get(p["votes"], j) == v) + lean[k]) / (total(side, everywhere) + 1.0)
        rates = F.transform(
            F.sequence(F.lit(0), F.lit(n_rules - 1)),
            lambda j: F.struct(
                share("g", j, -1, "ng").alias("ng"),
                share("b", j, -1, "nb").alias("nb"),
                share("g", j, 1, "pg").alias("pg"),
                share("b", j, 1, "pb").alias("pb"),
            ),
        )
        new = (total("g", everywhere) + prior) / (total("g", everywhere) + total("b", everywhere) + 1.0)
        return F.struct(new.alias("prior"), rates.alias("rates")).cast(state_type)

    # sorted, so that sums don't depend on the order in which patterns arrive
    gathered = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))
    return gathered.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, improve).alias("fit")).select("fit.*")


def posterior(prior: Column, rates: Column, votes: Column) -> Column:
    """Probability of "good" given the votes."""
    evidence = F.zip_with(
        rates,
        votes,
        lambda r, v: F.when(v < 0, F.log(r["ng"] / r["nb"]))
        .when(v > 0, F.log(r["pg"] / r["pb"]))
        .otherwise(F.log((1 - r["ng"] - r["pg"]) / (1 - r["nb"] - r["pb"]))),
    )
    odds = F.aggregate(evidence, F.log(prior / (1 - prior)), lambda a, e: a + e)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, rounds: int = ROUNDS, cut: float = 0.5) -> DataFrame:
    """Measures, votes, posterior and verdict for each row of ``docs`` (doc_id, text).

    base_failed: fewer than 50 words, or over half of them in repeated 3-word
    windows. kept: false if base_failed, else whether the posterior reaches
    ``cut``. The rates are estimated from all documents that pass the base rules.

    A null or empty text has no words and fails the base rules. Repeated rows
    stay and count each. A null doc_id is kept. Other columns are left out. No
    rows: no rows.
    """
    votes = rules()
    n, r = F.col("n_words"), F.col("n_repeat_words")
    measured = measure(docs).select(
        "*",
        ((n < MIN_WORDS) | (100 * r > 50 * n)).alias("base_failed"),
        F.array(*(v.alias(k) for k, v in votes.items())).alias("votes"),
    )
    measured = stored(measured, "measured")
    patterns = measured.where(~F.col("base_failed")).groupBy("votes").agg(F.count("*").alias("n"))
    fit = estimate(patterns, len(votes), rounds).first()
    known = F.array(*(F.struct(*(F.lit(r[k]).alias(k) for k in ("ng", "nb", "pg", "pb"))) for r in fit["rates"]))
    return measured.select(
        *(c for c in measured.columns if c != "votes"),
        *(F.get("votes", j).alias(f"vote_{k}") for j, k in enumerate(votes)),
        posterior(F.lit(fit["prior"]), known, F.col("votes")).alias("posterior"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= cut))
