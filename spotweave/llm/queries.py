"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from spotweave.llm import (
    divergence, license_scan, line_dedup, mixing, packing, pair_search, quality_lm, quality_rules, simhash,
    token_counts, topk_search, toxic_spans, url_filter,
)
from spotweave.llm.licenses import NOTICES
from spotweave.session import stored

# fixed values: the rules of the URL query
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    templates = spark.createDataFrame(list(NOTICES.items()), "template string, text string")
    return license_scan.scan(table(spark, sf, "documents"), templates)


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, "posterior", *(c for c in judged.columns if c.startswith("vote_")))


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf, "documents")))


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"))


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality_lm.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge_urls(table(spark, sf, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    # the mixed documents with all columns are the result and are written in order; a checksum stands for the texts, as in the SQL
    mixed = stored(mixing.mix(docs, mixing.repetition_rates(docs)), "mixed")
    return mixed.select("doc_id", "source", "copy", "order_key", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return pair_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = toxic_spans.score_documents(docs, toxic_spans.fit_model(docs, table(spark, sf, "labels")))
    places = F.transform("spans", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string")))
    return scored.select(
        "doc_id",
        toxic_spans.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        F.size("spans").alias("n_spans"),
        F.array_join(places, " ").alias("spans"),
    )


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_quality_rules, op3_packing, op4_token_counts, op5_line_dedup, op6_quality_classifier,
        op7_url_filter, op8_topk_search, op9_simhash, op10_mixing, op11_source_divergence, op12_lexical_search,
        op13_toxicity, pipeline,
    )
}

_BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op5_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op7_url_filter": f"""
WITH r(host, path, verdict) AS (VALUES {", ".join(map(repr, URL_RULES))}),
u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
f AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS rank
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE rank = 1""",
    "op8_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5""",
    "op10_mixing": f"""
WITH s AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source),
a AS (SELECT sum(size) AS total, count(*) AS n FROM s WHERE size > 0),
r AS (SELECT source, CASE WHEN size > 0 THEN total / n / size ELSE 1 END AS rate FROM s, a),
c AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
  FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r)),
u AS (
  SELECT doc_id, source, md5(text) AS text_md5,
         ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents),
n AS (SELECT doc_id, u.source, text_md5, count(*) AS copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND below <= u GROUP BY ALL),
e AS (SELECT doc_id, source, text_md5, unnest(range(0, copies))::INTEGER AS copy FROM n)
SELECT doc_id, source, copy, text_md5,
       ('0x' || substr(md5('{mixing.SEED}/order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 13))::BIGINT
         / 4503599627370496.0 AS order_key
FROM e""",
    "op11_source_divergence": rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("text")} AS text FROM documents),
t AS (
  SELECT row, lang, source, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
u AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM u GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(n.n, 0) AS n, coalesce(v.v, 0) AS v, v.n AS lang_n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) LEFT JOIN v USING (lang)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(u.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(u.c, 0) + 1)) // (g.n + g.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.c + 1)) // (g.lang_n + g.v)::HUGEINT AS q
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
x AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM y)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
    "op12_lexical_search": rf"""
WITH t AS (
  SELECT d.row, d.doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents) d),
i AS (
  SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
l AS (SELECT row, doc_id, count(*) AS n FROM t GROUP BY ALL),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l),
m AS (SELECT row, doc_id, 75 + (25 * n * docs) // total AS m FROM l, a),
f AS (SELECT row, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, a GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (row) GROUP BY item_id, row, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
