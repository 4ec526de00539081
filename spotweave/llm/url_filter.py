"""Allow and block rules for URLs as a sort-merge range join.

A rule (host, path) fits its host and all subdomains if the path starts with the
rule's. The canonical key is the host's labels in reverse order, a separator and
the path. Each URL has one key for every suffix of its host, so "fits" means that
the rule's key is a prefix of one of them, and a rule is the interval of keys
that start with its own. URLs and rules are cut into ranges of keys, a rule is
copied to each range its interval reaches, and a sorted sweep over a range keeps
a stack of the nested rules that are open.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spotweave.llm.batches import hashed_share

#: Between host and path, between a key and what only spreads equal keys, and past any other character.
SEP, SPREAD, LAST = "\x01", "\x00", "\U0010ffff"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DEFAULT = "allow"
#: Keys drawn to choose the ranges; they affect balance, not results.
SAMPLE = 4096


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or a text without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit(SEP), path)


def rule_table(rules: DataFrame) -> DataFrame:
    """key, size, rule, verdict: one row for each host and path; a rule without host is left out, of two verdicts block wins."""
    host = F.translate("host", UPPER, UPPER.lower())
    path = F.coalesce("path", F.lit(""))
    clean = rules.where(F.coalesce("host", F.lit("")) != "").select(host.alias("host"), path.alias("path"), "verdict")
    return clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        _key(F.split("host", r"\."), F.col("path")).alias("key"),
        (F.length("host") + F.length("path")).alias("size"),
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.size(F.split("host", r"\.")).alias("labels"),
    )


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and key, rules before URLs of the same key: each URL key with the innermost open rule."""
    here, stack = None, []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["part"] != here:
                here, stack = row["part"], []
            while stack and not row["key"].startswith(stack[-1]["key"]):
                stack.pop()
            if row["rule"] is not None:
                stack.append(row)
            elif stack:
                top = stack[-1]
                out.append((row["page_id"], row["url"], top["size"], top["rule"], top["verdict"]))
        if out:
            page, url, size, rule, verdict = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(page, pa.int64()), pa.array(url, pa.string()), pa.array(size, pa.int32()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["page_id", "url", "size", "rule", "verdict"],
            )


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url, rule, verdict for the distinct (page_id, url) that a rule fits: the longest rule.

    Of two equally long ones that with the greater text wins.
    """
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", "url").where(F.col("url").contains("://"))
    parts = urls.select("page_id", "url", F.split(host, r"\.").alias("labels"), path.alias("path"))
    ruled = rule_table(rules)
    # a host is looked up by its suffixes of the lengths that rules have: few, whatever the number of its labels
    lengths = sorted(r[0] for r in ruled.select("labels").distinct().collect())
    there = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= F.size("labels"))
    suffix = F.explode(there).alias("k")
    leveled = parts.select("page_id", "url", "labels", "path", suffix)
    tail = F.slice("labels", F.size("labels") - F.col("k") + 1, F.col("k"))
    spread = F.concat(F.lit(SPREAD), F.hex(F.xxhash64("page_id", "url")))
    keys = leveled.select("page_id", "url", F.concat(_key(tail, F.col("path")), spread).alias("key"))

    spark = pages.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a share known from the number of pages, so the sample doesn't grow with them; repeated rows are one key
    chosen = hashed_share(pages.count(), SAMPLE, F.col("page_id"), F.col("url"))
    drawn = sorted(r[0] for r in keys.where(chosen).select("key").distinct().collect())
    cuts = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, k) for k in key], dtype="int32")

    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    points = keys.select(
        range_of("key").alias("part"), "key", "page_id", "url", empty("size", "int"), empty("rule", "string"), empty("verdict", "string")
    )
    reach = F.sequence(range_of("key"), range_of(F.concat("key", F.lit(LAST))))
    intervals = ruled.select(
        F.explode(reach).alias("part"), "key", empty("page_id", "long"), empty("url", "string"), "size", "rule", "verdict"
    )
    both = points.unionByName(intervals)
    # part fixes the task; a key alone sorts before the same key with what spreads it
    swept = both.repartition("part").sortWithinPartitions("part", "key").mapInArrow(
        _sweep, "page_id long, url string, size int, rule string, verdict string"
    )
    best = swept.groupBy("page_id", "url").agg(F.max(F.struct("size", "rule", "verdict")).alias("best"))
    return best.select("page_id", "url", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, url, host, path, rule, verdict for each row of ``pages`` (page_id, url, ...).

    ``rules``: host, path, verdict. Without a fitting rule: rule null and the
    verdict ``default``. A null url, or one without ``://``, has an empty host
    and path and fits no rule. A null page_id is judged like any other. Repeated
    rows stay, with equal results. Other columns are left out. No pages: no
    rows; no rules: all rows have the default.
    """
    best = match_rules(pages.withColumn("page_id", F.col("page_id").cast("long")), rules).select(
        F.col("page_id").alias("m_page"), F.col("url").alias("m_url"), "rule", "verdict"
    )
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    joined = rows.join(best, rows["page_id"].eqNullSafe(best["m_page"]) & (rows["url"] == best["m_url"]), "left")
    return joined.select(
        "page_id", "url", host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
