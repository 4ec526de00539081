"""Mixing of sources to target weights by Poisson replication, with DataFrame functions only.

A source with target share w of the corpus and natural share s is repeated w / s
times on average. Each document's count is drawn by inverting the Poisson
distribution at a uniform number hashed from seed and document, so a run gives
the same counts on any cluster, and the documents need no shuffle to be drawn.
The copies are then put in a global random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.llm.batches import free_name
from spotweave.session import stored

SEED = "mix-1"
#: 52 bits of a hash: exact in a double.
_HEX = 13
#: Copies of a document that leave one row at most.
CHUNK = 1024


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the parts."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, _HEX), 16, 10).cast("long") / F.lit(float(16**_HEX))


def repetition_rates(docs: DataFrame, targets: DataFrame | None = None, total: float = 1.0) -> DataFrame:
    """source, rate: mean number of copies for each source.

    ``targets`` (source, weight) need not add up to 1; without it all sources
    weigh the same. Sizes are code points of text; the copies together have
    ``total`` times the size of the sources with a weight. A null source is a
    source. A source that ``targets`` leaves out, gives no weight or repeats
    with weights that add up to nothing has rate 0; one without text has rate 1.
    """
    size = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    if targets is None:
        weighed = size.withColumn("weight", F.lit(1.0))
    else:
        t = targets.groupBy(F.col("source").alias("t_source")).agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
        weighed = size.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").select(
            "source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    # stored: one pass over the texts for sums and rates, and Spark knows that a row for each source is little
    weighed = stored(weighed, "source_sizes")
    live = (F.col("weight") > 0) & (F.col("size") > 0)
    sums = weighed.agg(F.sum(F.when(live, F.col("size"))).alias("size"), F.sum(F.when(live, F.col("weight"))).alias("weight")).first()
    scale = total * (sums["size"] or 0.0) / (sums["weight"] or 1.0)
    return weighed.select(
        "source",
        F.when(live, F.lit(scale) * F.col("weight") / F.col("size"))
        .when((F.col("weight") > 0) | F.lit(targets is None), 1.0)
        .otherwise(0.0)
        .alias("rate"),
    )


def poisson_count(rate: Column, u: Column) -> Column:
    """The smallest k with P(X <= k) > ``u``, for a Poisson variable of mean ``rate``; 0 for a rate of 0.

    Terms are summed one after another and no array of them is held. Beyond 12
    deviations on either side less than 2^-60 is left, so a large rate costs a
    number of terms like its root. The first term is in Loader's form, which
    doesn't cancel.
    """
    from_zero = rate < 400
    first = F.when(from_zero, F.lit(0)).otherwise(F.floor(rate - 12 * F.sqrt(rate))).cast("long")
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("long")
    k = F.greatest(first, F.lit(1)).cast("double")
    d = (k - rate) / rate
    stirling = 1 / (12 * k) - 1 / (360 * k * k * k)
    tail = F.exp(-rate * ((1 + d) * F.log1p(d) - d) - stirling) / F.sqrt(2 * F.pi() * k)
    start = F.struct(F.when(from_zero, F.exp(-rate)).otherwise(tail).alias("p"), F.lit(0.0).alias("sum"), first.alias("count"))

    def step(acc: Column, k: Column) -> Column:
        total = acc["sum"] + acc["p"]
        return F.struct(
            (acc["p"] * rate / (k + 1)).alias("p"), total.alias("sum"), (acc["count"] + F.when(total <= u, 1).otherwise(0)).alias("count")
        )

    return F.when(rate > 0, F.aggregate(F.sequence(first, last), start, step, lambda acc: acc["count"])).otherwise(F.lit(0).cast("long"))


def draw_counts(docs: DataFrame, rates: DataFrame, seed: str = SEED, name: str = "copies") -> DataFrame:
    """``docs`` with ``name``: how often each row is taken."""
    key, rate, u = (free_name(docs, c) for c in ("rate_source", "rate", "uniform"))
    table = rates.select(F.col("source").alias(key), F.col("rate").alias(rate))
    # a row for each source, so Spark sends it to all tasks when it is small and splits hot sources when not
    joined = docs.join(table, docs["source"].eqNullSafe(F.col(key)), "left").withColumn(u, uniform(seed, docs["doc_id"]))
    count = F.coalesce(poisson_count(F.col(rate), F.col(u)), F.lit(0))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), count.alias(name))


def mix(docs: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """Copies of the rows of ``docs`` (doc_id, source, text, ...) in a global random order.

    All columns of ``docs`` and two more: copy (from 0) and order_key, by which
    the result is sorted over all partitions. Rows of the same doc_id have the
    same count. A null doc_id is drawn like any other value. A source without
    rate has no copy. Columns of ``docs`` named copy or order_key are replaced.
    No rows: no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("copy", "order_key")]
    name, chunk = free_name(docs, "copies"), free_name(docs, "chunk")
    copies = F.col(name)
    drawn = draw_counts(docs, rates, seed, name)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = drawn.where((copies > 0) & (copies <= CHUNK))
    # a document with very many copies is dealt out in chunks first, so they don't all leave one task
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((copies - 1) / CHUNK)))
    many = drawn.where(copies > CHUNK).select(*columns, name, chunks.alias(chunk))
    many = many.repartition(n, "doc_id", chunk)
    begin = F.col(chunk) * CHUNK
    taken = few.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy")).union(
        many.select(*columns, F.explode(F.sequence(begin, F.least(begin + CHUNK, copies) - 1)).alias("copy"))
    )
    taken = taken.withColumn("copy", F.col("copy").cast("int"))
    ordered = taken.withColumn("order_key", uniform(seed + "/order", F.col("doc_id"), F.col("copy")))
    # the keys are uniform in [0, 1), so their ranges are known without a pass that samples them
    return ordered.repartitionById(n, F.floor(F.col("order_key") * n).cast("int")).sortWithinPartitions("order_key")
