"""Exact top-k by inner product: vectors by descending length, rotated partial sums, residual bounds.

Vectors are cut into blocks of similar length, the longest first. The first
block gives each query a k-th best score. Every other pair of a query block and
a vector block is dropped unseen if lengths alone (Cauchy-Schwarz) show that no
score can reach it. Inside a pair, an orthogonal rotation from a singular value
decomposition puts most of a vector's length into few leading components: their
partial sum plus the product of the residual lengths bounds the score, and only
what passes is computed whole. Scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spotweave.llm.batches import hashed_share
from spotweave.session import stored

K = 5
SCALE = 256
#: Vectors of a block, queries of a block, and vectors compared at once.
BLOCK_ROWS, QUERY_ROWS, CHUNK = 8192, 1024, 1024
#: Vectors by which the rotation is fitted; it affects speed, not results.
FIT_ROWS = 4096
RESULT = "query_id long, vec_id long, score long"


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of floor(scale * x)), norm2; without rows that have no id, no vector, or a null or non-finite component."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~F.coalesce(odd, F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("double"))
    rows = whole.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of an array column, short ones filled with zeros."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    sizes = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = values
    return out


def rotation(vectors: DataFrame, dim: int, rows: int = FIT_ROWS) -> np.ndarray:
    """Orthogonal matrix whose leading columns hold most of the length of a bounded sample of the vectors."""
    # a share known from the number of vectors, so the sample doesn't grow with them; repeated rows are one
    chosen = hashed_share(vectors.count(), rows, F.col("vec_id"))
    sample = vectors.where(chosen).select("vec_id", "v").distinct().toArrow()
    m = _matrix(sample.column("v"), dim)
    return np.linalg.svd(m, full_matrices=True)[2].T if len(m) >= dim else np.eye(dim)


def block_topk(q_ids, q, theta, c_ids, c, turn: np.ndarray, k: int):
    """Best ``k`` of one block for each query: arrays query_id, vec_id, score. Scores below ``theta`` may be missing."""
    dim = q.shape[1]
    head = max(1, dim // 4)
    order = np.argsort(-(c * c).sum(axis=1), kind="stable")
    c, c_ids = c[order], c_ids[order]
    q_norm, c_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    q_head, c_head = q @ turn[:, :head], c @ turn[:, :head]
    rest = lambda norm, part: np.sqrt(np.maximum(norm**2 - (part * part).sum(axis=1), 0.0))
    q_rest, c_rest = rest(q_norm, q_head), rest(c_norm, c_head)
    theta = theta.copy()
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for i in range(0, len(c), CHUNK):
        part = slice(i, i + CHUNK)
        # room for rounding: bounds are never too low
        slack = 1e-6 + 1e-9 * q_norm * c_norm[i]
        alive = np.flatnonzero(q_norm * c_norm[i] + slack >= theta)
        if not len(alive):
            break
        bound = q_head[alive] @ c_head[part].T + np.outer(q_rest[alive], c_rest[part])
        r, j = np.nonzero((bound + slack[alive, None] >= theta[alive, None]) & (q_ids[alive, None] != c_ids[None, part]))
        r, j = alive[r], j + i
        if 4 * len(r) > len(alive) * len(c_ids[part]):
            scores = (q @ c[part].T)[r, j - i]
        else:
            scores = np.concatenate([np.einsum("ij,ij->i", q[r[a : a + 65536]], c[j[a : a + 65536]]) for a in range(0, len(r), 65536)] or [np.zeros(0)])
        good = scores >= theta[r]
        r, ids, scores = (np.concatenate(x) for x in zip(best, (r[good], c_ids[j[good]], scores[good])))
        by = np.lexsort((ids, -scores, r))
        r, ids, scores = r[by], ids[by], scores[by]
        start = np.searchsorted(r, r)
        top = np.arange(len(r)) - start < k
        best = (r[top], ids[top], scores[top])
        full = np.flatnonzero((np.arange(len(best[0])) - np.searchsorted(best[0], best[0])) == k - 1)
        theta[best[0][full]] = np.maximum(theta[best[0][full]], best[2][full])
    return q_ids[best[0]], best[1], best[2]


def _pair_task(dim: int, turn: np.ndarray, k: int):
    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q_ids, ids, scores = block_topk(
            left.column("vec_id").to_numpy(), _matrix(left.column("v"), dim), left.column("theta").to_numpy(),
            right.column("vec_id").to_numpy(), _matrix(right.column("v"), dim), turn, k,
        )
        return pa.table({"query_id": q_ids, "vec_id": ids, "score": scores.astype(np.int64)})

    return task


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(embeddings: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query vector the ``k`` best other vectors by exact inner product.

    ``embeddings``: vec_id, embedding, ...; ``is_query``: which vec_ids are
    queries. Components become floor(scale * x); scores are exact while they are
    below 2^53. Ties go to the smaller vec_id; a query with fewer than ``k``
    others has all of them.

    Rows without id or vector, or with a null or non-finite component, take no
    part. Shorter vectors are filled with zeros. A vec_id that occurs more than
    once is a candidate once for each row, and one query: the row with the least
    vector; it is never its own candidate. Other columns are left out. No
    queries: no rows.
    """
    vectors = integer_vectors(embeddings, scale)
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    rows, dim = facts["n"], max(1, facts["dim"] or 1)
    blocks = max(1, -(-rows // BLOCK_ROWS))
    turn = rotation(vectors, dim)
    # equal lengths are spread by the id's hash, so copies of one vector fill no block
    cut = vectors.repartitionByRange(blocks, F.desc("norm2"), F.xxhash64("vec_id"))
    cut = stored(cut.withColumn("block", F.spark_partition_id()), "vectors")
    first = cut.agg(F.min("block")).first()[0] or 0

    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "norm2")).alias("q"))
    queries = stored(queries.select("vec_id", "q.v", "q.norm2"), "queries")
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    queries = queries.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    task = _pair_task(dim, turn, k)
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")

    def pairs(q: DataFrame, c: DataFrame) -> DataFrame:
        return q.groupBy("group", "block").cogroup(c.groupBy("group", "block")).applyInArrow(task, RESULT)

    head = pairs(
        queries.select("group", F.lit(first).alias("block"), "vec_id", "v", F.lit(float("-inf")).alias("theta")),
        cut.where(F.col("block") == first).select(every_group, "block", "vec_id", "v"),
    )
    head = stored(head, "first")
    kth = head.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k)
    known = queries.join(kth.select(F.col("query_id").alias("vec_id"), "low"), "vec_id", "left").select(
        "group", "vec_id", "v", "norm2", F.coalesce(F.col("low").cast("double"), F.lit(float("-inf"))).alias("theta")
    )
    # the length that a vector needs to matter to any query of the group
    need = known.groupBy("group").agg(F.min(F.when(F.col("norm2") > 0, F.col("theta") / F.sqrt("norm2")).otherwise(F.lit(float("-inf")))).alias("need"))
    lengths = cut.where(F.col("block") != first).groupBy("block").agg(F.sqrt(F.max("norm2")).alias("longest"))
    open_pairs = stored(
        lengths.select("block", "longest", every_group).join(need, "group").where(F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("need")).select("group", "block"),
        "pairs",
    )
    rest = pairs(
        known.join(open_pairs, "group").select("group", "block", "vec_id", "v", "theta"),
        cut.join(open_pairs, "block").select("group", "block", "vec_id", "v"),
    )
    return _ranked(head.union(rest), k).select("query_id", "rank", "vec_id", "score")
