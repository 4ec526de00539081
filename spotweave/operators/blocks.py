"""Smoothing of shares over blocks of tissue: several steps for one shuffle.

A block is a square of the grid of a sample. Its task gets the spots of the block and a border as wide as the
spots reach in those steps, so the values of its own spots are those of a run over the whole sample.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from spotweave.operators.spatial import AT, WORK

# functions sent to tasks travel by value: executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block with its border, and shares of all points in it, at most.
ROWS, VALUES = 1 << 13, 1 << 21
#: Steps for one shuffle at most; a border is no wider than a quarter of its block.
STEPS = 5
#: Sides of a block that are tried: twice the radius, doubled up to so many times.
LEVELS = 10


class Blocks(NamedTuple):
    side: float
    steps: int


class Move(NamedTuple):
    """What a parameter point does: ``steps`` times a pull to the neighbours, a threshold and a largest change."""

    pull: float
    threshold: float
    cap: float
    steps: int


def _steps(level: int) -> int:
    return min(STEPS, 1 << level >> 1)


def block_plan(rows: DataFrame, radius: float, width: int, work: int = WORK) -> Blocks | None:
    """The largest blocks that a task can hold, ``width`` shares to a row; None where spots lie too densely for any.

    The pairs of a block are bounded by its rows and the densest cell of twice the radius, as a circle touches four of them.
    """
    side = 2.0 * float(radius)
    cells = rows.groupBy("sample", *[F.floor(F.col(c) / side).alias(n) for c, n in zip(AT, ("_cx", "_cy"))]).agg(F.count(F.lit(1)).alias("_n"))
    sizes = [F.struct(F.lit(m).alias("m"), F.lit(1 << m).alias("w"), F.lit(-(-_steps(m) // 2)).alias("h")) for m in range(LEVELS + 1)]
    tried = cells.select("*", F.inline(F.array(*sizes)))
    for c in ("_cx", "_cy"):
        tried = tried.withColumn(c, F.explode(F.sequence(F.floor((F.col(c) - F.col("h")) / F.col("w")), F.floor((F.col(c) + F.col("h")) / F.col("w")))))
    held = tried.groupBy("sample", "m", "_cx", "_cy").agg(F.sum("_n").alias("_n"))
    most = {r.m: r.n for r in held.groupBy("m").agg(F.max("_n").alias("n")).collect()}
    for level in range(LEVELS, 0, -1):
        n = most.get(level, 0)
        if 0 < n <= ROWS and n * width <= VALUES and 4 * n * most[0] <= 8 * work:
            return Blocks(side * (1 << level), _steps(level))
    return None


def with_border(rows: DataFrame, blocks: Blocks, radius: float) -> DataFrame:
    """Rows in every block ``_bx, _by`` that has them in its border; ``_own`` in their own."""
    own = F.lit(True)
    for c, b in zip(AT, ("_bx", "_by")):
        # a little wider than the steps reach, so that rounding never loses a neighbour
        margin = F.lit(blocks.steps * radius * (1 + 1e-9)) + F.abs(F.col(c)) * 1e-14
        low, high = (F.floor((F.col(c) + m) / blocks.side) for m in (-margin, margin))
        rows = rows.withColumn(b, F.explode(F.sequence(low, high)))
        own = own & (F.col(b) == F.floor(F.col(c) / blocks.side))
    return rows.withColumn("_own", own)


def _pairs(x: np.ndarray, y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and other rows within ``radius``; the rows lie sorted by cells as wide as the radius. NaN is near nothing."""
    side = radius * (1 + 1e-6) + max(np.nanmax(np.abs(x), initial=0), np.nanmax(np.abs(y), initial=0)) * 1e-14
    cx, cy = (np.nan_to_num(np.floor((v - np.nanmin(v, initial=np.inf)) / side), nan=0).astype(np.int64) + 1 for v in (x, y))
    line = cx.max() + 2
    order = np.lexsort((y, x, cx, cy))
    at, x, y = (cy * line + cx)[order], x[order], y[order]
    found = []
    for up in (-line, 0, line):
        low, high = np.searchsorted(at, at + up - 1), np.searchsorted(at, at + up + 1, "right")
        n = high - low
        a = np.repeat(np.arange(len(at)), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n - low, n)
        near = ((x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 <= radius**2) & (a != b)
        found.append((order[a[near]], order[b[near]]))
    return tuple(np.concatenate(v) for v in zip(*found))


class _Neighbours:
    """Neighbours of rows that are ordered by falling number of neighbours: the first of each row, the second, and so on."""

    def __init__(self, x: np.ndarray, y: np.ndarray, radius: float):
        a, b = _pairs(x, y, radius)
        n = np.bincount(a, minlength=len(x))
        self.order = np.argsort(-n, kind="stable")
        self.n = n[self.order]
        rank = np.empty_like(self.order)
        rank[self.order] = np.arange(len(x))
        a, b = rank[a], rank[b]
        by_row = np.argsort(a, kind="stable")
        a, b = a[by_row], b[by_row]
        turn = np.arange(len(a)) - (np.cumsum(self.n) - self.n)[a]
        self.others = np.split(b[np.argsort(turn, kind="stable")], np.cumsum(np.bincount(turn))[:-1]) if len(a) else []

    def sums(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros_like(p)
        for other in self.others:
            out[: len(other)] += p[other]
        return out


def _step(e: np.ndarray, p: np.ndarray, near: _Neighbours, pull: np.ndarray, threshold: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """``deconv._moved`` for rows x points x types; NaN is above all numbers, as in Spark."""
    n = near.n[:, None, None]
    mean = np.where(n > 0, near.sums(p) / np.maximum(n, 1), e)
    z = np.maximum((e + pull * mean) / (1 + pull) - threshold, 0)
    y = np.maximum(p + np.fmin(np.maximum(z - p, -cap), cap), 0)
    total = y.sum(2, keepdims=True)
    none = total <= 0
    return np.where(none, p, y / np.where(none, 1, total))


def _task(radius: float, k: int, moves: Sequence[Move]) -> Callable[[pa.Table], pa.Table]:
    pull, threshold, cap = (np.array([m[i] for m in moves])[:, None] for i in range(3))
    last = np.array([m.steps for m in moves])

    def lists(column: pa.ChunkedArray, n: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1, k)

    def task(table: pa.Table) -> pa.Table:
        own = np.flatnonzero(table["_own"].to_numpy())
        n = table.num_rows if len(own) else 0
        out = table.take(own).drop_columns(["_bx", "_by", "_own", "p"])
        gaps, p = np.zeros((last.max(), len(last))), np.zeros((0, 1))
        if n:
            near = _Neighbours(*(table[c].to_numpy() for c in AT), radius)
            mine = np.zeros(n, bool)
            mine[own] = True
            mine, e, p = mine[near.order], lists(table["e"], n)[near.order], lists(table["p"], n)[near.order]
            for t in range(last.max()):
                new = np.where((t < last)[:, None], _step(e, p, near, pull, threshold, cap), p)
                gaps[t] = np.abs(new - p)[mine].max((0, 2))
                p = new
            back = np.empty_like(p)
            back[near.order] = p
            p = back[own].reshape(len(own), -1)
        ends = pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32())
        out = out.append_column("p", pa.ListArray.from_arrays(ends, pa.array(p.ravel())))
        # noted once for a block
        noted = [gaps.ravel().tolist(), *[None] * (len(own) - 1)][: len(own)]
        return out.append_column("gaps", pa.array(noted, pa.list_(pa.float64())))

    return task


def smoothed(rows: DataFrame, blocks: Blocks, radius: float, k: int, moves: Sequence[Move]) -> DataFrame:
    """Rows ``sample, spot, spot_x, spot_y, e, p`` (and others of their own) after the steps of each point; ``p`` is flat: points x types.

    ``gaps``: the largest change in a block for each step and point, flat, in one row of each block.
    """
    kept = [c for c in rows.columns if c not in ("sample", "spot", *AT, "e", "p")]
    met = with_border(rows, blocks, radius).withColumns({c: F.when(F.col("_own"), F.col(c)) for c in kept})
    schema = StructType([f for f in rows.schema if f.name != "p"]).add("p", ArrayType(DoubleType())).add("gaps", ArrayType(DoubleType()))
    return met.groupBy("sample", "_bx", "_by").applyInArrow(_task(float(radius), k, moves), schema)
