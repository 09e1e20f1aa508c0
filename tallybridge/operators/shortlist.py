"""Short lists of candidates out of scored pairs of names, in one pass that keeps no pairs.

A name goes by the smallest index of its records. Every task keeps, of the pairs that it scores, the best few statement names of each ledger name and the best
ledger name of each statement name; what tasks kept is merged by two aggregations. Scores are whole ten-thousandths, ``points``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import grid, scoring
from .shared import written

#: Candidates of a name at first, and how many times more when a list has run out.
LENGTH, LONGER = 32, 8
#: Pairs that a task holds before it drops all but the best.
HELD = 1 << 20


def _best_rows(key: np.ndarray, points: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k rows of every key with the most points, the smallest ``other`` on ties."""
    order = np.lexsort((other, -points, key))
    key, points, other = key[order], points[order], other[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    place = np.arange(len(key)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return key[place < k], points[place < k], other[place < k]


def _keeper(k: int):
    def keep(batches):
        held, size, limit = [], 0, HELD

        def best():
            a, points, b = (np.concatenate(c) for c in zip(*held))
            return [_best_rows(a, points, b, k)], [_best_rows(b, points, a, 1)]

        sides: list[list] = [[], []]

        def shrink():
            nonlocal held, size, limit
            for side, new in zip(sides, best()):
                side += new
                if len(side) > 1:
                    side[:] = [_best_rows(*(np.concatenate(c) for c in zip(*side)), k if side is sides[0] else 1)]
            held, size = [], 0

        for batch in batches:
            a, b, score = (batch.column(c).to_numpy() for c in ("a_first", "b_first", "score"))
            points = np.rint(score * 10000).astype(np.int64)
            live = points > 0
            if live.any():
                held.append((a[live], points[live], b[live]))
                size += int(live.sum())
            if size > limit:
                shrink()
        if held:
            shrink()
        for side, rows in zip("ab", sides):
            for key, points, other in rows:
                yield pa.RecordBatch.from_arrays([pa.array([side] * len(key), pa.string()), pa.array(key), pa.array(points), pa.array(other)], ["side", "key", "points", "other"])

    return keep


def shortlists(scored: DataFrame, k: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Of pairs (a_first, b_first, score): ``lists`` (a_first, b_first, points, cut) and ``best_b`` (b_first, a_first, points). Pairs of score 0 are in neither.

    A list holds the k best. ``cut`` is 0 where that is all; else the points of the last one, so what has more points is there in full.
    """
    return merged(scored.select("a_first", "b_first", "score").mapInArrow(_keeper(k), grid.SCHEMA), k)


def all_names(a: DataFrame, b: DataFrame, k: int = LENGTH, *, algorithm: str = "weighted", penalty_from: float = 0.0, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """The same of all names of ``a`` with all of ``b`` (columns of ``scoring.names``, with their first keys). ``seen`` gets the counts pairs, above (of those above 0) and same (of names on both sides)."""
    if scoring.in_blocks(algorithm):
        kept = grid.kept(a, b, k, scoring.ALGORITHMS[algorithm], penalty_from)
        if seen:
            total = lambda c: F.sum(F.when(F.col("side") == "n", F.col(c)))
            kept = kept.observe(seen, total("key").alias("pairs"), total("points").alias("above"), total("other").alias("same"))
        return merged(kept.where("side <> 'n'"), k)
    return shortlists(scoring.observed(scoring.score_names(a, b, algorithm, None, penalty_from), seen), k)


def merged(kept: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``lists`` and ``best_b`` out of what tasks kept."""
    kept = written(kept, "kept")
    by_a, by_b = kept.where("side = 'a'"), kept.where("side = 'b'")
    placed = by_a.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.col("points").desc(), "other"))).where(F.col("place") <= k)
    full = F.count("*").over(Window.partitionBy("key")) == k
    lists = placed.select(F.col("key").alias("a_first"), F.col("other").alias("b_first"), "points", F.when(full, F.min("points").over(Window.partitionBy("key"))).otherwise(0).alias("cut"))
    best = by_b.groupBy("key").agg(F.max(F.struct("points", (-F.col("other")).alias("o"))).alias("m"))
    return written(lists, "lists"), best.select(F.col("key").alias("b_first"), (-F.col("m.o")).alias("a_first"), F.col("m.points").alias("points"))
