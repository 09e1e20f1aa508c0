"""All names of one side with all of the other in a grid of tiles, each scored by one task, of which only what is asked for comes back.

A name is copied along its row or column of the grid, so a task holds one tile's names of either side and no pair of names becomes a row of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks

#: Names a side of a tile at most, and at least where there are more tasks to be had; scores that are held at once.
TILE, LEAST, HELD = 5_000, 256, 1 << 19
SCHEMA = "side string, key long, points long, other long"


def _sizes(spark, n_a: int, n_b: int) -> tuple[int, int]:
    """Rows and columns of the grid."""
    columns = max(1, -(-n_b // TILE))
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, -(-n_a // TILE), min(-(-tasks // columns), -(-n_a // LEAST))), columns


def _row_of(counts: dict[int, int], rows: int, *by: str):
    """The row of the grid that a ledger name is in: names stand by their lengths, as those of one length are scored faster together, and the rows are equal parts of that line."""
    before, at = {}, 0
    for length in sorted(counts):
        before[length], at = at, at + counts[length]
    pick = lambda x: F.element_at(F.create_map(*(F.lit(v) for kv in x.items() for v in kv)), F.length("a_clean"))
    share = F.pmod(F.xxhash64("a_clean", *by), F.lit(1 << 20)) / (1 << 20)
    place = pick({k: float(v) for k, v in before.items()}) + share * pick({k: float(v) for k, v in counts.items()})
    return F.least(F.floor(place * (rows / at)), F.lit(rows - 1)).cast("long")


def column_of(text, columns: int):
    """The column of the grid that a statement name is in."""
    return F.pmod(F.xxhash64(text), F.lit(columns).cast("long"))


def compared(a: DataFrame, b: DataFrame, parts: tuple[str, ...], work: Callable, schema: str, carried: str | None = None) -> tuple[DataFrame, int]:
    """What ``work`` makes of every tile, and the number of columns. ``a`` and ``b``: the columns ``first`` and ``parts`` of names, with the prefix of their side; ``a`` may have one more column, ``carried``.

    ``work`` gets, of a tile, its column and, of either side, a table in the order of ``first``, and gives record batches.
    """
    spark = a.sparkSession
    counts = {r[0]: r[1] for r in a.groupBy(F.length("a_clean")).count().collect()} or {0: 1}  # a row for each length of a name
    rows, columns = _sizes(spark, sum(counts.values()), b.count())
    along = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    row = _row_of(counts, rows, *([carried] if carried else []))
    told = lambda side: [F.col(f"{side}_{c}").alias(c) for c in ("first", *parts)]
    kind = a.schema[carried].dataType if carried else "string"
    left = a.select(F.lit(True).alias("own"), *told("a"), (F.col(carried) if carried else F.lit(None).cast(kind)).alias("carried"), row.alias("_r"), along(columns).alias("_c"))
    right = b.select(F.lit(False).alias("own"), *told("b"), F.lit(None).cast(kind).alias("carried"), along(rows).alias("_r"), column_of("b_clean", columns).alias("_c"))
    met = left.unionByName(right).withColumn("tile", (F.col("_r") * columns + F.col("_c")).cast("int")).drop("_r", "_c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        for tile in table["tile"].unique().to_pylist() if table else ():
            one = table.filter(pa.compute.equal(table["tile"], tile)).sort_by("first")
            own = one["own"].to_numpy()
            x, y = one.filter(pa.array(own)), one.filter(pa.array(~own))
            if x.num_rows and y.num_rows:
                yield from work(tile % columns, x, y)

    return met.repartitionById(rows * columns, "tile").mapInArrow(run, schema), columns


def _strips(x: pa.Table, y: pa.Table, parts: tuple[str, ...], score: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of names of ``x`` and their points with all names of ``y``, a bounded number at a time; names of one length come together."""
    lists = {p: x[p].to_pylist() for p in parts}
    order = np.argsort(np.fromiter(map(len, lists["clean"]), np.int64, x.num_rows), kind="stable")
    other = blocks.Side({p: y[p].to_pylist() for p in parts})
    step = max(1, HELD // y.num_rows)
    for at in (order[i : i + step] for i in range(0, len(order), step)):
        yield at, np.rint(score(blocks.Side({p: [v[i] for i in at] for p, v in lists.items()}), other) * 10000).astype(np.int64)


def _batch(side: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([side] * len(columns[0]), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["side", "key", "points", "other"])


def _keeping(parts: tuple[str, ...], score: Callable, k: int, least: int) -> Callable:
    """Side a: the k best of every ledger name of the tile with ``least`` points; b: the best ledger name of every statement name; n: pairs, those above 0, equal names."""

    def work(_, x: pa.Table, y: pa.Table):
        a, b = x["first"].to_numpy(), y["first"].to_numpy()
        n_a, n_b = len(a), len(b)
        best_b, above = np.full(n_b, -1, np.int64), 0
        for at, points in _strips(x, y, parts, score):
            above += int((points > 0).sum())
            np.maximum(best_b, (points * n_a + (n_a - 1 - at)[:, None]).max(0), out=best_b)
            key = points * n_b + np.arange(n_b - 1, -1, -1)  # the first of equals is the largest
            key = np.partition(key, n_b - k, axis=1)[:, n_b - k :] if k < n_b else key
            won, place = key // n_b, n_b - 1 - key % n_b
            i, j = np.nonzero(won >= least)
            yield _batch("a", a[at][i], won[i, j], b[place[i, j]])
        won = best_b // n_a
        yield _batch("b", b[won >= least], won[won >= least], a[n_a - 1 - best_b % n_a][won >= least])
        same = len({t for t in x["clean"].to_pylist() if t} & set(y["clean"].to_pylist()))
        yield _batch("n", np.array([n_a * n_b]), np.array([above]), np.array([same]))

    return work


def kept(a: DataFrame, b: DataFrame, k: int, weights: dict[str, float], penalty_from: float = 0.0) -> DataFrame:
    """(side, key, points, other) of the tiles by the whole method: see ``_keeping``. Pairs of score 0 are left out."""
    score = lambda x, y: blocks.scores(x, y, weights, penalty_from)
    return compared(a, b, blocks.PARTS, _keeping(blocks.PARTS, score, k, 1), SCHEMA)[0]


def best_ratios(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The same by the plain ratio, with pairs of score 0."""
    return compared(a, b, ("clean",), _keeping(("clean",), blocks.ratios, k, 0), SCHEMA)[0]


#: Stands for all statement names, where a ledger name is like none.
ALL = -1


def top_ratios(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_first, points, names): the statement names of every ledger name that have its best plain ratio, or ``ALL`` where that is 0."""

    def work(_, x: pa.Table, y: pa.Table):
        keys, others = x["first"].to_numpy(), y["first"].to_numpy()
        for at, points in _strips(x, y, ("clean",), blocks.ratios):
            most = points.max(1)
            i, j = np.nonzero((points == most[:, None]) & (most > 0)[:, None])
            yield _batch("a", keys[at][i], points[i, j], others[j])
            none = keys[at][most == 0]
            yield _batch("a", none, np.zeros(len(none), np.int64), np.full(len(none), ALL))

    found = compared(a, b, ("clean",), work, SCHEMA)[0]
    level = found.groupBy("key", "points").agg(F.sort_array(F.collect_set("other")).alias("names"))
    return level.groupBy(F.col("key").alias("a_first")).agg(F.max_by(F.struct("points", "names"), "points").alias("m")).select("a_first", "m.points", "m.names")


#: Ledger records that one row of ``every_ratio`` carries.
CHUNK = 4096


def every_ratio(own: DataFrame, rows: DataFrame) -> DataFrame:
    """(a_idx, b_idx, points) of all records (a_idx, a_clean) and (b_idx, b_clean) by the plain ratio. Points come as a list for each ledger name and column of the grid; records are
    unfolded where it lies, so no table of pairs is moved or stored. A name of many records is several rows, which different tasks get."""
    counts = own.groupBy("a_clean").agg(F.ceil(F.count("*") / CHUNK).alias("_n"))
    chunk = F.pmod(F.xxhash64("a_idx"), F.col("_n"))
    a = own.join(counts, "a_clean").groupBy("a_clean", chunk.alias("_k")).agg(F.collect_list("a_idx").alias("a_ids"))
    a = a.select(F.lit(0).cast("long").alias("a_first"), "a_clean", "a_ids")
    b = rows.groupBy("b_clean").agg(F.min("b_idx").alias("b_first"))

    def work(column: int, x: pa.Table, y: pa.Table):
        ids = x["carried"]
        for at, points in _strips(x, y, ("clean",), blocks.ratios):
            for lo in range(0, len(at), 16):
                some = points[lo : lo + 16].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * some.shape[1], pa.int32()), pa.array(some.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([column] * len(some), pa.int64()), ids.take(pa.array(at[lo : lo + 16])).combine_chunks(), lists], ["_c", "a_ids", "all"])

    found, columns = compared(a, b, ("clean",), work, "_c long, a_ids array<long>, all array<int>", "a_ids")
    place = F.row_number().over(Window.partitionBy("_c").orderBy("b_first")) - 1  # names of a column, no more than TILE on average
    places = b.select("b_clean", "b_first", column_of("b_clean", columns).alias("_c")).withColumn("_p", place)
    lists = rows.join(places, "b_clean").groupBy("_c").agg(F.collect_list(F.struct("b_idx", "_p")).alias("_rows"))
    met = found.join(F.broadcast(lists), "_c").select(F.explode("a_ids").alias("a_idx"), "all", "_rows")
    return met.select("a_idx", "all", F.explode("_rows").alias("_b")).select("a_idx", "_b.b_idx", F.get("all", F.col("_b._p")).alias("points"))
