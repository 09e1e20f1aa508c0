"""Near-duplicate embeddings by Euclidean p-stable hashing.

Normalised vectors are projected on random Gaussian directions, shifted and quantised; the quantised values of one table make a bucket. For unit
vectors a cosine is a distance, so the bucket width, the projections per table and the number of tables follow from the threshold, the number of
vectors and the recall asked for. Vectors that meet in a bucket are compared exactly, in double precision, by blocks of products.
A pair counts in the first table in which it meets, so no pairs have to be made distinct: a task returns counts per vector and a spanning forest.
Wide buckets keep the tables few, as every table moves every vector once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

#: Probability at least with which a pair exactly at the threshold meets in some table; closer pairs meet more often.
RECALL = 0.995
#: Bucket width in units of the distance at the threshold, and the random partners in a bucket that set the number of projections.
WIDTH, PARTNERS = 8.0, 8192
#: Members of a slice of a bucket, of which a task compares two at most, and rows of one product.
SLICE, BLOCK = 16384, 512


def _meet(width_over_distance: float) -> float:
    """Probability that one projection puts two vectors in one bucket (the p-stable formula for Gaussians)."""
    r = width_over_distance
    normal = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int, float]:
    """(projections per table, tables, bucket width) for n vectors."""
    distance = math.sqrt(2 - 2 * threshold)
    width = WIDTH * distance
    near, far = _meet(WIDTH), _meet(width / math.sqrt(2))
    k = max(2, math.ceil(math.log(max(n, 2) / PARTNERS) / -math.log(far)))
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))
    return k, tables, width


def _vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components of a column of vectors, where each vector starts, and its length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets, np.int64)
    return column.values.to_numpy(zero_copy_only=False), offsets[:-1], np.diff(offsets)


def _unit(flat: np.ndarray, start: np.ndarray, dim: int) -> np.ndarray:
    """The vectors that start there, in double precision and of length one."""
    x = flat[start[:, None] + np.arange(dim)].astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1)[:, None]


def _hasher(k: int, tables: int, width: float, seed: int):
    """Adds each vector's bucket in every table, as a 32-bit hash."""

    def run(batches):
        drawn: dict[int, tuple] = {}
        weigh = np.random.default_rng(seed).integers(1, 1 << 62, k).astype(np.uint64) | np.uint64(1)
        for batch in batches:
            flat, start, dims = _vectors(batch.column("embedding"))
            signatures = np.empty((len(start), tables), np.int32)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                if dim not in drawn:
                    rng = np.random.default_rng([seed, dim])
                    drawn[dim] = rng.normal(size=(dim, k * tables)), rng.uniform(0, width, k * tables)
                a, shift = drawn[dim]
                cell = np.floor((_unit(flat, start[rows], dim) @ a + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(rows), tables, k)
                with np.errstate(over="ignore"):
                    h = C.mix64((cell * weigh).sum(2, dtype=np.uint64) + np.uint64(dim))
                signatures[rows] = (h >> np.uint64(33)).astype(np.int32)
            offsets = pa.array(np.arange(len(start) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(signatures.reshape(-1)))], [*batch.schema.names, "signature"])

    return run


_PLACE = ["table", "key", "dim"]
_GROUP = [*_PLACE, "low", "high"]


def close_pairs(x: np.ndarray, first: np.ndarray, second: np.ndarray | None, threshold: float):
    """Chunks of (i, j) with a cosine of the unit vectors ``x`` at the threshold or above: i of ``first`` with the later ones of it, or with all of ``second``.

    A product in single precision decides all pairs that are farther from the threshold than its error can be; the others are multiplied in double precision.
    """
    single, slack = x.astype(np.float32), max(1e-6, x.shape[1] * 2.0**-22)
    for at in range(0, len(first), BLOCK):
        q = first[at : at + BLOCK]
        others = first[at + 1 :] if second is None else second
        for to in range(0, len(others), BLOCK):
            o = others[to : to + BLOCK]
            near = single[q] @ single[o].T
            i, j = np.nonzero(near >= threshold - slack)
            cosine = near[i, j]
            i, j = q[i], o[j]
            if second is None:
                later = i < j
                i, j, cosine = i[later], j[later], cosine[later]
            unsure = np.flatnonzero(cosine < threshold + slack)
            if len(unsure):
                below = unsure[np.einsum("nd,nd->n", x[i[unsure]], x[j[unsure]]) < threshold]
                i, j = np.delete(i, below), np.delete(j, below)
            if len(i):
                yield i, j


def _comparer(threshold: float):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def bucket(table: int, low: int, high: int, own: np.ndarray, x: np.ndarray, copies: np.ndarray, before: np.ndarray):
        """Of one group: copies linked with each member, and each member's root within it."""
        n = len(copies)
        links = np.zeros(n, np.int64)
        if table and (before == before[0]).all(0).any():
            return links, np.arange(n)  # all of them met in one earlier table
        first, second = (np.arange(n), None) if low == high else (np.flatnonzero(own == low), np.flatnonzero(own == high))

        def pairs():
            for i, j in close_pairs(x, first, second, threshold):
                for t in range(table):
                    fresh = before[i, t] != before[j, t]
                    i, j = i[fresh], j[fresh]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                yield i, j

        return links, C.forest(n, pairs())

    def run(batches):
        for t in C.whole_groups(batches, _GROUP):
            table, dim, low, high, own, copies, ids = (t.column(c).to_numpy() for c in ("table", "dim", "low", "high", "own", "copies", "rep"))
            first = C.group_starts([t.column(c).to_numpy() for c in _GROUP])
            size = np.diff(np.append(first, len(ids)))
            flat, start, _ = _vectors(t.column("embedding"))
            seen, seen_start, _ = _vectors(t.column("before"))
            out: list[list] = [[], [], []]
            for a, n in zip(first[size > 1], size[size > 1]):
                rows = slice(a, a + n)
                before = seen[seen_start[a] : seen_start[a] + n * table[a]].reshape(n, table[a])
                links, root = bucket(int(table[a]), low[a], high[a], own[rows], _unit(flat, start[rows], int(dim[a])), copies[rows], before)
                said = np.flatnonzero((links > 0) | (root != np.arange(n)))
                for o, v in zip(out, (ids[rows][said], links[said], ids[rows][root[said]])):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64)) for o in out], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """``vectors`` (vec_id, embedding) with n_links and component_id, one row for each input row.

    Equal vectors are compared as one class that remembers its copies, so thousands of copies cost one vector; all its rows have the
    same links, the other copies among them. A vector that is null, empty, zero or holds a null or a non-finite component links with nothing and is its own
    component; vectors of different lengths don't link. A row with a null id counts and links like any other; a component in which every id is null has component
    null. No pair below the threshold is linked; a pair at it is found with probability ``recall`` at least. A bucket over ``SLICE`` classes goes to several
    tasks, each with two slices of it. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    C.small_batches(spark, 4096)
    # two hashes of 64 bits stand for a vector where only its class is looked up
    v = vectors.select("vec_id", "embedding", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(seed), "embedding").alias("g"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    k, tables, width = plan(v.where(valid).select("h", "g").distinct().count(), threshold, recall)
    # a class is named by a number, as its rows may have no id; it is fixed by being written
    classes = v.where(valid).groupBy("embedding", "h", "g").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id())
    hashed = C.materialize(classes.mapInArrow(_hasher(k, tables, width, seed), T.StructType([*classes.schema, T.StructField("signature", T.ArrayType(T.IntegerType()))])), "hashed")
    met = hashed.select("rep", "copies", "embedding", F.size("embedding").alias("dim"), "signature", F.posexplode("signature").alias("table", "key"))
    met = met.withColumn("before", F.slice("signature", F.lit(1), F.col("table"))).drop("signature")
    found = C.tiles(met, _PLACE, ["rep"], SLICE).mapInArrow(_comparer(threshold), "id long, links long, other long")
    found = C.materialize(found.groupBy("id", "other").agg(F.sum("links").alias("links")), "links")
    components = C.connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = hashed.join(links, F.col("rep") == links["id"], "left").drop("id").join(components, F.col("rep") == components["id"], "left").withColumn("component", F.coalesce("component", "rep"))
    of = C.materialize(of.select("h", "g", "component", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    named = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(named, "component").select("h", "g", "n_links", "component_id")
    # written before, so that AQE can split the rows of a frequent vector
    linked = v.where(valid).select("vec_id", "h", "g").join(C.materialize(of, "classes"), ["h", "g"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id")
    return linked.union(v.where(~valid).select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings at cosine 0.95 or more."""
    out = near_duplicates(C.table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
