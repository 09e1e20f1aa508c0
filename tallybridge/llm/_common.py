"""What several operators share: the shared folder, written tables, rows dealt by key, text batches, word hashes, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are cut into groups of about so many bytes for vectorised work; a longer text is a group of its own.
GROUP_BYTES = 2 << 20
#: Contents of character classes of Java patterns: white space, and scripts written without spaces (Thai to Tibetan, Burmese, Khmer, Tai, Chinese, Japanese).
SPACE = r"\s\u0085\u00A0\u1680\u2000-\u200B\u2028\u2029\u202F\u205F\u3000"
UNSPACED = r"\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u1950-\u1AAF\u2E80-\u2FFF\u3001-\u9FFF\uA9E0-\uA9FF\uAA60-\uAADF\uF900-\uFAFF\uFF66-\uFF9F" + "\U00020000-\U0003FFFD"  # as they are: Java's lookbehind misses them as escapes


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``. Where it is unset a local master (tests) gets a new local one; a
    cluster is an error, as its machines would not see each other's files."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d is None:
        d = spark.sparkContext.getCheckpointDir()
    if d is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="tallybridge-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallybridge/{uuid.uuid4().hex[:12]}-{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once and its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    remove(df.sparkSession, df.written_at)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def local_view(path: str) -> str:
    """A mounted shared folder as an ordinary path; memory mapping needs one."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder (file:) for memory-mapped files, not {path}")
    return path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def tiles(keyed: DataFrame, place: list[str], member: list[str], slice_rows: int) -> DataFrame:
    """Rows of ``keyed`` brought together by ``place``, sorted, for comparing the members of a place with each other.

    A place of over ``slice_rows`` members is cut into slices by a hash of ``member``, and every pair of slices (low, high) is a group of its own, so no task
    holds more than two slices whatever the size of the place. ``own`` is a row's slice: in a group with low = high all pairs count, in another one those of a
    row of ``low`` with a row of ``high``. Groups come whole and in the order of (place, low, high, own, member).
    """
    # written, so that Spark knows its size before it plans the join: rows then move once, unless very many places are large
    large = keyed.groupBy(*place).count().where(F.col("count") > slice_rows).select(*place, F.ceil(F.col("count") / slice_rows).cast("int").alias("slices"))
    dealt = keyed.join(materialize(large, "large-places"), place, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(*member), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "slices")
    order = [*place, "low", "high"]
    return dealt.repartition(partitions(keyed.sparkSession), *order).sortWithinPartitions(*order, "own", *member)


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole groups of equal ``key`` out of sorted batches, of ``rows`` rows or little more; a larger group is a table of its own."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        new = np.zeros(batch.num_rows, bool)
        for k, c in enumerate(columns):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= last is None or c[0] != last[k]
        last = [c[-1] for c in columns]
        at = np.flatnonzero(new)
        if size + batch.num_rows >= rows and len(at) and size + at[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, at[-1])])
            held, size, batch = [], 0, batch.slice(at[-1])
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def group_starts(columns: list[np.ndarray]) -> np.ndarray:
    """First rows of the runs of equal values."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts: hold Arrow batches to ``rows`` rows, so that a worker's memory stays bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def text_groups(batch: pa.RecordBatch, name: str = "text", limit: int = GROUP_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of groups of about ``limit`` bytes; a null text counts as empty. No copy of the bytes is made."""
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield slice(i, j), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE -= _BASE % 8 - 5  # 5 modulo 8: powers stay distinct in their low bits
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, GROUP_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and the row of each.

    A word's hash is a polynomial in its bytes, taken for all words at once from running sums, then mixed.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = word[cut]  # a text's end also ends a word
    last[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _power_table(n)
    with np.errstate(over="ignore"):
        run = np.cumsum(_BYTE[_LOWER[data]] * up[:n], dtype=np.uint64)
        h = run[ends] - np.where(starts > 0, run[starts - 1], np.uint64(0))
        h = mix64(h * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(off, starts, "right") - 1


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge (a, b) of longs.

    Alternating large-star and small-star rounds: each hangs neighbours on the smallest one, and the rounds end when only stars
    are left. Every round is a few joins and grouped minima, nothing is gathered in one place, and each round's edges are written
    to the shared folder, so a lost executor costs one round at most. Self-edges and nulls are dropped; no edges: no rows.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = materialize(edges.where(F.col("a") != F.col("b")).select(a.alias("a"), b.alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or state == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
        seen = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(hung.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(now)
        now = after


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], holds: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The smallest index in each index's component, over chunks of index pairs; with ``holds``, over those for which it is true. Pairs that are joined
    already are not asked for."""
    label = np.arange(n)
    for i, j in pairs:
        if holds is not None:
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            true = holds(i, j)
            i, j = i[true], j[true]
        while len(i):
            p, q = label[i], label[j]
            differ = p != q
            if not differ.any():
                break
            i, j, p, q = i[differ], j[differ], p[differ], q[differ]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label
