"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are grouped exactly first. Distinct ones meet in buckets: the 64 bits are cut into more blocks than bits may differ, so that two close
fingerprints agree on at least one whole block. In a task, all members of all its buckets are turned into 64 vertical bit planes; each
member is compared with words of 64 others at once, carry-save adders count the differing planes, and a word is abandoned as soon as
every lane in it is past the radius. Links become spanning forests per bucket, and their components are found by distributed rounds.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

SEED = 42
#: Members of a slice of a bucket; a task compares two slices at most.
SLICE = 8192
#: Words of 64 bits in a wide fingerprint, and members of a random bucket that set the bits of a bucket's key.
WIDE, BUCKET = 8, 1024
#: (query, word) cells compared at a time in a task.
CELLS = 1 << 16
#: Sets of so many shingles at most are compared as they are: the majorities of few shingles say too little of them. Pairs of them checked at a time.
FEW, FEW_PAIRS = 32, 1 << 15


def shingle_hashes(text: str, size: int = 3) -> np.ndarray:
    """XXH64 of every word shingle of A-Z lower-cased text, repeats included; fewer words make one shingle, none make none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), ">u8").astype(np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def wide_simhash(hashes: np.ndarray, words: int) -> list[int]:
    """``words`` fingerprints of 64 bits; the first is the plain one, the others are those of remixed hashes."""
    with np.errstate(over="ignore"):
        return [simhash(hashes if w == 0 else C.mix64(hashes + np.uint64(w) * np.uint64(0x9E3779B97F4A7C15))) for w in range(words)]


def _columns(words: int) -> list[str]:
    return ["fp", *(f"fp{w}" for w in range(1, words))]


def _fingerprinter(size: int, words: int, carried: list[str]):
    def run(batches):
        for batch in batches:
            prints, few = [], []
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text or "", size)
                h = h if words == 1 else np.unique(h)
                prints.append(wide_simhash(h, words))
                few.append(h.view(np.int64) if 0 < len(h) <= FEW else None)
            prints = np.array(prints, np.uint64).reshape(-1, words)
            out = [*map(batch.column, carried), *(pa.array(np.ascontiguousarray(prints[:, w]).view(np.int64)) for w in range(words))]
            names = [*carried, *_columns(words)]
            if words > 1:
                out, names = [*out, pa.array(few, pa.list_(pa.int64()))], [*names, "few"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1, digest: bool = False) -> DataFrame:
    """(doc_id, fp, fp1, …): ``words`` 64-bit fingerprints of every row as signed longs; null text counts as empty, which has fingerprint zero.
    With ``digest``, ``text_digest`` of the text comes after the id. Wide fingerprints come with ``few``: the distinct shingles' hashes in the order of
    unsigned numbers where there are ``FEW`` at most, else (and for no shingle) null.

    A plain fingerprint counts a repeated shingle each time, wide ones count it once, as they stand for the similarity of sets.
    """
    C.small_batches(docs.sparkSession)
    carried = ["doc_id", *(["text_digest"] if digest else [])]
    read = docs.select("doc_id", "text", *([text_digest().alias("text_digest")] if digest else []))
    longs = ", ".join(f"{c} long" for c in [*carried, *_columns(words)])
    return read.mapInArrow(_fingerprinter(size, words, carried), longs + (", few array<long>" if words > 1 else ""))


def text_digest() -> Column:
    """What tells texts of one id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows: row p holds bit p of all values, 64 values to a word."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def close_lanes(planes: np.ndarray, values: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, lanes) where ``values[query]`` is within ``radius`` of some of the ``lanes`` of ``word``.

    Each cell counts in bit-sliced counters that start so high that they overflow just beyond the radius. Three planes go through a full
    adder: their sum enters at weight 1 and their carry at weight 2. Cells whose lanes have all overflowed leave after every
    twelve planes.
    """
    width = max(2, radius.bit_length())
    start = (1 << width) - 1 - radius
    cell = np.arange(len(query))
    near = lanes.copy()
    full = ~np.uint64(0)
    counter = [np.full(len(query), full if start >> k & 1 else 0, np.uint64) for k in range(width)]
    want = values[query]

    def add(x: np.ndarray, k: int) -> np.ndarray:
        for i in range(k, width):
            counter[i], x = counter[i] ^ x, counter[i] & x
        return x

    for p in range(0, 64, 3):
        x = [planes[q][word] ^ (np.uint64(0) - (want >> np.uint64(q) & np.uint64(1))) for q in range(p, min(p + 3, 64))]
        if len(x) == 3:
            half = x[0] ^ x[1]
            near &= ~add(half ^ x[2], 0)
            near &= ~add((x[0] & x[1]) | (half & x[2]), 1)
        else:
            for y in x:
                near &= ~add(y, 0)
        if p % 12 == 9 or p + 3 >= 64:
            keep = near != 0
            if not keep.all():
                cell, near, word, want = cell[keep], near[keep], word[keep], want[keep]
                counter = [c[keep] for c in counter]
                if not len(cell):
                    break
    return cell, near


def _close_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, queries: np.ndarray, radius: int):
    """Chunks of index pairs (i, j), starts[i] <= j < ends[i], of values within the radius; i runs over ``queries``."""
    planes = bit_planes(values)
    start, end = starts[queries], ends[queries]
    spans = np.where(start < end, ((end - 1) >> 6) - (start >> 6) + 1, 0)
    total = np.concatenate([[0], np.cumsum(spans)])
    full = ~np.uint64(0)
    for at in range(0, int(total[-1]), CELLS):
        n = np.arange(at, min(at + CELLS, int(total[-1])))
        k = np.searchsorted(total, n, "right") - 1
        q, w = queries[k], (start[k] >> 6) + n - total[k]
        low, high = np.maximum(start[k] - w * 64, 0), np.minimum(end[k] - w * 64, 64)
        lanes = (full << low.astype(np.uint64)) & (full >> (64 - high).astype(np.uint64))
        cell, near = close_lanes(planes, values, q, w, lanes, radius)
        if len(cell):
            bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            c, lane = np.nonzero(bits)
            yield q[cell[c]], w[cell[c]] * 64 + lane


_GROUP = ["block", "key", "low", "high"]


def _spans(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, queries): the rows that each query row is compared with in whole groups of ``tiles``."""
    low, high, own = (t.column(c).to_numpy() for c in ("low", "high", "own"))
    first = C.group_starts([t.column(c).to_numpy() for c in _GROUP])
    size = np.diff(np.append(first, len(own)))
    ends = np.repeat(first + size, size)
    # a group of one slice compares each member with those after it, one of two slices the first slice's with the second's
    second = np.repeat(first + np.add.reduceat(own == low, first), size)
    starts = np.where(low == high, np.arange(1, len(own) + 1), second)
    return starts, ends, np.flatnonzero((own == low) & (starts < ends))


def _forest_edges(t: pa.Table, pairs, holds=None) -> pa.RecordBatch:
    """A spanning forest of the links of every group, as edges between ``rep``."""
    rep = t.column("rep").to_numpy()
    label = C.forest(len(rep), pairs, holds)
    out = np.flatnonzero(label != np.arange(len(rep)))
    return pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(rep[label[out]])], ["a", "b"])


def _linker(radius: int, words: int = 1, wide_radius: int = 0):
    """Links of fingerprints within ``radius``; of wide ones only if all bits are within ``wide_radius`` and not both rows are ``short``."""

    def link(batches):
        for t in C.whole_groups(batches, _GROUP):
            wide = np.array([t.column(c).to_numpy() for c in _columns(words)]).view(np.uint64)
            short = t.column("short").to_numpy() if words > 1 else None

            def holds(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                return ~(short[i] & short[j]) & (sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in wide) <= wide_radius)

            yield _forest_edges(t, _close_pairs(wide[0], *_spans(t), radius), holds if words > 1 else None)

    return link


def _few_linker(similarity: float):
    """Links of sets ``few`` at a Jaccard similarity of ``similarity`` or more, decided by the sets themselves.

    Each set marks the bits that its hashes' lowest six bits name. Marks differ in no more bits than sets in elements, so the bit-sliced comparison
    of marks leaves out only pairs that differ too much.
    """
    radius = int(2 * FEW * (1 - similarity) / (1 + similarity) + 1e-9)

    def link(batches):
        for t in C.whole_groups(batches, _GROUP):
            sets = t.column("few").combine_chunks()
            flat = sets.flatten().to_numpy().view(np.uint64)
            size = sets.value_lengths().to_numpy()
            at = np.cumsum(size) - size
            marks = np.bitwise_or.reduceat(np.uint64(1) << (flat & np.uint64(63)), at)
            held = np.full((len(size), FEW), ~np.uint64(0))
            held[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at, size)] = flat

            def holds(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                both = np.sort(np.concatenate([held[i], held[j]], axis=1), axis=1)
                shared = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != ~np.uint64(0))).sum(1)
                return shared >= similarity * (size[i] + size[j] - shared) - 1e-9

            close = _close_pairs(marks, *_spans(t), radius)
            parts = ((i[k : k + FEW_PAIRS], j[k : k + FEW_PAIRS]) for i, j in close for k in range(0, len(i), FEW_PAIRS))
            yield _forest_edges(t, parts, holds)

    return link


def _edges(keyed: DataFrame, linker) -> DataFrame:
    """Edges between members of equal (block, key)."""
    return C.tiles(keyed, ["block", "key"], ["rep"], SLICE).mapInArrow(linker, "a long, b long").distinct()


def blocks_for(n: int, radius: int, bucket: int = BUCKET) -> int:
    """As few blocks as keep a bucket of ``n`` random fingerprints to ``bucket`` members: a key is ``blocks - radius`` of them."""
    blocks = radius + 1
    while blocks < 64 and n / 2.0 ** (64 * (blocks - radius) / blocks) > bucket:
        blocks += 1
    return blocks


def close_links(classes: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) over ``rep`` whose components are those of all links between the distinct ``fp`` of ``classes`` (fp, rep).

    Of ``blocks`` blocks any two close values agree on ``blocks - radius``, and every choice of so many is a key. More blocks make wider keys, so their
    number follows from that of the fingerprints (``blocks_for``); the links are the same.
    """
    blocks = blocks or blocks_for(classes.count(), radius)
    cut = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << cut[k + 1]) - (1 << cut[k])) for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    keyed = classes.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])).alias("block", "key"))
    return _edges(keyed, _linker(radius))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def differing_bits(similarity: float) -> float:
    """Share of fingerprint bits that differ between two sets of shingles of one size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def similar_links(classes: DataFrame, n: int, similarity: float, words: int = WIDE, recall: float = 0.99) -> DataFrame:
    """Edges (a, b) over ``rep`` between wide fingerprints that speak for a similarity of ``similarity`` or more of their shingles.

    Such fingerprints differ in too many bits for whole blocks to agree. Instead tables of random bits make the buckets, as many tables as
    ``recall`` asks for and as many bits as hold random buckets of ``n`` members to ``BUCKET``. In a bucket the first 64 bits are compared by bit planes
    at three standard deviations beyond what is expected, and what passes by all bits at two and a half. Pairs with ``few`` on both sides are left to ``few_links``.
    """
    p = differing_bits(similarity)
    bits = max(12, math.ceil(math.log2(max(n, 1) / BUCKET)))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - p) ** bits))
    beyond = lambda width, sigmas: int(width * p + sigmas * math.sqrt(width * p * (1 - p)))
    rng = np.random.default_rng(64)
    keys = []
    for _ in range(tables):
        masks = [0] * words
        for b in rng.choice(64 * words, bits, replace=False).tolist():
            masks[b // 64] |= 1 << b % 64
        keys.append(F.xxhash64(*(F.col(c).bitwiseAND(F.lit(_signed(m)).cast("long")) for c, m in zip(_columns(words), masks))))
    keyed = classes.select(*_columns(words), F.col("few").isNotNull().alias("short"), "rep", F.posexplode(F.array(*keys)).alias("block", "key"))
    return _edges(keyed, _linker(beyond(64, 3), words, beyond(64 * words, 2.5)))


def few_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) over ``rep`` between sets ``few`` at a Jaccard similarity of ``similarity`` or more, all of them and no other.

    Two sets so alike share at least the part ``similarity`` of either, so in one common order they share an element among the first
    n - ceil(similarity * n) + 1 of each; these are the keys.
    """
    n = F.size("few")
    first = (n - F.ceil(n * similarity - 1e-9) + 1).cast("int")
    keyed = classes.where(F.col("few").isNotNull()).select("few", "rep", F.lit(0).alias("block"), F.explode(F.slice("few", F.lit(1), first)).alias("key"))
    return _edges(keyed, _few_linker(similarity))


def near_duplicates(docs: DataFrame, *, size: int = 3, radius: int = 3, blocks: int | None = None, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id reachable over fingerprints at most ``radius`` bits apart, or, where
    ``similarity`` is given, over wide fingerprints that speak for so similar sets of shingles (two sets of ``FEW`` shingles at most: over their own similarity).

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id keep a row and take the component of their
    fingerprint; a component in which every id is null has component null. Repeated rows stay. An empty table gives no rows. Other columns are not read.
    """
    words = 1 if similarity is None else WIDE
    own = _columns(words)
    prints = C.materialize(fingerprints(docs, size, words), "fingerprints")
    if similarity is None:
        classes = _numbered(prints.groupBy(*own).agg(F.min("doc_id").alias("first")))
        of = _components(classes, close_links(classes, radius, blocks), own)
    else:
        of = _similar_classes(prints, similarity, F.col("doc_id"))
    of = of.join(of.groupBy("component").agg(F.min("first").alias("component_id")), "component").select(*own, "component_id")
    return prints.join(of, own, "left").select("doc_id", "fp", "component_id")


def _numbered(classes: DataFrame) -> DataFrame:
    """Classes by numbers: an id can't name one, as ids repeat and rows without an id link like any other."""
    return C.materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")


def _components(classes: DataFrame, links: DataFrame, own: list[str]) -> DataFrame:
    components = C.connected_components(links)
    return classes.join(components, classes["rep"] == components["id"], "left").select(*own, "first", F.coalesce("component", "rep").alias("component"))


def _similar_classes(prints: DataFrame, similarity: float, first: Column) -> DataFrame:
    """(wide fingerprint, first, component) of every distinct wide fingerprint; ``first`` is the least of its rows."""
    own = _columns(WIDE)
    classes = _numbered(prints.groupBy(*own).agg(F.min(first).alias("first"), F.any_value("few").alias("few")))
    return _components(classes, similar_links(classes, classes.count(), similarity).union(few_links(classes, similarity)), own)


def one_of_each(docs: DataFrame, *, size: int, similarity: float) -> DataFrame:
    """(doc_id, text_digest) of the row that stands for each component: the smallest id, then the smallest digest; one without an id only where no row has one."""
    prints = C.materialize(fingerprints(docs, size, WIDE, digest=True), "fingerprints")
    of = _similar_classes(prints, similarity, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_digest"))
    return of.groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_digest")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 3 or fewer differing bits."""
    out = near_duplicates(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
