"""An interpolated modified Kneser-Ney model of any order from 2 on, counted in Spark and memory-mapped by the workers that score with it.

Counting runs from words to n-grams of the highest order and from there down, as the count of a shorter n-gram is the number of words seen before it. Map tasks
ship arrays of distinct keys or grams with their counts, compressed; reduce tasks merge those of one part and write plain arrays into the shared folder:

- ``word-*``: hashes of all training tokens, sorted, with their counts and ranks by count; the rank within its part, and then the part, make a token's number, so
  frequent tokens have small numbers, which take little room wherever they are moved.
- ``gram3-*`` and so on: for every n-gram of order 3 or more a 64-bit key, sorted: a hash of its context in the high bits, its last number in the low ones. All
  that follows a context is then one range of keys, and its statistics are sums over that range. Contexts are dealt to parts by their hash.
- ``pair-*``: sorted exact 64-bit keys (number of the first token, number of the second) with their counts.
- ``stat-*``: for every number: followers' tokens and how many followers occur once, twice, more often; distinct predecessors.

Counts take one byte, and those that don't fit are listed beside. Words are told apart by 64-bit hashes and contexts of order 3 or more within a part
by the 64 bits less those of a word's number; nothing verifies them, so at about a million contexts in a part and four million words one in four million shares
another's statistics. Files are written under a temporary name and renamed, so a repeated task replaces its file by an equal one. Scoring sorts the distinct
keys of a batch and looks them up by binary search in the mapped arrays.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .language_id import remainder

#: The hash that stands for the end of a text; word hashes are mixed 64-bit values, this is one more of them.
END = np.uint64(0x5851F42D4C957F2D)
#: Order of the model by default.
ORDER = 3
#: Keys that a map task gathers before it ships them.
FLUSH = 4 << 20
#: Tokens of the training texts for each part of the n-grams at most; there are as many parts as shuffle partitions at least.
PART_TOKENS = 32 << 20
#: A first token whose share of all tokens is above 1 / (SPREAD * parts) has its pairs dealt by the second token.
SPREAD = 4

_MOVED = "part int, keys binary, counts binary"


def tokens_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of the texts, each ended by END; the text of each token; the number of tokens of each text."""
    h, text = C.words_of(data, off)
    n = len(off) - 1
    count = np.bincount(text, minlength=n) + 1
    ends = np.cumsum(count) - 1
    out = np.empty(int(count.sum()), np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word], out[ends] = h, END
    return out, np.repeat(np.arange(n), count), count


def _press(x: np.ndarray) -> bytes:
    """An array of unsigned integers, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpress(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def press_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences."""
    return _press(np.diff(keys, prepend=np.uint64(0)))


def unpress_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpress(b, np.uint64), dtype=np.uint64)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _shipped(keys: np.ndarray, counts: np.ndarray, part: np.ndarray):
    """Record batches with one row per part."""
    order = np.argsort(part, kind="stable")
    keys, counts, part = keys[order], counts[order], part[order]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, int)
    spans = list(zip(cut[:-1], cut[1:]))
    yield pa.RecordBatch.from_arrays(
        [pa.array([int(part[a]) for a, _ in spans], pa.int32()), pa.array([press_keys(keys[a:b]) for a, b in spans], pa.binary()), pa.array([_press(counts[a:b]) for a, b in spans], pa.binary())],
        ["part", "keys", "counts"],
    )


def _gatherer(keys_of, part_of):
    """Map side: the distinct keys of a task's texts with their counts, sorted within each part."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, data, off in C.text_groups(batch):
                held.append(np.unique(keys_of(data, off), return_counts=True))
                n += len(held[-1][0])
                if n > FLUSH:
                    keys, counts = merged(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
                    yield from _shipped(keys, counts.astype(np.uint64), part_of(keys))
                    held, n = [], 0
        if held:
            keys, counts = merged(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            yield from _shipped(keys, counts.astype(np.uint64), part_of(keys))

    return run


def _save(path: str, x: np.ndarray) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        np.save(f, x)
    os.replace(temporary, path)


def _by_part(batches):
    """(part, rows) of one part after the other; batches are sorted by part, and parts come whole because rows are dealt by part."""
    part, rows = None, []
    for batch in batches:
        for now, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if now != part and rows:
                yield part, rows
                rows = []
            part = now
            rows.append(row)
    if rows:
        yield part, rows


def _merged_parts(batches):
    """Each part of a task with its merged keys and counts."""
    for part, rows in _by_part(batches):
        yield part, *merged(np.concatenate([unpress_keys(k) for k, _ in rows]), np.concatenate([_unpress(c, np.uint64) for _, c in rows]))


def _to_parts(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "part").sortWithinPartitions("part")


def _save_counts(path: str, counts: np.ndarray) -> None:
    """One byte for each count; 255 stands for those listed in a file of (place, count)."""
    _save(f"{path}.count.npy", np.minimum(counts, 255).astype(np.uint8))
    large = np.flatnonzero(counts >= 255)
    _save(f"{path}.large.npy", np.stack([large.astype(np.int64), counts[large].astype(np.int64)]))


def _numbers(values: list) -> pa.RecordBatch:
    part, *rest = zip(*values) if values else ([], [], [], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.int64()) for x in rest)], ["part", "n", "n1", "n2", "n3", "n4"])


_NUMBERS = "part int, n long, n1 long, n2 long, n3 long, n4 long"


def _frequencies(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _word_writer(folder: str):
    def run(batches):
        rows = []
        for part, keys, counts in _merged_parts(batches):
            _save(f"{folder}/word-{part:06d}.key.npy", keys)
            _save(f"{folder}/word-{part:06d}.count.npy", counts)
            rank = np.empty(len(counts), np.uint32)
            rank[np.argsort(~counts, kind="stable")] = np.arange(len(counts))
            _save(f"{folder}/word-{part:06d}.rank.npy", rank)
            rows.append((part, len(keys), int(counts.sum()), 0, 0, 0))
        yield _numbers(rows)

    return run


class Words:
    """The mapped word arrays: hash -> number, count."""

    def __init__(self, folder: str, bits: int, sizes: list[int]):
        self.shift = np.uint64(64 - bits)
        self.size = sum(sizes)
        self.start = number_of_start(sizes)
        load = lambda k, what: np.load(f"{folder}/word-{k:06d}.{what}.npy", mmap_mode="r") if sizes[k] else np.zeros(0, np.uint64)
        self.keys = [load(k, "key") for k in range(len(sizes))]
        self.counts = [load(k, "count") for k in range(len(sizes))]
        self.ranks = [load(k, "rank") for k in range(len(sizes))]

    def number(self, part: int, at: np.ndarray) -> np.ndarray:
        return self.ranks[part][at].astype(np.int64) * len(self.keys) + part

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts (0) of sorted hashes."""
        number, count = np.full(len(h), -1), np.zeros(len(h), np.int64)
        edges = np.searchsorted(h >> self.shift, np.arange(len(self.keys) + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(edges)):
            part = slice(edges[k], edges[k + 1])
            keys = self.keys[k]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, h[part]), len(keys) - 1)
            hit = keys[at] == h[part]
            number[part] = np.where(hit, self.number(k, at), -1)
            count[part] = np.where(hit, self.counts[k][at], 0)
        return number, count


def number_of_start(sizes: list[int]) -> int:
    """The number that stands before a text's first token, beyond those of all tokens."""
    return max(sizes, default=0) * len(sizes)


class Layout:
    """Where a pair's key lies: by a hash of its first token, or of both where the first is frequent."""

    def __init__(self, parts: int, spread: np.ndarray):
        self.parts, self.spread = parts, spread

    def part(self, keys: np.ndarray) -> np.ndarray:
        first = keys >> np.uint64(32)
        if len(self.spread):
            at = np.minimum(np.searchsorted(self.spread, first), len(self.spread) - 1)
            first = np.where(self.spread[at] == first, keys, first)
        return (C.mix64(first) % np.uint64(self.parts)).astype(np.int32)


def _windows(words: Words, data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """Numbers of every token (the last array) and of the ``size - 1`` before it; ``start`` stands before a text's first token."""
    h, _, count = tokens_of(data, off)
    distinct, back = np.unique(h, return_inverse=True)
    out = [words.lookup(distinct)[0][back].astype(np.uint64)]
    starts = np.cumsum(count) - count
    for _ in range(size - 1):
        before = np.empty_like(out[0])
        before[1:] = out[0][:-1]
        before[starts] = words.start
        out.insert(0, before)
    return out


def _pairs_of(words: Words):
    """Keys of neighbouring tokens."""

    def run(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        first, second = _windows(words, data, off, 2)
        return (first << np.uint64(32)) | second

    return run


_STEP = np.uint64(0x9FB21C651E98DF25)


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of numbers."""
    with np.errstate(over="ignore"):
        h = C.mix64(columns[0] + _STEP)
        for c in columns[1:]:
            h = C.mix64(h * _STEP + c + np.uint64(1))
    return h


class GramLayout:
    """Of n-grams of order 3 or more: the part and the high bits of the key of a context."""

    def __init__(self, parts: int, size: int):
        self.parts, self.low = parts, np.uint64((1 << max(1, size.bit_length())) - 1)

    def part(self, context: np.ndarray) -> np.ndarray:
        return (C.mix64(~context) % np.uint64(self.parts)).astype(np.int32)


_GRAMS = "part int, grams binary, counts binary"


def _distinct_grams(columns: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of numbers and their summed counts (1 each by default)."""
    whole = chained(columns)
    order = np.argsort(whole)
    whole = whole[order]
    first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]])) if len(whole) else np.zeros(0, int)
    total = np.diff(np.append(first, len(whole))) if counts is None else np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return [c[order[first]] for c in columns], total.astype(np.uint64)


def _shipped_grams(columns: list[np.ndarray], counts: np.ndarray, place: GramLayout):
    """Rows of one part each: the numbers, column after column, and the counts."""
    part = place.part(chained(columns[:-1]))
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, int)
    rows = [(int(part[a]), _press(np.concatenate([c[order[a:b]] for c in columns]).astype(np.uint32)), _press(counts[order[a:b]])) for a, b in zip(cut[:-1], cut[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.binary(), pa.binary()))], ["part", "grams", "counts"])


def _gram_gatherer(words: Words, order: int, place: GramLayout, batches):
    """Map side of the highest order."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        for _, data, off in C.text_groups(batch):
            held.append([c.astype(np.uint32) for c in _windows(words, data, off, order)])
            n += len(held[-1][0])
            if n > FLUSH:
                yield from _shipped_grams(*_distinct_grams([np.concatenate(c).astype(np.uint64) for c in zip(*held)], None), place)
                held, n = [], 0
    if held:
        yield from _shipped_grams(*_distinct_grams([np.concatenate(c).astype(np.uint64) for c in zip(*held)], None), place)


def _gram_writer(folder: str, order: int, place: GramLayout, pair_place: Layout):
    """Reduce side of one order: writes its arrays, passes on the distinct grams without their first word, each counting once."""

    def run(batches):
        for part, rows in _by_part(batches):
            counts = np.concatenate([_unpress(c, np.uint64) for _, c in rows])
            columns = [np.concatenate(c).astype(np.uint64) for c in zip(*(_unpress(g, np.uint32).reshape(order, -1) for g, _ in rows))]
            columns, counts = _distinct_grams(columns, counts)
            keys = (chained(columns[:-1]) & ~place.low) | columns[-1]
            by_key = np.argsort(keys)
            _save(f"{folder}/gram{order}-{part:06d}.key.npy", keys[by_key])
            _save_counts(f"{folder}/gram{order}-{part:06d}", counts[by_key])
            _save(f"{folder}/gram{order}-{part:06d}.frequency.npy", np.array(_frequencies(counts)))
            shorter, before = _distinct_grams(columns[1:], None)
            if order > 3:
                yield from _shipped_grams(shorter, before, place)
            else:
                pairs = (shorter[0] << np.uint64(32)) | shorter[1]
                by_key = np.argsort(pairs)
                pairs = pairs[by_key]
                yield from _shipped(pairs, before[by_key], pair_place.part(pairs))

    return run


#: Statistics of a token, and the numbers that one file of them covers: its followers' counts in all, followers that occur once, twice, more often, predecessors.
_KINDS = 5
_STAT_SPAN = 1 << 18


def _pair_writer(folder: str):
    """Reduce side of the pairs: writes their arrays, passes on what they add to the statistics of single tokens."""

    def run(batches):
        for part, keys, counts in _merged_parts(batches):
            _save(f"{folder}/pair-{part:06d}.key.npy", keys)
            _save_counts(f"{folder}/pair-{part:06d}", counts)
            n = _frequencies(counts)
            yield _stat_rows(keys, counts, part, n)

    return run


_STATS = "kind int, span int, keys binary, counts binary, part int, n long, n1 long, n2 long, n3 long, n4 long"


def _stat_rows(keys: np.ndarray, counts: np.ndarray, part: int, n: list[int]) -> pa.RecordBatch:
    first, second = (keys >> np.uint64(32)), keys & np.uint64(0xFFFFFFFF)
    rows: list[tuple] = []

    def add(kind: int, ids: np.ndarray, values: np.ndarray) -> None:
        ids, values = merged(ids, values)
        span = (ids // np.uint64(_STAT_SPAN)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], span[1:] != span[:-1], [True]])) if len(ids) else [0]
        rows.extend((kind, int(span[a]), press_keys(ids[a:b]), _press(values[a:b]), None, None, None, None, None, None) for a, b in zip(cut[:-1], cut[1:]))

    one = np.ones(len(keys), np.uint64)
    add(0, first, counts)
    for k, chosen in ((1, counts == 1), (2, counts == 2), (3, counts > 2)):
        add(k, first[chosen], one[chosen])
    add(4, second, one)
    rows.append((-1, -1, None, None, part, len(keys), *n))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["kind", "span", "keys", "counts", "part", "n", "n1", "n2", "n3", "n4"])


def _stat_writer(folder: str):
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for kind, span, keys, counts in zip(*(batch.column(k).to_pylist() for k in ("kind", "span", "keys", "counts"))):
                if span not in held:
                    held[span] = np.zeros((_KINDS, _STAT_SPAN), np.int64)
                held[span][kind][(unpress_keys(keys) % np.uint64(_STAT_SPAN)).astype(np.int64)] += _unpress(counts, np.uint64).astype(np.int64)
        rows = []
        for span, stats in held.items():
            _save(f"{folder}/stat-{span:06d}.npy", stats)
            before = stats[4]
            rows.append((span, int(before.sum()), *_frequencies(before)))
        yield _numbers(rows)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The three discounts of modified Kneser-Ney; 0.5 of a count where the counts of counts are too few."""
    if not (n1 and n2):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> str:
    """Count all rows of ``docs`` and return the folder of the model of this order, as every worker sees it.

    Null texts count as empty: their end is their only token. Hot words are merged in the map tasks and their pairs are spread, so no
    part depends on one word. Parts number as the session's shuffle partitions, or one for every ``PART_TOKENS`` tokens if that is more.
    """
    if order < 2:
        raise ValueError(f"an order of 2 at least, not {order}")
    spark = docs.sparkSession
    C.small_batches(spark)
    folder = C.local_view(C.new_path(spark, "ngrams"))
    Path(folder).mkdir(parents=True, exist_ok=True)
    texts = docs.select(F.col(text).alias("text"))
    parts = C.partitions(spark)
    bits = max(4, (parts - 1).bit_length())
    shift = np.uint64(64 - bits)
    words = texts.mapInArrow(_gatherer(lambda data, off: tokens_of(data, off)[0], lambda keys: (keys >> shift).astype(np.int32)), _MOVED)
    counted = {r["part"]: (r["n"], r["n1"]) for r in _to_parts(words, parts).mapInArrow(_word_writer(folder), _NUMBERS).collect()}
    sizes = [counted.get(k, (0, 0))[0] for k in range(1 << bits)]
    if number_of_start(sizes) >= 0xFFFFFFFF:
        raise ValueError(f"{sum(sizes)} distinct tokens don't fit numbers of 32 bits")
    total = sum(x[1] for x in counted.values())
    parts = max(parts, -(-total // PART_TOKENS))
    spread = _frequent(folder, bits, sizes, total / (SPREAD * parts))
    place, grams = Layout(parts, spread), GramLayout(parts, number_of_start(sizes))

    def pair_gatherer(batches):
        yield from _gatherer(_pairs_of(Words(folder, bits, sizes)), place.part)(batches)

    def gram_gatherer(batches):
        yield from _gram_gatherer(Words(folder, bits, sizes), order, grams, batches)

    if order == 2:
        moved = texts.mapInArrow(pair_gatherer, _MOVED)
    else:
        moved = texts.mapInArrow(gram_gatherer, _GRAMS)
        for k in range(order, 2, -1):
            moved = _to_parts(moved, parts).mapInArrow(_gram_writer(folder, k, grams, place), _GRAMS if k > 3 else _MOVED)
    pairs = C.materialize(_to_parts(moved, parts).mapInArrow(_pair_writer(folder), _STATS), "ngram-stats")
    n = pairs.where("kind < 0").select("part", "n", "n1", "n2", "n3", "n4").collect()
    stats = pairs.where("kind >= 0").select("kind", "span", "keys", "counts").repartition(parts, "span").mapInArrow(_stat_writer(folder), _NUMBERS).collect()
    cuts = {2: discounts(*(sum(r[k] for r in n) for k in ("n1", "n2", "n3", "n4"))), 1: discounts(*(sum(r[k] for r in stats) for k in ("n1", "n2", "n3", "n4")))}
    for k in range(3, order + 1):
        seen = [np.load(f) for f in Path(folder).glob(f"gram{k}-*.frequency.npy")]
        cuts[k] = discounts(*(int(x) for x in np.sum(seen, 0))) if seen else discounts(0, 0, 0, 0)
    meta = {
        "order": order, "bits": bits, "sizes": sizes, "tokens": total, "parts": parts, "spread": [int(x) for x in spread], "discounts": [cuts[k] for k in range(1, order + 1)],
        "pairs": sum(r["n"] for r in stats), "low_counts": [sum(r[k] for r in stats) for k in ("n1", "n2")],
    }
    C.release(pairs)
    meta["low_mass"] = _low_mass(folder, meta)
    temporary = Path(folder, f"meta.{uuid.uuid4().hex}")
    temporary.write_text(json.dumps(meta))
    temporary.replace(Path(folder, "meta.json"))
    return folder


def _frequent(folder: str, bits: int, sizes: list[int], above: float) -> np.ndarray:
    """Numbers of the tokens that occur more often than ``above``: at most a few times the number of parts. Counts are read from the mapped files."""
    words = Words(folder, bits, sizes)
    return np.sort(np.concatenate([words.number(k, np.flatnonzero(c > max(above, 1))) for k, c in enumerate(words.counts)] or [[]])).astype(np.uint64)


def _low_mass(folder: str, meta: dict) -> float:
    """The share of the lower order's probability that its discounts free, out of counts of counts alone."""
    if not meta["pairs"]:
        return 1.0
    known = sum(meta["sizes"])
    ones, twos = meta["low_counts"]
    d1, d2, d3 = meta["discounts"][0]
    return (d1 * ones + d2 * twos + d3 * (known - ones - twos)) / meta["pairs"]


#: Followers of a context from which on its statistics are kept once they are summed up.
LARGE = 4096


class _Table:
    """Mapped sorted keys of one part with their counts."""

    def __init__(self, path: str):
        self.keys = np.load(f"{path}.key.npy", mmap_mode="r")
        self.small = np.load(f"{path}.count.npy", mmap_mode="r")
        self.places, self.large = np.load(f"{path}.large.npy")
        self.kept: dict[int, list[int]] = {}

    def counts(self, at: np.ndarray) -> np.ndarray:
        out = self.small[at].astype(np.int64)
        large = np.flatnonzero(out == 255)
        out[large] = self.large[np.searchsorted(self.places, at[large])]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys; 0 for those that are not there."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts(at), 0)

    def ranges(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each range of places: the sum of its counts, and how many are 1, 2, more."""
        out = np.zeros((4, len(low)), np.int64)
        n = high - low
        for i in np.flatnonzero(n > LARGE):
            if low[i] not in self.kept:
                c = self.counts(np.arange(low[i], high[i]))
                self.kept[low[i]] = [c.sum(), (c == 1).sum(), (c == 2).sum(), (c > 2).sum()]
            out[:, i] = self.kept[low[i]]
        few = np.flatnonzero((n > 0) & (n <= LARGE))
        if len(few):
            first = np.cumsum(n[few]) - n[few]
            c = self.counts(np.repeat(low[few] - first, n[few]) + np.arange(int(n[few].sum())))
            for k, x in enumerate((c, c == 1, c == 2, c > 2)):
                out[k, few] = np.add.reduceat(x, first, dtype=np.int64)
        return out


class Model:
    """A trained model's mapped arrays."""

    def __init__(self, folder: str):
        self.folder = folder
        self.meta = json.loads(Path(folder, "meta.json").read_text())
        self.words = Words(folder, self.meta["bits"], self.meta["sizes"])
        self.layout = Layout(self.meta["parts"], np.array(self.meta["spread"], np.uint64))
        self.grams = GramLayout(self.meta["parts"], self.words.start)
        self.open: dict[str, np.ndarray | _Table | None] = {}

    def table(self, name: str) -> _Table | None:
        if name not in self.open:
            path = f"{self.folder}/{name}"
            self.open[name] = _Table(path) if os.path.exists(f"{path}.key.npy") else None
        return self.open[name]

    def _by_part(self, part: np.ndarray, name: str):
        """(table, rows) of every part that is asked for and there."""
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(self.meta["parts"] + 1))
        for k in np.flatnonzero(np.diff(edges)):
            table = self.table(f"{name}-{k:06d}")
            if table is not None:
                yield table, order[edges[k] : edges[k + 1]]

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys."""
        out = np.zeros(len(keys), np.int64)
        for table, rows in self._by_part(self.layout.part(keys), "pair"):
            out[rows] = table.find(keys[rows])
        return out

    def gram_counts(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of rows of numbers, and the four statistics of their contexts; a last number beyond the words counts 0."""
        contexts, back = np.unique(chained(columns[:-1]), return_inverse=True)
        stats = np.zeros((4, len(contexts)), np.int64)
        part, name = self.grams.part(contexts), f"gram{len(columns)}"
        for table, rows in self._by_part(part, name):
            head = contexts[rows] & ~self.grams.low
            stats[:, rows] = table.ranges(np.searchsorted(table.keys, head), np.searchsorted(table.keys, head | self.grams.low, "right"))
        count = np.zeros(len(back), np.int64)
        asked = np.flatnonzero((stats[0][back] > 0) & (columns[-1] < self.words.start))
        keys, part = (contexts[back[asked]] & ~self.grams.low) | columns[-1][asked], part[back[asked]]
        order = np.lexsort((keys, part))
        for table, rows in self._by_part(part[order], name):
            count[asked[order[rows]]] = table.find(keys[order[rows]])
        return count, stats[:, back]

    def stats(self, number: np.ndarray) -> np.ndarray:
        """The five statistics of sorted numbers; zeros for -1."""
        out = np.zeros((_KINDS, len(number)), np.int64)
        span = number // _STAT_SPAN
        for k in np.unique(span):
            name = f"stat-{k:06d}"
            if k >= 0 and (name in self.open or os.path.exists(f"{self.folder}/{name}.npy")):
                if name not in self.open:
                    self.open[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
                rows = slice(*np.searchsorted(span, [k, k + 1]))
                out[:, rows] = self.open[name][:, number[rows] % _STAT_SPAN]
        return out

    @staticmethod
    def interpolated(cut: list[float], count: np.ndarray, stats: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of one order out of counts, contexts' statistics and the next lower order's; the latter alone where a context was never seen."""
        d = np.array([0.0, *cut])
        total, ones, twos, more = stats
        safe = np.where(total > 0, total, 1)
        free = d[1] * ones + d[2] * twos + d[3] * more
        return np.where(total > 0, np.maximum(count - d[np.minimum(count, 3)], 0) / safe + free / safe * lower, lower)

    def score(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score, log10 probability by the model."""
        m = self.meta
        h, text, count = tokens_of(data, off)
        n = len(count)
        distinct, back = np.unique(h, return_inverse=True)
        number, seen = self.words.lookup(distinct)
        vocabulary = self.words.size
        base = np.log10((seen + 1) / (m["tokens"] + vocabulary + 1))
        order = np.argsort(number, kind="stable")
        of = np.zeros((_KINDS, len(number) + 1), np.int64)  # the last column: the start of a text
        of[:, order] = self.stats(number[order])
        of[:, -1:] = self.stats(np.array([self.words.start]))
        before = of[4, :-1]
        d = np.array([0.0, *m["discounts"][0]])
        low = np.maximum(before - d[np.minimum(before, 3)], 0) / max(1, m["pairs"]) + m["low_mass"] / (vocabulary + 1)
        starts = np.cumsum(count) - count
        places = [back]  # of the token and those before it in ``distinct``; after the last: the start of a text
        for _ in range(m["order"] - 1):
            earlier = np.empty_like(back)
            earlier[1:] = places[0][:-1]
            earlier[starts] = len(distinct)
            places.insert(0, earlier)
        numbers = np.append(number, self.words.start)
        first, second = numbers[places[-2]], numbers[back]
        asked = (first >= 0) & (second >= 0)
        keys, at = np.unique((first[asked].astype(np.uint64) << np.uint64(32)) | second[asked].astype(np.uint64), return_inverse=True)
        c = np.zeros(len(h), np.int64)
        c[asked] = self.pair_counts(keys)[at]
        p = self.interpolated(m["discounts"][1], c, of[:4, places[-2]], low[back])
        for k in range(3, m["order"] + 1):
            columns = [numbers[x] for x in places[-k:]]
            rows = np.flatnonzero(np.logical_and.reduce([x >= 0 for x in columns[:-1]]) & (of[0][places[-2]] > 0))
            c, stats = self.gram_counts([x[rows].astype(np.uint64) for x in columns])  # an unknown last number becomes the largest
            p[rows] = self.interpolated(m["discounts"][k - 1], c, stats, p[rows])
        sums = lambda x: np.bincount(text, x, n)
        return count, sums(seen[back] > 0).astype(np.int64), sums(base[back]), sums(np.log10(p))


_models: dict[str, Model] = {}


def _scorer(folder: str):
    def run(batches):
        if folder not in _models:
            _models.clear()
            _models[folder] = Model(folder)
        model = _models[folder]
        for batch in batches:
            parts = [model.score(data, off) for _, data, off in C.text_groups(batch)]
            columns = [np.concatenate(x) for x in zip(*parts)] or [np.zeros(0)] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, kinds)), pa.array(np.full(batch.num_rows, model.meta["tokens"]), pa.int64())],
                ["doc_id", "n_tokens", "n_known", "base_score", "score", "train_tokens"],
            )

    return run


def score(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, train_tokens) of every row by the model in ``folder``.

    Null and empty texts are one token, their end. Repeated rows get equal scores, null ids stay. A model that has seen no text gives every token
    the same probability. Other columns are not read; an empty table gives no rows.
    """
    C.small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, train_tokens long"
    return docs.select("doc_id", "text").mapInArrow(_scorer(folder), schema)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod 7 is not 2."""
    docs = C.table(spark, sf_dir, "documents")
    held: Column = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    folder = train(docs.where(~held))
    return score(docs, folder).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
