"""Best-fit packing with a swap-based local search.

Documents become token pieces of at most one capacity. Pieces are dealt into shards of bounded size; a shard is packed best-fit
decreasing, then its underfull bins exchange pieces: moves, one for one, two for one and one for two, always from an emptier bin to a
fuller one, which raises the sum of squared fills until bins run empty. The search of a shard ends when no exchange is left or its bins are as few as
its tokens allow. The emptiest bins, of half the pieces at most, are dealt again over fewer shards, until one shard holds what is left.
"""

from __future__ import annotations

import heapq
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from ._tokens import lower_word_encoder

#: Pieces in a shard: what one task holds, whatever the input.
SHARD = 8192
#: Bins filled to this share or more are not packed again.
REOPEN_BELOW = 0.98

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(tokenizer_path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()
    step = capacity * 4

    def cut(batches):
        encode = lower_word_encoder(tokenizer_path).ids
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = memoryview(encode(text or "") + end)
                rows += [(doc, k, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step])) for k, at in enumerate(range(0, len(ids), step))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of every document: its ids, then ``end_id``; only what is longer than ``capacity`` is cut."""
    C.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_cutter(tokenizer_path, capacity, end_id), PIECE_SCHEMA)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: best fit, by decreasing size. The set of remainders in use is the bits of one integer."""
    bins: list[list[int]] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        s = sizes[i]
        fits = used >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = stacks[r].pop()
            if not stacks[r]:
                used ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        r -= s
        if r:
            stacks[r].append(b)
            used |= 1 << r
    return bins


class _Open:
    """Pieces of underfull bins by size, and for each size the bins that hold it, the emptiest first."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.bins: list[dict[int, list[int]]] = [{} for _ in bins]  # of each bin: its pieces by size
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.count = [0] * (capacity + 1)
        self.present = 0  # bit s: some open bin holds a piece of size s
        for b, pieces in enumerate(bins):
            if self.fill[b] < capacity:
                for i in pieces:
                    self._put(i, b)
                self._tell(b)

    def _put(self, i: int, b: int) -> None:
        s = self.sizes[i]
        self.bins[b].setdefault(s, []).append(i)
        self.count[s] += 1
        self.present |= 1 << s

    def _take(self, s: int, b: int) -> int:
        own = self.bins[b][s]
        i = own.pop()
        if not own:
            del self.bins[b][s]
        self.count[s] -= 1
        if not self.count[s]:
            self.present ^= 1 << s
        return i

    def _tell(self, b: int) -> None:
        for s in self.bins[b]:
            heapq.heappush(self.heaps[s], (self.fill[b], b))

    def exchange(self, to: int, giver: int, come: tuple[int, ...], go: tuple[int, ...]) -> None:
        """Pieces of the sizes ``come`` move from ``giver`` to ``to``, and those of the sizes ``go`` back."""
        there, back = [self._take(s, giver) for s in come], [self._take(s, to) for s in go]
        for i in there:
            self._put(i, to)
        for i in back:
            self._put(i, giver)
        gain = sum(come) - sum(go)
        self.fill[to] += gain
        self.fill[giver] -= gain
        self._tell(to)
        self._tell(giver)

    def largest(self, low: int, high: int, b: int) -> tuple[int, int]:
        """(size, bin): the largest size in [low, high] that a bin other than ``b`` and no fuller holds, in the emptiest such bin; (0, -1) if none does."""
        m = self.present & ((1 << (min(high, self.capacity) + 1)) - 1)
        while m.bit_length() > low >= 1:
            s = m.bit_length() - 1
            heap, own = self.heaps[s], None
            while heap and heap[0][0] <= self.fill[b]:
                f, g = heap[0]
                if f != self.fill[g] or s not in self.bins[g]:
                    heapq.heappop(heap)  # told before the bin changed
                elif g == b:
                    own = heapq.heappop(heap)
                else:
                    break
            found = heap[0][1] if heap and heap[0][0] <= self.fill[b] else -1
            if own:
                heapq.heappush(heap, own)
            if found >= 0:
                return s, found
            m ^= 1 << s
        return 0, -1

    def best_exchange(self, b: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]]:
        """(gain, giver, sizes that come, sizes that go): what fills ``b`` most; gain 0 if nothing does."""
        room = self.capacity - self.fill[b]
        s, g = self.largest(1, room, b)
        best = (s, g, (s,), ())
        own = sorted(x for x, pieces in self.bins[b].items() for _ in range(min(2, len(pieces))))
        for k, x in enumerate(own):
            if best[0] == room:
                break
            if k and own[k - 1] == x:
                continue
            s, g = self.largest(x + best[0] + 1, x + room, b)
            if s:
                best = (s - x, g, (s,), (x,))
            if k + 1 < len(own):
                two = x + own[k + 1]
                s, g = self.largest(two + best[0] + 1, two + room, b)
                if s:
                    best = (s - two, g, (s,), (x, own[k + 1]))
            s, g = self.largest((x + room) // 2, x + room - 1, b)
            if s:
                rest = [r for r, pieces in self.bins[g].items() if x + best[0] < s + r <= x + room and (r != s or len(pieces) > 1)]
                if rest:
                    best = (s + max(rest) - x, g, (s, max(rest)), (x,))
        return best


def local_search(sizes: list[int], bins: list[list[int]], capacity: int, rounds: int | None = None) -> list[list[int]]:
    """Exchange pieces between underfull bins, each time raising the sum of squared fills; bins that run empty are left out.

    Every exchange fills a bin further out of one that is no fuller, so the search ends by itself. It also ends when the bins are as few as the total size
    and the pieces over half a bin allow. ``rounds`` bounds the passes over all underfull bins; the default is no bound.
    """
    least = max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    used = sum(1 for b in bins if b)
    if used <= least:
        return [b for b in bins if b]
    state = _Open(sizes, bins, capacity)
    full = [b for b in range(len(bins)) if state.fill[b] >= capacity]
    moved, done = True, 0
    while moved and used > least and (rounds is None or done < rounds):
        moved = False
        for b in sorted((b for b in range(len(bins)) if 0 < state.fill[b] < capacity), key=lambda b: -state.fill[b]):
            while 0 < state.fill[b] < capacity and used > least:
                gain, giver, come, go = state.best_exchange(b)
                if gain <= 0:
                    break
                state.exchange(b, giver, come, go)
                used -= not state.fill[giver]
                moved = True
        done += 1
    return [bins[b] for b in full] + [[i for pieces in own.values() for i in pieces] for own in state.bins if own]


PACKED_SCHEMA = PIECE_SCHEMA + ", shard long, sequence_id long, offset long, fill long"


def _packer(capacity: int):
    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = t.column("length").to_pylist()
        bins = local_search(sizes, best_fit(sizes, capacity), capacity)
        base = t.column("shard")[0].as_py() << 32
        seq, off, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                seq[i], off[i] = base + k, at
                at += sizes[i]
            fill[b] = at
        for name, values in (("sequence_id", seq), ("offset", off), ("fill", fill)):
            t = t.append_column(name, pa.array(values))
        return t

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = 2048, shard: int = SHARD) -> DataFrame:
    """Pieces with ``sequence_id``, ``offset`` and ``fill`` (tokens in the sequence).

    Shards are dealt by row, not by key, so repeated ids and copies spread evenly. Every level after the first takes the emptiest bins of the one before: those
    below ``REOPEN_BELOW``, from the emptiest on, as long as they hold no more than half of its pieces. So each level is at most half as large, the last is one
    shard, and the work is that of the first level twice at most. Levels end early only where the emptiest fill alone is that of over half the pieces: such
    bins could not be joined within their shards, nor can they across them.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done, first, rows = [], 0, pieces
    while True:
        n = rows.count()
        shards = max(1, -(-n // shard))
        dealt = rows.select(*columns, (F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)) + first).alias("shard"))
        packed = C.materialize(dealt.groupBy("shard").applyInArrow(_packer(capacity), PACKED_SCHEMA), "packed")
        limit, held = 0, 0
        if shards > 1:
            for r in sorted(packed.where(F.col("fill") < REOPEN_BELOW * capacity).groupBy("fill").count().collect()):  # one row per fill
                held += r["count"]
                if held > n // 2:
                    break
                limit = r["fill"]
        if not limit:
            done.append(packed)
            break
        done.append(packed.where(F.col("fill") > limit))
        rows = packed.where(F.col("fill") <= limit)
        first += shards
    return reduce(DataFrame.union, done).drop("shard")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, fill.

    A null or empty text is one piece that holds the end id alone. Rows with equal or null ids are packed each for itself. An empty table gives
    no rows. Other columns of ``docs`` are not read.
    """
    return pack_pieces(C.materialize(cut_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens of the lower-case tokenizer."""
    import public_tokenizers

    return pack_documents(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
