"""Which token of one tokenizer stands where which of another does, and how often over the whole corpus.

Both tokenizers cut the same bytes; a place where a token of each ends is a cut, and the two tokens that end there are linked. What stands between two lone spaces
is cut by both alike wherever it occurs, so its groups are kept in a bounded dictionary of each worker.

Counts of linked pairs come from inverted bitmaps. Documents are numbered within blocks of bounded size, and a pair has one row per block in which it occurs: the
words of 16 documents that are not empty, and for each word as many bit planes as the pair's largest multiplicity has binary digits. Planes ORed give the
documents, planes weighed by their powers of two the links; both are counted by popcount and summed over blocks. Scores of pairs go back along the same rows.
"""

from __future__ import annotations

import array
import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from ._tokens import _LETTERS, _LONE_SPACE, _ODD_SPACE, _PLAIN, ID_CACHE_BYTES, _Bounded

#: A block ends at so many documents, or at the document that brings it to so many postings: what a task holds.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 1 << 22
#: Bits of an id of either vocabulary; with 16 bits for a document of a block a posting is one number.
ID_BITS = 24
#: Characters of texts whose new words are aligned together.
TEXT_CHARS = 4 << 20

DOCUMENT = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
POSTING = "pair long, words binary, planes binary"


class Aligner(_Bounded):
    """Text -> (counts, groups, pairs), or None where the tokens of either side don't give back the text's bytes with a space in front.

    ``counts`` holds the numbers of A tokens, B tokens and groups in fields of 40 bits, ``groups`` is their text, ``pairs`` the linked ids as 64-bit numbers (A id
    above the lower ``ID_BITS``).
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.room, self.local = ID_CACHE_BYTES, {}
        byte = {letter: b for b, letter in _LETTERS.items()}
        vocab = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(map(byte.__getitem__, vocab.get(i, ""))) for i in range(max(vocab) + 1)]
        self.leads = np.array([x[:1] == b" " for x in self.a_bytes])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(pieces)) > 1 << ID_BITS:
            raise ValueError(f"ids of over {ID_BITS} bits")
        #: No piece has a space after another character, so none reaches over a lone space, and merges on its two sides can't meet.
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)

    def library(self, text: str, a: list[int] | None = None, b: list[int] | None = None):
        """By the two libraries, for any text; ``a`` and ``b`` are its ids where they are known."""
        a, b = a or self.a.encode(" " + text, add_special_tokens=False).ids, b or self.b.encode(text)
        by_a, by_b = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        whole = b" " + text.encode()
        if b"".join(by_a) != whole or b"".join(by_b) != whole:
            return None
        groups, pairs, i, j, p, at_a, at_b = [], [], 0, 0, 0, 0, 0
        for q, piece in enumerate(by_b, 1):
            at_b += len(piece)
            while at_a < at_b:
                at_a += len(by_a[p])
                p += 1
            if at_a == at_b:
                groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
                pairs.append(a[p - 1] << ID_BITS | b[q - 1])
                i, j = p, q
        return len(a) + (len(b) << 40) + (len(groups) << 80), ";".join(groups).encode(), array.array("q", pairs).tobytes()

    def __missing__(self, text: str):
        return self.local[text]

    def learn(self, texts: set[str]) -> None:
        """Align what stands between lone spaces and is not known yet. A encodes it all as one text, in which a token that begins with a space begins a word; B as a list."""
        words, odd = [], []
        for t in texts - self.keys():
            (odd if not t or " " in t or t[-1].isspace() else words).append(t)
        self.local = {t: self.library(t) for t in odd}
        if words:
            a = np.array(self.a.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids)
            at = [*np.flatnonzero(self.leads[a]).tolist(), len(a)]
            if len(at) != len(words) + 1:
                raise ValueError("the tokenizer file does not begin each word with a token of its own")
            a = a.tolist()
            self.local |= {w: self.library(w, a[i:j], b) for w, i, j, b in zip(words, at, at[1:], self.b.encode(words, num_threads=1))}
        for t, out in self.local.items() if self.room > 0 else ():
            self.keep(t, out)
            if out:
                self.room -= 240 + len(out[1]) + len(out[2])

    def align(self, texts: list[str]):
        """(n_a, n_b, n_groups, SHA-256 of the groups, pairs), or None, for each text in turn; about ``TEXT_CHARS`` of them are worked on at a time."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and size < TEXT_CHARS:
                size += len(texts[j])
                j += 1
            cut = [self._cut(t) for t in texts[i:j]]
            self.learn(set().union(*filter(None, cut)))
            for text, words in zip(texts[i:j], cut):
                found = [*map(self.__getitem__, words)] if words else [self.library(text)] if text else [None]
                if None in found:
                    yield None
                    continue
                counts, groups, pairs = zip(*found)
                n, field = sum(counts), (1 << 40) - 1
                yield n & field, n >> 40 & field, n >> 80, hashlib.sha256(b";".join(groups)).hexdigest(), b"".join(pairs)
            i = j

    def _cut(self, text: str) -> list[str] | None:
        if not text or not self.apart or not _PLAIN.fullmatch(text):
            return None
        return _LONE_SPACE.split(text) if text[0] == " " or text[-1] == " " or _ODD_SPACE.search(text) else text.split(" ")


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _binaries(data: bytes, ends: np.ndarray) -> pa.Array:
    """Binary values that follow each other in ``data``; ``ends`` begins with 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def bitmaps(pair: np.ndarray, place: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Bitmaps of postings in the order of (pair, place): the distinct pairs, the numbers of their words, and word after word the planes of each."""
    word, bit = (place >> 4).astype(np.uint16), np.uint16(1) << (place & 15).astype(np.uint16)
    rows = C.group_starts([pair])
    at = C.group_starts([pair, word])
    row_of = np.searchsorted(rows, at, "right") - 1
    digits = np.frexp(np.maximum.reduceat(times, rows).astype(np.float64))[1]  # of the largest multiplicity
    n_planes = digits[row_of]
    ends = np.concatenate([[0], np.cumsum(n_planes)])
    planes = np.zeros(ends[-1], "<u2")
    for k in range(int(digits.max())):
        has = n_planes > k
        planes[ends[:-1][has] + k] = np.bitwise_or.reduceat(np.where(times >> k & 1, bit, np.uint16(0)), at)[has]
    first = np.concatenate([np.searchsorted(at, rows), [len(at)]])
    return pair[rows], _binaries(word[at].astype("<u2").tobytes(), 2 * first), _binaries(planes.tobytes(), 2 * ends[first])


def unfold(words: pa.Array, planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, its number, start of its planes, all planes, the power of each) of bitmaps."""
    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        return np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].view("<u2"), np.diff(off) // 2

    word, n_words = flat(words)
    plane, n_planes = flat(planes)
    row = np.repeat(np.arange(len(n_words)), n_words)
    each = (n_planes // np.maximum(n_words, 1))[row]  # planes of each word
    start = np.cumsum(each) - each
    power = np.arange(len(plane)) - np.repeat(start, each)
    return row, word, start, plane, power


def counted(words: pa.Array, planes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(documents, links) of every bitmap."""
    row, _, start, plane, power = unfold(words, planes)
    docs, links = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    if len(row):
        rows = C.group_starts([row])
        there = row[rows]
        docs[there] = np.add.reduceat(np.bitwise_count(np.bitwise_or.reduceat(plane, start)).astype(np.int64), rows)
        links[there] = np.add.reduceat(np.add.reduceat(np.bitwise_count(plane).astype(np.int64) << power, start), rows)
    return docs, links


def postings(words: pa.Array, planes: pa.Array):
    """Chunks of (row, place in the block, multiplicity) of all documents of the bitmaps."""
    row, word, start, plane, power = unfold(words, planes)
    for k in range(16 if len(row) else 0):
        times = np.add.reduceat((plane >> k & 1).astype(np.int64) << power, start)
        at = np.flatnonzero(times)
        yield row[at], word[at].astype(np.int64) * 16 + k, times[at]


def _null(n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, kind)


def _encoder(a_path: str, b_path: str, docs_limit: int, postings_limit: int):
    names = ["block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "words", "planes"]

    def encode(batches):
        align = aligner(a_path, b_path).align  # kept by the worker
        block, place, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush():
            pair, at, times = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(pair.astype(np.uint64) << np.uint64(16) | at.astype(np.uint64))
            key, words, planes = bitmaps(pair[order], at[order], times[order])
            for i in range(0, len(key), 1 << 14):
                part = slice(i, i + (1 << 14))
                n = len(key[part])
                nothing = [_null(n, t) for t in (pa.int32(), kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *nothing, pa.array(key[part]), words[part], planes[part]], names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            column, texts, i = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()], 0
            aligned = align(texts)
            while i < len(texts):
                j = min(len(texts), i + docs_limit - place)
                got, each, there, total = [], [], [], size
                for found in itertools.islice(aligned, j - i):
                    found = found or (0, 0, 0, "", b"")
                    got.append((*found[:3], len(found[4]) // 8, found[3]))
                    each.append(found[4])
                    total += len(found[4]) // 8
                    if total >= postings_limit:
                        break
                n, sizes = len(got), np.array([x[3] for x in got], np.int64)
                if sizes.any():
                    at = np.repeat(np.arange(place, place + n, dtype=np.uint64), sizes)
                    both = np.sort(at << np.uint64(2 * ID_BITS) | np.frombuffer(b"".join(each), np.uint64))
                    first = C.group_starts([both])
                    pair, at = both[first] & np.uint64((1 << 2 * ID_BITS) - 1), both[first] >> np.uint64(2 * ID_BITS)
                    held.append((pair.astype(np.int64), at.astype(np.int64), np.diff(np.append(first, len(both)))))
                    size += len(first)
                a, b, groups, links, digest = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(place, place + n, dtype=np.int32)), column.slice(i, n), *(pa.array(c, pa.int64()) for c in (a, b, groups, links)), pa.array(digest, pa.string()), *(_null(n, t) for t in (pa.int64(), pa.binary(), pa.binary()))], names)
                i, place = i + n, place + n
                if place >= docs_limit or size >= postings_limit or total >= postings_limit:
                    if held:
                        yield from flush()
                    block, place, held, size = block + 1, 0, [], 0
        if held:
            yield from flush()

    return encode


def _count(batches):
    for batch in batches:
        docs, links = counted(batch.column("words"), batch.column("planes"))
        yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(docs), pa.array(links)], ["pair", "n_docs", "n_links"])


def _return_scores(batches):
    """Sums of every document of a block from the scored bitmaps of all its pairs; rows come in the order of blocks."""
    now, best, total = None, None, None

    def told():
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], ["block", "place", "n_best", "count_sum"])

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        starts = C.group_starts([blocks]) if len(blocks) else []
        for i, j in zip(starts, [*starts[1:], len(blocks)]):
            if blocks[i] != now:
                if now is not None:
                    yield told()
                now, best, total = blocks[i], np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            part = batch.slice(i, j - i)
            score, is_best = part.column("score").to_numpy(), part.column("best").to_numpy(zero_copy_only=False)
            for row, place, times in postings(part.column("words"), part.column("planes")):
                np.add.at(total, place, times * score[row])
                np.add.at(best, place, times * is_best[row])
    if now is not None:
        yield told()


def align_tokens(docs: DataFrame, a_path: str, b_path: str, *, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> tuple[DataFrame, DataFrame]:
    """Alignment of every text of ``docs`` (doc_id, text) and the linked pairs of the corpus.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row for each row of ``docs``, repeated and null ids too. Texts that are
    null, empty, or not given back byte by byte by both tokenizers have zeros and an empty digest. Pairs: a, b, n_docs, n_links, best (no other A id is
    linked with b more often). An empty table gives two empty ones. Other columns are left out. ``a_path`` is a byte-level BPE file, ``b_path`` a sentencepiece model.
    """
    if not 0 < block_docs <= 1 << 16:
        raise ValueError("a block has 1 to 65,536 documents")
    spark = docs.sparkSession
    C.small_batches(spark)
    document = DOCUMENT.format(id=docs.schema["doc_id"].dataType.simpleString())
    both = C.materialize(docs.select("doc_id", "text").mapInArrow(_encoder(a_path, b_path, block_docs, block_postings), f"block long, place int, {document}, {POSTING}"), "alignment")
    maps = both.where(F.col("pair").isNotNull()).select("block", "pair", "words", "planes")
    sums = maps.select("pair", "words", "planes").mapInArrow(_count, "pair long, n_docs long, n_links long").groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    pairs = sums.select("pair", F.shiftright("pair", ID_BITS).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int").alias("b"), "n_docs", "n_links")
    pairs = C.materialize(pairs, "pairs")
    most = pairs.groupBy("b").agg(F.max("n_links").alias("_most"))  # a row for each id of B's vocabulary at most, so small whatever the corpus
    pairs = C.materialize(pairs.join(F.broadcast(most), "b").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("_most")).alias("best")), "scored-pairs")
    scored = maps.join(pairs.select("pair", F.col("n_links").alias("score"), "best"), "pair").select("block", "words", "planes", "score", "best")
    dealt = scored.repartition(C.partitions(spark), "block").sortWithinPartitions("block")
    back = dealt.mapInArrow(_return_scores, "block long, place int, n_best long, count_sum long")
    rows = both.where(F.col("place").isNotNull()).join(back, ["block", "place"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), pairs.drop("pair")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece tokenizer over all documents."""
    import public_tokenizers

    return align_tokens(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
