"""Token counts and packing against the library and plain versions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallybridge.llm import packing, token_counts
from tallybridge.llm._tokens import byte_level_counter, lower_word_encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["a\n\n b", "a  b   c ", " x", "it's I'LL don't", "<|endoftext|>x", "a<|startoftext|>", "x²½ 12 345", "é É ß", "tab\there", "\x1c\x85 y", "\xa0z", "中文 İ", "", "\r\n \n", "word" * 50]


def some_texts(n=300):
    rng = random.Random(8)
    letters = list("abcXYZ  \n\n\t'stm,.!?éßÀ×÷µª²¼\xa01290<|>") + ["<|endoftext|>", "'ll", " é", "  ", "\r\n"]
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_encoders_equal_the_library():
    count, ids = byte_level_counter(BYTE).count, lower_word_encoder(WORD).ids
    a, b = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for t in some_texts():
        assert count(t) == len(a.encode(t, add_special_tokens=False).ids), repr(t)
        assert ids(t) == np.array(b.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_counts_come_from_the_cache(spark, tmp_path):
    texts = [None, *some_texts(20)]
    rows = [(k, t, "kept") for k, t in enumerate(texts)] + [(None, "null id", "kept")] * 40 + [(0, None, "kept"), (1, texts[1], "kept"), (500, texts[2], "kept"), (501, "word " * 30000, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    cache = str(tmp_path / "cache")
    library = Tokenizer.from_file(BYTE)
    got = token_counts.count_tokens(docs, BYTE, cache).collect()
    assert len(got) == len(rows)
    assert all(r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t, _ in rows})  # each distinct miss once, null and repeated ids too
    more = spark.createDataFrame([(900, "a new one", "")], docs.schema)
    assert token_counts.count_tokens(docs.union(more), BYTE, cache).count() == len(rows) + 1
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t, _ in rows}) + 1
    token_counts.count_tokens(docs, BYTE, cache).collect()
    assert spark.read.parquet(cache).count() == stored.count()
    spark.read.parquet(cache).selectExpr("digest", "tokenizer", "n_tokens + 1000 AS n_tokens").write.parquet(str(tmp_path / "other"))
    assert token_counts.count_tokens(docs, BYTE, str(tmp_path / "other")).first().n_tokens >= 1000
    assert token_counts.count_tokens(docs.limit(0), BYTE, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("low,high", [(1, 40), (30, 70), (51, 99), (100, 100)])
def test_bins_hold_everything_and_search_never_loses(low, high):
    rng = random.Random(low)
    sizes = [rng.randint(low, high) for _ in range(400)]
    first = packing.best_fit(sizes, 100)
    later = packing.local_search(sizes, [list(b) for b in first], 100)
    for bins in (first, later):
        assert sorted(i for b in bins for i in b) == list(range(400)) and max(sum(sizes[i] for i in b) for b in bins) <= 100
    assert len(later) <= len(first)
    if high == 40:
        assert len(later) == -(-sum(sizes) // 100)


def test_search_empties_a_bin_by_swaps():
    sizes = [60, 30, 55, 40, 5, 10]  # 90, 95, 15: one for one and moves fill two bins
    assert len(packing.local_search(sizes, [[0, 1], [2, 3], [4, 5]], 100)) == 2


def test_ids_stay_exact_beside_nulls(spark):
    rows = [(2**60 + 1, "a b"), (2**60 + 3, "c"), (None, "d")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORD, 2048).collect()
    assert {r.doc_id for r in got} == {2**60 + 1, 2**60 + 3, None} and len(got) == 3


@pytest.mark.parametrize("shape", ["small", "halves", "thirds", "long", "mixed"])
def test_search_ends_with_no_exchange_left(shape):
    rng = random.Random(2)
    draw = {"small": lambda: rng.randint(1, 90), "halves": lambda: rng.randint(300, 700), "thirds": lambda: rng.randint(200, 500), "long": lambda: rng.randint(600, 1000), "mixed": lambda: min(1000, int(rng.lognormvariate(5, 1.2)) + 1)}[shape]
    sizes = [draw() for _ in range(1500)]
    first = packing.best_fit(sizes, 1000)
    last = packing.local_search(sizes, [list(b) for b in first], 1000)
    assert sorted(i for b in last for i in b) == list(range(1500)) and max(sum(sizes[i] for i in b) for b in last) <= 1000
    squares = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
    assert len(last) <= len(first) and squares(last) >= squares(first)
    state = packing._Open(sizes, last, 1000)
    assert len(last) == max(-(-sum(sizes) // 1000), sum(s > 500 for s in sizes)) or not any(state.best_exchange(b)[0] > 0 for b in range(len(last)) if state.fill[b] < 1000)


def test_packed_documents(spark):
    words = "the quick brown fox jumps over the lazy dog " * 300
    rows = [(0, "one", 1), (1, None, 1), (2, "", 1), (3, words * 3, 1), (4, words, 1), (4, words, 1), (None, "null", 1)] + [(k, words[: k * 7], 1) for k in range(10, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack_documents(docs, WORD, 2048).collect()
    library = Tokenizer.from_file(WORD)
    want = []
    for doc, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length, r.fill))
    for parts in places.values():
        at = 0
        for offset, length, fill in sorted(parts):
            assert offset == at
            at += length
        assert at == fill <= 2048
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0


@pytest.mark.parametrize("low,high", [(1, 900), (1, 200), (300, 450), (510, 900), (600, 600)])
def test_shards_lose_little(spark, low, high):
    """Many small shards take as many bins as one pack of everything, or one more."""
    rng = random.Random(3)
    sizes = [rng.randint(low, high) for _ in range(3000)]
    pieces = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(sizes)], packing.PIECE_SCHEMA)
    got = packing.pack_pieces(pieces, 1000, shard=256).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    whole = len(packing.local_search(sizes, packing.best_fit(sizes, 1000), 1000))
    assert len({r.sequence_id for r in got}) <= 1.02 * whole + 1
