"""Token alignment against a plain version that encodes whole texts and counts with dictionaries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallybridge.llm import registry, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a\n\n b", "a  b   c ", " x", "it's I'LL don't", "<|endoftext|>x y", "x²½ 12 345", "é É ß", "tab\there and", "\x1c\x85 y", "\xa0z", "中文 İ", "", "\r\n \n", "word" * 50, None, "▁a b", "<s> </s> <unk>", "<0x41> b", " a", "a ", "  ", "ä\x00b", "a \n b", "\n a"]


def letter_bytes():
    """The published byte-level alphabet, by its own rule."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, more = {chr(b): b for b in seen}, 0
    for b in range(256):
        if b not in seen:
            out[chr(256 + more)] = b
            more += 1
    return out


def plain(rows):
    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), letter_bytes()
    a.encode_special_tokens = True
    names = {i: t for t, i in a.get_vocab().items()}
    docs, count = [], Counter()
    for k, text in rows:
        none = (k, 0, 0, 0, [], "")
        if not text:
            docs.append(none)
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bx = [bytes(letters[c] for c in names[i]) for i in x]
        by = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
        if b"".join(bx) != (" " + text).encode() or b"".join(by) != (" " + text).encode():
            docs.append(none)
            continue
        ends = lambda parts: {len(b"".join(parts[: i + 1])): i for i in range(len(parts))} if len(parts) < 300 else {int(e): i for i, e in enumerate(np.cumsum([len(p) for p in parts]))}
        ex, ey = ends(bx), ends(by)
        cuts, groups, i, j = sorted(set(ex) & set(ey)), [], 0, 0
        links = [(x[ex[c]], y[ey[c]]) for c in cuts]
        for c in cuts:
            groups.append(",".join(map(str, x[i : ex[c] + 1])) + "|" + ",".join(map(str, y[j : ey[c] + 1])))
            i, j = ex[c] + 1, ey[c] + 1
        count.update(links)
        docs.append((k, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (p, q), n in count.items():
        most[q] = max(most.get(q, 0), n)
    return [(k, n, m, g, len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), h) for k, n, m, g, ls, h in docs], count, {x: len({k for k, *_, ls, _ in docs if x in ls}) for x in count}


def some_rows(n=150):
    rng = random.Random(5)
    letters = list("abcXYZ  \n\t'stm,.!éß×²\xa012") + ["<|endoftext|>", "'ll", " é", "  ", "the ", "in "]
    return list(enumerate(ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)] + ["the cat and the hat " * 40]))


def test_words_give_what_whole_texts_give():
    one, texts = token_alignment.Aligner(A, B), [t for _, t in some_rows(400) if t]
    one.room = 20000  # for some
    for k in range(0, len(texts), 100):
        for t, got in zip(texts[k : k + 100], one.align(texts[k : k + 100]), strict=True):
            whole = one.library(t)
            assert (got is None) == (whole is None), repr(t)
            if got:
                assert got[:4] == (whole[0] & (1 << 40) - 1, whole[0] >> 40 & (1 << 40) - 1, whole[0] >> 80, hashlib.sha256(whole[1]).hexdigest()) and got[4] == whole[2], repr(t)


@pytest.mark.parametrize("docs_limit,postings_limit", [(1 << 16, 1 << 22), (17, 1 << 22), (1 << 16, 500)])
def test_against_the_plain_version(spark, docs_limit, postings_limit):
    rows = some_rows() + [(9000, "many words " * 20000)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, pair string, block int").repartition(3)
    got, pairs = token_alignment.align_tokens(docs, A, B, block_docs=docs_limit, block_postings=postings_limit)
    expected, count, docs_of = plain(rows)
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    table = {(r.a, r.b): (r.n_links, r.n_docs) for r in pairs.collect()}
    assert table == {x: (n, docs_of[x]) for x, n in count.items()}


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(None, "a b c")] * 30 + [(1, "a b c")] * 3 + [(1, "d é")]
    got, _ = token_alignment.align_tokens(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    expected = plain(rows)[0]
    assert Counter(map(tuple, got.collect())) == Counter(expected)
    for texts in ([], [None, ""]):
        none = token_alignment.align_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B)
        assert none[0].count() == len(texts) and none[1].count() == 0


def test_bitmaps_hold_and_count_multiplicities():
    rng = np.random.default_rng(3)
    both = np.unique(np.stack([rng.integers(0, 40, 3000), rng.integers(0, 5000, 3000)], 1), axis=0)
    times = rng.integers(1, 40, len(both))
    times[rng.integers(0, len(both), 5)] = 1 << 33
    pair, words, planes = token_alignment.bitmaps(both[:, 0], both[:, 1], times)
    assert pair.tolist() == sorted(set(both[:, 0].tolist()))
    docs, links = token_alignment.counted(words, planes)
    for k, p in enumerate(pair):
        mine = both[:, 0] == p
        assert docs[k] == mine.sum() and links[k] == times[mine].sum()
    part = words.slice(7, 20), planes.slice(7, 20)
    back = {(int(pair[7:27][r]), int(x)): int(n) for rows, places, many in token_alignment.postings(*part) for r, x, n in zip(rows, places, many)}
    inner = (both[:, 0] >= pair[7]) & (both[:, 0] <= pair[26])
    assert back == {(int(p), int(x)): int(n) for (p, x), n in zip(both[inner], times[inner])}
    assert token_alignment.counted(pa.array([], pa.binary()), pa.array([], pa.binary()))[0].size == 0


def test_registered_query(spark):
    got = registry.QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", "string")]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows)[0])
