"""Token files: round trip, order, and what a reader passes over."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc
import pytest
from tokenizers import Tokenizer

from tallybridge.llm import _tokens, token_files
from tallybridge.llm._tokens import byte_level_encoder

BYTE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a\n\n b", "a  b   c ", " x", "it's I'LL don't", "<|endoftext|>x", "x²½ 12 345", "é É ß", "tab\there", "\x1c\x85 y", "\xa0z", "中文 İ", "", "\r\n \n", "word" * 50, None, "the same", "the same"]


def expected(rows):
    """(doc_id, start, n_tokens, crc) of (doc_id, text) rows whose ids differ, by the library."""
    library, at, out = Tokenizer.from_file(BYTE), 0, []
    for k, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_encoder_equals_the_library():
    library, rng = Tokenizer.from_file(BYTE), random.Random(8)
    letters = list("abcXYZ  \n\n\t'stm,.!?éßÀ×÷µª²¼\xa01290<|>") + ["<|endoftext|>", "'ll", " é", "  ", "\r\n"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    encoder = byte_level_encoder(BYTE)
    expected = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [t for t, x in zip(texts, expected) if encoder.ids(t) != x] == []
    encoder.spaced.clear()
    encoder.spaced.room = 3000  # no room for most
    assert [*map(encoder.ids, texts)] == expected


def test_new_words_are_encoded_together(monkeypatch):
    library, rng = Tokenizer.from_file(BYTE), random.Random(9)
    word = lambda: "".join(rng.choice("abcdeéßÀµª") for _ in range(rng.randint(1, 70)))
    joint = [" ", "  ", ", ", ".\n", "\n", "'s ", "! ", "\xa0", "?! ", "-"]
    texts = ["".join(word() + rng.choice(joint) for _ in range(300)) for _ in range(20)] + [t or "" for t in ODD]
    expected = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for room, apart, chars in [(None, True, 1 << 20), (3000, True, 9000), (0, True, 1), (3000, False, 9000)]:
        monkeypatch.setattr(_tokens, "TEXT_CHARS", chars)
        encoder = _tokens.ByteLevelEncoder(BYTE)
        assert encoder.apart
        encoder.apart = apart
        encoder.spaced.room = encoder.pieces.room = encoder.spaced.room if room is None else room
        calls, model = [], encoder._model
        encoder._model = lambda text: calls.append(text) or model(text)
        assert [*encoder.all_ids(texts)] == expected and [*encoder.all_ids(texts)] == expected
        assert not encoder.spaced.new and not encoder.pieces.new
        if room is None:
            assert len(calls) < 600 and len(encoder.spaced) + len(encoder.pieces) > 3000


@pytest.mark.parametrize("files", [1, 3])
def test_round_trip(spark, tmp_path, files):
    rows = [(900 - 7 * k, t) for k, t in enumerate(ODD)] + [(-5, "long text, " * 30000)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, part int, ids string").repartition(3)
    token_files.write_tokens(docs, str(tmp_path / "t"), BYTE, files=files)
    got = token_files.checksums(token_files.read_tokens(spark, str(tmp_path / "t"))).collect()
    assert sorted(map(tuple, got)) == expected(rows)
    written = sorted((tmp_path / "t").glob("*.orc"))
    ids = [x for f in written for x in pyarrow.orc.ORCFile(str(f)).read(["doc_id"])["doc_id"].to_pylist()]
    assert ids == sorted(k for k, _ in rows)  # files by name hold documents in order
    some = token_files.read_tokens(spark, str(tmp_path / "t"), [900, -5, 1]).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in some) == [x[:3] for x in expected(rows) if x[0] in (900, -5)]


def test_repeats_and_null_ids_spread_and_stay_gapless(spark, tmp_path):
    docs = spark.createDataFrame([(None, "no id")] * 300 + [(7, "again")] * 300 + [(8, "one"), (8, "two")], "doc_id long, text string")
    token_files.write_tokens(docs, str(tmp_path / "t"), BYTE, files=4)
    got = sorted(((r.start, r.n_tokens, r.doc_id) for r in token_files.checksums(token_files.read_tokens(spark, str(tmp_path / "t"))).collect()))
    assert len(got) == 602 and all(x[0] + x[1] == y[0] for x, y in zip(got, got[1:])) and got[0][0] == 0
    assert [x[2] for x in got] == [None] * 300 + [7] * 300 + [8] * 2
    sizes = [r["count"] for r in spark.read.orc(str(tmp_path / "t")).groupBy("part").count().collect()]
    assert max(sizes) <= 250


def test_empty_table(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), BYTE)
    assert token_files.read_tokens(spark, str(tmp_path / "t")).count() == 0


def rows_read(df):
    """Rows that the scan of a plan gave out when it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan
    while leaf.children().size():
        leaf = leaf.children().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_stripes_and_pruning(spark, tmp_path):
    docs = spark.range(0, 40000, 2).selectExpr("id AS doc_id", "concat('number ', hex(id * 77777), ' and ', sha2(string(id), 512)) AS text")
    token_files.write_tokens(docs, str(tmp_path / "t"), BYTE, files=2, stripe_bytes=128 << 10)
    files = [pyarrow.orc.ORCFile(str(f)) for f in sorted((tmp_path / "t").glob("*.orc"))]
    assert all(f.nstripes > 2 for f in files) and sum(f.nrows for f in files) == 20000
    first = files[0].read_stripe(0, ["doc_id"]).column(0).to_pylist()
    assert first == list(range(0, 2 * len(first), 2))
    with_filter = spark.read.orc(str(tmp_path / "t")).where("doc_id = 10002").select("n_tokens").coalesce(1)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,10002)]" in with_filter._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = spark.read.orc(str(tmp_path / "t"))
        assert 0 < rows_read(read.where("doc_id = 10002").select("n_tokens")) <= 1000  # one row group by its bounds
        absent = [rows_read(read.where(f"doc_id = {k}").select("n_tokens")) for k in range(10001, 10401, 20)]
        assert absent.count(0) >= 17  # within the bounds of a row group, ruled out by its Bloom filter
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    plain = read.where("doc_id = 10002").count(), read.where("doc_id = 10003").count()
    assert plain == (1, 0)
